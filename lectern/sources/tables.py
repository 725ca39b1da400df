"""Parquet tables and the course relations that are plain projections of them.

Every expression in RELATIONS is valid in Spark SQL and in DuckDB, so that the
same text defines the relation for a query and for its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: relation: (source table, {column: expression})
RELATIONS: dict[str, tuple[str, dict[str, str]]] = {
    "f_course": (
        "region",
        {
            "id": "cast(r_regionkey as bigint)",
            "title": "r_name",
            "is_approved": "r_regionkey % 2 = 1",
        },
    ),
    "f_outline": (
        "customer",
        {
            "id": "c_custkey",
            "parent_id": "case when c_custkey < 25 then null else cast(floor(c_custkey / 4) as bigint) end",
            "course_id": "c_custkey % 5",
            "ord": "c_nationkey % 4",
            "title": "c_name",
            "description": "case when c_custkey % 2 = 0 then concat('about ', c_mktsegment) else '' end",
        },
    ),
    "f_material": (
        "orders",
        {
            "id": "o_orderkey",
            "module_node_id": "case when o_orderkey % 100 < 25 and o_orderkey % 2 = 0 then o_orderkey % 100 end",
            "outline_node_id": "o_orderkey % 100",
            "status": "case o_orderstatus when 'F' then 'completed' when 'P' then 'processing' else 'pending' end",
            "created_at": "o_orderdate",
        },
    ),
    "f_object": (
        "documents",
        {
            "id": "doc_id",
            "material_id": "doc_id % 500",
            "kind": "case when doc_id % 7 = 0 then 'image' else 'text' end",
            "title": "source",
            "content": "text",
            "ord": "n_chars % 5",
        },
    ),
    "g_object": (  # f_object after a change: texts with another beginning, and objects of other materials
        "documents",
        {
            "id": "doc_id",
            "material_id": "case when doc_id % 70 = 5 then (doc_id + 1) % 500 else doc_id % 500 end",
            "kind": "case when doc_id % 7 = 0 then 'image' else 'text' end",
            "title": "source",
            "content": "case when doc_id % 50 = 3 then concat('new ', text) else text end",
            "ord": "n_chars % 5",
        },
    ),
    "f_question": (
        "events",
        {
            "id": "event_id",
            "node_id": "event_id % 200",
            "bloom_level": "case event_type when 'view' then 'Remember' when 'click' then 'UNDERSTAND' "
            "when 'purchase' then 'apply' when 'signup' then 'analyze' end",
            "question_format": "case when event_id % 4 = 0 then 'TF' else 'MCQ' end",
            "question_text": "concat('Q', cast(event_id as varchar(20)))",
            "choices": "case event_id % 6 when 1 then '[\"view\",\"click\",\"purchase\",\"signup\",\"error\"]' "
            "when 2 then '{\"A\":\"Error\",\"B\":\"\",\"C\":\" view \"}' when 3 then '[]' "
            "when 4 then '[\"False\",\"True\"]' when 5 then '{}' end",
            "correct_answer": "case event_id % 5 when 0 then ' b ' when 1 then 'TRUE' "
            "when 2 then concat(' ', event_type) when 4 then 'none of these' end",
        },
    ),
    "f_answer": (  # rows of a question sync as they come in over time
        "events",
        {
            "lesson_id": "event_id % 50",
            "question_id": "event_id % 700",
            "bloom_level": "event_type",
            "ord": "user_id % 9",
            "moment": "ts",
        },
    ),
    "f_variant": (
        "labels",
        {
            "id": "doc_id",
            "material_id": "doc_id % 500",
            "variant": "case when toxic = 1 then 'SIMPLIFIED' when quality = 1 then 'Elaborated' else 'audio-only' end",
            "narration": "concat('n', cast(doc_id as varchar(20)))",
            "audio_url": "''",
        },
    ),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = RELATIONS[name]
    return table(spark, sf_dir, source).selectExpr(*(f"{e} as {c}" for c, e in columns.items()))


def relation_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation as a stream of the files that its table has."""
    source, columns = RELATIONS[name]
    rows = spark.readStream.schema(table(spark, sf_dir, source).schema).parquet(f"{sf_dir}/{source}.parquet*")  # a pattern, as a table may be one file
    return rows.selectExpr(*(f"{e} as {c}" for c, e in columns.items()))


def relation_sql(*names: str) -> str:
    """The relations as common table expressions, for an oracle's WITH clause."""
    parts = []
    for name in names:
        source, columns = RELATIONS[name]
        parts.append(f"{name} as (select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source})")
    return ",\n".join(parts)

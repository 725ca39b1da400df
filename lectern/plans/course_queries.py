"""One flat query per course operator, and for each the same result as DuckDB SQL.

State that a merge starts from is derived from the driver tables too: every second
root has a module, inactive for every fourth; the stored questions are those of even
materials, with a stale number, plus links of questions that are no longer fresh.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.choices import answer_label, choice_texts, with_items
from lectern.functions.text import BLOOM_BUCKETS, bloom_bucket, first_filled, node_order
from lectern.operators import lesson_text, lookup, outline, questions, select, snapshot, sync, variants
from lectern.operators.numbering import number_rows
from lectern.operators.snapshot import no_rows
from lectern.plans import course, package, refresh
from lectern.sources.shared import fresh_path, saved
from lectern.sources.tables import relation, relation_sql, relation_stream
from lectern.streaming import keyed_sync

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


@dataclass
class _Relations:
    """t(name): a relation of one set of tables; t.stream(name): the same as a stream."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, name: str) -> DataFrame:
        return relation(self.spark, self.sf_dir, name)

    def stream(self, name: str) -> DataFrame:
        return relation_stream(self.spark, self.sf_dir, name)


def _query(oracle: str, *relations: str):
    """Registers a query with its oracle; the relations become the oracle's common table expressions."""

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, _Relations(spark, sf_dir))

        name = build.__name__.rstrip("_")
        QUERIES[name] = run
        ORACLES[name] = f"with recursive {relation_sql(*relations)}{',' if oracle.lstrip().startswith('+') else ''}\n{oracle.lstrip().removeprefix('+')}"
        return build

    return add


BELOW = """below(root_id, id, depth) as (
  select c.parent_id, c.id, 1 from f_outline c join f_outline r on c.parent_id = r.id where r.parent_id is null
  union all
  select b.root_id, c.id, b.depth + 1 from below b join f_outline c on c.parent_id = b.id
)"""

SOURCES = f"""{BELOW},
root as (select * from f_outline where parent_id is null),
tiers as (
  select r.id as root_id, 1 as tier, 'material' as source_kind, m.id as source_id, m.created_at
  from root r join f_material m on m.module_node_id = r.id where m.status = 'completed'
  union all
  select b.root_id, 2, 'material', m.id, m.created_at
  from below b join f_material m on m.outline_node_id = b.id where m.status = 'completed' and m.module_node_id is null
  union all
  select id, 3, 'outline', id, null from root
),
sources as (select * from tiers qualify rank() over (partition by root_id order by tier) = 1)"""

OLD_MODULES = "old_module as (select id + 1000 as id, id as source_id, id % 4 <> 0 as is_active from f_outline where parent_id is null and id % 2 = 0)"

MODULES = f"""{OLD_MODULES},
new_module as (
  select id, source_id, true as is_active from old_module
  union all
  select (select max(id) from old_module) + row_number() over (order by ord nulls last, id), id, true
  from f_outline where parent_id is null and id not in (select source_id from old_module)
)"""

LESSONS = f"""{SOURCES}, {MODULES},
new_lesson as (
  select row_number() over (order by o.ord nulls last, s.root_id, s.created_at nulls last, s.source_id) as id,
         m.id as module_id, s.source_kind, s.source_id
  from sources s join new_module m on m.source_id = s.root_id join f_outline o on o.id = s.root_id
)"""

PIECES = r"""piece as (
  select o.id, o.material_id, o.ord, regexp_replace(coalesce(o.title, 'None') || chr(10) || coalesce(o.content, 'None'), '^\s+|\s+$', '', 'g') as p
  from f_object o where o.kind = 'text'
)"""

MATERIAL_TEXT = f"""{PIECES},
material_text as (
  select material_id, coalesce(string_agg(p, chr(10) || chr(10) order by ord nulls last, id) filter (where p <> ''), '') as lesson_text
  from piece group by material_id
)"""

NUMBERED = """numbered as (
  select o.material_id, q.id as question_id,
         case lower(coalesce(q.bloom_level, '')) when 'remember' then 'REMEMBER' when 'understand' then 'UNDERSTAND' else 'ANALYZE' end as bloom_level,
         row_number() over (partition by o.material_id order by o.ord nulls last, q.id) as ord
  from f_question q join f_object o on o.id = q.node_id where o.kind = 'text'
)"""

#: Kind, elements (or values of A to D) of each question's choices, for the oracles.
CHOICES = r"""choice as (
  select id, question_format, regexp_replace(coalesce(correct_answer, ''), '^\s+|\s+$', '', 'g') as answer,
         coalesce(choices like '{"%', false) as is_map,
         case when choices like '[%' then from_json(choices, '["VARCHAR"]')
              when choices like '{"%' then [coalesce(json_extract_string(choices, '$.A'), ''), coalesce(json_extract_string(choices, '$.B'), ''),
                                            coalesce(json_extract_string(choices, '$.C'), ''), coalesce(json_extract_string(choices, '$.D'), '')]
              else [] end as items
  from f_question
),
labelled as (
  select *, case when upper(answer) in ('A', 'B', 'C', 'D') then upper(answer)
                 when question_format = 'TF' and lower(answer) = 'true' then 'A'
                 when question_format = 'TF' and lower(answer) = 'false' then 'B'
                 else coalesce(['A', 'B', 'C', 'D'][nullif(list_position(list_transform(items[1:4], lambda x: lower(trim(x))), lower(answer)), 0)], answer) end as label,
            case when is_map then list_filter(items, lambda x: x <> '')
                 when question_format = 'TF' and len(items) = 0 then ['True', 'False']
                 else items[1:4] end as texts
  from choice
)"""

OLD_LINKS = """old_link as (
  select row_number() over (order by material_id, question_id) as id, material_id as lesson_id, question_id, 'APPLY' as bloom_level, ord + 100 as ord
  from numbered where material_id % 2 = 0
  union all
  select 1000000 + id, 7, id, 'REMEMBER', 1 from f_question where id % 97 = 0 and id not in (select question_id from numbered where material_id = 7)
)"""

LINKS = f"""{NUMBERED}, {OLD_LINKS},
new_link as (
  select o.id, o.lesson_id, o.question_id, coalesce(n.bloom_level, o.bloom_level) as bloom_level, coalesce(n.ord, o.ord) as ord
  from old_link o left join numbered n on n.material_id = o.lesson_id and n.question_id = o.question_id
  union all
  select (select max(id) from old_link) + row_number() over (order by n.material_id, n.ord, n.question_id), n.material_id, n.question_id, n.bloom_level, n.ord
  from numbered n where not exists (select 1 from old_link o where o.lesson_id = n.material_id and o.question_id = n.question_id)
)"""

SAVED = "saved as (select material_id as lesson_id, lower(variant) as variant, id, narration, audio_url from f_variant qualify row_number() over (partition by material_id, lower(variant) order by id desc) = 1)"

SPINE = f"""{MATERIAL_TEXT}, {SAVED},
spine as (
  select t.material_id as lesson_id, k.variant, case when s.id is not null then s.narration else t.lesson_text end as text, coalesce(s.audio_url, '') as audio_url
  from material_text t cross join (values ('normal'), ('elaborated'), ('simplified')) k(variant)
  left join saved s on s.lesson_id = t.material_id and s.variant = k.variant
)"""


def _old_modules(t) -> DataFrame:
    r = outline.roots(t("f_outline")).where("id % 2 = 0")
    return r.select((F.col("id") + 1000).alias("id"), F.col("id").alias("source_id"), (F.col("id") % 4 != 0).alias("is_active"))


def _modules(t) -> DataFrame:
    return sync.sync_modules(_old_modules(t), t("f_outline"))


_NO_LESSONS = "id bigint, module_id bigint, source_kind string, source_id bigint"


def _lessons(spark, t, modules: DataFrame | None = None) -> DataFrame:
    return sync.sync_lessons(spark, no_rows(spark, _NO_LESSONS), modules or saved(_modules(t), "modules"), t("f_outline"), t("f_material"))


def _fresh(t) -> DataFrame:
    return questions.material_questions(t("f_object"), t("f_question")).withColumnRenamed("material_id", "lesson_id")


def _old_links(t) -> DataFrame:
    fresh = _fresh(t)
    stored = number_rows(fresh.where("lesson_id % 2 = 0"), [F.col("lesson_id"), F.col("question_id")], "id")
    stored = stored.select("id", "lesson_id", "question_id", F.lit("APPLY").alias("bloom_level"), (F.col("ord") + 100).alias("ord"))
    seven = fresh.where("lesson_id = 7").select(F.col("question_id").alias("id"))
    stale = t("f_question").where("id % 97 = 0").join(seven, "id", "left_anti")
    return stored.unionByName(
        stale.select((F.col("id") + 1000000).alias("id"), F.lit(7).cast("bigint").alias("lesson_id"), F.col("id").alias("question_id"), F.lit("REMEMBER").alias("bloom_level"), F.lit(1).cast("bigint").alias("ord"))
    )


def _links(t) -> DataFrame:
    return sync.sync_questions(_old_links(t), _fresh(t))


@_query("select id, outline_node_id, created_at from f_material where status = 'completed'", "f_material")
def scan_completed_materials(spark, t):
    return outline.completed(t("f_material")).select("id", "outline_node_id", "created_at")


@_query("select id, ord, title from f_outline where parent_id is null", "f_outline")
def outline_roots(spark, t):
    return outline.roots(t("f_outline")).select("id", "ord", "title")


@_query(f"+{BELOW} select root_id, id, depth from below", "f_outline")
def outline_descendants(spark, t):
    return outline.descendants(spark, t("f_outline"))


@_query(
    """+walk(root_id, id, depth, path) as (
  select c.parent_id, c.id, 1, [c.ord * 10000000000 + c.id] from f_outline c join f_outline r on c.parent_id = r.id where r.parent_id is null
  union all
  select b.root_id, c.id, b.depth + 1, list_append(b.path, c.ord * 10000000000 + c.id) from walk b join f_outline c on c.parent_id = b.id
) select root_id, id, depth, row_number() over (partition by root_id order by path) as position from walk""",
    "f_outline",
)
def outline_preorder_rank(spark, t):
    return outline.preorder(spark, t("f_outline"))


@_query(f"+{SOURCES} select root_id, source_id, created_at from tiers where tier = 1", "f_outline", "f_material")
def module_source_tier1(spark, t):
    return outline.direct_sources(t("f_outline"), t("f_material"))


@_query(f"+{SOURCES} select root_id, source_id, created_at from tiers where tier = 2", "f_outline", "f_material")
def module_source_tier2(spark, t):
    return outline.inherited_sources(spark, t("f_outline"), t("f_material"))


@_query(f"+{SOURCES} select root_id, tier, source_kind, source_id from sources", "f_outline", "f_material")
def module_sources_cascade(spark, t):
    return outline.lesson_sources(spark, t("f_outline"), t("f_material")).drop("created_at")


@_query(
    f"+{OLD_MODULES} select o.id as node_id, m.id as module_id from f_outline o left join old_module m on m.source_id = o.id",
    "f_outline",
)
def module_lookup_or_null(spark, t):
    m = _old_modules(t).select(F.col("id").alias("module_id"), F.col("source_id").alias("node_id"))
    return lookup.attach_or_null(t("f_outline").select(F.col("id").alias("node_id")), m, "node_id")


@_query(f"+{MODULES} select id, source_id, is_active from new_module", "f_outline")
def sync_modules(spark, t):
    return _modules(t)


@_query(f"+{LESSONS} select id, module_id, source_kind, source_id from new_lesson", "f_outline", "f_material")
def sync_lessons(spark, t):
    return _lessons(spark, t)


@_query(
    f"+{MODULES} select m.id as module_id, o.course_id from new_module m join f_outline o on o.id = m.source_id where m.is_active", "f_outline"
)
def active_modules_of_course(spark, t):
    return sync.active_modules(_modules(t), t("f_outline")).select(F.col("id").alias("module_id"), "course_id")


@_query(
    "select id, case lower(coalesce(bloom_level, '')) when 'remember' then 'remember' when 'understand' then 'understand' else 'analyze' end as bucket from f_question",
    "f_question",
)
def bloom_bucket_(spark, t):
    return t("f_question").select("id", bloom_bucket(F.col("bloom_level")).alias("bucket"))


@_query(f"+{CHOICES} select id, label from labelled", "f_question")
def answer_label_(spark, t):
    label = answer_label(F.col("correct_answer"), F.col("choices"), F.col("question_format"), F.col("_parsed"))
    return with_items(t("f_question")).select("id", label.alias("label"))


@_query(
    f"+{CHOICES} select id, cast(generate_subscripts(texts, 1) as bigint) as position, unnest(texts) as text from labelled", "f_question"
)
def choice_texts_(spark, t):
    texts = choice_texts(F.col("choices"), F.col("question_format"), F.col("_parsed"))
    rows = with_items(t("f_question")).select("id", F.posexplode(texts).alias("position", "text"))
    return rows.withColumn("position", F.col("position").cast("bigint") + 1)


@_query(f"+{MATERIAL_TEXT} select material_id, lesson_text from material_text", "f_object")
def lesson_text_material(spark, t):
    return lesson_text.material_text(t("f_object"))


@_query(
    f"""+{PIECES} select m.outline_node_id as node_id,
  coalesce(string_agg(p, chr(10) || chr(10) order by material_id, ord nulls last, piece.id) filter (where p <> ''), '') as lesson_text
from piece join f_material m on m.id = piece.material_id where m.status = 'completed' group by 1""",
    "f_object",
    "f_material",
)
def lesson_text_outline(spark, t):
    return lesson_text.outline_text(t("f_object"), t("f_material"))


@_query(
    f"""+{MATERIAL_TEXT} select o.id, coalesce(nullif(x.lesson_text, ''), nullif(o.description, ''), o.title) as lesson_text
from f_outline o left join material_text x on x.material_id = o.id""",
    "f_object",
    "f_outline",
)
def lesson_text_fallback(spark, t):
    texts = lesson_text.material_text(t("f_object")).withColumnRenamed("material_id", "id")
    filled = first_filled(F.col("lesson_text"), F.col("description"), F.col("title"))
    return t("f_outline").join(texts, "id", "left").select("id", filled.alias("lesson_text"))


@_query(f"+{NUMBERED} select material_id, question_id, bloom_level, ord from numbered", "f_object", "f_question")
def lesson_questions_numbered(spark, t):
    return questions.material_questions(t("f_object"), t("f_question"))


@_query(
    """select m.outline_node_id, q.id as question_id,
  case lower(coalesce(q.bloom_level, '')) when 'remember' then 'REMEMBER' when 'understand' then 'UNDERSTAND' else 'ANALYZE' end as bloom_level,
  row_number() over (partition by m.outline_node_id order by o.ord nulls last, q.id) as ord
from f_question q join f_object o on o.id = q.node_id join f_material m on m.id = o.material_id where o.kind = 'text'""",
    "f_object",
    "f_question",
    "f_material",
)
def lesson_questions_outline(spark, t):
    return questions.outline_questions(t("f_object"), t("f_question"), t("f_material"))


@_query(f"+{LINKS} select id, lesson_id, question_id, bloom_level, ord from new_link", "f_object", "f_question")
def module_question_upsert(spark, t):
    return _links(t)


@_query(f"+{SAVED} select lesson_id, variant, id, narration, audio_url from saved", "f_variant")
def variant_last_wins(spark, t):
    return variants.saved_variants(t("f_variant").withColumnRenamed("material_id", "lesson_id"))


@_query(f"+{SPINE} select lesson_id, variant, text, audio_url from spine", "f_object", "f_variant")
def variant_spine(spark, t):
    texts = lesson_text.material_text(t("f_object")).withColumnRenamed("material_id", "lesson_id")
    return variants.variant_spine(texts, t("f_variant").withColumnRenamed("material_id", "lesson_id"))


@_query(
    f"""+{LINKS}, lesson as (select distinct material_id as lesson_id from f_object),
bucket as (select lesson_id, b from lesson cross join (values ('remember'), ('understand'), ('analyze')) v(b) union select lesson_id, lower(bloom_level) from new_link where lesson_id in (select lesson_id from lesson))
select b.lesson_id, b.b as bucket, count(n.id) as n_questions,
  coalesce(string_agg(cast(n.question_id as varchar), ',' order by n.ord, n.id), '') as question_ids
from bucket b left join new_link n on n.lesson_id = b.lesson_id and lower(n.bloom_level) = b.b group by 1, 2""",
    "f_object",
    "f_question",
)
def questions_by_bucket(spark, t):
    lessons = t("f_object").select(F.col("material_id").alias("lesson_id")).distinct()
    links = _links(t).where("bloom_level is not null").select("lesson_id", F.lower("bloom_level").alias("bucket"), "id", "ord", "question_id")
    ranked = F.array_sort(F.collect_list(F.struct(F.col("ord").isNull(), "ord", "id", "question_id")))
    ids = F.concat_ws(",", F.transform(ranked, lambda r: r["question_id"].cast("string")))
    lists = links.groupBy("lesson_id", "bucket").agg(F.count(F.lit(1)).alias("n_questions"), ids.alias("question_ids"))
    spine = lessons.withColumn("bucket", F.explode(F.array(*map(F.lit, BLOOM_BUCKETS)))).unionByName(lists.select("lesson_id", "bucket").join(lessons, "lesson_id", "left_semi")).distinct()
    return spine.join(lists, ["lesson_id", "bucket"], "left").select("lesson_id", "bucket", F.coalesce("n_questions", F.lit(0)).alias("n_questions"), F.coalesce("question_ids", F.lit("")).alias("question_ids"))


@_query("select id, case when coalesce(ord, 0) <> 0 then cast(ord as bigint) else id end as node_order from f_outline", "f_outline")
def node_order_fallback(spark, t):
    return t("f_outline").select("id", node_order(F.col("ord"), F.col("id")).alias("node_order"))


@_query("select id, title from f_course where is_approved order by id limit 1", "f_course")
def first_approved_course(spark, t):
    return select.first_approved_course(t("f_course")).select("id", "title")


@_query(
    f"""+{MODULES} select o.course_id, m.id as module_id from new_module m join f_outline o on o.id = m.source_id where m.is_active
qualify row_number() over (partition by o.course_id order by o.ord nulls last, o.id) = 1""",
    "f_outline",
)
def first_active_module(spark, t):
    return select.first_active_modules(_modules(t), t("f_outline")).select("course_id", F.col("id").alias("module_id"))


@_query(
    f"""+{LESSONS},
course as (select id as course_id from f_course where is_approved order by id limit 1),
module as (select m.id as module_id, o.course_id from new_module m join f_outline o on o.id = m.source_id join course c on c.course_id = o.course_id
  where m.is_active order by o.ord nulls last, o.id limit 1)
select m.course_id, l.module_id, l.id as lesson_id, l.source_kind, l.source_id
from new_lesson l join module m on m.module_id = l.module_id left join f_outline o on l.source_kind = 'outline' and o.id = l.source_id
order by o.ord nulls last, l.id limit 1""",
    "f_outline",
    "f_material",
    "f_course",
)
def first_lesson(spark, t):
    modules = saved(_modules(t), "modules")
    return select.first_lesson(t("f_course"), modules, _lessons(spark, t, modules), t("f_outline"))


@dataclass
class _Synced:
    """Modules and lessons after a sync, with what packages add to them."""

    lessons: DataFrame
    modules: DataFrame


def _synced(spark, t) -> _Synced:
    modules = saved(_modules(t), "modules")
    titled = modules.join(t("f_outline").select(F.col("id").alias("source_id"), "title", F.col("ord").alias("sequence_order")), "source_id")
    return _Synced(course.titled(saved(_lessons(spark, t, modules), "lessons")), titled)


def _stored_questions(spark, t, lessons: DataFrame) -> DataFrame:
    fresh = questions.fresh_questions(lessons, t("f_object"), t("f_question"), t("f_material"))
    return sync.sync_questions(no_rows(spark, course.MODULE_QUESTIONS), fresh)


def _lesson_variants(t, lessons: DataFrame) -> DataFrame:
    lesson_of = lessons.where("source_kind = 'material'").select(F.col("source_id").alias("material_id"), F.col("id").alias("lesson_id"))
    return t("f_variant").join(lesson_of, "material_id")


def _packages(spark, t) -> DataFrame:
    x = _synced(spark, t)
    return package.packages(
        x.lessons, x.modules, t("f_outline"), t("f_material"), t("f_object"), t("f_question"), _stored_questions(spark, t, x.lessons), _lesson_variants(t, x.lessons)
    )


def nested_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one nested package per lesson."""
    return _packages(spark, _Relations(spark, sf_dir))


PACKAGE = f"""{LESSONS}, {MATERIAL_TEXT}, {NUMBERED},
lesson as (select *, 'Lesson ' || cast(id as varchar) as title from new_lesson),
node_text as (
  select m.outline_node_id as node_id, coalesce(string_agg(p, chr(10) || chr(10) order by material_id, ord nulls last, piece.id) filter (where p <> ''), '') as lesson_text
  from piece join f_material m on m.id = piece.material_id where m.status = 'completed' group by 1
),
lesson_txt as (
  select l.id as lesson_id, coalesce(nullif(coalesce(x.lesson_text, n.lesson_text), ''), nullif(o.description, ''), l.title) as lesson_text
  from lesson l left join material_text x on l.source_kind = 'material' and x.material_id = l.source_id
  left join node_text n on l.source_kind = 'outline' and n.node_id = l.source_id
  left join f_outline o on l.source_kind = 'outline' and o.id = l.source_id
),
by_node as (
  select m.outline_node_id as node_id, q.id as question_id,
    case lower(coalesce(q.bloom_level, '')) when 'remember' then 'REMEMBER' when 'understand' then 'UNDERSTAND' else 'ANALYZE' end as bloom_level,
    row_number() over (partition by m.outline_node_id order by o.ord nulls last, q.id) as ord
  from f_question q join f_object o on o.id = q.node_id join f_material m on m.id = o.material_id where o.kind = 'text'
),
link as (
  select l.id as lesson_id, n.question_id, n.bloom_level, n.ord from lesson l join numbered n on l.source_kind = 'material' and n.material_id = l.source_id
  union all
  select l.id, n.question_id, n.bloom_level, n.ord from lesson l join by_node n on l.source_kind = 'outline' and n.node_id = l.source_id
)"""

_PACKAGE_TABLES = ("f_outline", "f_material", "f_object", "f_question")


@_query(
    f"""+{PACKAGE}, saved as (
  select l.id as lesson_id, lower(v.variant) as variant, v.id, v.narration, v.audio_url
  from lesson l join f_variant v on l.source_kind = 'material' and v.material_id = l.source_id
  qualify row_number() over (partition by l.id, lower(v.variant) order by v.id desc) = 1
)
select t.lesson_id, k.variant, case when s.id is not null then s.narration else t.lesson_text end as text, coalesce(s.audio_url, '') as audio_url
from lesson_txt t cross join (values ('normal'), ('elaborated'), ('simplified')) k(variant)
left join saved s on s.lesson_id = t.lesson_id and s.variant = k.variant""",
    *_PACKAGE_TABLES,
    "f_variant",
)
def package_flat_variants(spark, t):
    lessons = _synced(spark, t).lessons
    texts = lesson_text.lesson_texts(lessons, t("f_object"), t("f_material"), t("f_outline"))
    return variants.variant_spine(texts, _lesson_variants(t, lessons))


@_query(
    f"""+{PACKAGE}, {CHOICES}
select k.lesson_id, k.question_id as id, k.ord, lower(k.bloom_level) as bloom_level, q.question_text as question,
  array_to_string(c.texts, '|') as choices, c.label as correct_answer
from link k join f_question q on q.id = k.question_id join labelled c on c.id = k.question_id""",
    *_PACKAGE_TABLES,
)
def package_flat_questions(spark, t):
    cards = questions.question_cards(_stored_questions(spark, t, _synced(spark, t).lessons), t("f_question"))
    shown = cards.withColumn("choices", F.concat_ws("|", "choices"))
    return shown.select("lesson_id", F.col("question_id").alias("id"), "ord", F.col("bucket").alias("bloom_level"), "question", "choices", "correct_answer")


@_query(
    f"""+{LESSONS} select l.id as lesson_id, 'Lesson ' || cast(l.id as varchar) as lesson_title,
  case when coalesce(o.ord, 0) <> 0 then cast(o.ord as bigint) else l.id end as node_order, l.module_id, r.title as module_title, r.ord as sequence_order
from new_lesson l join new_module m on m.id = l.module_id join f_outline r on r.id = m.source_id
left join f_outline o on l.source_kind = 'outline' and o.id = l.source_id""",
    "f_outline",
    "f_material",
)
def package_header(spark, t):
    x = _synced(spark, t)
    return package.package_headers(x.lessons, x.modules, t("f_outline"))


@_query(
    f"""+{PACKAGE}, {CHOICES}
select k.lesson_id, lower(k.bloom_level) as bucket, k.question_id as id, q.question_text as question, array_to_string(c.texts, '|') as choices
from link k join f_question q on q.id = k.question_id join labelled c on c.id = k.question_id""",
    *_PACKAGE_TABLES,
)
def serialized_questions(spark, t):
    shown = package.without_answers(_packages(spark, t))
    rows = shown.select(F.col("id").alias("lesson_id"), F.explode("questions").alias("bucket", "cards"))
    rows = rows.select("lesson_id", "bucket", F.explode("cards").alias("c"))
    return rows.select("lesson_id", "bucket", "c.id", "c.question", F.concat_ws("|", "c.choices").alias("choices"))


@_query(
    f"+{LESSONS} select module_id as id, count(*) as n_lessons, min(id) as first_lesson from new_lesson group by 1", "f_outline", "f_material"
)
def module_overview(spark, t):
    modules = package.module_view(package.without_answers(_packages(spark, t)))
    return modules.select("id", F.size("lesson_nodes").cast("bigint").alias("n_lessons"), F.col("lesson_nodes")[0]["id"].alias("first_lesson"))


@_query("select id, title, course_id from f_outline where id = 30", "f_outline")
def unique_fetch(spark, t):
    return lookup.by_key(t("f_outline"), "id", 30, strict=True).select("id", "title", "course_id")


@_query(
    f"+{LESSONS} select 'module' as kind, id, source_id from new_module union all select 'lesson', id, source_id from new_lesson", "f_outline", "f_material"
)
def snapshot_commit(spark, t):
    """Modules and lessons written as one version, as a reader finds them."""
    root = fresh_path(spark, "state")
    modules = saved(_modules(t), "modules")
    snapshot.write_snapshot(spark, root, {"modules": modules, "lessons": _lessons(spark, t, modules)})
    kinds = {"module": "modules", "lesson": "lessons"}
    rows = [snapshot.read_snapshot(spark, root, name).select(F.lit(kind).alias("kind"), "id", "source_id") for kind, name in kinds.items()]
    return rows[0].unionByName(rows[1])


@_query(
    f"""+{LESSONS} select l.id as lesson_id, 'Lesson ' || cast(l.id as varchar) as lesson_title, r.title as module_title, l.module_id
from new_lesson l join new_module m on m.id = l.module_id join f_outline r on r.id = m.source_id""",
    "f_outline",
    "f_material",
)
def package_document(spark, t):
    """What a client reads from the JSON documents of the nested packages."""
    at = lambda path: F.get_json_object("document", f"$.{path}")
    documents = package.as_json(_packages(spark, t))
    return documents.select("lesson_id", at("lesson_node.title").alias("lesson_title"), at("module.title").alias("module_title"), at("module.id").cast("bigint").alias("module_id"))


@_query(f"+{LESSONS} select module_id as id, string_agg(cast(id as varchar), ',' order by id) as lesson_ids from new_lesson group by 1", "f_outline", "f_material")
def module_lesson_order(spark, t):
    """The lessons of each module in the order that a learner sees."""
    modules = package.module_view(package.without_answers(_packages(spark, t)))
    return modules.select("id", F.concat_ws(",", F.transform("lesson_nodes", lambda n: n["id"].cast("string"))).alias("lesson_ids"))


def _store(spark, t) -> course.Course:
    """A course store with empty state."""
    none = no_rows(spark, "id bigint, lesson_id bigint, variant string, narration string, audio_url string")
    return course.Course(fresh_path(spark, "state"), t("f_course"), t("f_outline"), t("f_material"), t("f_object"), t("f_question"), none)


def _course_ids(t) -> list[int]:
    """Courses are called one by one, as a client would; they are few, whatever the size of their tables."""
    return [r.id for r in t("f_course").select("id").orderBy("id").collect()]


#: Ids as calls give them that sync one course after the other, by course id.
CALLED = f"""{SOURCES},
called_module as (
  select row_number() over (order by course_id, ord nulls last, id) as id, id as source_id, course_id, ord from root where course_id in (select id from f_course)
),
called_lesson as (
  select row_number() over (order by m.course_id, m.ord nulls last, s.root_id, s.created_at nulls last, s.source_id) as id, m.id as module_id, m.course_id, s.source_kind, s.source_id
  from sources s join called_module m on m.source_id = s.root_id
),
called_first as (
  select l.* from called_lesson l join (select * from called_module qualify row_number() over (partition by course_id order by ord nulls last, source_id) = 1) m on m.id = l.module_id
  left join f_outline o on l.source_kind = 'outline' and o.id = l.source_id
  qualify row_number() over (partition by l.course_id order by o.ord nulls last, l.id) = 1
)"""


@_query(
    f"""+{CALLED}
select 'module' as kind, id, 'outline' as source_kind, source_id, id as module_id from called_module
union all select 'lesson', id, source_kind, source_id, module_id from called_lesson""",
    "f_course",
    "f_outline",
    "f_material",
)
def sync_course_call(spark, t):
    """Modules and lessons after each course has been brought up to date by a call of its own."""
    store = _store(spark, t)
    for c in _course_ids(t):
        course.sync_course_outline(spark, store, c)
    state = snapshot.current(spark, store.root)
    modules = state.rows(course.MODULES).select(F.lit("module").alias("kind"), "id", F.lit("outline").alias("source_kind"), "source_id", F.col("id").alias("module_id"))
    return modules.unionByName(state.rows(course.LESSONS).select(F.lit("lesson").alias("kind"), "id", "source_kind", "source_id", "module_id"))


@_query(f"+{CALLED} select course_id, module_id, id as lesson_id, source_kind, source_id from called_first", "f_course", "f_outline", "f_material")
def first_lesson_call(spark, t):
    """The lesson that each course begins with, asked for by a call for each course."""
    store = _store(spark, t)
    found = [saved(course.first_lesson_node(spark, store, c), "first") for c in _course_ids(t)]  # a row each
    return reduce(DataFrame.unionByName, found)


@_query(
    f"""+{CALLED}, {MATERIAL_TEXT}, {NUMBERED}, {CHOICES},
saved as (select material_id, lower(variant) as variant, id, narration, audio_url from f_variant qualify row_number() over (partition by material_id, lower(variant) order by id desc) = 1),
node_text as (
  select m.outline_node_id as node_id, coalesce(string_agg(p, chr(10) || chr(10) order by material_id, ord nulls last, piece.id) filter (where p <> ''), '') as lesson_text
  from piece join f_material m on m.id = piece.material_id where m.status = 'completed' group by 1
),
by_node as (
  select m.outline_node_id as node_id, q.id as question_id,
    case lower(coalesce(q.bloom_level, '')) when 'remember' then 'REMEMBER' when 'understand' then 'UNDERSTAND' else 'ANALYZE' end as bloom_level,
    row_number() over (partition by m.outline_node_id order by o.ord nulls last, q.id) as ord
  from f_question q join f_object o on o.id = q.node_id join f_material m on m.id = o.material_id where o.kind = 'text'
),
asked as (
  select distinct on (course_id) l.* from called_lesson l
  where l.source_kind = 'material' and l.source_id in (select material_id from numbered) or l.source_kind = 'outline' and l.source_id in (select node_id from by_node)
  order by course_id, id
),
called as (select * from called_first union select * from asked),
link as (
  select l.id as lesson_id, n.question_id, n.bloom_level, n.ord from called l join numbered n on l.source_kind = 'material' and n.material_id = l.source_id
  union all
  select l.id, n.question_id, n.bloom_level, n.ord from called l join by_node n on l.source_kind = 'outline' and n.node_id = l.source_id
),
shown as (
  select l.id as lesson_id, l.source_kind, l.source_id, coalesce(nullif(coalesce(x.lesson_text, n.lesson_text), ''), nullif(o.description, ''), 'Lesson ' || cast(l.id as varchar)) as lesson_text
  from called l left join material_text x on l.source_kind = 'material' and x.material_id = l.source_id
  left join node_text n on l.source_kind = 'outline' and n.node_id = l.source_id
  left join f_outline o on l.source_kind = 'outline' and o.id = l.source_id
)
select t.lesson_id, 'variant' as kind, k.variant as key, 0 as ord, case when s.id is not null then s.narration else t.lesson_text end as text, coalesce(s.audio_url, '') as more
from shown t cross join (values ('normal'), ('elaborated'), ('simplified')) k(variant)
left join saved s on t.source_kind = 'material' and s.material_id = t.source_id and s.variant = k.variant
union all
select k.lesson_id, 'question', lower(k.bloom_level), k.ord, q.question_text, array_to_string(c.texts, '|') || '>' || c.label
from link k join f_question q on q.id = k.question_id join labelled c on c.id = k.question_id""",
    "f_course",
    *_PACKAGE_TABLES,
    "f_variant",
)
def build_package_call(spark, t):
    """Variants and questions of the packages of each course's first lesson, and of its first one that has a question, each built by a call of its own."""
    store = _store(spark, t)
    firsts = [course.first_lesson_node(spark, store, c).first() for c in _course_ids(t)]
    state = snapshot.current(spark, store.root)
    lessons = state.rows(course.LESSONS)
    store.variants = saved(_lesson_variants(t, lessons), "variants")  # joined once; a call reads its lesson's rows
    of_course = sync.active_modules(state.rows(course.MODULES), t("f_outline")).select(F.col("id").alias("module_id"), "course_id")
    asked = questions.fresh_questions(lessons, t("f_object"), t("f_question"), t("f_material")).select(F.col("lesson_id").alias("id"))
    asked = lessons.join(asked, "id", "left_semi").join(of_course, "module_id").groupBy("course_id").agg(F.min("id").alias("id"))  # a row a course
    rows = []
    for lesson_id in sorted({f.lesson_id for f in firsts if f} | {r.id for r in asked.collect()}):
        package_ = course.build_package(spark, store, lesson_id).select(F.col("lesson_node.id").alias("lesson_id"), "variants", "questions")
        package_ = saved(package_, "package")  # a row; else the plans of all packages would be one
        variant = package_.select("lesson_id", F.explode("variants").alias("key", "v"))
        rows.append(variant.select("lesson_id", F.lit("variant").alias("kind"), "key", F.lit(0).cast("bigint").alias("ord"), "v.text", F.col("v.audio_url").alias("more")))
        card = package_.select("lesson_id", F.explode("questions").alias("key", "cards")).select("lesson_id", "key", F.explode("cards").alias("c"))
        more = F.concat(F.concat_ws("|", "c.choices"), F.lit(">"), "c.correct_answer")
        rows.append(card.select("lesson_id", F.lit("question").alias("kind"), "key", F.col("c.order").alias("ord"), F.col("c.question").alias("text"), more.alias("more")))
    return reduce(DataFrame.unionByName, rows)


@_query(
    f"""+{PACKAGE.replace("f_object", "g_object")}, saved as (
  select l.id as lesson_id, lower(v.variant) as variant, v.id, v.narration, v.audio_url
  from lesson l join f_variant v on l.source_kind = 'material' and v.material_id = l.source_id
  qualify row_number() over (partition by l.id, lower(v.variant) order by v.id desc) = 1
)
select t.lesson_id, k.variant, case when s.id is not null then s.narration else t.lesson_text end as text
from lesson_txt t cross join (values ('normal'), ('elaborated'), ('simplified')) k(variant)
left join saved s on s.lesson_id = t.lesson_id and s.variant = k.variant""",
    "f_outline",
    "f_material",
    "g_object",
    "f_question",
    "f_variant",
)
def package_refresh(spark, t):
    """Variants of all packages after objects have changed: of packages as they were, and of those that the change reaches."""
    x = _synced(spark, t)
    links = saved(_stored_questions(spark, t, x.lessons), "links")
    variant_rows = _lesson_variants(t, x.lessons).select("id", "lesson_id", "variant", "narration", "audio_url")
    before = refresh.Inputs(x.lessons, x.modules, t("f_outline"), t("f_material"), t("f_object"), t("f_question"), links, variant_rows)
    after = replace(before, objects=t("g_object"))
    old = saved(before.packages(), "packages")
    out = refresh.refreshed(old, before, after).select(F.col("lesson_node.id").alias("lesson_id"), F.explode("variants").alias("variant", "v"))
    return out.select("lesson_id", "variant", "v.text")


@_query(
    """+latest as (
  select * from f_answer qualify row_number() over (partition by lesson_id, question_id order by moment desc, ord desc nulls last, bloom_level desc nulls last) = 1
) select row_number() over (order by lesson_id, question_id) as id, lesson_id, question_id, bloom_level, ord from latest""",
    "f_answer",
)
def stream_question_sync(spark, t):
    """Question rows as a stream: the latest of each (lesson, question), as keyed state has put them into the course state."""
    rows = t.stream("f_answer").withColumn("at", F.col("moment").cast("timestamp"))
    root = fresh_path(spark, "stream")
    keyed_sync.start_sync(rows, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return keyed_sync.stored(spark, f"{root}/state").select("id", "lesson_id", "question_id", "bloom_level", "ord")

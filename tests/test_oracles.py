"""Every course query gives the rows of its SQL in DuckDB."""

import duckdb
import pytest

from lectern.plans import course_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in records)


@pytest.mark.parametrize("name", sorted(course_queries.QUERIES))
def test_query(spark, duck, name):
    df = course_queries.QUERIES[name](spark, DATA)
    got = df.collect()
    want = duck.execute(course_queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    first = __spark_entry__.entry(spark).first()
    assert set(first.variants) == {"normal", "elaborated", "simplified"}
    assert {"remember", "understand", "analyze"} <= set(first.questions)

"""Trees of any depth and width: depth, sizes and pre-order by doubling."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import outline, tree

SCHEMA = "id bigint, parent_id bigint, ord int"


def walked(rows):
    """{id: (root, depth, position)} of all nodes below roots, by a walk with a stack; and {id: size}."""
    children, out, sizes = {}, {}, {}
    for i, parent, o in rows:
        children.setdefault(parent, []).append(((o is None, o or 0), i))
    for _, root in children.get(None, []):
        stack, position, order = [(root, 0)], 0, []
        while stack:
            node, depth = stack.pop()
            order.append(node)
            if depth:
                position += 1
                out[node] = (root, depth, position)
            stack += [(c, depth + 1) for _, c in sorted(children.get(node, []), reverse=True)]
        for node in reversed(order):
            sizes[node] = 1 + sum(sizes[c] for _, c in children.get(node, []))
    return out, sizes


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    want, sizes = walked(rows)
    assert {r.id: (r.root_id, r.depth, r.position) for r in tree.preorder(spark, df, **more).collect()} == want
    got = tree.measured(spark, df, sizes=True).collect()
    assert {r.id: r.size for r in got} == sizes and len(got) == len(sizes)
    assert {r.id: (r.root_id, r.depth) for r in outline.descendants(spark, df).collect()} == {k: v[:2] for k, v in want.items()}


@pytest.mark.parametrize("seed", range(3))
def test_forests(spark, many_parts, seed):
    r = random.Random(seed)
    rows = [(1, None, None), (2, None, 3)]
    for i in range(3, 400):
        rows.append((i, r.choice([r.randrange(1, i), max(1, i - 1), 2]), r.choice([None, 0, 1, 2, -5])))
    r.shuffle(rows)
    check(spark, rows)
    check(spark, rows, most=20)  # children of one node in several ranges


def test_small_forests(spark):
    check(spark, [])
    check(spark, [(1, None, 1)])
    check(spark, [(1, None, 1), (2, 1, None), (3, None, None)])


def test_a_chain_of_5000_nodes(spark):
    rows = [(i, i - 1 if i > 1 else None, i % 3) for i in range(1, 5001)]
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    seeds = df.where("id = 1")
    assert outline.below(spark, df, seeds).agg(F.count("*"), F.max("id")).first()[:] == (4999, 5000)  # too deep to walk level by level
    assert outline.below(spark, df.where("id <= 50"), seeds).count() == 49


def test_a_root_with_very_many_nodes(spark):
    """300,000 children of one root, each 40th with a chain of three below it, without one task for all of them."""
    n = 300_000
    far = F.col("id")
    nodes = spark.range(1, n + 1).select(far, F.lit(0).cast("bigint").alias("parent_id"), (far % 7).cast("int").alias("ord"))
    chain = [spark.range(1, n + 1).where("id % 40 = 0").select((far + k * n).alias("id"), (far + (k - 1) * n).alias("parent_id"), F.lit(1).alias("ord")) for k in (1, 2, 3)]
    top = spark.createDataFrame([(0, None, 1)], SCHEMA)
    df = top.union(nodes).union(chain[0]).union(chain[1]).union(chain[2])
    got = tree.preorder(spark, df, most=50_000).toPandas().sort_values("position")
    assert got.position.tolist() == list(range(1, len(got) + 1)) and len(got) == n + 3 * n // 40
    want = []
    for i in sorted(range(1, n + 1), key=lambda i: (i % 7, i)):
        want += [i] + ([i + n, i + 2 * n, i + 3 * n] if i % 40 == 0 else [])
    assert got.id.tolist() == want


def test_what_no_root_reaches(spark):
    rows = [(1, None, 1), (2, 1, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1), (6, 5, 1), (7, 99, 1), (8, 7, 1), (9, 9, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.root_id, r.id, r.depth, r.position) for r in tree.preorder(spark, df).collect()] == [(1, 2, 1, 1)]
    assert sorted(r.id for r in tree.unreached(spark, df).collect()) == [3, 4, 5, 6, 7, 8, 9]


def test_session_is_left_as_it_was(spark):
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    df = spark.createDataFrame([(1, None, 1), (2, 1, 1)], SCHEMA)
    outline.below(spark, df, df.where("id = 1"))
    assert spark.conf.get(limit, None) == before

"""Neighbours over a whole table and the reading order of threads."""

import random

import pytest

from daybook.operators.order import neighbours
from daybook.operators.threads import reading_order


@pytest.mark.parametrize("circular", [False, True])
@pytest.mark.parametrize("n", [1, 2, 1000])
def test_neighbours(spark, n, circular):
    any_of = random.Random(n)
    values = [(any_of.choice([None, *range(50)]), i, any_of.choice([None, "x", "y"])) for i in range(n)]
    any_of.shuffle(values)
    near = neighbours(spark.createDataFrame(values, "at int, id int, v string").repartition(7), ["at", "id"], ["id", "v"], circular)
    order = sorted(values, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {}
    for k, r in enumerate(order):
        before = order[k - 1] if k or circular else (None,) * 3
        after = order[(k + 1) % n] if k + 1 < n or circular else (None,) * 3
        want[r[1]] = (before[1], before[2], after[1], after[2])
    assert {r.id: (r.prev_id, r.prev_v, r.next_id, r.next_v) for r in near.collect()} == want


def test_neighbours_need_no_single_task(spark):
    near = neighbours(spark.range(10_000).withColumnRenamed("id", "k").repartition(8), ["k"], ["k"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert near.where("prev_k = k - 1 or k = 0").where("next_k = k + 1 or k = 9999").count() == 10_000
    assert neighbours(spark.range(0), ["id"], ["id"]).count() == 0


def brute(rows):
    """Recursion over each tree; comments that no root leads to have nulls."""
    out = {}
    for tree in {r[0] for r in rows}:
        parent = {}
        for t, i, p in rows:
            if t == tree:
                parent[i] = min((x for x in (parent.get(i), p) if x is not None), default=None)
        below = {}
        for i, p in parent.items():
            below.setdefault(p if p in parent else None, []).append(i)
        place = 0
        out |= {(tree, i): (None, None, None) for i in parent}

        def walk(i, depth):
            nonlocal place
            mine, place = place, place + 1
            for k in sorted(below.get(i, [])):
                walk(k, depth + 1)
            out[tree, i] = (mine, place - mine, depth)

        for i in sorted(below.get(None, [])):
            walk(i, 1 if parent[i] is None else 2)
    return out


def found(df):
    return {(r.tree, r.id): (r.place, r.size, r.depth) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_reading_order_of_any_trees(spark, seed):
    """Branches, replies whose parent isn't there, cycles, rows that come twice, numbers above 9,999 and below 0."""
    any_of = random.Random(seed)
    rows = []
    for tree in range(6):
        ids = any_of.sample(range(-100, 40_000), any_of.choice([1, 2, 30, 120]))
        rows += [(tree, i, any_of.choice([None, any_of.choice(ids), any_of.choice(ids[: k + 1]), 50_000])) for k, i in enumerate(ids)]
    rows += rows[:5] + [(9, 1, 2), (9, 2, 1), (9, 3, 2), (9, 4, 4), (9, 5, None)]
    assert found(reading_order(spark.createDataFrame(rows, "tree int, id long, parent long").repartition(3))) == brute(rows)


def test_reading_order_of_nothing(spark):
    assert reading_order(spark.createDataFrame([], "tree int, id long, parent long")).count() == 0


def test_deep_and_wide_threads(spark):
    """20,000 levels in one tree, a root with 200,000 replies in another."""
    deep = spark.range(20_000).selectExpr("1 AS tree", "id", "nullif(id - 1, -1) AS parent")
    wide = spark.range(200_001).selectExpr("2 AS tree", "id", "CASE WHEN id > 0 THEN 0 END AS parent")
    got = reading_order(deep.union(wide))
    assert got.where("tree = 1 and place = id and size = 20000 - id and depth = id + 1").count() == 20_000
    assert got.where("tree = 2 and place = id and size = if(id = 0, 200001, 1) and depth = if(id = 0, 1, 2)").count() == 200_001

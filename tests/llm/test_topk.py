import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import topk


def brute(rows, k, every, scale=1024):
    ok = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(q, w)), j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:k])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(topk.op13_topk(spark, "/root/testdata/sf0.001")) == brute(rows, 10, 100)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_odd_rows(spark, kind):
    """Null ids and parts, repeated ids and rows, ties, several lengths, none at all, huge and tiny numbers, clashing names."""
    any_of = random.Random(4)
    odd = [None, [], [1.0, None], [math.nan, 1.0], [math.inf], [0.0, 0.0]]
    rows = [(any_of.choice([None, *range(200)]), any_of.choice(odd) if any_of.random() < 0.2 else [any_of.choice([0.5, -0.25, any_of.gauss(0, 1) // 2**-20 * 2**-20, 0.0]) for _ in range(any_of.choice([2, 3]))]) for _ in range(700)]
    rows += [(100, [1e6, -1e6]), (101, [-131072.0, 262144.0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("rank", F.lit("x")).withColumn("block", F.lit(1)).repartition(3)
    got = found(topk.top_k(df, k=7, every=10))
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()], 7, 10)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.1])], "vec_id long, embedding array<float>")
    assert found(topk.top_k(df)) == [(0, 1, 1, 512 * 102)]
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 0")).count() == 0


def test_too_long_vectors_take_no_part(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1e300]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert found(topk.top_k(df)) == [(0, 1, 2, 1024 * 2048)]


@pytest.mark.parametrize("n, dim, spread", [(1, 3, 5), (300, 8, 3), (2048, 32, 400), (700, 4, 1)])
def test_the_bounds_are_a_proof(n, dim, spread):
    """No row of the k best, ties included, is ever outside what ``possible`` leaves, with and without a floor; and it leaves few."""
    r = np.random.default_rng(n)
    x = r.normal(0, spread, (n, dim)).astype(np.int64)
    p, ids = topk.postings(x), np.arange(n, dtype="<i8")
    block = topk.Block(dim, ids.tobytes(), ids.tobytes(), x.astype("<i8").tobytes(), p["order"].tobytes(), p["sizes"].astype("<u2").tobytes(), p["low"].astype("<i8").tobytes(), p["width"].astype("<i8").tobytes())
    left = 0
    for i in range(min(n, 60)):
        scores = x @ x[i]
        scores[i] = np.iinfo(np.int64).min
        need = np.sort(scores)[::-1][:10][-1]
        best = set(np.flatnonzero(scores >= need)) - {i}
        for floor in (None, int(need)):
            at = block.possible(x[i], i, 10, floor)
            assert best <= set(at.tolist()) and i not in at
            left += len(at)
        assert not len(block.possible(x[i], i, 10, 1 << 50)) or n <= 11
    assert n < 2048 or left < 60 * n


def test_search_stops_before_all_postings(monkeypatch):
    r = np.random.default_rng(0)
    x = (r.normal(0, 1, (2048, 64)) * 128).astype(np.int64)
    x[1] = x[0]
    x[2:12] = x[0] + r.integers(-9, 9, (10, 64))
    p, ids, read = topk.postings(x), np.arange(2048, dtype="<i8"), []
    block = topk.Block(64, ids.tobytes(), ids.tobytes(), x.astype("<i8").tobytes(), p["order"].tobytes(), p["sizes"].astype("<u2").tobytes(), p["low"].astype("<i8").tobytes(), p["width"].astype("<i8").tobytes())
    real = block.members
    monkeypatch.setattr(block, "members", lambda s: (read.append(int(block.counts[s].sum())), real(s))[1])
    assert set(range(1, 11)) & set(block.possible(x[0], 0, 10, None).tolist())
    assert sum(read) < 2048 * 64 * 0.6

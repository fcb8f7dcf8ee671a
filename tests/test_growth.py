"""What a task or a worker holds, and what is moved, doesn't grow faster than the tables."""

import glob
import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daybook.functions import scrub
from daybook.functions.lazy import arrow_udf
from daybook.operators import assets, store, threads
from daybook.operators.threads import reading_order
from daybook.plans import documents_html
from daybook.plans.registry import Tables
from daybook.shared import shared_dir

SF = "/root/testdata/sf0.001"


def test_batches_of_long_texts_are_bounded(spark):
    """F1, F8: before, a worker was handed up to 10,000 texts of any length at once."""

    @arrow_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    df = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("ab"), 5000 + F.col("id").cast("int") % 2).alias("t"))
    assert df.select(together("t").alias("n")).agg(F.max("n")).first()[0] < 8 << 20


def test_index_of_long_patterns_is_sparse(spark):
    """before, every run of every text was indexed."""
    text = "".join(random.Random(1).choice("ab c") for _ in range(6000))
    one = spark.createDataFrame([(1, text), (2, text[:700])], "id long, text string")
    assert one.select(F.size(scrub.grams(F.col("text"), 16, 66))).first()[0] < 100
    for length in (9, 33, 81, 400):
        patterns = {text[k : k + length + k % 3] for k in (0, 1, 65, 66, 331, 690, 6000 - length)} | {"d" * length}
        found = {tuple(r) for r in scrub.found_in(spark.createDataFrame([(p,) for p in patterns], "pattern string"), one, 6).collect()}
        assert found == {(p, i) for p in patterns for i, t in ((1, text), (2, text[:700])) if p in t}


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """before, one task sorted and wrote all rows of a bucket, and a new table was one bucket first."""
    monkeypatch.setattr(store, "SHARE", 100, raising=False)
    kind = {"a": (StructType().add("id", "long", False).add("v", "string"), ["id"])}
    s = store.Store(spark, f"file://{tmp_path}/s", kind, most=10_000)
    rows = spark.range(2000).select("id", F.lit("x").alias("v"))
    s.write("a", rows.coalesce(1))
    assert len(glob.glob(f"{tmp_path}/s/a/*/bucket=0/*.parquet")) > 5
    s.upsert("a", rows.select("id", F.lit("y").alias("v")).union(spark.sql("SELECT 2000L, 'y'")))
    assert s.read("a").agg(F.count("*"), F.count_distinct("id"), F.min("v"), F.max("id")).first() == (2001, 2001, "y", 2000)
    written = []
    monkeypatch.setattr(store.Transaction, "_write", lambda self, name, rows, buckets, *more, f=store.Transaction._write: (written.append(buckets), f(self, name, rows, buckets, *more))[1])
    store.Store(spark, f"file://{tmp_path}/t", kind, most=100).write("a", rows)
    assert len(written) == 1 and written[0] > 1


def test_cover_runs_in_spark_alone(spark, monkeypatch):
    """before, bitmaps of 4 KB an item went through Python."""
    monkeypatch.setattr(F, "pandas_udf", None)
    pairs = [(i, e) for i in range(9) for e in range(300) if (e * 7 + i * i) % (i + 3) == 0]
    left, best = {i: {e for j, e in pairs if j == i} for i in range(9)}, []
    while len(best) < 3:
        best.append(min(left, key=lambda i: (-len(left[i]), i)))
        left = {i: s - left[best[-1]] for i, s in left.items()}
    assert assets.set_cover(spark.createDataFrame(pairs, "item long, element long"), 3) == best


def _calls(monkeypatch):
    calls = []
    for name in ("written", "checkpointed"):
        if hasattr(threads, name):
            monkeypatch.setattr(threads, name, lambda df, f=getattr(threads, name): (calls.append(1), f(df))[1])
    return calls


def test_rounds_depend_on_the_largest_thread_alone(spark, monkeypatch):
    """before, the roots of a tree were one list, so that rounds grew with the tree."""
    calls = _calls(monkeypatch)
    rows = spark.range(3000).select((F.col("id") % 2).cast("int").alias("tree"), "id", F.when(F.col("id") % 6 > 1, F.col("id") - F.col("id") % 6 + F.col("id") % 2).alias("parent"))
    got = {(r["tree"], r["id"]): (r["place"], r["size"], r["depth"]) for r in reading_order(rows).collect()}
    assert len(calls) < 11
    assert got == {(i % 2, i): (i // 2, 3 if i % 6 < 2 else 1, 1 if i % 6 < 2 else 2) for i in range(3000)}


def test_small_trees_are_ordered_without_rounds(spark, monkeypatch):
    """before, every tree took rounds that moved two steps a comment."""
    any_of = random.Random(3)
    rows = [(t, i, any_of.choice([None, i - 1, any_of.randrange(40), 99])) for t in range(60) for i in any_of.sample(range(40), 25)]
    df = spark.createDataFrame(rows, "tree int, id long, parent long")
    by_tour = sorted(map(tuple, threads._tour(df).collect()))
    calls = _calls(monkeypatch)
    assert sorted(map(tuple, reading_order(df).collect()), key=lambda r: r[:2]) == by_tour
    assert len(calls) < 3


def test_landed_documents_are_bounded(spark, monkeypatch):
    """before, three tasks wrote all lines."""
    monkeypatch.setattr(documents_html, "LINES", 100, raising=False)
    lines = spark.range(1000).select(F.concat(F.lit("<a id='"), "id", F.lit("'/>")).alias("line"))
    path = documents_html._landed(Tables(spark, SF), lines, "several")
    assert spark.read.text(path).where("value = '</journal>'").count() == 10

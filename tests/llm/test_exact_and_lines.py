import hashlib
import re

import pytest
from pyspark.sql import functions as F

from daybook.llm.exact_dedup import exact_dedup
from daybook.llm.line_dedup import SortedRuns, cut_lines

BLANK = " \t\n\x0b\x0c\r"
DOCS = [
    (5, "same text here"), (3, "same text here"), (9, "same text here"), (1, ""), (2, None), (4, "Other"), (6, "other"), (6, "other"), (None, "other"), (None, "alone"),
    (7, "line one is long\nshort\nline one is long\n  LINE ONE IS LONG\t\nkept only here"), (8, "line one is long\n\nshort\n"), (10, "\x0bline one is long\r"), (11, "x" * 50_000 + "\n" + "line one is long"), (12, "ÄÖÜ line is long\näöü line is long"), (13, "äöü line is long"),
]
SCHEMA = "doc_id long, text string"


def frame(spark, rows=DOCS):
    # extra columns whose names clash with those of results
    return spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("keep_id", F.lit(0)).repartition(3)


@pytest.mark.parametrize("digest", [lambda t: F.sha2(t, 256), lambda t: F.lit("all collide"), lambda t: F.length(t), lambda t: F.when(t != "other", t), lambda t: F.lit(None).cast("string")])
def test_exact(spark, digest):
    got = sorted(((r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark), digest).collect()), key=str)
    want = []
    for i, t in DOCS:
        group = [j for j, u in DOCS if (u or "") == (t or "")]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, hashlib.sha256((t or "").encode()).hexdigest(), keep, len(group), i == keep))
    assert got == sorted(want, key=str)


def test_exact_empty(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def brute_lines(docs, least=10):
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    key = lambda line: lower(line).strip(BLANK)
    first = {}
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    first[key(line)] = min(i, first.get(key(line), i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_lines(spark, batches, fanout):
    got = cut_lines(frame(spark), batches=batches, fanout=fanout)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == brute_lines(DOCS)
    assert "digest" in got.columns


def test_lines_empty(spark):
    assert cut_lines(frame(spark, [])).count() == 0


def test_lines_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = cut_lines(docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == brute_lines([tuple(r) for r in docs.collect()])


def test_lines_hand_any_column_through(spark):
    """Columns with the names used inside, dots and back-quotes among them."""
    names = ["lines", "cut", "row", "whole", "tag", "key", "pos", "batch", "a.b", "c0", "odd`name", "first"]
    df = frame(spark)
    for k, n in enumerate(names):
        df = df.withColumn(n, F.lit(k))
    got = cut_lines(df)
    assert got.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped", "kept_text"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == brute_lines(DOCS)
    assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(range(len(names)))}


def test_lines_of_long_texts(spark):
    """Two texts of some megabytes, one of 100,000 lines, one of a single line."""
    docs = [(1, "\n".join(f"line number {i % 90_000}" for i in range(100_000))), (2, "x" * 3_000_000), (3, "\n".join(f"line number {i}" for i in range(89_990, 90_010))), (4, "x" * 3_000_000)]
    got = cut_lines(spark.createDataFrame(docs, SCHEMA))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute_lines(docs)


def test_exact_of_long_texts(spark):
    docs = [(1, "x" * 3_000_000), (2, "x" * 3_000_000), (3, "x" * 3_000_000 + "y"), (4, "z" * 2_000_000)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True)}


def test_buckets_grow_with_the_keys(spark, tmp_path):
    """Runs that outgrow their buckets are written with more of them; no key is lost and later batches join without an exchange above a run."""
    runs = SortedRuns(spark, f"file://{tmp_path}/runs", buckets=1, most=100)
    firsts = lambda lo, hi: spark.range(lo, hi).selectExpr("unhex(md5(cast(id as string))) AS key", "id + 100 AS doc").groupBy("key").agg(F.min("doc").alias("mine"), F.max("doc").alias("last"))
    seen = []
    for lo in range(0, 1000, 200):
        shared = runs.add(firsts(max(0, lo - 10), lo + 200))
        assert shared.count() == (10 if lo else 0)
        seen.append(runs.buckets)
        assert sum(runs.rows.values()) == lo + 200 <= runs.buckets * 100
    assert seen == sorted(seen) and seen[-1] >= 16
    assert runs.all().groupBy("key").count().where("count > 1").count() == 0 and runs.all().count() == 1000
    plan = plan_of(runs.met(firsts(0, 20)))
    assert plan[plan.index("Bucketed: true") - 2000 : plan.index("Bucketed: true")].count("ENSURE_REQUIREMENTS") <= 1
    runs.close()
    again = SortedRuns(spark, f"file://{tmp_path}/runs", buckets=1)
    assert again.buckets == seen[-1] and again.all().count() == 1000
    again.close()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buckets", [4, 6])
def test_runs_are_never_moved(spark, tmp_path, buckets):
    """Neither the join of a batch with the runs nor a merge of runs has an exchange above a run."""
    runs = SortedRuns(spark, f"file://{tmp_path}/runs", buckets=buckets, fanout=3)
    firsts = lambda lo, hi: spark.range(lo, hi).selectExpr("unhex(md5(cast(id as string))) AS key", "id + 100 AS doc").groupBy("key").agg(F.min("doc").alias("mine"), F.max("doc").alias("last"))
    runs.add(firsts(0, 50))
    runs.add(firsts(30, 80))
    plan = plan_of(runs.met(firsts(60, 90)))
    top = plan[: plan.index("Exchange")] if "Exchange" in plan else plan
    assert "SortMergeJoin" in top and plan.count("Bucketed: true") == 2 and "Union" in plan
    assert plan[plan.index("Union") :].count("Exchange") == 0
    assert runs.all().count() == 80
    runs.add(firsts(0, 100))
    assert len(runs.levels[0]) == 0 and len(runs.levels[1]) == 1 and runs.all().count() == 100
    (only,) = runs.levels[1]
    parts = [f for f in (tmp_path / "runs" / only).iterdir() if f.name.startswith("part-")]
    assert len(parts) <= buckets
    runs.close()


def test_runs_outlive_their_session(spark, tmp_path):
    """A second call goes on from the folder, whichever of the two holds the smaller doc_ids; repeating a call changes nothing."""
    folder = f"file://{tmp_path}/index"
    first = [(5, "this line is old\nanother old line\nown line of five"), (6, "this line is old")]
    second = [(1, "this line is old\nbrand new line"), (9, "brand new line\nANOTHER OLD LINE  "), (5, first[0][1])]
    cut = lambda rows: {r.doc_id: r.kept_text for r in cut_lines(spark.createDataFrame(rows, SCHEMA), batches=2, index=folder).collect()}
    assert cut(first) == {5: first[0][1], 6: ""}
    for _ in range(2):
        assert cut(second) == {1: "brand new line", 9: "", 5: first[0][1]}
    runs = SortedRuns(spark, folder)
    assert runs.all().count() == 4
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("daybook_run")]

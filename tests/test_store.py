import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import assets, store, threads
from daybook.schemas import TABLES


def users(spark, *rows):
    return spark.createDataFrame(rows, TABLES["users"][0])


def test_snapshots_are_idempotent(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.read("users").count() == 0
    s.upsert("users", users(spark, (1, "a"), (2, "b")))
    for _ in range(2):
        s.upsert("users", users(spark, (2, "c"), (3, "d")))
    assert sorted(map(tuple, s.read("users").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_state(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.get_state("entries.before") is None
    s.set_state("entries.before", "2004")
    s.set_state("entries.before", "2003")
    assert s.get_state("entries.before") == "2003"


def test_unknown_poster_is_refused(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.upsert("users", users(spark, (1, "a")))
    row = (5, 1, None, None, None, None, None, "A", "now")
    s.upsert("comments", spark.createDataFrame([row], TABLES["comments"][0]))
    s.check()  # anonymous is fine
    s.upsert("comments", spark.createDataFrame([(6, 1, None, 9, *row[4:])], TABLES["comments"][0]))
    with pytest.raises(ValueError):
        s.check()


def test_index_does_not_blank_bodies(spark):
    old = spark.createDataFrame([(1, "A", "text"), (2, "A", None)], "id long, state string, body string")
    new = spark.createDataFrame([(1, "D"), (3, "A")], "id long, state string")
    got = sorted(map(tuple, store.update_some(old, new, ["id"], ["state"]).collect()))
    assert got == [(1, "D", "text"), (2, "A", None), (3, "A", None)]


def test_poison_is_sticky(spark):
    kind = TABLES["assets"][0]
    old = spark.createDataFrame([("h", "image/png", 1, 1, 1, "poison", "p", "t")], kind)
    refs = spark.createDataFrame([(1, None, "u", "x", "entry", 1, None, None, None, None), (2, None, "u", "x", "entry", 2, None, None, None, None)], TABLES["asset_refs"][0])
    results = spark.createDataFrame([("u", "h", "image/png", 1, 1, 1, "ok", "p", 200, None, "t2")], "source_url string, hash string, mime string, byte_len long, width int, height int, status string, local_path string, http_status int, error string, fetched_at string")
    refs2, assets2 = store.record_fetches(refs, old, results)
    assert [r.hash for r in refs2.collect()] == ["h", "h"]
    assert assets2.first().status == "poison"


@pytest.mark.parametrize(
    "refs, options, found",
    [
        ([("p", "x", f"u{i}") for i in range(142)], {}, {("p", "x")}),
        ([("p", "x", "same")] * 40, {}, set()),
        ([("p", "x", f"u{i}") for i in range(6)] + [(f"h{i}", "x", f"v{i}") for i in range(60)], {}, set()),
        ([("p", "x", f"u{i}") for i in range(20)] + [("p", "y", f"v{i}") for i in range(20)], {}, {("p", "x"), ("p", "y")}),
        ([("p", "x", f"u{i}") for i in range(3)], {}, set()),
        ([("p", "x", f"u{i}") for i in range(3)], {"min_urls": 2}, {("p", "x")}),
        ([("p", "x", f"u{i}") for i in range(30)] + [("q", "x", "v0"), ("r", "x", "v1")], {}, {("p", "x")}),
    ],
)
def test_host_collapse(spark, refs, options, found):
    df = spark.createDataFrame(refs, "hash string, host string, url string")
    assert {(r.hash, r.host) for r in assets.host_collapse(df, **options).collect()} == found


def test_threads(spark):
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 9, 7), (2, 1, 2), (2, 2, 1)] + [(3, i, i - 1 if i else None) for i in range(130)]
    got = {(r.tree, r.id): r.depth for r in threads.thread_depths(spark.createDataFrame(rows, "tree int, id int, parent int")).collect()}
    assert got[1, 3] == 3 and got[1, 9] == 2 and got[3, 129] == 130
    assert got[2, 1] is None and got[2, 2] is None


def test_set_cover(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 4), ("c", 5)], "item string, element int")
    assert assets.set_cover(pairs, 2) == ["b", "a"]


def plain_cover(pairs, budget):
    left, out = set(pairs), []
    while left and len(out) < budget:
        counts = {}
        for i, _ in left:
            counts[i] = counts.get(i, 0) + 1
        best = min(counts, key=lambda i: (-counts[i], i))
        out.append(best)
        gone = {e for i, e in pairs if i == best}
        left = {(i, e) for i, e in left if e not in gone}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_set_cover_by_bitmaps(spark, seed):
    """Against sets, with repeated pairs, elements of several buckets of bits and more steps than there is to cover."""
    r = random.Random(seed)
    pairs = [(r.randrange(12), r.randrange(r.choice([5, 90_000]))) for _ in range(2000)]
    df = spark.createDataFrame(pairs + pairs[:50], "item int, element long").repartition(5)
    assert assets.set_cover(df, 9) == plain_cover(pairs, 9)
    assert assets.set_cover(df.where("item < 2"), 9) == plain_cover([p for p in pairs if p[0] < 2], 9)
    assert assets.set_cover(df.limit(0)) == []


def test_set_cover_over_many_buckets(spark):
    pairs = spark.range(100_000).selectExpr("id % 3 AS item", "id AS element").union(spark.range(40_000).selectExpr("9 AS item", "id AS element"))
    assert assets.set_cover(pairs) == [9, 0, 1, 2]


def test_numbers(spark):
    rows = spark.createDataFrame([(f"w{i}",) for i in range(500)], "w string").repartition(7)
    got = [r.w for r in assets.numbers(rows, "w").orderBy("number").collect()]
    assert got == sorted(got) and assets.numbers(rows, "w").agg({"number": "max"}).first()[0] == 500


def test_lost_reasons(spark):
    refs = spark.createDataFrame([(None, "a", "t", 404, None), (None, "b", "t", None, "dns"), (None, "c", None, None, None), ("h", "d", "t", 200, None)], "hash string, source_url string, fetched_at string, http_status int, error string")
    assert {r.source_url: r.reason for r in assets.lost_reasons(refs).collect()} == {"a": "HTTP 404", "b": "dns"}
    assert assets.pending(refs).collect()[0][0] == "c"
    assert refs.where(F.col("hash") == "h").count() == 1


def test_long_chains_have_their_depth(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("7 AS tree", "id", "nullif(id - 1, -1) AS parent").union(spark.createDataFrame([(7, -5, -6), (7, -6, -5), (7, -7, -5)], "tree int, id long, parent long"))
    got = threads.thread_depths(rows)
    assert got.where("id >= 0 and depth = id + 1 and root = 0").count() == n
    assert got.where("id < 0 and depth is null and root is null").count() == 3

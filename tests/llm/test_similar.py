"""Similar texts against brute force over all pairs."""

import random

import numpy as np
import pytest
from daybook.llm import similar
from pyspark.sql import functions as F

LEAST = 0.8


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Smallest doc_id reachable over pairs of rows with the same words or a similarity of 0.8."""
    by = {}
    for i, text in rows:
        if i is not None:
            by.setdefault(i, []).append((b" ".join((text or "").encode().lower().split()), shingles(text)))
    up = {i: i for i in by}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(by)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x == y or (s and len(s & t) >= LEAST * len(s | t)) for x, s in by[a] for y, t in by[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def made(seed, families=12, copies=6):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(families):
        words = [r.choice(vocab) for _ in range(r.choice([60, 200, 500]))]
        texts.append(" ".join(words))
        for _ in range(copies):
            w = list(words)
            for _ in range(max(1, int(len(w) * r.choice([0.003, 0.008, 0.015, 0.04])))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(r.choice([" ", "\n", "  "]).join(w).upper() if r.random() < 0.3 else " ".join(w))
    return texts


def run(spark, rows, kind="doc_id long, text string"):
    found = similar.similar_groups(spark.createDataFrame(rows, kind)).collect()
    return {r["doc_id"]: r["component_id"] for r in found}, len(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_brute_force(spark, seed):
    rows = list(enumerate(made(seed)))
    random.Random(seed).shuffle(rows)
    assert run(spark, rows)[0] == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"x{i % 900}" for i in range(60_000))
    rows = [(9, None), (4, ""), (7, " \t\n"), (3, "one two"), (2, "ONE  two"), (1, "one two three"), (5, long), (6, long + " y"), (8, "a b c d e f"), (8, "a b c d e f"), (8, "g h i j k l"), (None, "one two")]
    got, n = run(spark, rows)
    assert got == brute(rows) and n == 11
    assert got[9] == got[7] == 4 and got[3] == 2 and got[1] == 1 and got[6] == 5


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, [])[0] == {}
    odd = spark.createDataFrame([(1, "a b c", 5), (2, "A b c", 6)], "doc_id int, text string, node long").withColumn("digest", F.lit(1)).withColumn("sketch", F.lit(2))
    assert sorted((r["doc_id"], r["component_id"]) for r in similar.similar_groups(odd).collect()) == [(1, 1), (2, 1)]


def reached(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_members_of_a_bucket_are_connected_as_by_all_pairs(seed):
    r = np.random.default_rng(seed)
    centre = r.integers(0, 1 << 63, 5).astype(np.uint64)
    fps = np.array([centre[i % 5] ^ sum((np.uint64(1 << int(b)) for b in r.choice(64, r.integers(0, 12), replace=False)), np.uint64(0)) for i in range(100)] + [centre[0]] * 3, np.uint64)
    a, b = similar.near_forest(np.arange(103), fps)
    pairs = [(i, j) for j in range(103) for i in range(j) if int(fps[i] ^ fps[j]).bit_count() <= similar.FAR]
    assert len(a) < 103 and reached(103, zip(a.tolist(), b.tolist())) == reached(103, pairs)


@pytest.mark.parametrize("seed, n", [(1, 2), (2, 3), (3, 40), (4, 90)])
def test_sets_are_connected_as_by_all_pairs(seed, n, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 7)
    r = random.Random(seed)
    base = [r.sample(range(10_000), 40) for _ in range(max(1, n // 6))]
    sets = [set(r.choice(base)[r.randrange(4) :]) | set(r.sample(range(10_000), r.randint(0, 6))) for _ in range(n)] + [set()]
    got = similar.alike([np.array(sorted(x), np.int64) for x in sets], LEAST).tolist()
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] & sets[j] and len(sets[i] & sets[j]) >= LEAST * len(sets[i] | sets[j])]
    assert got == reached(len(sets), pairs)


def crowd(seed, n, twins, words=300, share=0.02):
    """One template's texts, most pairs at about 0.7, and near copies of ``twins`` of them."""
    r = random.Random(seed)
    base = [f"w{r.randrange(4000)}" for _ in range(words)]

    def changed(w, k):
        w = list(w)
        for at in r.sample(range(len(w)), k):
            w[at] = f"n{r.randrange(1 << 40)}"
        return w

    texts = [changed(base, round(words * share)) for _ in range(n)]
    return [" ".join(w) for w in texts + [changed(w, 5) for w in texts[:twins]]]


def test_near_copies_inside_a_crowded_family(spark):
    rows = list(enumerate(crowd(5, 360, 120)))
    want = brute(rows)
    assert len(set(want.values())) > 200 and len(set(want.values())) < 400
    assert run(spark, rows)[0] == want


def test_large_families_and_buckets_in_blocks(spark, monkeypatch):
    """With blocks of a few members every family and bucket is split, and the groups stay the same."""
    rows = list(enumerate(crowd(6, 90, 40, words=120)))
    want = brute(rows)
    families, verified = similar.families, similar.verified
    monkeypatch.setattr(similar, "families", lambda uniq, scratch: families(uniq, scratch, 8))
    monkeypatch.setattr(similar, "verified", lambda held, least, scratch: verified(held, least, scratch, 10, 900))
    assert run(spark, rows)[0] == want

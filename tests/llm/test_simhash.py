import random

import numpy as np
import pytest
import xxhash

from daybook.llm import simhash
from daybook.llm.common import Scratch
from daybook.llm.components import components


def slow_fingerprint(text, size=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(fps, most=4):
    """fps: [(id, fp)] -> id -> smallest id reachable."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= most:
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        low[root(i)] = min(d, low.get(root(i), d))
    return {d: low[root(i)] for i, (d, _) in enumerate(fps)}


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "A b C d", "x y z w " * 50, "é Ü ß d e f g", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_code_is_perfect():
    """Each of the 2048 syndromes has its own pattern of three bits or fewer."""
    e = simhash.errors()
    assert len(set(e.tolist())) == 2048 and all(int(x).bit_count() <= 3 for x in e)
    assert (simhash.syndromes(e) == np.arange(2048)).all()


@pytest.mark.parametrize("seed", range(3))
def test_every_pair_within_four_bits_shares_a_key(seed):
    rng = random.Random(seed)
    codes = [simhash.Golay(w) for _, w in simhash.SEGMENTS]
    a, b = [], []
    for _ in range(1500):
        x = rng.getrandbits(64)
        a.append(x)
        b.append(x ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))))
    keys = [set() for _ in a], [set() for _ in b]
    for side, fps in zip(keys, (a, b)):
        k, at = simhash.bucket_keys(np.array(fps, np.uint64), codes)
        for key, i in zip(k.tolist(), at.tolist()):
            side[i].add(key)
    assert all(x & y for x, y in zip(*keys))


def test_groups_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = [(i, rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))) for i in range(900)]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps]
    frame = spark.createDataFrame(signed, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size: frame)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(frame).collect()}
    assert got == slow_groups(fps)


def test_texts(spark):
    rows = [(3, "a b c d e"), (1, "A b  c\nd e"), (2, None), (5, ""), (4, "quite another text than that"), (4, "quite another text than that"), (None, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = [(r.doc_id, r.component_id) for r in simhash.near_groups(df).collect()]
    assert sorted(got, key=str) == sorted([(3, 1), (1, 1), (2, 2), (5, 2), (4, 4), (4, 4), (None, 1)], key=str)
    assert simhash.near_groups(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(200, 240)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {i: 100 for i in [100, *range(200, 240)]}


def test_crowded_buckets_are_searched_in_blocks(spark):
    """With blocks of eight, most buckets of this crowd are split; the components stay those of brute force."""
    rng = random.Random(12)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 7, 9]))) for _ in range(260)} | {centre ^ sum(1 << b for b in rng.sample(range(30), 12)) for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    up = {f: f for f in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                x, y = sorted((root(signed[i]), root(signed[j])))
                up[y] = x
    uniq = spark.createDataFrame([(f,) for f in signed], "fp long")
    scratch = Scratch(spark, "crowd")
    for block in (8, 4096):
        got = {r.node: r.root for r in components(simhash.links(uniq, scratch, 4, block), scratch).collect()}
        assert {f: got.get(f, f) for f in signed} == {f: root(f) for f in signed}

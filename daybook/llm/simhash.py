"""Operator 6, SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments of 22, 21 and 21 bits. The binary Golay code
(23, 12) is perfect: each word has one codeword within three bits. A segment's keys are the
codewords of all words within one bit of it (one key, or six or fewer), so segments that differ
in two bits share a key: the word between them decodes to it.

Four differing bits fall on the segments as a <= b <= c, and then either a = 0 and b <= 2, or
a = b = 1 and c <= 2. The first case is met by one whole segment and a shared codeword of another;
the second by a whole half of each of two segments (the error is in the other half) and a shared
codeword of the third. Either key has 33 bits or more, so buckets stay small as the corpus grows,
and no link within four bits is lost. Candidates of a bucket are verified by their whole
fingerprints; a bucket gives a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table
from .components import components

#: The generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and the bits (first, width) of the segments.
GENERATOR, SEGMENTS = 0xC75, ((0, 22), (22, 21), (43, 21))
SEED = 42
#: Fingerprints of a bucket that are searched in one task.
BLOCK = 4096


def fingerprint(text: str | None, size: int = 4) -> int:
    """Majority of the bits of the XXH64 of all shingles, repeats included; fewer words give one shingle, no words give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, text -> doc_id, fp long (the fingerprint's bits as a signed number)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator, of 23-bit words."""
    s = words.astype(np.int64)
    for bit in range(22, 10, -1):
        s = np.where((s >> bit) & 1, s ^ (GENERATOR << (bit - 11)), s)
    return s


def errors() -> np.ndarray:
    """The one error pattern of three bits or fewer for each of the 2048 syndromes."""
    one = [1 << i for i in range(23)]
    all_ = [0, *one]
    all_ += [a | b for i, a in enumerate(one) for b in one[:i]]
    all_ += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    patterns = np.array(all_, np.int64)
    out = np.zeros(2048, np.int64)
    out[syndromes(patterns)] = patterns
    return out


class Golay:
    """For words of some width: what to flip for each key, by syndrome; -1 where a word has fewer keys."""

    def __init__(self, width: int):
        err, flips = errors(), np.array([0, *(1 << i for i in range(width))], np.int64)
        every = np.arange(2048, dtype=np.int64)
        patterns = np.stack([err[every ^ syndromes(np.array([f]))[0]] ^ f for f in flips], axis=1)
        sets = [sorted(set(row)) for row in patterns.tolist()]
        self.most = max(map(len, sets))
        self.flips = np.array([s + [-1] * (self.most - len(s)) for s in sets], np.int64)

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, most) codeword indices of 12 bits; -1 where there is none."""
        flip = self.flips[syndromes(words)]
        return np.where(flip < 0, -1, (words[:, None] ^ flip) >> 11)


def bucket_keys(fps: np.ndarray, codes: list[Golay]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints, and the position in fps that each belongs to."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    ball = [code.keys(s) for code, s in zip(codes, seg)]
    halves = [(s & 0x7FF, s >> 11) for s in seg]
    keys, at, role = [], [], 0

    def put(exact: np.ndarray, near: np.ndarray) -> None:
        nonlocal role
        k = (np.int64(role) << 40) | (exact[:, None] << 12) | near
        ok = near >= 0
        keys.append(k[ok])
        at.append(np.nonzero(ok)[0])
        role += 1

    for whole in range(3):
        for near in range(3):
            if near != whole:
                put(seg[whole], ball[near])
    for near in range(3):
        a, b = (x for x in range(3) if x != near)
        for ha in halves[a]:
            for hb in halves[b]:
                put((ha << 11) | hb, ball[near])
    return np.concatenate(keys), np.concatenate(at)


def forest(fps: np.ndarray, most: int) -> tuple[list, list]:
    """Edges that connect what links within ``most`` bits connect; each found by a breadth-first search that takes linked ones out of the pool."""
    a, b, pool = [], [], fps
    while len(pool) > 1:
        queue, pool = [pool[0]], pool[1:]
        while queue and len(pool):
            p = queue.pop()
            hit = np.bitwise_count(pool ^ p) <= most
            new = pool[hit]
            if len(new):
                a.append(np.full(len(new), p, np.uint64))
                b.append(new)
                queue.extend(new)
                pool = pool[~hit]
    return a, b


def crowds(members: DataFrame, most: int, block: int, scratch: Scratch) -> DataFrame:
    """(key, fp) members of large buckets -> edges (a, b) that connect what links there; blocks of a bucket meet two by two, each two in a group of their own."""

    def met(batches):
        for cell, fps in whole_groups(batches):
            fps = fps.view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            for s, e in zip(first, np.append(first[1:], len(cell))):
                a, b = forest(np.unique(fps[s:e]), most)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

    sizes = scratch.keep(members.groupBy("key").agg(F.greatest(F.lit(2), F.ceil(F.count("*") / block).cast("int")).alias("blocks")))
    dealt = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    rows = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(met, "a long, b long")


def whole_groups(batches):
    """The columns of batches sorted by the first one, cut where it changes."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        part = [np.asarray(c) for c in b.columns]
        k = part[0]
        if k[0] == k[-1] and (not held or held[-1][0][-1] == k[0]):
            held.append(part)
            continue
        whole = [np.concatenate(c) for c in zip(*held, part)]
        cut = np.searchsorted(whole[0], k[-1])
        held = [[c[cut:] for c in whole]]
        if cut:
            yield [c[:cut] for c in whole]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def links(uniq: DataFrame, scratch: Scratch, most: int = 4, block: int = BLOCK) -> DataFrame:
    """Distinct fp -> edges (a, b) whose components are those of all links within ``most`` (at most 4) differing bits.

    A bucket of more than ``block`` fingerprints is not searched in one task but by ``crowds``.
    """
    if most > 4:
        raise ValueError("the keys meet all pairs up to 4 differing bits only")

    def spread(batches):
        codes = [Golay(width) for _, width in SEGMENTS]
        for b in batches:
            fps = np.asarray(b.column(0)).view(np.uint64)
            for i in range(0, len(fps), 2000):
                keys, at = bucket_keys(fps[i : i + 2000], codes)
                for j in range(0, len(keys), 50000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[j : j + 50000]), pa.array(fps[i + at[j : j + 50000]].view(np.int64))], ["key", "fp"])

    def met(batches):
        for keys, fps in whole_groups(batches):
            fps = fps.view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.append(first, len(keys)))
            two = first[count == 2]
            ok = np.bitwise_count(fps[two] ^ fps[two + 1]) <= most
            a, b = [fps[two][ok]], [fps[two + 1][ok]]
            for s, n in zip(first[(count > 2) & (count <= block)], count[(count > 2) & (count <= block)]):
                x, y = forest(fps[s : s + n], most)
                a += x
                b += y
            a, b, many = np.concatenate(a), np.concatenate(b), np.repeat(count > block, count)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["key", "a", "b"])
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[many]), pa.array(fps[many].view(np.int64)), pa.nulls(int(many.sum()), pa.int64())], ["key", "a", "b"])

    bounded_batches(uniq.sparkSession)
    keyed = uniq.select("fp").mapInArrow(spread, "key long, fp long")
    found = scratch.keep(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(met, "key long, a long, b long"))
    crowded = found.where("key is not null").select("key", F.col("a").alias("fp"))
    return found.where("key is null").select("a", "b").union(crowds(crowded, most, block, scratch))


def near_groups(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """doc_id, text -> doc_id, fp long, component_id long; one row for each row of docs.

    Words are runs without blanks, A-Z lower-cased; the fingerprint is over ``size``-word shingles
    and links at ``most`` differing bits or fewer. Null and empty texts have fingerprint 0 and link
    like any other. component_id is the smallest doc_id reachable; null doc_ids count only where a
    component has no other. Equal fingerprints are joined once, so copies cost nothing further.
    Repeated rows come back as often. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, size))
    uniq = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = scratch.keep(components(links(uniq, scratch, most), scratch))
    member = scratch.keep(linked.join(uniq, linked["node"] == uniq["fp"]).select("fp", "root", "first"))
    least = scratch.keep(member.groupBy("root").agg(F.min("first").alias("least")))
    joined = scratch.keep(member.join(least, "root").select("fp", "least"))
    ids = scratch.keep(uniq.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of documents."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

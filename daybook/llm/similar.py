"""Operator 6 for similar texts: Golay-code fuzzy hashing where SimHash distances are large.

Texts whose sets of shingles have a Jaccard similarity of 0.8 differ in about 15 of 100 bits of a
SimHash, so the few bits of ``simhash.near_groups`` miss most of them. Here three fingerprints of
64 bits, over the set of shingles, are cut into nine segments. Some segment very likely differs in
two bits or fewer (or in three that decode alike), and then shares a codeword of the Golay code
with its counterpart. A codeword alone has 12 bits, too few for a large corpus, so each key joins
it with the smallest of the shingles' hashes under one of several orders, which similar texts share
as often as they are similar.

Members of a bucket within ``FAR`` bits of each other belong to one family; families that share a
member are one. All pairs of a family are then verified by their whole sets of shingles, inside the
tasks that hold the sets: no table of pairs is ever made. A large family is dealt into blocks, and
each two blocks meet in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches
from .components import components
from .embed_dedup import star
from .simhash import SEED, SEGMENTS, Golay, forest, whole_groups

#: Fingerprints of a text; orders of the shingles for each segment.
WORDS, ORDERS = 3, 2
ROLES = WORDS * len(SEGMENTS)
#: Candidates differ in at most this many of 64 bits: three standard deviations above the mean at similarity 0.8.
FAR = 18
#: Members of a bucket or a family that are compared in one task, and half of what two blocks have; columns that are multiplied at once.
BLOCK, CHUNK = 1024, 4096


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of 64-bit hashes, another function for each salt."""
    x = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Distinct XXH64 of the shingles, in order; fewer words give one shingle, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - size + 1)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """WORDS fingerprints, then the smallest hash under each order; zeros for an empty set."""
    out = np.zeros(WORDS + ROLES * ORDERS, np.uint64)
    if not len(hashes):
        return out
    for w in range(WORDS):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 15):
            part = mixed(hashes[i : i + (1 << 15)], w)
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    for k in range(ROLES * ORDERS):
        out[WORDS + k] = mixed(hashes, WORDS + k).min()
    return out


def spread_keys(sketches: np.ndarray, codes: list[Golay]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, the row of each, the fingerprint that its bucket compares: not the one of the segment, so that each has a fair view)."""
    keys, at, fps = [], [], []
    for role in range(ROLES):
        w, s = divmod(role, len(SEGMENTS))
        first, width = SEGMENTS[s]
        near = codes[s].keys(((sketches[:, w] >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64))
        row, col = np.nonzero(near >= 0)
        for k in range(ORDERS):
            anchor = sketches[row, WORDS + role * ORDERS + k]
            keys.append(mixed(anchor ^ (near[row, col].astype(np.uint64) << np.uint64(52)), 1000 + role * ORDERS + k))
            at.append(row)
            fps.append(sketches[row, (w + 1) % WORDS])
    return np.concatenate(keys), np.concatenate(at), np.concatenate(fps)


def near_forest(nodes: np.ndarray, fps: np.ndarray, far: int = FAR) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the members of a bucket which links within ``far`` bits connect."""
    known, first, which = np.unique(fps, return_index=True, return_inverse=True)
    a, b = forest(known, far)
    reps = nodes[first]
    same = np.flatnonzero(reps[which] != nodes)
    ends = [np.concatenate([*(reps[np.searchsorted(known, x)] for x in side), tied]) for side, tied in ((a, reps[which[same]]), (b, nodes[same]))]
    return ends[0], ends[1]


def families(uniq: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """node, sketch binary -> distinct edges (a, b) that connect the nodes which some bucket holds within FAR bits of each other."""

    def spread(batches):
        codes = [Golay(width) for _, width in SEGMENTS]
        for b in batches:
            nodes = np.asarray(b.column(0))
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(len(nodes), -1)
            for i in range(0, len(nodes), 500):
                keys, at, fps = spread_keys(rows[i : i + 500], codes)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[i + at]), pa.array(fps.view(np.int64))], ["key", "node", "fp"])

    def met(batches, most: int = block):
        for keys, nodes, fps in whole_groups(batches):
            fps = fps.view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.append(first, len(keys)))
            two = first[count == 2]
            two = two[(np.bitwise_count(fps[two] ^ fps[two + 1]) <= FAR) & (nodes[two] != nodes[two + 1])]
            a, b = [nodes[two]], [nodes[two + 1]]
            some = (count > 2) & (count <= most)
            for s, n in zip(first[some], count[some]):
                x, y = near_forest(nodes[s : s + n], fps[s : s + n])
                a.append(x)
                b.append(y)
            a, b, many = np.concatenate(a), np.concatenate(b), np.repeat(count > most, count)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["key", "a", "b"])
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[many]), pa.array(nodes[many]), pa.array(fps[many].view(np.int64))], ["key", "a", "b"])

    bounded_batches(uniq.sparkSession)
    keyed = uniq.select("node", "sketch").mapInArrow(spread, "key long, node long, fp long")
    found = scratch.keep(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(met, "key long, a long, b long"))
    crowded = found.where("key is not null").toDF("key", "node", "fp")
    sizes = crowded.groupBy("key").agg(F.greatest(F.lit(2), F.ceil(F.count("*") / block).cast("int")).alias("blocks"))
    rows = in_twos(crowded.join(scratch.keep(sizes), "key"), "key").select("cell", "node", "fp")
    more = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: met(batches, 1 << 62), "key long, a long, b long")
    return scratch.keep(found.where("key is null").union(more).select("a", "b").distinct())


def in_twos(rows: DataFrame, key: str) -> DataFrame:
    """Rows with node and blocks (one or more for each key) -> a row, with its cell, for each two blocks of the key that it is in; a single block is a cell."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other or blocks = 1")
    return dealt.withColumn("cell", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))


def alike(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For some sets the smallest place that links of a similarity of ``least`` or more reach from each."""
    n = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if both and both >= least * (n.sum() - both) else 1])
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row, shared = np.repeat(np.arange(len(sets)), n), count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        lo, hi = np.searchsorted(column, [start, start + CHUNK])
        part = np.zeros((len(sets), CHUNK), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        both += part @ part.T
    hit = (both > 0) & (both >= least * (n[:, None] + n[None, :] - both.astype(np.float64)))
    np.fill_diagonal(hit, True)
    return star(hit)[0]


def verified(held: DataFrame, least: float, scratch: Scratch, block: int = BLOCK, volume: int = 1 << 20) -> DataFrame:
    """(family, node, set) -> edges (a, b) that connect what sets of a similarity of ``least`` or more connect in each family.

    A family of more than ``block`` sets, or of more than ``volume`` shingles in all, is dealt into blocks.
    """

    def met(batches):
        for a, b in cells(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def cells(batches):
        now, nodes, sets = None, [], []
        for batch in batches:
            values, lengths = batch.column(2).flatten().to_numpy(), np.asarray(batch.column(2).value_lengths())
            ends = np.cumsum(lengths)
            for cell, node, end, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, lengths):
                if cell != now and nodes:
                    yield edges(nodes, sets)
                    nodes, sets = [], []
                now = cell
                nodes.append(node)
                sets.append(values[end - n : end])
        if nodes:
            yield edges(nodes, sets)

    def edges(nodes, sets):
        if len(nodes) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(nodes)
        nodes, roots = np.array(nodes)[order], alike([sets[i] for i in order], least)
        child = np.flatnonzero(roots != np.arange(len(nodes)))
        return nodes[roots[child]], nodes[child]

    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("set")) / volume)).cast("int").alias("blocks")
    sizes = scratch.keep(held.groupBy("family").agg(blocks).where("blocks > 1"))
    dealt = held.join(sizes, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = in_twos(dealt, "family").select("cell", "node", "set")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(met, "a long, b long")


def similar_groups(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, text -> doc_id, component_id (the smallest doc_id reachable); one row for each row with a doc_id.

    Texts link when the sets of their ``size``-word shingles have a Jaccard similarity of ``least``
    or more, or when their words are the same; words are runs without blanks, A-Z lower-cased. Links
    are exact; that two similar texts come into one family is probabilistic, and none of 3,000 made
    pairs at 0.8 was missed. Null counts as empty; texts without words are alike, texts of fewer
    words than ``size`` link only when equal.
    Rows of one doc_id count as one document; rows without one take no part. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")

    def drawn(batches):
        for b in batches:
            words = [(t or "").encode().lower().split() for t in b.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            shingles = [shingle_set(w, size) for w in words]
            sketches = [sketch(x).tobytes() for x in shingles]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "digest", "sketch"])

    def sets(batches):
        for b in batches:
            out = [shingle_set((t or "").encode().lower().split(), size).view(np.int64) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["family", "node", "set"])

    bounded_batches(spark)
    drawn_ = scratch.keep(rows.mapInArrow(drawn, "doc_id long, digest binary, sketch binary"))
    uniq, uniq_path = scratch.write(drawn_.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")))
    family = scratch.keep(components(families(uniq, scratch), scratch).select(F.col("root").alias("family"), F.col("node").alias("doc_id")))
    held, held_path = scratch.write(rows.join(family, "doc_id").select("family", "doc_id", "text").mapInArrow(sets, "family long, node long, set array<long>"))
    linked = components(scratch.keep(verified(held, least, scratch)), scratch)
    scratch.drop(held_path)
    ids = uniq.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return drawn_.select("doc_id", "digest").join(scratch.keep(ids), "digest").select("doc_id", "component_id")

"""Operator 4, embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c). They are turned to principal
directions, put in the order of their grid cells (width epsilon) on the leading ones, and cut into
blocks along that order. Only blocks whose boxes lie within epsilon meet; inside such a pair the
two intervals are halved again and again, skipping halves that are provably distant, down to
leaves that are compared in double precision. Besides the leading coordinates, boxes bound the norm
of what they leave out. Directions only steer the pruning: any rotation gives the same links.
Blocks travel in groups: a block is sent once to each group of its partners, not to each partner.
Equal vectors are joined once and counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table
from .components import components

#: Principal directions; vectors of a leaf; blocks of a group.
LEADING, LEAF, GROUP = 12, 128, 8
#: Room for the rounding of coordinates to single precision, beside epsilon squared.
ROOM = 1e-5


def directions(reps: DataFrame, bound: int = 5000) -> dict[int, np.ndarray]:
    """Principal directions for each length of vector, from at most about ``bound`` vectors chosen by a hash."""
    n = reps.count()
    part = reps if n <= bound else reps.where(F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * bound / n))
    by: dict[int, list] = {}
    for (v,) in part.select("embedding").collect():
        by.setdefault(len(v), []).append(v)
    out = {}
    for dim, rows in by.items():
        x = unit(np.array(rows, np.float64))
        x -= x.mean(axis=0)
        out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEADING].copy()
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def number_of(vectors: DataFrame) -> type:
    """The precision in which the vectors come."""
    return np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64


def star(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a 0/1 matrix of links between rows and columns: the smallest node (rows first) of each row's and each column's component."""
    rows, cols = hit.shape
    none = rows + cols
    a, b = np.arange(rows), np.arange(rows, none)
    while True:
        b2 = np.minimum(b, np.where(hit, a[:, None], none).min(axis=0))
        a2 = np.minimum(a, np.where(hit, b2[None, :], none).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


class Pair:
    """Two blocks, or a block with itself: degrees of both and the edges of a spanning forest."""

    def __init__(self, first: dict, second: dict, least: float, same: bool):
        self.a, self.b, self.least, self.same = first, second, least, same
        self.eps2 = 2 - 2 * least + ROOM
        self.deg_a, self.deg_b = np.zeros(len(first["ids"]), np.int64), np.zeros(len(second["ids"]), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self) -> Pair:
        todo = [(0, len(self.a["ids"]), 0, len(self.b["ids"]))]
        while todo:
            i, j, k, m = todo.pop()
            if i == j or k == m or (self.same and k < i):
                continue
            u, v = self.a["near"][i:j], self.b["near"][k:m]
            gap = np.maximum(0, np.maximum(v.min(axis=0) - u.max(axis=0), u.min(axis=0) - v.max(axis=0)))
            if gap @ gap > self.eps2:
                continue
            if j - i <= LEAF and m - k <= LEAF:
                self.leaf(i, j, k, m)
            else:
                h, g = (i + j) // 2, (k + m) // 2
                if self.same and (i, j) == (k, m):
                    todo += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
                elif j - i >= m - k:
                    todo += [(i, h, k, m), (h, j, k, m)]
                else:
                    todo += [(i, j, k, g), (i, j, g, m)]
        return self

    def leaf(self, i: int, j: int, k: int, m: int) -> None:
        u, v = self.a["vectors"][i:j], self.b["vectors"][k:m]
        cos = u @ v.T / (self.a["norms"][i:j, None] * self.b["norms"][None, k:m])
        hit = cos >= self.least
        own = self.same and (i, j) == (k, m)
        if own:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.deg_a[i:j] += hit @ self.b["counts"][k:m]
        if not own:
            self.deg_b[k:m] += hit.T @ self.a["counts"][i:j]
        ids = np.concatenate([self.a["ids"][i:j], self.b["ids"][k:m]])
        roots = np.concatenate(star(hit))
        child = np.flatnonzero(roots != np.arange(len(ids)))
        self.edges.append((ids[child], ids[roots[child]]))

    def forest(self) -> list[tuple[int, int]]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.get(x, x)) != x:
                up[x] = x = up.get(p, p)
            return x

        out = []
        for a, b in self.edges:
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((x, y))
        return out


def blocks_of(reps: DataFrame, least: float, size: int) -> DataFrame:
    """Reps in grid order -> block, label, dim, lo and hi of the leading coordinates, and the vectors as bytes."""
    number = number_of(reps)
    turn, eps = reps.sparkSession.sparkContext.broadcast(directions(reps)), float(np.sqrt(2 - 2 * least))

    def near(vectors: list) -> np.ndarray:
        """Coordinates along the leading directions and the norm of the rest: vectors within epsilon are within epsilon here as well."""
        x = unit(np.array(vectors, np.float64))
        d = turn.value.get(x.shape[1])
        lead = x @ d if d is not None else x[:, :LEADING]
        rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1, keepdims=True)))
        return np.concatenate([lead, rest], axis=1)

    def cells(batches):
        for b in batches:
            rows = b.column("embedding").to_pylist()
            out = [None] * len(rows)
            for dim in {len(v) for v in rows}:
                at = [i for i, v in enumerate(rows) if len(v) == dim]
                for i, c in zip(at, np.floor(near([rows[i] for i in at])[:, :-1] / eps).astype(np.int32)):
                    out[i] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    def cut(batches):
        task, k, held, at = TaskContext.get().partitionId(), 0, [], None

        def block():
            ids, counts, vectors = zip(*held)
            x = near(vectors)
            return [(task << 32) + k, *at, x.min(axis=0), x.max(axis=0), np.array(ids, np.int64).tobytes(), np.array(counts, np.int64).tobytes(), np.array(vectors, number).tobytes(), x.astype(np.float32).tobytes()]

        def batch(row):
            kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["block", "label", "dim", "lo", "hi", "ids", "counts", "vectors", "near"])

        for b in batches:
            for label, dim, rep, n, v in zip(*(b.column(c).to_pylist() for c in ("label", "dim", "rep", "n", "embedding"))):
                if held and (at != (label, dim) or len(held) == size):
                    yield batch(block())
                    held, k = [], k + 1
                at = (label, dim)
                held.append((rep, n, v))
        if held:
            yield batch(block())

    order = ["label", "dim", "cells", "rep"]
    placed = reps.mapInArrow(cells, f"label string, dim int, rep long, n long, embedding {reps.schema['embedding'].dataType.simpleString()}, cells array<int>")
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(cut, "block long, label string, dim int, lo array<double>, hi array<double>, ids binary, counts binary, vectors binary, near binary")


def met_pairs(blocks: DataFrame, least: float) -> DataFrame:
    """Pairs (first <= second) of blocks of one label whose boxes lie within epsilon; met by their cells on the first direction."""
    eps = float(np.sqrt(2 - 2 * least))
    cell = lambda x: F.floor(x / eps).cast("int")
    box = blocks.select("block", "label", "dim", "lo", "hi")
    a = box.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0]))))
    b = box.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")[0] - eps), cell(F.col("hi")[0] + eps))))
    b = b.select("label", "dim", "cell", F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gap = F.zip_with(F.zip_with("lo", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= 2 - 2 * least + ROOM
    both = a.join(b, ["label", "dim", "cell"]).where(near)
    return both.select(F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")).distinct()


def compared(blocks: DataFrame, pairs: DataFrame, least: float, number: type) -> DataFrame:
    """(a, b, n): with b null, n more links of a; else an edge of the spanning forest.

    Blocks that follow each other form groups; a row for each block and each two groups that it is
    needed in, with its partners there, so a block is sent once to each such two.
    """
    group = lambda c: F.shiftright(c, GROUP.bit_length() - 1)
    grouped = pairs.select(F.xxhash64(group("first"), group("second")).alias("cell"), "first", "second")
    asks = grouped.groupBy("cell", F.col("first").alias("block")).agg(F.collect_set("second").alias("partners"))
    asked = grouped.select("cell", F.col("second").alias("block"), F.array().cast("array<bigint>").alias("partners")).distinct()
    needed = asks.union(asked).groupBy("cell", "block").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    rows = needed.join(blocks.select("block", "dim", "ids", "counts", "vectors", "near"), "block").select("cell", "block", "partners", "dim", "ids", "counts", "vectors", "near")

    def read(d: dict) -> dict:
        vectors = np.frombuffer(d["vectors"], number).reshape(-1, d["dim"]).astype(np.float64)
        near = np.frombuffer(d["near"], np.float32).reshape(len(vectors), -1)
        return {"ids": np.frombuffer(d["ids"], np.int64), "counts": np.frombuffer(d["counts"], np.int64), "vectors": vectors, "near": near, "norms": np.linalg.norm(vectors, axis=1)}

    def found(held: dict):
        data = {block: read(d) for block, d in held.items()}
        for first, d in held.items():
            for second in d["partners"]:
                a, b = data[first], data[second]
                pair = Pair(a, b, least, first == second).run()
                ids, deg = np.concatenate([a["ids"], b["ids"]]), np.concatenate([pair.deg_a, pair.deg_b])
                ok = deg > 0
                edges = pair.forest()
                if ok.any():
                    x = [*ids[ok].tolist(), *(e[0] for e in edges)]
                    y = [None] * int(ok.sum()) + [e[1] for e in edges]
                    n = [*deg[ok].tolist(), *[None] * len(edges)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (x, y, n)], ["a", "b", "n"])

    def run(batches):
        held, now = {}, None
        for batch in batches:
            for d in batch.to_pylist():
                if d["cell"] != now:
                    yield from found(held)
                    held, now = {}, d["cell"]
                held[d["block"]] = d
        yield from found(held)

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = 0.93, size: int = 512) -> DataFrame:
    """vec_id, embedding, label -> vec_id, n_links, component_id, kept; one row for each row.

    Vectors link when labels and lengths are equal and the cosine, in double precision, is ``least``
    or more. Null ids, labels and vectors, zero vectors and those with null or non-finite parts
    link with nothing: they are their own component and kept. Labels may be of any type that has a
    text form, and are equal when that is; numbers of double precision are kept as they are. Repeated rows count as vectors of
    their own. component_id is the smallest vec_id reachable. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fine = fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    kind = "array<float>" if number_of(vectors) is np.float32 else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.when(fine, v).cast(kind).alias("embedding"))
    bounded_batches(spark)
    reps = rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    reps = scratch.keep(reps.select("label", F.size("embedding").alias("dim"), "rep", "n", "embedding"))
    blocks = scratch.keep(blocks_of(reps, least, size))
    pairs = scratch.keep(met_pairs(blocks, least))
    found = scratch.keep(compared(blocks, pairs, least, number_of(rows)))
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    linked = components(found.where("b is not null").select("a", "b"), scratch)
    info = reps.join(degree, F.col("rep") == F.col("a"), "left").join(linked, F.col("rep") == F.col("node"), "left")
    info = scratch.keep(info.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    out = rows.join(info, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE array_cosine_similarity(a.e, b.e) >= 0.93),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id, e.vec_id = coalesce(c.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""

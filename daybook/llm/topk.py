"""Operator 13, exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors become whole numbers and are indexed in blocks. For each dimension a block holds its rows as
posting segments: rows whose component has the same quantised impact, ordered by impact. A query
turns every segment into a contribution (its component times the segment's upper end) and takes the
segments of all dimensions in order of falling contribution. What is still to come can add to a row
at most the contribution of the next segment for each dimension that the row has not met, which
bounds every row's score from above. The rows of the greatest bounds are scored, and rows whose bound
is under the k-th best score known are out by proof; the search of a block stops as soon as few
others are left. Those are scored exactly.

Queries and blocks meet in cells: a block of queries and a run of index blocks, which one task reads
one by one, so that later blocks start from the scores found in earlier ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_batches, table

#: Rows of an index block; quantised impacts of a dimension in a block; index blocks of a cell; queries of a cell.
BLOCK, LEVELS, RUN, QUERIES = 2048, 32, 4, 1024
#: Parts of a block's postings after which bounds are compared; a block's rows left, over one of this many, at which exact scores are cheaper than more postings.
ROUNDS, FEW = 10, 8
#: Vectors whose squares sum to more take no part: their scores need not fit a long.
LONGEST = 1 << 61


def postings(x: np.ndarray) -> dict[str, np.ndarray]:
    """Rows x dimensions of whole numbers -> order (each dimension's rows by falling component), ends of its segments there, low and width of the impacts."""
    n, dim = x.shape
    low = x.min(axis=0)
    width = (x.max(axis=0) - low) // LEVELS + 1
    level = (x - low) // width
    order = np.argsort(-level, axis=0, kind="stable").T
    sizes = np.zeros((dim, LEVELS), np.int64)
    np.add.at(sizes, (np.broadcast_to(np.arange(dim), level.shape), LEVELS - 1 - level), 1)
    return {"order": order.astype("<u2").ravel(), "sizes": sizes, "low": low, "width": width}


class Block:
    """An index block as it is read: vectors, their numbers and the posting segments."""

    def __init__(self, dim: int, rows: bytes, ids: bytes, vectors: bytes, order: bytes, sizes: bytes, low: bytes, width: bytes):
        self.rows, self.ids = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")
        self.n, self.dim = len(self.rows), dim
        self.x = np.frombuffer(vectors, "<i8").reshape(self.n, dim)
        sizes, low, width = np.frombuffer(sizes, "<u2").astype(np.int64).reshape(dim, LEVELS), np.frombuffer(low, "<i8"), np.frombuffer(width, "<i8")
        filled = np.flatnonzero(sizes.ravel())
        self.order = np.frombuffer(order, "<u2").astype(np.intp)
        self.begins = (np.arange(dim)[:, None] * self.n + np.cumsum(sizes, axis=1) - sizes).ravel()[filled]
        self.counts, self.dims = sizes.ravel()[filled], filled // LEVELS
        #: Lower and upper ends of the segments, which stand from the greatest impact down.
        self.least = (low[:, None] + (LEVELS - 1 - np.arange(LEVELS)) * width[:, None]).ravel()[filled]
        self.greatest = self.least + width[self.dims] - 1
        self.reach = max(abs(int(self.least.min(initial=0))), abs(int(self.greatest.max(initial=0))))

    def segments(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filled segments by falling contribution, and what each adds at most."""
        qd = q[self.dims]
        most = np.maximum(qd * self.least, qd * self.greatest)
        turn = np.argsort(-most, kind="stable")
        return turn, most[turn]

    def members(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of segments, one segment after the other, and where each segment's end."""
        n = self.counts[segments]
        ends = np.cumsum(n)
        at = np.repeat(self.begins[segments] - (ends - n), n)
        at += np.arange(len(at))
        return self.order[at], n

    def possible(self, q: np.ndarray, own: int, k: int, floor: int | None) -> np.ndarray:
        """Rows that may be among the k best of the block and reach ``floor``; all others provably don't. ``own`` is the query's row."""
        other = self.rows != own
        left = np.flatnonzero(other)
        if not self.dim or len(left) <= k or int(np.abs(q).sum()) * self.reach >= 1 << 52:  # beyond, bounds would not be exact in doubles
            return left
        turn, most = self.segments(q.astype(np.float64))
        first = np.full(self.dim, -np.inf)
        np.maximum.at(first, self.dims[turn], most)
        if floor is not None and first.sum() < floor:
            return left[:0]
        upper, met = np.where(other, 0.0, -np.inf), np.zeros(self.n)
        cuts = np.searchsorted(np.cumsum(self.counts[turn]), self.n * self.dim * np.arange(1, ROUNDS + 1) // ROUNDS) + 1
        begin = 0
        for end in np.unique(cuts).tolist():
            rows, n = self.members(turn[begin:end])
            upper += np.bincount(rows, np.repeat(most[begin:end], n), self.n)
            met += np.bincount(rows, minlength=self.n)
            begin = end
            bound = upper
            if end < len(turn):
                bound = upper + np.minimum(first, most[end]).sum() - most[end] * met
            leading = np.argpartition(bound, self.n - k)[self.n - k :]
            reached = int((self.x[leading] @ q).min())  # k rows other than the query's reach this
            floor = reached if floor is None else max(floor, reached)
            left = np.flatnonzero(bound >= floor)
            if len(left) * FEW <= self.n:
                break
        return left


class Best:
    """The k best (score, id) of a query so far, ties to smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[top], ids[top]


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, embedding -> vec_id, x: floor(scale * component) of each vector that takes part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda s, c: s + F.pow(c.cast("double") * scale, F.lit(2.0)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    return rows.where(square < float(LONGEST)).select("vec_id", F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def index(vectors: DataFrame, every: int) -> DataFrame:
    """vec_id, x -> blocks (kind 1) with their postings, and blocks of the queries among their rows (kind 0)."""
    names = ["kind", "block", "dim", "rows", "ids", "vectors", "order", "sizes", "low", "width"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]

    def cut(batches):
        held: dict[tuple, list] = {}
        task, made, row = TaskContext.get().partitionId(), 0, 0

        def block(kind: int, dim: int, rows: list):
            nonlocal made
            number, ids, x = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8"), np.array([r[2] for r in rows], "<i8").reshape(len(rows), dim)
            made += 1
            out = [kind, (task << 32) + made, dim, number.tobytes(), ids.tobytes(), x.tobytes(), None, None, None, None]
            if kind and dim:
                p = postings(x)
                out[6:] = [p["order"].tobytes(), p["sizes"].astype("<u2").tobytes(), p["low"].astype("<i8").tobytes(), p["width"].astype("<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds)], names)

        for b in batches:
            for vec_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = ((task << 40) + row, vec_id, x)
                row += 1
                for kind, most in ((1, BLOCK), *(((0, QUERIES),) if vec_id % every == 0 else ())):
                    rows = held.setdefault((kind, len(x)), [])
                    rows.append(r)
                    if len(rows) == most:
                        yield block(kind, len(x), rows)
                        rows.clear()
        for (kind, dim), rows in held.items():
            if rows:
                yield block(kind, dim, rows)

    return vectors.mapInArrow(cut, "kind int, block long, dim int, rows binary, ids binary, vectors binary, order binary, sizes binary, low binary, width binary")


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100) -> DataFrame:
    """vec_id, embedding -> query_id, rank (from 1), vec_id, score: the k rows of highest inner product for each row whose vec_id is divisible by ``every``.

    Components count as floor(scale * component), in doubles. All rows but the query's own are candidates, ties go to smaller
    vec_ids; with fewer rows than k, all are returned. Rows with null ids, null vectors, or null or non-finite components take
    no part, nor do vectors so long that their scores might not fit a long (a length of about 2^30 / scale or more). Only
    vectors of one length are compared; those of no components score 0. Rows repeated with one vec_id are rows of their own,
    also as queries. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    bounded_batches(spark)
    blocks = scratch.keep(index(whole_numbers(vectors, scale), every))
    # numbers within a kind and length, so that cells need no more than counts; a row for each block
    place = F.row_number().over(Window.partitionBy("kind", "dim").orderBy("block")) - 1
    placed = scratch.keep(blocks.select("kind", "dim", "block", place.alias("place")))
    sizes = placed.groupBy("dim").agg(F.count_if(F.col("kind") == 0).alias("asked"), F.floor((F.count_if(F.col("kind") == 1) + RUN - 1) / RUN).cast("long").alias("runs"))
    met = placed.join(sizes, "dim").where("asked > 0")
    met = met.withColumn("other", F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("asked") - 1))))
    asked, run_of = F.when(F.col("kind") == 0, F.col("place")).otherwise(F.col("other")), F.when(F.col("kind") == 0, F.col("other")).otherwise(F.floor(F.col("place") / RUN))
    cells = met.select("block", "kind", "dim", F.concat_ws(":", "dim", asked.cast("string"), run_of.cast("long").cast("string")).alias("cell"))
    work = blocks.drop("kind", "dim").join(cells, "block")

    def search(batches):
        cell, queries, best = None, None, []

        def found():
            rows, ids = queries
            n = [len(b.ids) for b in best]
            if sum(n):
                cols = [np.repeat(rows, n), np.repeat(ids, n), np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "query_id", "vec_id", "score"])

        for batch in batches:
            for d in batch.to_pylist():
                if d["cell"] != cell:
                    if cell is not None:
                        yield from found()
                    cell = d["cell"]
                    queries = np.frombuffer(d["rows"], "<i8"), np.frombuffer(d["ids"], "<i8")
                    asked = np.frombuffer(d["vectors"], "<i8").reshape(len(queries[0]), d["dim"])
                    best = [Best(k) for _ in queries[0]]
                    continue
                block = Block(d["dim"], *(d[c] or b"" for c in ("rows", "ids", "vectors", "order", "sizes", "low", "width")))
                for own, q, b in zip(queries[0].tolist(), asked, best):
                    at = block.possible(q, own, k, b.floor())
                    if len(at):
                        b.offer(block.x[at] @ q, block.ids[at])
        if cell is not None:
            yield from found()

    near = work.repartition("cell").sortWithinPartitions("cell", "kind", "block").mapInArrow(search, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for every row of embeddings whose vec_id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

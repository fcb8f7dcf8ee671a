"""Comment trees: depth and order of every reply."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from daybook.operators.order import along, neighbours
from daybook.shared import bounded_batches, checkpointed, written


def thread_depths(comments: DataFrame) -> DataFrame:
    """(tree, id, parent) -> tree, id, depth, root: ancestors counted by pointer doubling.

    Every round doubles the distance each pointer spans, so a thread of depth d takes log2(d)
    joins. A parent that isn't there counts one level; a null parent is a root of depth 1. Rows on
    or above a cycle never meet a root. As every round resolves all threads up to twice the depth,
    a round that resolves nothing leaves only those, and they come back with depth and root null.
    """
    rows = comments.select("tree", "id", "parent")
    known = rows.select("tree", F.col("id").alias("parent"), F.lit(True).alias("_known"))
    start = rows.join(known, ["tree", "parent"], "left")
    dangling = F.col("parent").isNotNull() & F.col("_known").isNull()
    now = start.select("tree", "id", F.when(F.col("_known"), F.col("parent")).alias("up"), F.when(dangling, 2).otherwise(1).cast("long").alias("depth"), F.col("id").alias("root"))
    now = checkpointed(now)
    open_, before = now.where("up is not null").count(), -1
    while open_ and open_ != before:
        above = now.select("tree", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
        met = now.join(above, ["tree", "up"], "left")
        now = met.select("tree", "id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_root", "root").alias("root"))
        now = checkpointed(now)
        open_, before = now.where("up is not null").count(), open_
    return now.select("tree", "id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), F.when(F.col("up").isNull(), F.col("root")).alias("root"))


#: Comments of a tree that is ordered in one place.
SMALL = 256


def reading_order(comments: DataFrame) -> DataFrame:
    """(tree, id, parent) -> tree, id, place, size, depth: where a comment stands when a thread is read from top to bottom.

    ``place`` counts from 0 within a tree, replies below their parent and by id; ``size`` counts a comment and all below it, so
    its last reply stands at place + size - 1. Roots and replies whose parent isn't there come at the top, by id; the latter
    have depth 2. Comments on or above a cycle have nulls; of rows with one id, the one with the smallest parent counts.

    Trees of ``SMALL`` comments at most are ordered where their rows meet, many at once; larger ones of any size by ``_tour``.
    """
    rows = comments.groupBy("tree", "id").agg(F.min("parent").alias("parent"))
    if not all(isinstance(rows.schema[c].dataType, (IntegerType, LongType)) for c in ("id", "parent")):
        return _tour(rows)
    rows = written(rows)
    large = written(rows.groupBy("tree").agg(F.count("*").alias("n"), F.count("id").alias("ids")).where((F.col("n") > SMALL) | (F.col("ids") < F.col("n"))).select("tree"))
    some = large.take(1)
    small = (rows.join(large, "tree", "left_anti") if some else rows).where("tree is not null")
    kind = StructType([rows.schema["tree"], rows.schema["id"], *StructType().add("place", "long").add("size", "long").add("depth", "long")])
    trees = small.groupBy("tree").agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), F.coalesce(F.col("parent").cast("long"), F.lit(0)).alias("parent"), F.col("parent").isNotNull().alias("reply"))).alias("told"))
    bounded_batches(rows.sparkSession)
    done = trees.mapInArrow(_ordered(kind), kind)
    return done.unionByName(_tour(rows.join(large, "tree", "left_semi"))) if some else done


def _ordered(kind: StructType):
    """Reading order of whole trees, a row each: all trees of a batch as one forest, level by level."""
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parents, replies = (part.to_numpy(zero_copy_only=False) for part in b.column("told").flatten().flatten())
            of = np.repeat(np.arange(len(b)), pc.list_value_length(b.column("told")).to_numpy(zero_copy_only=False))
            by = np.lexsort((ids, of))
            ids, parents, replies, of = ids[by], parents[by], replies[by], of[by]
            place, size, depth = forest(of, ids, parents, replies)
            whole = [pa.array(v, pa.int64(), mask=depth == 0) for v in (place, size, depth)]
            yield pa.RecordBatch.from_arrays([b.column("tree").take(pa.array(of)).cast(out.field(0).type), pa.array(ids).cast(out.field(1).type), *whole], schema=out)

    return run


def forest(of: np.ndarray, ids: np.ndarray, parents: np.ndarray, replies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, size, depth of comments that lie by tree (``of``, whole numbers) and id; all 0 on or above a cycle."""
    n = len(ids)
    known = np.unique(np.concatenate([ids, parents[replies]]))
    code = of * np.int64(len(known)) + np.searchsorted(known, ids)
    want = of * np.int64(len(known)) + np.searchsorted(known, parents, side="left").clip(max=max(len(known) - 1, 0))
    at = np.searchsorted(code, want).clip(max=max(n - 1, 0))
    up = np.where(replies & (code[at] == want), at, -1)
    depth = np.where(up >= 0, 0, np.where(replies, 2, 1))
    levels = [np.flatnonzero(up < 0)]
    below = np.argsort(up, kind="stable")  # replies by parent, each parent's by id
    first, last = np.searchsorted(up[below], np.arange(n)), np.searchsorted(up[below], np.arange(n), side="right")
    while len(levels[-1]):
        now = levels[-1]
        count = (last - first)[now]
        to = below[np.repeat(first[now] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        depth[to] = np.repeat(depth[now], count) + 1
        levels.append(to)
    size = (depth > 0).astype(np.int64)
    for to in reversed(levels[1:]):
        np.add.at(size, up[to], size[to])
    place = np.zeros(n, np.int64)
    for level, to in enumerate(levels[:-1]):
        # those of one parent (of one tree at the top) lie together, in order
        group, all_before = up[to] if level else of[to], np.cumsum(size[to]) - size[to]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = all_before - np.repeat(all_before[start], np.diff(np.append(start, len(to))))
        place[to] = before + (place[up[to]] + 1 if level else 0)
    return place, size, depth


def _tour(rows: DataFrame) -> DataFrame:
    """Reading order by the tour that enters and leaves every comment below a root.

    It is a list: each step knows the next from the first reply, the next sibling or the parent, and the last one leaves the root.
    Pointer doubling sums what is left of the list behind each step, in as many joins as the longest list has binary digits; its
    end tells the root. Roots of a tree are then counted along their order. A round that ends no list leaves only cycles.
    """
    known = rows.select("tree", F.col("id").alias("parent"), F.lit(True).alias("_known"))
    nodes = written(rows.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("_known"), F.col("parent")).alias("up"), (F.col("parent").isNotNull() & F.col("_known").isNull()).alias("lost")))
    near = neighbours(nodes.where("up is not null"), ["tree", "up", "id"], ["tree", "up", "id"])
    same = F.col("tree").eqNullSafe(F.col("next_tree")) & F.col("up").eqNullSafe(F.col("next_up"))
    below = near.select("tree", "id", "up", "lost", F.when(same, F.col("next_id")).alias("sibling"))
    roots = nodes.where("up is null").select("tree", "id", "up", "lost", F.lit(None).cast(nodes.schema["id"].dataType).alias("sibling"))
    first = nodes.where("up is not null").groupBy("tree", "up").agg(F.min("id").alias("child")).withColumnRenamed("up", "id")
    linked = written(below.union(roots).join(first, ["tree", "id"], "left"))
    deep = F.when(F.col("lost"), 2).otherwise(1).cast("long")
    enter = linked.select("tree", "id", F.lit(0).alias("leaves"), F.coalesce("child", "id").alias("to"), F.col("child").isNull().cast("int").alias("to_leaves"), F.lit(1).cast("long").alias("n"), deep.alias("d"), deep.alias("own"), F.when(F.lit(False), F.col("id")).alias("root"))
    end = F.coalesce("sibling", "up")
    leave = linked.select("tree", "id", F.lit(1), end, F.col("sibling").isNull().cast("int"), F.lit(0).cast("long"), -deep, deep, F.when(end.isNull(), F.col("id")))
    now = written(enter.union(leave))
    open_, before = now.where(F.col("to").isNotNull()).count(), -1
    while open_ and open_ != before:
        behind = now.select("tree", F.col("id").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("_to"), F.col("to_leaves").alias("_leaves"), F.col("n").alias("_n"), F.col("d").alias("_d"), F.col("root").alias("_root"))
        going = now.where(F.col("to").isNotNull()).join(behind, ["tree", "to", "to_leaves"])
        going = going.select("tree", "id", "leaves", F.col("_to").alias("to"), F.col("_leaves").alias("to_leaves"), (F.col("n") + F.col("_n")).alias("n"), (F.col("d") + F.col("_d")).alias("d"), "own", F.col("_root").alias("root"))
        now = written(now.where(F.col("to").isNull()).union(going))
        open_, before = now.where(F.col("to").isNotNull()).count(), open_
    done = F.col("to").isNull()
    both = now.groupBy("tree", "id").agg(F.max(F.when(done & (F.col("leaves") == 0), F.struct("n", "d", "own", "root"))).alias("in"), F.max(F.when(done & (F.col("leaves") == 1), F.col("n"))).alias("out"))
    both = written(both.select("tree", "id", F.col("in.root").alias("root"), F.col("in.n").alias("n"), (F.col("in.n") - F.col("out")).alias("size"), (F.col("in.own") - F.col("in.d")).alias("depth")))
    tops = along(both.where(F.col("id") == F.col("root")).select("tree", "root", F.col("n").alias("_all")), "tree", "root", "_all", "_before")
    return both.join(tops, ["tree", "root"], "left").where("tree is not null").select("tree", "id", (F.col("_before") + F.col("_all") - F.col("n")).alias("place"), "size", "depth")

"""Neighbours in one order over a whole table, without bringing the table into one task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from daybook.shared import shared_dir, swept, written


def neighbours(rows: DataFrame, order: list[str], columns: list[str], circular: bool = False) -> DataFrame:
    """Rows with ``columns`` of the row before (prev_*) and of the row behind (next_*) in ascending order of all rows; null at the ends, or with ``circular`` the other end.

    Rows are dealt into ranges of the order and written once, lag and lead work inside a range, and the
    ends of each range are handed over by a table with one row a range, whose size is the number
    of partitions. ``order`` must tell rows apart, else neighbours among equal rows are any of them.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/order-{uuid.uuid4().hex}"
    swept(spark, path)
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    held = spark.read.schema(dealt.schema).parquet(path)
    key, shown = F.struct(*order), F.struct(*columns)
    ends = held.groupBy("_range").agg(F.min_by(shown, key).alias("first"), F.max_by(shown, key).alias("last")).collect()
    ends.sort(key=lambda r: r["_range"])
    kind = StructType([StructField(c, held.schema[c].dataType) for c in columns])
    edges = []
    for i, r in enumerate(ends):
        before = ends[i - 1]["last"] if i or circular else None
        after = ends[(i + 1) % len(ends)]["first"] if i + 1 < len(ends) or circular else None
        edges.append((r["_range"], before, after))
    edge = spark.createDataFrame(edges, StructType([StructField("_range", held.schema["_range"].dataType), StructField("_before", kind), StructField("_after", kind)]))
    w = Window.partitionBy("_range").orderBy(*order)
    # a struct, so that a neighbour whose values are null is told from none
    found = held.withColumn("_lag", F.lag(shown).over(w)).withColumn("_lead", F.lead(shown).over(w)).join(F.broadcast(edge), "_range")
    prev, after = F.coalesce("_lag", "_before"), F.coalesce("_lead", "_after")
    return found.select(*rows.columns, *(prev[c].alias(f"prev_{c}") for c in columns), *(after[c].alias(f"next_{c}") for c in columns))


def along(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of ``value`` over all rows of their group before them in ``order``, which tells a group's rows apart, as ``name``.

    Summed inside ranges of (group, order); only a range's first group may have begun in ranges before, and the driver hands on
    what it had there, from one row a range.
    """
    dealt = written(rows.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range", group).agg(F.sum(value).alias("n"))
    # an outer struct, so that a group that is null is told from none
    ends = sums.groupBy("_range").agg(F.min_by(F.struct(group, "n"), F.struct(group)).alias("first"), F.max_by(F.struct(group, "n"), F.struct(group)).alias("last")).collect()
    open_, starts = None, []
    for r in sorted(ends, key=lambda r: r["_range"]):
        had = open_[1] if open_ and open_[0] == r["first"][0] else 0
        starts.append((r["_range"], r["first"][0], had))
        open_ = (r["last"][0], r["last"][1] + (had if r["last"][0] == r["first"][0] else 0))
    start = rows.sparkSession.createDataFrame(starts, StructType([StructField("_range", dealt.schema["_range"].dataType), StructField("_group", dealt.schema[group].dataType), StructField("_had", LongType())]))
    w = Window.partitionBy("_range", group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0))).join(F.broadcast(start), "_range")
    return found.select(*rows.columns, (F.col(name) + F.when(F.col(group).eqNullSafe(F.col("_group")), F.col("_had")).otherwise(0)).alias(name))

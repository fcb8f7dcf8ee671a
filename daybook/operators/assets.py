"""References to images: work lists, host collapse, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.shared import checkpointed, written


def host_collapse(refs: DataFrame, min_urls: int = 5, min_share: float = 0.5) -> DataFrame:
    """(hash, host, url) -> blobs that a host serves for many of its addresses: hash, host, distinct_urls, share.

    Both thresholds are inclusive; empty hashes and hosts are ignored. Distinct addresses are
    counted by two levels of grouping, so the first one combines before the shuffle.
    """
    seen = refs.where("coalesce(hash, '') <> '' and coalesce(host, '') <> ''").select("host", "hash", "url").distinct()
    per_blob = seen.groupBy("host", "hash").agg(F.count("*").alias("distinct_urls"))
    per_host = seen.select("host", "url").distinct().groupBy("host").agg(F.count("*").alias("all_urls"))
    share = F.col("distinct_urls") / F.col("all_urls")
    return per_blob.join(per_host, "host").where((F.col("distinct_urls") >= min_urls) & (share >= min_share)).select("hash", "host", "distinct_urls", share.alias("share"))


def pending(refs: DataFrame) -> DataFrame:
    """Addresses not tried yet, each once."""
    return refs.where("fetched_at is null").select("source_url").distinct()


def image_stats(refs: DataFrame, assets: DataFrame) -> DataFrame:
    a = refs.agg(
        F.count("*").alias("refs"),
        F.count_distinct("source_url").alias("urls"),
        F.count_distinct("host").alias("hosts"),
        F.count_distinct(F.when(F.col("fetched_at").isNull(), F.col("source_url"))).alias("pending"),
        F.count_if(F.col("hash").isNull() & F.col("fetched_at").isNotNull()).alias("dead"),
    )
    b = assets.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "poison").alias("poison"))
    return a.join(F.broadcast(b))  # one row each


def live_paths(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """Address -> local path of what can be shown."""
    ok = assets.where("status = 'ok'").select("hash", "local_path")
    return refs.join(ok, "hash").groupBy("source_url").agg(F.max("local_path").alias("local_path"))


def lost_reasons(refs: DataFrame) -> DataFrame:
    """Address -> why it was not recovered."""
    lost = refs.where("hash is null and fetched_at is not null")
    reason = F.coalesce("error", F.concat(F.lit("HTTP "), F.col("http_status").cast("string")), F.lit("not recovered"))
    return lost.groupBy("source_url").agg(F.max(reason).alias("reason"))


#: Elements of a word of bits.
BITS = 64


def set_cover(pairs: DataFrame, budget: int = 16) -> list:
    """Greedy cover: up to ``budget`` items (item, element), each covering most elements not yet covered; smallest item at a tie.

    Elements get whole numbers, and an item becomes the words of 64 bits that it has numbers in: the only shuffles of pairs. A step
    counts the bits of words that are left and takes the covered ones away by and-not, word by word, so it moves a row a word instead
    of the pairs, all of it in Spark; the driver sees one item a step. Null items and elements count as items and elements.
    """
    distinct = pairs.select("item", "element").distinct()
    elements = distinct.select("element").distinct()
    order = F.struct(F.xxhash64("element").alias("hash"), "element")
    numbered = numbers(elements.withColumn("order", order), "order").select("element", "number")
    placed = distinct.join(numbered, distinct["element"].eqNullSafe(numbered["element"])).select("item", "number")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("number", F.lit(BITS)).cast("int"))
    bits = placed.groupBy("item", F.floor(F.col("number") / BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))
    left, chosen = written(bits), []
    while len(chosen) < budget:
        best = left.groupBy("item").agg(F.sum(F.bit_count("bits")).alias("n")).where("n > 0").orderBy(F.desc("n"), "item").first()
        if best is None:
            break
        chosen.append(best["item"])
        if len(chosen) == budget:
            break
        taken = left.where(F.col("item").eqNullSafe(best["item"])).select("word", F.col("bits").alias("_taken"))
        met = left.join(F.broadcast(taken) if taken.count() < 100_000 else taken, "word", "left")
        left = written(met.select("item", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_taken", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0"))
    return chosen


def numbers(rows: DataFrame, order: str) -> DataFrame:
    """Rows with ``number``, 1, 2, ... in ascending order of a column, without one task that sees them all: counted by ranges."""
    dealt = checkpointed(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in dealt.groupBy("_range").count().collect()}  # a row for each partition
    before, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    first = rows.sparkSession.createDataFrame(starts, "_range int, _first long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.withColumn("number", own).join(F.broadcast(first), "_range").withColumn("number", F.col("number") + F.col("_first")).drop("_range", "_first")

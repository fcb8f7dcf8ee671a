"""Userpics and posters of embeds: links to the blobs their bytes landed in, rows harvested from rendered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators.store import insert_missing, upsert


def _stamped(rows: DataFrame, outcomes: DataFrame, key: list[str], column: str, now: str) -> DataFrame:
    # a repeated outcome counts once; any blob is better than none
    met = outcomes.groupBy(*key).agg(F.max("hash").alias("_hash")).withColumn("_met", F.lit(True))
    taken = {column: F.col("_hash"), "fetched_at": F.lit(now)}
    return rows.join(met, key, "left").select(*(F.when(F.col("_met"), taken[c]).otherwise(F.col(c)).alias(c) if c in taken else c for c in rows.columns))


def link_userpics(userpics: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """outcomes (url, hash): every picture of a tried address gets its blob, or null; the time is set either way, so failures aren't tried again."""
    return _stamped(userpics, outcomes, ["url"], "hash", now)


def link_posters(embeds: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """outcomes (ditemid, idx, hash): the same for the posters of embeds."""
    return _stamped(embeds, outcomes, ["ditemid", "idx"], "thumb_hash", now)


def untried(rows: DataFrame) -> DataFrame:
    return rows.where("fetched_at is null")


def stats(rows: DataFrame, column: str) -> DataFrame:
    """known, stored, failed of userpics (column hash) or embeds (column thumb_hash)."""
    stored = F.col(column).isNotNull()
    return rows.agg(F.count("*").alias("known"), F.count_if(stored).alias("stored"), F.count_if(~stored & F.col("fetched_at").isNotNull()).alias("failed"))


def take_harvest(tables: dict[str, DataFrame], harvest: DataFrame) -> dict[str, DataFrame]:
    """harvest (ditemid and the columns of ``harvest_udf``) -> new userpics, entry_userpics, comment_userpics, entry_embeds.

    Known pictures stay as they are; links of entries, comments and embeds are replaced; a comment
    that the archive doesn't hold gets no link. A link seen with several pictures takes the highest.
    """
    entry = harvest.where("entry is not null").select("ditemid", "entry.*")
    comment = harvest.select(F.inline("comments"))
    shown = entry.select("picid", "userid", "url").unionByName(comment.select("picid", "userid", "url"))
    shown = shown.groupBy("picid").agg(F.min_by(F.struct("userid", "url"), "url").alias("s")).select("picid", "s.*")
    held = comment.join(tables["comments"].select(F.col("id").alias("comment_id")), "comment_id", "left_semi")
    frames = harvest.select("ditemid", F.posexplode("frames").alias("idx", "url")).groupBy("ditemid", "idx").agg(F.max("url").alias("url"))
    return {
        "userpics": insert_missing(tables["userpics"], shown, ["picid"]),
        "entry_userpics": upsert(tables["entry_userpics"], entry.groupBy("ditemid").agg(F.max("picid").alias("picid")), ["ditemid"]),
        "comment_userpics": upsert(tables["comment_userpics"], held.groupBy("comment_id").agg(F.max("picid").alias("picid")), ["comment_id"]),
        "entry_embeds": _with_embeds(tables["entry_embeds"], frames),
    }


def _with_embeds(old: DataFrame, frames: DataFrame) -> DataFrame:
    """New addresses replace old ones; what is known of the poster stays."""
    rest = old.select("ditemid", "idx", "thumb_hash", "fetched_at")
    return upsert(old, frames.join(rest, ["ditemid", "idx"], "left"), ["ditemid", "idx"])

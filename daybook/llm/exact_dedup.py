"""Operator 10, exact dedup by skew-safe combining. DataFrame functions only.

A hot text never meets in one task: each task first combines its own copies (the map side of the
first aggregate), the winners then meet by (digest, salt, text) and only the few winners of each
salt meet by (digest, text). The text is a grouping key at every stage, so equal digests of
different texts are never merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, digest=sha256, salts: int = 32) -> DataFrame:
    """doc_id, text -> doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs.

    Texts are equal when identical; null counts as empty. The largest doc_id of a group stays.
    Null doc_ids lose to all others; a group of nulls only has keep_id null and keeps them. Rows
    repeated with the winning doc_id all say kept, for they are one document. An empty table gives
    an empty result; other columns of docs, whatever their names, are not read.
    ``digest`` may be any function of the text, null too: it steers the shuffle, equality is by content.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("digest", F.coalesce(digest(F.col("text")).cast("string"), F.lit("")))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = winners.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest = groups.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    by_digest = scratch.keep(by_digest)
    clash = by_digest.where("texts > 1").select("digest")
    found = rows.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256")).join(by_digest.where("texts = 1"), "digest")
    out = found.select("doc_id", "keep_id", "group_size", "text_sha256")
    if clash.take(1):
        exact = groups.join(clash, "digest", "left_semi")
        met = rows.join(clash, "digest", "left_semi").join(exact, ["digest", "text"])
        out = out.union(met.select("doc_id", "keep_id", "group_size", F.sha2("text", 256)))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

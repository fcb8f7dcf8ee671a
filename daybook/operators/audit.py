"""Audit of rendered entries against the pages once shown: verdicts, work lists, rollups, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.harvest import stream
from daybook.functions.html import missing_run_udf
from daybook.functions.text import decode_entities, strip_tags
from daybook.sources.files import VERDICTS


def verdicts(rendered: DataFrame, shown: DataFrame) -> DataFrame:
    """rendered (ditemid, shape, html) and shown (ditemid, text, breaks) -> ditemid, shape, gap, br_diff.

    gap is the longest run of the shown text that our rendering lacks, -1 where the page shows no
    body; br_diff is the shown line breaks less ours, 0 where there is no body. Entries without a page have no verdict.
    """
    met = rendered.join(shown, "ditemid")
    ours = stream(decode_entities(strip_tags(F.coalesce("html", F.lit("")))))
    gap = F.when(F.col("text").isNull(), -1).otherwise(missing_run_udf(stream(F.col("text")), ours))
    lines = F.coalesce(F.col("breaks") - F.regexp_count(F.coalesce("html", F.lit("")), F.lit("<br>")), F.lit(0))
    return met.select("ditemid", "shape", gap.cast("int").alias("gap"), lines.cast("int").alias("br_diff"))


def _parity() -> Column:
    return (F.col("gap") == 0) & (F.coalesce("br_diff", F.lit(0)) == 0)


def retired(state: DataFrame, pictures: DataFrame) -> DataFrame:
    """ditemid of entries of which every job is done: text found and compared, breaks compared, picture known."""
    done = state.where("br_diff is not null and coalesce(gap, 0) <> -1")
    return done.join(pictures.select("ditemid"), "ditemid", "left_semi")


def to_audit(entries: DataFrame, state: DataFrame, pictures: DataFrame, recheck: bool = False) -> DataFrame:
    """Entries left to audit; ``recheck`` takes those at less than parity again as well."""
    seen = retired(state, pictures)
    return entries.join((seen.where(_parity()) if recheck else seen).select("ditemid"), "ditemid", "left_anti")


def rollup(state: DataFrame) -> DataFrame:
    """audited, parity, diverging (all that are not at parity), gaps, broken_lines, not_located."""
    return state.agg(
        F.count("*").alias("audited"), F.count_if(_parity()).alias("parity"), F.count_if(~F.coalesce(_parity(), F.lit(False))).alias("diverging"),
        F.count_if(F.col("gap") > 0).alias("gaps"), F.count_if(F.col("br_diff") != 0).alias("broken_lines"), F.count_if(F.col("gap") == -1).alias("not_located"),
    )


def still_open(state: DataFrame) -> DataFrame:
    """Entries that diverge, the widest gap first."""
    return state.where((F.col("gap") > 0) | (F.coalesce("br_diff", F.lit(0)) != 0)).orderBy(F.desc("gap"), "ditemid")


def save(state: DataFrame, folder: str) -> None:
    """Adds verdicts, with the time, to a folder of JSON lines; a killed run keeps all that were saved before."""
    state.withColumn("at", F.current_timestamp()).write.mode("append").json(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The saved verdicts, the last one of each entry."""
    kept = spark.read.schema(f"{VERDICTS}, at timestamp").json(folder)
    return kept.groupBy("ditemid").agg(F.max_by(F.struct("shape", "gap", "br_diff"), F.struct("at", "gap")).alias("v")).select("ditemid", "v.*")

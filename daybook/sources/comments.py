"""The comment export: an index of comments and posters, and pages of bodies, as XML with attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.text import comment_state


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    # text keeps its blanks; absent attributes are null
    return spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(path)


def comment_index(spark: SparkSession, path: str) -> DataFrame:
    raw = _rows(spark, path, "comment", "_id bigint, _jitemid bigint, _posterid bigint, _state string")
    return raw.select(F.col("_id").alias("id"), F.col("_jitemid").alias("jitemid"), F.nullif("_posterid", F.lit(0)).alias("posterid"), comment_state(F.col("_state")).alias("state"))


def posters(spark: SparkSession, path: str) -> DataFrame:
    raw = _rows(spark, path, "usermap", "_id bigint, _user string")
    return raw.select(F.col("_id").alias("posterid"), F.col("_user").alias("username"))


#: Of a comment in the export.
BODY = "_id bigint,_jitemid bigint,_posterid bigint,_parentid bigint,_state string,subject string,body string,date string"


def bodies_of(raw: DataFrame) -> DataFrame:
    parent = F.nullif("_parentid", F.lit(0))
    return raw.select(
        F.col("_id").alias("id"), F.col("_jitemid").alias("jitemid"), parent.alias("parentid"), F.nullif("_posterid", F.lit(0)).alias("posterid"),
        "subject", "body", "date", comment_state(F.col("_state")).alias("state"),
    )


def comment_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Deleted comments come without children: their body is null, which is not ''."""
    return bodies_of(_rows(spark, path, "comment", BODY))

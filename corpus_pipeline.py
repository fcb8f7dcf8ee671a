"""The corpus pipeline: quality, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from daybook.llm import line_dedup, packing, pii, quality, similar
from daybook.llm.common import Scratch, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The model learns from the labelled documents among docs."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, quality.ratings_of(table(spark, sf_dir, "labels"))))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document whose lines all go stays as an empty one."""
    return _with_text(line_dedup.cut_lines(docs.select(*COLUMNS)), F.col("kept_text"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are alike by 0.8 or more, the smallest doc_id stays; rows without a doc_id stay too."""
    groups = similar.similar_groups(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds."""
    found = pii.find_pii(docs.select(*COLUMNS))
    return _with_text(found, pii.redact(F.coalesce("text", F.lit("")), F.col("pii")))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, *packing.production()).drop("tag")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", one_of_each),
    ("PII", without_pii),
    ("best-fit packing", packs),
]

#: The classifier, the links of fingerprints and the packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

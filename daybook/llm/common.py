"""What the operators share: scratch tables in the shared folder, table reading, Arrow batch limits."""

from __future__ import annotations

import uuid

from daybook.shared import bounded_batches, delete, shared_dir, swept  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: White space that the contracts name: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path may belong to any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    Written tables cut lineage and outlive lost executors. ``drop`` frees one that is no longer
    read; the others go when the driver's process ends, since lazy results may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        swept(spark, self.root)
        self.count = 0

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/t{self.count}"

    def write(self, df: DataFrame, partition_by: str | None = None) -> tuple[DataFrame, str]:
        path = self.path()
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        delete(self.spark, path)

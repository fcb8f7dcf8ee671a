"""Landing zone of raw responses, and JSON documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bodies kept as a fixture, and the verdicts of an audit.
BODIES = "id bigint, context string, html string"
VERDICTS = "ditemid bigint, shape string, gap int, br_diff int"


def put(spark: SparkSession, path: str, text: str) -> None:
    """One small document as a file of any file system that Spark writes."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def capture(spark: SparkSession, send: Callable[[str], str], requests: Iterable[tuple[str, str]], folder: str) -> int:
    """(name, request) -> each raw response in a file of that name, stored before the next request is sent."""
    n = 0
    for name, body in requests:
        put(spark, f"{folder.rstrip('/')}/{name}", send(body))
        n += 1
    return n


def captured(spark: SparkSession, folder: str) -> DataFrame:
    """name, xml of the raw responses in a folder, one row a file."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("xml"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, each an array or an object over several lines; a file that is none raises when it is read."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")

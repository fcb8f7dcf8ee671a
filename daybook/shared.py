"""The folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a local session gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='daybook-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        swept(spark, found)
    return found.rstrip("/")


def checkpointed(df):
    """df written to the shared folder and read back, without its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/rdd")
    return df.checkpoint()


def written(df):
    """df written to the shared folder as Parquet and read back: without its lineage, packed, and read by columns. Goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    swept(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 20_000, mb: int = 4) -> None:
    """Bounds the Arrow batches that Python workers hold, by rows and by bytes, so that long texts don't pile up.

    These are settings of the session. Every operator sets the same two, so a result that is
    computed later runs under them whichever operator came last; smaller ones of the caller stay.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def swept(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the driver's process ends, while its session lives."""
    _made.append((spark, path))


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

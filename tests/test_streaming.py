import datetime as dt

from daybook.operators.store import Store
from daybook.schemas import TABLES
from daybook.streaming.events import into_store, windowed_counts


def test_pages_into_the_store_once(spark, tmp_path):
    kind = TABLES["users"][0]
    spark.createDataFrame([(1, "a"), (2, "b")], kind).write.parquet(f"{tmp_path}/in/p1")
    spark.createDataFrame([(2, "c")], kind).write.parquet(f"{tmp_path}/in/p2")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        pages = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        into_store(spark, pages, store, "users", f"{tmp_path}/check").awaitTermination()
    assert store.read("users").count() == 2


def test_windowed_counts(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 0, 10)
    rows = [(t + dt.timedelta(minutes=20 * i), "click") for i in range(30)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/ev")
    q = windowed_counts(stream).writeStream.format("memory").queryName("daybook_w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert all(r.n == 3 for r in spark.table("daybook_w").collect()) and spark.table("daybook_w").count() >= 6

"""Bucketed merges and transactions of the store, on the analogue tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daybook.operators.store import Store, insert_missing, update_some, upsert
from daybook.plans.registry import query
from daybook.shared import shared_dir

TABLES = {
    "entries": (StructType().add("itemid", "long", False).add("security", "string").add("fetched_at", "string"), ["itemid"]),
    "comments": (StructType().add("id", "long", False).add("jitemid", "long").add("state", "string").add("body", "string").add("fetched_at", "string"), ["id"]),
}


def archive(t, most: int = 2_000) -> Store:
    """A store of its own in the shared folder, with orders as entries and events as comments."""
    store = Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}", TABLES, most)
    entries = t.orders.select(F.col("o_orderkey").alias("itemid"), F.col("o_orderstatus").alias("security"), F.lit("2004").alias("fetched_at"))
    comments = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("jitemid"), F.lit("A").alias("state"), F.col("event_type").alias("body"), F.lit("2004").alias("fetched_at"))

    def first(tx) -> None:
        tx.write("entries", entries)
        tx.write("comments", comments)

    store.transact(first)
    return store


@query(
    "bucket_merge",
    """WITH new AS (SELECT o_orderkey AS itemid, 'second' AS security, '2006' AS fetched_at FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT o_orderkey, 'first', '2005' FROM orders WHERE o_orderkey % 97 < 2
UNION ALL SELECT max(o_orderkey) + 1, 'added', '2005' FROM orders), last AS (SELECT itemid, max_by(security, fetched_at) AS security, max(fetched_at) AS fetched_at FROM new GROUP BY 1)
SELECT * FROM last UNION ALL SELECT o_orderkey, o_orderstatus, '2004' FROM orders WHERE o_orderkey NOT IN (SELECT itemid FROM last)""",
)
def bucket_merge(t):
    """A batch with keys that come twice, new ones and known ones, merged into the buckets it falls into."""
    store, key = archive(t), F.col("o_orderkey").alias("itemid")
    new = t.orders.where("o_orderkey % 97 = 0").select(key, F.lit("second").alias("security"), F.lit("2006").alias("fetched_at"))
    new = new.union(t.orders.where("o_orderkey % 97 < 2").select(key, F.lit("first"), F.lit("2005")))
    store.upsert("entries", new.union(t.orders.agg(F.max("o_orderkey") + 1).select("*", F.lit("added"), F.lit("2005"))))
    return store.read("entries")


@query(
    "transaction",
    """SELECT 'entries' AS tab, o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'private' ELSE o_orderstatus END AS state FROM orders
UNION ALL SELECT 'comments', event_id, CASE WHEN event_id % 10 = 0 THEN 'S' ELSE 'A' END FROM events UNION ALL SELECT 'comments', max(event_id) + 1, 'S' FROM events""",
)
def transaction(t):
    """Two tables changed at once; a transaction that fails half-way leaves both as they were."""
    store = archive(t)
    entries = t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("itemid"), F.lit("private").alias("security"))
    comments = t.events.where("event_id % 10 = 0").select(F.col("event_id").alias("id")).union(t.events.agg(F.max("event_id") + 1)).select("id", F.lit("S").alias("state"))

    def both(tx) -> None:
        tx.merge("entries", entries, lambda old, new: update_some(old, new, ["itemid"], ["security"]))
        tx.merge("comments", comments, lambda old, new: update_some(old, new, ["id"], ["state"]))

    def half(tx) -> None:
        tx.merge("entries", entries.withColumn("security", F.lit("lost")), lambda old, new: upsert(old, new, ["itemid"]))
        raise ArithmeticError("half-way")

    store.transact(both)
    try:
        store.transact(half)
    except ArithmeticError:
        pass
    a = store.read("entries").select(F.lit("entries").alias("tab"), F.col("itemid").alias("id"), F.col("security").alias("state"))
    return a.union(store.read("comments").select(F.lit("comments"), "id", "state"))


@query(
    "bucket_insert",
    "SELECT event_id AS id, event_type AS body FROM events UNION ALL SELECT m + 1 + row_number() OVER (ORDER BY o_orderkey) - 1, 'new' FROM orders, (SELECT max(event_id) AS m FROM events) WHERE o_orderkey % 50 = 0",
)
def bucket_insert(t):
    """Ids that are there stay as they are, the others are added; a repeated row is added once."""
    store = archive(t)
    count, top = t.orders.where("o_orderkey % 50 = 0").count(), t.events.agg(F.max("event_id")).first()[0]
    new = t.spark.range(top - 100, top + 1 + count).select("id", F.lit("new").alias("body"), F.lit("2005").alias("fetched_at"))
    store.merge("comments", new.union(new.where("id % 7 = 0")), lambda old, rows: insert_missing(old, rows, ["id"]))
    return store.read("comments").select("id", "body")

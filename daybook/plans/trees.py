"""Comment trees, upserts and paging on the analogue tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from daybook.functions.text import host_of  # noqa: F401
from daybook.operators import store, threads
from daybook.plans.registry import query
from daybook.shared import shared_dir
from daybook.sources import paging


def chains(t):
    """Turns as replies to the turn before; every third conversation lacks its root, so its first reply dangles."""
    c = t.conversations.select(F.col("conv_id").alias("tree"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))
    return c.where("not (tree % 3 = 0 and id = 0)")


CHAINS = "ch AS (SELECT conv_id AS tree, turn AS id, CASE WHEN turn > 0 THEN turn - 1 END AS parent FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 0))"
DEPTHS = f"""WITH RECURSIVE {CHAINS}, r(tree, id, depth) AS (
SELECT tree, id, CASE WHEN parent IS NULL THEN 1 ELSE 2 END FROM ch WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM ch p WHERE p.tree = ch.tree AND p.id = ch.parent)
UNION ALL SELECT ch.tree, ch.id, r.depth + 1 FROM ch JOIN r ON ch.tree = r.tree AND ch.parent = r.id)"""


@query("thread_depth", f"{DEPTHS} SELECT tree, id, depth FROM r")
def thread_depth(t):
    return threads.thread_depths(chains(t)).select("tree", "id", "depth")


@query("deepest_thread", f"{DEPTHS} SELECT tree, id, depth FROM r ORDER BY depth DESC, tree, id LIMIT 1")
def deepest_thread(t):
    return threads.thread_depths(chains(t)).select("tree", "id", "depth").orderBy(F.desc("depth"), "tree", "id").limit(1)


@query("thread_roots", f"{DEPTHS} SELECT tree, max(depth) AS deepest, count(*) AS comments FROM r GROUP BY 1")
def thread_roots(t):
    return threads.thread_depths(chains(t)).groupBy("tree").agg(F.max("depth").alias("deepest"), F.count("*").alias("comments"))


def order_sql(nodes: str) -> str:
    """Reading order by lists of ids from the root down, over ch(tree, id, parent)."""
    return f"""WITH RECURSIVE {nodes}, r(tree, id, path, depth) AS (
SELECT tree, id, [id], CASE WHEN parent IS NULL THEN 1 ELSE 2 END FROM ch WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM ch p WHERE p.tree = ch.tree AND p.id = ch.parent)
UNION ALL SELECT ch.tree, ch.id, list_append(r.path, ch.id), r.depth + 1 FROM ch JOIN r ON ch.tree = r.tree AND ch.parent = r.id),
up AS (SELECT tree, id, count(*) AS size FROM (SELECT tree, unnest(path) AS id FROM r) GROUP BY ALL)
SELECT r.tree, r.id, row_number() OVER (PARTITION BY r.tree ORDER BY path) - 1 AS place, up.size, r.depth FROM r JOIN up USING (tree, id)"""


@query("thread_paths", order_sql(CHAINS))
def thread_paths(t):
    """Reading order of chains of replies: roots and dangling replies first, children by id below their parent."""
    return threads.reading_order(chains(t))


@query("reading_order", order_sql("ch AS (SELECT user_id % 7 AS tree, event_id AS id, CASE WHEN event_id % 101 > 0 THEN event_id // 7 * 2 END AS parent FROM events WHERE event_id > 0)"))
def reading_order(t):
    """Branching threads: every event replies to an earlier one, whose thread may be another, so that many replies dangle."""
    parent = F.when(F.col("event_id") % 101 > 0, F.floor(F.col("event_id") / 7) * 2)
    return threads.reading_order(t.events.where("event_id > 0").select((F.col("user_id") % 7).alias("tree"), F.col("event_id").alias("id"), parent.alias("parent")))


@query("upsert_entries", "SELECT o_orderkey AS itemid, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS security FROM orders UNION ALL SELECT max(o_orderkey) + 1, 'new' FROM orders")
def upsert_entries(t):
    old = t.orders.select(F.col("o_orderkey").alias("itemid"), F.col("o_orderstatus").alias("security"))
    new = old.where("itemid % 5 = 0").select("itemid").union(old.agg(F.max("itemid") + 1)).withColumn("security", F.lit("new"))
    return store.upsert(old, new, ["itemid"])


@query("partial_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'D' ELSE o_orderstatus END AS state, o_orderpriority AS body FROM orders UNION ALL SELECT max(o_orderkey) + 1, 'D', NULL FROM orders")
def partial_upsert(t):
    old = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("body"))
    new = old.where("id % 4 = 0").select("id").union(old.agg(F.max("id") + 1)).select("id", F.lit("D").alias("state"))
    return store.update_some(old, new, ["id"], ["state"])


@query("refs_upsert", "SELECT 'u' || (doc_id % 100) AS source_url, max_by(lang, doc_id) AS alt FROM documents GROUP BY 1")
def refs_upsert(t):
    rows = t.documents.select(F.concat(F.lit("u"), (F.col("doc_id") % 100).cast("string")).alias("source_url"), F.col("lang").alias("alt"), "doc_id")
    return store.last_of(rows, ["source_url"], "doc_id").select("source_url", "alt")


@query("insert_missing", "SELECT user_id, min(event_id) AS first FROM events WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT user_id, -1 FROM events WHERE user_id % 2 <> 0")
def insert_missing(t):
    old = t.events.where("user_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("first"))
    new = t.events.select("user_id", F.lit(-1).cast("bigint").alias("first"))
    return store.insert_missing(old, new, ["user_id"])


@query("poison_flag", "SELECT doc_id AS hash, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'poison' ELSE 'ok' END AS status FROM documents")
def poison_flag(t):
    assets = t.documents.select(F.col("doc_id").alias("hash"), F.lit("ok").alias("status"))
    return store.flag_poison(assets, t.labels.where("toxic = 1").select(F.col("doc_id").alias("hash")))


@query("replace_tags", "SELECT p_partkey AS itemid, CASE WHEN p_partkey % 2 = 0 THEN 'fresh' ELSE p_brand END AS tag FROM part")
def replace_tags(t):
    old = t.part.select(F.col("p_partkey").alias("itemid"), F.col("p_brand").alias("tag"))
    new = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("itemid"), F.array(F.lit("fresh"), F.lit("fresh")).alias("tags"))
    return store.replace_tags(old, new)


@query("incremental_pages", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IS NOT NULL")
def incremental_pages(t):
    """A paged source read to its end: pages of about 10,000 rows, each stored before the cursor moves."""
    return pages_stored(t.orders.select(F.col("o_orderkey").alias("id")), 10_000)


def pages_stored(rows, size: int):
    """All rows that have an id, page by page through Parquet: a page that is committed again replaces itself."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    n = paging.by_key(rows, lambda page, k: page.write.mode("overwrite").parquet(f"{root}/page={k}"), {}, "orders.start", size)
    return spark.read.schema(rows.schema).parquet(f"{root}/page=*") if n else rows.where("false")

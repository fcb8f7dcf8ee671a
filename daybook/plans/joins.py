"""Joins on the analogue tables. Dimensions of fixed size may be broadcast by Spark's own size check; nothing is forced."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.operators import assets, store
from daybook.plans.registry import query

#: References to blobs, of documents: host, hash, address; some failed and some are pending.
REFS_SQL = """refs AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 NOT IN (0, 1) THEN sha256(text) END AS hash, 'u' || (doc_id % 400) AS source_url, source AS host,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '2024' END AS fetched_at, CASE WHEN doc_id % 7 = 1 AND doc_id % 2 = 0 THEN 404 END AS http_status, CASE WHEN doc_id % 7 = 1 AND doc_id % 3 = 0 THEN 'timeout' END AS error FROM documents),
assets AS (SELECT sha256(text) AS hash, 'blobs/' || sha256(text) AS local_path, CASE WHEN min(doc_id) % 5 = 0 THEN 'poison' ELSE 'ok' END AS status FROM documents GROUP BY text)"""


def refs_of(t):
    d = t.documents
    k = F.col("doc_id") % 7
    return d.select(
        F.col("doc_id").alias("id"), F.when(k > 1, F.sha2("text", 256)).alias("hash"), F.concat(F.lit("u"), (F.col("doc_id") % 400).cast("string")).alias("source_url"), F.col("source").alias("host"),
        F.when(k != 0, F.lit("2024")).alias("fetched_at"), F.when((k == 1) & (F.col("doc_id") % 2 == 0), 404).alias("http_status"), F.when((k == 1) & (F.col("doc_id") % 3 == 0), "timeout").alias("error"),
    )


def assets_of(t):
    d = t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("m"))
    return d.select("hash", F.concat(F.lit("blobs/"), "hash").alias("local_path"), F.when(F.col("m") % 5 == 0, "poison").otherwise("ok").alias("status"))


@query("comments_with_entry", "SELECT l_orderkey AS itemid, l_linenumber AS line, strftime(o_orderdate, '%Y-%m-%d') AS eventtime FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IS NOT NULL")
def comments_with_entry(t):
    o = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("eventtime"))
    c = t.lineitem.where("l_returnflag is not null").select("l_orderkey", "l_linenumber")
    return c.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("itemid"), F.col("l_linenumber").alias("line"), "eventtime")


@query("comments_left_users", "SELECT o_orderkey AS id, c_name AS username FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END")
def comments_left_users(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("posterid"))
    return o.join(t.customer.select(F.col("c_custkey").alias("posterid"), F.col("c_name").alias("username")), "posterid", "left").select("id", "username")


@query("three_way_dims", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def three_way_dims(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("left_with_on_filter", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def left_with_on_filter(t):
    c = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("vocab_coalesce", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, n_name) AS mood FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END")
def vocab_coalesce(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("own"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("moodid"))
    return c.join(t.nation, F.col("moodid") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("own", "n_name").alias("mood"))


@query("tag_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def tag_semi(t):
    r = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(r, "o_orderkey", "left_semi")


@query("people_anti_author", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey <> coalesce((SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000001'), -1) GROUP BY 1")
def people_anti_author(t):
    me = t.customer.where("c_name = 'Customer#000000001'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").join(me, "o_custkey", "left_anti").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))


@query("conditional_key_join", "SELECT e.event_id, o.o_orderkey FROM events e LEFT JOIN lineitem l ON e.event_type = 'click' AND l.l_orderkey = e.event_id AND l.l_linenumber = 1 JOIN orders o ON o.o_orderkey = CASE WHEN e.event_type = 'click' THEN l.l_orderkey ELSE e.event_id END")
def conditional_key_join(t):
    e = t.events.select("event_id", "event_type", F.when(F.col("event_type") == "click", F.col("event_id")).alias("talk"))
    line = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("talk"), F.col("l_orderkey").alias("jitemid"))
    key = F.when(F.col("event_type") == "click", F.col("jitemid")).otherwise(F.col("event_id"))
    return e.join(line, "talk", "left").withColumn("o_orderkey", key).join(t.orders.select("o_orderkey"), "o_orderkey").select("event_id", "o_orderkey")


@query("orphans_check", "SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def orphans_check(t):
    return store.orphans(t.labels.select("doc_id"), t.documents.where("doc_id % 3 <> 0"), "doc_id", "doc_id")


@query("pending_worklist", f"WITH {REFS_SQL} SELECT DISTINCT source_url FROM refs WHERE fetched_at IS NULL")
def pending_worklist(t):
    return assets.pending(refs_of(t))


@query(
    "url_resolution_two_left",
    f"""WITH {REFS_SQL}, l AS (SELECT source_url, max(local_path) AS local_path FROM refs JOIN assets USING (hash) WHERE status = 'ok' GROUP BY 1),
x AS (SELECT source_url, max(coalesce(error, 'HTTP ' || http_status, 'not recovered')) AS reason FROM refs WHERE hash IS NULL AND fetched_at IS NOT NULL GROUP BY 1)
SELECT refs.id, coalesce(l.local_path, x.reason, 'unknown') AS shown FROM refs LEFT JOIN l USING (source_url) LEFT JOIN x USING (source_url)""",
)
def url_resolution_two_left(t):
    refs = refs_of(t)
    live, dead = assets.live_paths(refs, assets_of(t)), assets.lost_reasons(refs)
    return refs.select("id", "source_url").join(live, "source_url", "left").join(dead, "source_url", "left").select("id", F.coalesce("local_path", "reason", F.lit("unknown")).alias("shown"))


@query("referenced_blobs", f"WITH {REFS_SQL} SELECT hash FROM assets WHERE status = 'ok' AND hash IN (SELECT hash FROM refs WHERE hash IS NOT NULL)")
def referenced_blobs(t):
    return assets_of(t).where("status = 'ok'").join(refs_of(t), "hash", "left_semi").select("hash")


@query("shared_poster", "SELECT e.event_id, d.doc_id FROM events e JOIN documents d ON 'k' || (e.event_id % 50) = 'k' || d.doc_id")
def shared_poster(t):
    e = t.events.select("event_id", F.concat(F.lit("k"), (F.col("event_id") % 50).cast("string")).alias("url"))
    d = t.documents.select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("url"))
    return e.join(d, "url").select("event_id", "doc_id")

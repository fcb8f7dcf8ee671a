"""The datasets behind the pages of an archive's site, on the analogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.functions import text
from daybook.plans.registry import query


def entries_of(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(F.col("o_orderkey").alias("itemid"), day.alias("eventtime"), F.col("o_orderstatus").alias("security"), F.col("o_orderpriority").alias("mood"), F.col("o_custkey").alias("owner"))


@query(
    "entry_page",
    """WITH c AS (SELECT l_orderkey AS itemid, count(*) AS comments FROM lineitem GROUP BY 1)
SELECT o_orderkey AS itemid, strftime(o_orderdate, '%Y-%m-%d') AS eventtime, CASE o_orderstatus WHEN 'P' THEN 'private' WHEN 'F' THEN 'friends' ELSE 'public' END AS security, o_orderpriority AS mood,
coalesce(comments, 0) AS comments, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders LEFT JOIN c ON itemid = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def entry_page(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("itemid")).agg(F.count("*").alias("comments"))
    w = Window.partitionBy("owner").orderBy("eventtime", "itemid")
    label = F.when(F.col("security") == "P", "private").when(F.col("security") == "F", "friends").otherwise("public")
    e = entries_of(t).join(n, "itemid", "left")
    return e.select("itemid", "eventtime", label.alias("security"), "mood", F.coalesce("comments", F.lit(0)).alias("comments"), F.lag("itemid").over(w).alias("prev"), F.lead("itemid").over(w).alias("next"))


@query("comment_nodes", "SELECT l_orderkey AS itemid, l_linenumber AS id, CASE l_returnflag WHEN 'R' THEN 'removed' WHEN 'A' THEN 'visible' ELSE 'screened' END AS state, strftime(l_shipdate, '%B %-d, %Y') AS shown FROM lineitem")
def comment_nodes(t):
    state = F.when(F.col("l_returnflag") == "R", "removed").when(F.col("l_returnflag") == "A", "visible").otherwise("screened")
    return t.lineitem.select(F.col("l_orderkey").alias("itemid"), F.col("l_linenumber").alias("id"), state.alias("state"), F.date_format("l_shipdate", "MMMM d, yyyy").alias("shown"))


@query("rail", "SELECT year(o_orderdate)::INT AS y, count(*) AS n, count(DISTINCT strftime(o_orderdate, '%m-%d')) AS dates, sum(count(*)) OVER ()::BIGINT AS total FROM orders GROUP BY 1")
def rail(t):
    per = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.count_distinct(F.date_format("o_orderdate", "MM-dd")).alias("dates"))
    return per.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row for each year


@query("day_page", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS itemid, count(l_orderkey) AS comments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def day_page(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("itemid")).agg(F.count("*").alias("comments"))
    return entries_of(t).join(n, "itemid", "left").select(F.col("eventtime").alias("day"), "itemid", F.coalesce("comments", F.lit(0)).alias("comments"))


@query("tag_page", "SELECT p_brand AS tag, l_orderkey AS itemid, strftime(max(o_orderdate), '%Y-%m-%d') AS eventtime FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def tag_page(t):
    tags = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("tag"), F.col("l_orderkey").alias("itemid")).distinct()
    return tags.join(entries_of(t).select("itemid", "eventtime"), "itemid").select("tag", "itemid", "eventtime")


@query("otd_page", "SELECT strftime(o_orderdate, '%m-%d') AS md, year(o_orderdate)::INT AS y, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY ALL")
def otd_page(t):
    o = t.orders.groupBy(F.date_format("o_orderdate", "MM-dd").alias("md"), F.year("o_orderdate").alias("y"))
    return o.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("items"))


@query("person_page", "SELECT c_name AS name, o_orderkey AS itemid, strftime(o_orderdate, '%Y-%m-%d') AS eventtime, count(*) OVER (PARTITION BY c_custkey) AS total FROM orders JOIN customer ON o_custkey = c_custkey")
def person_page(t):
    total = t.orders.groupBy("o_custkey").agg(F.count("*").alias("total"))
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name")).join(total, "o_custkey")
    e = entries_of(t).withColumnRenamed("owner", "o_custkey")
    return e.join(c, "o_custkey").select("name", "itemid", "eventtime", "total")


@query("userpic_page", "SELECT n_name AS keyword, count(c_custkey) AS uses FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def userpic_page(t):
    uses = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("uses"))
    return t.nation.join(uses, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("keyword"), F.coalesce("uses", F.lit(0)).alias("uses"))


@query("month_page", "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS itemid, strftime(o_orderdate, '%d') AS day FROM orders")
def month_page(t):
    return t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("itemid"), F.date_format("o_orderdate", "dd").alias("day"))


@query("image_page", "SELECT sha256(text) AS hash, source AS host, min(doc_id) AS itemid, count(*) AS uses FROM documents GROUP BY ALL")
def image_page(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("hash"), F.col("source").alias("host")).agg(F.min("doc_id").alias("itemid"), F.count("*").alias("uses"))


@query("hour_slices", "SELECT hour(ts)::INT AS h, event_id FROM events")
def hour_slices(t):
    return t.events.select(F.hour("ts").alias("h"), "event_id")


@query("mood_slices", "SELECT trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def mood_slices(t):
    """Spellings that share a slug share a page."""
    return t.orders.groupBy(text.slugify(F.col("o_orderpriority")).alias("slug")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("artist_page", "SELECT p_brand AS artist, p_type AS song, count(*) AS n FROM part GROUP BY ALL")
def artist_page(t):
    return t.part.groupBy(F.col("p_brand").alias("artist"), F.col("p_type").alias("song")).agg(F.count("*").alias("n"))


@query("home_page", "SELECT o_orderkey AS itemid, strftime(o_orderdate, '%Y-%m-%d') AS eventtime FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def home_page(t):
    return entries_of(t).orderBy(F.desc("eventtime"), F.desc("itemid")).limit(30).select("itemid", "eventtime")


@query(
    "retrospect",
    """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT 'entries' AS measure, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'first', min(day) FROM d UNION ALL SELECT 'last', max(day) FROM d
UNION ALL SELECT 'busiest', (SELECT day FROM d ORDER BY n DESC, day LIMIT 1)
UNION ALL SELECT 'private_pct', (floor(count(*) FILTER (WHERE o_orderstatus = 'P') * 100 / greatest(1, count(*)) + 0.5)::BIGINT)::VARCHAR FROM orders
UNION ALL SELECT 'most_commented', (SELECT l_orderkey::VARCHAR FROM c ORDER BY n DESC, l_orderkey LIMIT 1)
UNION ALL SELECT 'top_mood', (SELECT m FROM (SELECT lower(o_orderpriority) AS m, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, m LIMIT 1)
UNION ALL SELECT 'people', count(DISTINCT o_custkey)::VARCHAR FROM orders""",
)
def retrospect(t):
    """The dashboard: one pass over the entries and one over the comments; arg-max aggregates instead of sorts."""
    e = entries_of(t)
    per_day = e.groupBy("eventtime").agg(F.count("*").alias("n"), F.count_if(F.col("security") == "P").alias("private"))
    days = per_day.agg(F.sum("n").alias("n"), F.sum("private").alias("p"), F.min("eventtime").alias("a"), F.max("eventtime").alias("b"), F.min(F.struct(-F.col("n"), "eventtime")).alias("top"))
    value = F.stack(F.lit(5), F.lit("entries"), F.col("n").cast("string"), F.lit("first"), F.col("a"), F.lit("last"), F.col("b"), F.lit("busiest"), F.col("top.eventtime"), F.lit("private_pct"), text.percent(F.col("p"), F.col("n")).cast("string"))
    out = days.select(value.alias("measure", "value"))
    busy = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), "l_orderkey")).alias("top"))
    mood = e.groupBy(F.lower("mood").alias("mood")).agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), "mood")).alias("top"))
    people = e.agg(F.count_distinct("owner").alias("n"))
    out = out.union(busy.select(F.lit("most_commented"), F.col("top.l_orderkey").cast("string"))).union(mood.select(F.lit("top_mood"), F.col("top.mood")))
    return out.union(people.select(F.lit("people"), F.col("n").cast("string")))

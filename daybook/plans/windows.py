"""Neighbours, gaps, top lists and set operations on the analogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.functions import text
from daybook.operators.order import neighbours
from daybook.plans.registry import query


@query("prev_next", "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def prev_next(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"))


@query(
    "archive_neighbours",
    "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lag(o_orderstatus) OVER w AS prev_status, lead(o_orderkey) OVER w AS next, lead(o_orderstatus) OVER w AS next_status FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)",
)
def archive_neighbours(t):
    """The entries before and behind in the order of the whole archive."""
    rows = t.orders.select("o_orderdate", "o_orderkey", "o_orderstatus")
    near = neighbours(rows, ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return near.select("o_orderkey", F.col("prev_o_orderkey").alias("prev"), F.col("prev_o_orderstatus").alias("prev_status"), F.col("next_o_orderkey").alias("next"), F.col("next_o_orderstatus").alias("next_status"))


@query(
    "circular_neighbours",
    "SELECT event_id, coalesce(lag(event_id) OVER w, (SELECT arg_max(event_id, (ts, event_id)) FROM events)) AS prev, coalesce(lead(event_id) OVER w, (SELECT arg_min(event_id, (ts, event_id)) FROM events)) AS next FROM events WINDOW w AS (ORDER BY ts, event_id)",
)
def circular_neighbours(t):
    near = neighbours(t.events.select("ts", "event_id"), ["ts", "event_id"], ["event_id"], circular=True)
    return near.select("event_id", F.col("prev_event_id").alias("prev"), F.col("next_event_id").alias("next"))


@query("month_prev_next", "SELECT month, lag(month) OVER (ORDER BY month) AS prev, lead(month) OVER (ORDER BY month) AS next FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)")
def month_prev_next(t):
    months, w = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct(), Window.partitionBy().orderBy("month")  # a row for each month
    return months.select("month", F.lag("month").over(w).alias("prev"), F.lead("month").over(w).alias("next"))


@query("otd_circular", "SELECT md, coalesce(lag(md) OVER (ORDER BY md), max(md) OVER ()) AS prev, coalesce(lead(md) OVER (ORDER BY md), min(md) OVER ()) AS next FROM (SELECT DISTINCT strftime(o_orderdate, '%m-%d') AS md FROM orders)")
def otd_circular(t):
    days, w, all_ = t.orders.select(F.date_format("o_orderdate", "MM-dd").alias("md")).distinct(), Window.partitionBy().orderBy("md"), Window.partitionBy()  # 366 rows at most
    return days.select("md", F.coalesce(F.lag("md").over(w), F.max("md").over(all_)).alias("prev"), F.coalesce(F.lead("md").over(w), F.min("md").over(all_)).alias("next"))


@query(
    "longest_gap",
    "SELECT strftime(prev, '%Y-%m-%d') AS start, strftime(day, '%Y-%m-%d') AS until, date_diff('day', prev, day) AS days FROM (SELECT day, lag(day) OVER (ORDER BY day) AS prev FROM (SELECT DISTINCT o_orderdate AS day FROM orders)) WHERE prev IS NOT NULL ORDER BY days DESC, start LIMIT 1",
)
def longest_gap(t):
    return gap_of(t.orders)


def gap_of(orders):
    """The longest run of days without an order, the earliest of several."""
    days = orders.select(F.to_date("o_orderdate").alias("day")).distinct()  # calendar days: some thousands in any archive
    gaps = days.withColumn("prev", F.lag("day").over(Window.partitionBy().orderBy("day"))).where("prev is not null")
    rows = gaps.select(F.date_format("prev", "yyyy-MM-dd").alias("start"), F.date_format("day", "yyyy-MM-dd").alias("until"), text.days_between(F.col("day"), F.col("prev")).alias("days"))
    return rows.orderBy(F.desc("days"), "start").limit(1)


@query("assign_slugs", "SELECT tag, slug FROM (SELECT tag, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY tag) = 1 THEN base ELSE base || '-' || substr(md5(tag), 1, 6) END AS slug FROM (SELECT DISTINCT p_type AS tag, trim(regexp_replace(lower(substr(p_type, 1, 8)), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part))")
def assign_slugs(t):
    tags = t.part.select(F.col("p_type").alias("tag")).distinct().withColumn("base", text.slugify(F.substring("tag", 1, 8)))
    first = F.row_number().over(Window.partitionBy("base").orderBy("tag")) == 1
    return tags.select("tag", F.when(first, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.substring(F.md5("tag"), 1, 6))).alias("slug"))


@query("embed_ordinal", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx FROM conversations")
def embed_ordinal(t):
    return t.conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("idx"))


@query("next_date", "SELECT coalesce(min(strftime(o_orderdate, '%m-%d')) FILTER (WHERE strftime(o_orderdate, '%m-%d') >= '12-25'), min(strftime(o_orderdate, '%m-%d'))) AS md FROM orders")
def next_date(t):
    return next_of(t.orders)


def next_of(orders):
    """The first month and day with an order from Christmas on, else the first of the year."""
    md = F.date_format("o_orderdate", "MM-dd")
    return orders.agg(F.coalesce(F.min(F.when(md >= "12-25", md)), F.min(md)).alias("md"))


@query("recent30", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def recent30(t):
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("top_artists", "SELECT p_brand AS artist, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 ORDER BY n DESC, first LIMIT 10")
def top_artists(t):
    return t.part.groupBy(F.col("p_brand").alias("artist")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).orderBy(F.desc("n"), "first").limit(10)


@query(
    "shape_quota",
    """WITH s AS (SELECT page_id, length(html) AS n, CASE WHEN html NOT ILIKE '%</html>%' THEN 'cut' WHEN html ILIKE '%<li%' THEN 'list' ELSE 'plain' END AS shape FROM pages)
SELECT shape, page_id FROM (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY n DESC, page_id) AS r FROM s) WHERE r <= 5""",
)
def shape_quota(t):
    shape = F.when(~F.expr("html ilike '%</html>%'"), "cut").when(F.expr("html ilike '%<li%'"), "list").otherwise("plain")
    s = t.pages.select("page_id", F.length("html").alias("n"), shape.alias("shape"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("shape").orderBy(F.desc("n"), "page_id"))).where("r <= 5").select("shape", "page_id")


@query("union_bodies", "SELECT 'entry' AS context, doc_id AS context_id, length(text) AS n FROM documents UNION ALL SELECT 'comment', conv_id * 100 + turn, length(text) FROM conversations")
def union_bodies(t):
    a = t.documents.select(F.lit("entry").alias("context"), F.col("doc_id").alias("context_id"), F.length("text").cast("bigint").alias("n"))
    b = t.conversations.select(F.lit("comment").alias("context"), (F.col("conv_id") * 100 + F.col("turn")).alias("context_id"), F.length("text").cast("bigint").alias("n"))
    return a.unionByName(b)


@query("distinct_values", "SELECT DISTINCT lang, source FROM documents")
def distinct_values(t):
    return t.documents.select("lang", "source").distinct()


@query("words_except", r"SELECT item_id, len(list_filter(list_distinct(regexp_split_to_array(trim(lower(text)), '[ \t\n\x0b\f\r]+')), lambda w: NOT list_contains(['de', 'la', 'en', 'the', 'der'], w))) AS n FROM benchmark")
def words_except(t):
    words = F.split(F.btrim(F.lower("text")), r"\s+")
    common = F.array(*(F.lit(w) for w in ("de", "la", "en", "the", "der")))
    return t.benchmark.select("item_id", F.size(F.array_except(F.array_distinct(words), common)).cast("bigint").alias("n"))


@query("union_last_wins", "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'label' ELSE 'document' END AS kind FROM (SELECT d.doc_id, max(coalesce(l.toxic, 0)) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)")
def union_last_wins(t):
    a = t.documents.select(F.col("doc_id").alias("id"), F.lit(1).alias("seq"), F.lit("document").alias("kind"))
    b = t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(2).alias("seq"), F.lit("label").alias("kind")).join(t.documents.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return a.unionByName(b).groupBy("id").agg(F.max_by("kind", "seq").alias("kind"))


@query("share_of_total", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def share_of_total(t):
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))  # a row for each type

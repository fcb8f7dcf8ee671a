"""The archive's own datasets, over tables of its shape that are made of the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.operators.archive import Archive
from daybook.plans.registry import query
from daybook.plans.trees import order_sql
from daybook.schemas import TABLES


def archive(t) -> Archive:
    """Orders as entries, line items as their comments in threads, suppliers as users, brands as tags, customers as pictures."""
    null = lambda kind: F.lit(None).cast(kind)
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30"))
    link = F.concat(F.lit('<p>see <a href="https://me.example.invalid/'), ((F.col("o_orderkey") + 1) * 256).cast("string"), F.lit('.html">next</a> <lj user="some_one"> '), "o_orderpriority", F.lit("<b>end"))
    entries = t.orders.select(
        F.col("o_orderkey").alias("itemid"), F.lit(0).alias("anum"), (F.col("o_orderkey") * 256).alias("ditemid"), stamp.alias("eventtime"), null("string").alias("logtime"), F.concat(F.lit("No. "), F.col("o_orderkey").cast("string")).alias("subject"),
        link.alias("body"), F.when(F.col("o_orderstatus") == "P", "private").when(F.col("o_orderstatus") == "F", "usemask").otherwise("public").alias("security"), null("bigint").alias("allowmask"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("mood"), F.when(F.col("o_orderkey") % 2 == 1, (F.col("o_custkey") % 5).cast("int")).alias("moodid"),
        F.concat(F.lit("Band "), (F.col("o_custkey") % 9).cast("string"), F.lit(" - "), "o_orderstatus").alias("music"), null("string").alias("location"), null("string").alias("picture_keyword"), F.create_map().cast("map<string,string>").alias("props"), F.lit("t").alias("fetched_at"),
    )
    number = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    reply = F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") * 16 + F.floor(F.col("l_linenumber") / 2))
    first = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    comments = first.select(number.alias("id"), F.col("l_orderkey").alias("jitemid"), reply.alias("parentid"), F.when(F.col("l_suppkey") % 10 > 0, F.col("l_suppkey")).alias("posterid"), null("string").alias("subject"), F.lit("told").alias("body"), F.lit("2004").alias("date"), F.lit("A").alias("state"), F.lit("t").alias("fetched_at"))
    tags = first.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("itemid"), F.col("p_brand").alias("tag")).distinct()
    made = {
        "entries": entries, "comments": comments, "entry_tags": tags, "users": t.supplier.select(F.col("s_suppkey").alias("posterid"), F.col("s_name").alias("username")),
        "moods": t.region.select(F.col("r_regionkey").alias("moodid"), F.col("r_name").alias("name"), null("int").alias("parent")),
    }
    return Archive({name: made.get(name) if name in made else t.spark.createDataFrame([], kind) for name, (kind, _) in TABLES.items()}, "Supplier#000000001", "https://me.example.invalid")


_E = """e AS (SELECT o_orderkey AS itemid, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 24 AS h, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE (SELECT r_name FROM region WHERE r_regionkey = o_custkey % 5) END AS mood, o_custkey % 9 AS band FROM orders),
c AS (SELECT l_orderkey AS itemid, l_linenumber AS k, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY ALL)"""


@query(
    "archive_slices",
    f"""WITH {_E}, x AS (SELECT 'days' AS kind, day AS slug, itemid FROM e UNION ALL SELECT 'months', day[:7], itemid FROM e UNION ALL SELECT 'years', day[:4], itemid FROM e UNION ALL SELECT 'onthisday', day[6:10], itemid FROM e UNION ALL SELECT 'hours', lpad(h::VARCHAR, 2, '0'), itemid FROM e
UNION ALL SELECT 'moods', trim(regexp_replace(lower(mood), '[^a-z0-9]+', '-', 'g'), '-'), itemid FROM e UNION ALL SELECT 'music', 'band' || band, itemid FROM e
UNION ALL SELECT DISTINCT 'tags', trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-'), c.itemid FROM c JOIN part ON p = p_partkey JOIN e ON e.itemid = c.itemid
UNION ALL SELECT DISTINCT 'people', trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-'), c.itemid FROM c JOIN supplier ON s = s_suppkey JOIN e ON e.itemid = c.itemid WHERE s % 10 > 0 AND s_name <> 'Supplier#000000001')
SELECT kind, slug, count(*) AS n, min(itemid) AS first, sum(itemid)::BIGINT AS items FROM x WHERE slug IS NOT NULL GROUP BY ALL""",
)
def archive_slices(t):
    """Every list of the site with what stands on it: days to people, by the functions that write its pages."""
    return archive(t).slices().groupBy("kind", "slug").agg(F.count("*").alias("n"), F.min("itemid").alias("first"), F.sum("itemid").alias("items"))


@query(
    "archive_comments",
    order_sql("ch AS (SELECT l_orderkey AS tree, l_orderkey * 16 + l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 16 + l_linenumber // 2 END AS parent FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))").replace(
        "SELECT r.tree, r.id, row_number() OVER (PARTITION BY r.tree ORDER BY path) - 1 AS place, up.size, r.depth FROM r JOIN up USING (tree, id)",
        "SELECT r.tree AS itemid, r.id, row_number() OVER (PARTITION BY r.tree ORDER BY path) - 1 AS place, r.depth, s_name AS who FROM r JOIN (SELECT l_orderkey * 16 + l_linenumber AS id, min(l_suppkey) AS s FROM lineitem GROUP BY 1) l USING (id) LEFT JOIN supplier ON s_suppkey = s AND s % 10 > 0",
    ),
)
def archive_comments(t):
    """Comments of all entries as their pages show them: in reading order, with depth and name, anonymous ones without."""
    return archive(t).comments().select("itemid", "id", "place", F.col("depth").cast("long").alias("depth"), "who")


@query(
    "archive_entries",
    """SELECT o_orderkey AS itemid, 'No. ' || o_orderkey AS title, CASE o_orderstatus WHEN 'P' THEN 'private' WHEN 'F' THEN 'friends' ELSE 'public' END AS security, coalesce(n, 0) AS comments,
(lag(o_orderkey) OVER w) * 256 AS prev, (lead(o_orderkey) OVER w) * 256 AS next, (SELECT count(*) FROM orders x WHERE x.o_orderkey = orders.o_orderkey + 1) AS own_links, 1 AS mentions
FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WINDOW w AS (ORDER BY strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad((o_orderkey % 24)::VARCHAR, 2, '0'), o_orderkey)""",
)
def archive_entries(t):
    """Entry pages: titles, labels, comments, neighbours in the whole archive, bodies with links to own entries that are held and to mentioned users."""
    a = archive(t)
    e = a.entries()
    shown = a.rendered(e, "entry", "itemid").select("itemid", F.regexp_count("html", F.lit(r'href="\.\./entries/\d+\.html"')).cast("long").alias("own_links"), F.regexp_count("html", F.lit('href="https://some-one.livejournal.com/"')).cast("long").alias("mentions"))
    near = a.neighbours().select("itemid", F.col("prev_ditemid").alias("prev"), F.col("next_ditemid").alias("next"))
    return e.select("itemid", "title", "security", "comments").join(near, "itemid").join(shown, "itemid")

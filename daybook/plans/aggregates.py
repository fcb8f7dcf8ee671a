"""Aggregates of the archive's dashboards on the analogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.functions import text
from daybook.operators import assets, audit, localize, pictures
from daybook.plans.joins import REFS_SQL, assets_of, refs_of
from daybook.plans.registry import query

NAMES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def day():
    return F.date_format("o_orderdate", "yyyy-MM-dd")


def first_by(df, partition: list[str], *order):
    """One row of each partition, by a total order."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NAMES))
def table_counts(t):
    out = None
    for n in NAMES:
        one = getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query(
    "asset_stats",
    f"""WITH {REFS_SQL} SELECT (SELECT count(*) FROM refs) AS refs, (SELECT count(DISTINCT source_url) FROM refs) AS urls, (SELECT count(DISTINCT host) FROM refs) AS hosts,
(SELECT count(DISTINCT source_url) FROM refs WHERE fetched_at IS NULL) AS pending, (SELECT count(*) FROM refs WHERE hash IS NULL AND fetched_at IS NOT NULL) AS dead,
(SELECT count(*) FROM assets WHERE status = 'ok') AS ok, (SELECT count(*) FROM assets WHERE status = 'poison') AS poison""",
)
def asset_stats(t):
    return assets.image_stats(refs_of(t), assets_of(t))


@query("distinct_urls", "SELECT url, count(*) AS n FROM (SELECT 'u' || (doc_id % 400) AS url FROM documents) GROUP BY 1")
def distinct_urls(t):
    return t.documents.groupBy(F.concat(F.lit("u"), (F.col("doc_id") % 400).cast("string")).alias("url")).agg(F.count("*").alias("n"))


@query(
    "host_collapse",
    """WITH s AS (SELECT DISTINCT source AS host, sha256(text) AS hash, doc_id FROM documents), b AS (SELECT host, hash, count(*) AS distinct_urls FROM s GROUP BY ALL),
h AS (SELECT host, count(DISTINCT doc_id) AS n FROM s GROUP BY 1) SELECT hash, host, distinct_urls, round(distinct_urls / n, 9) AS share FROM b JOIN h USING (host) WHERE distinct_urls >= 2 AND distinct_urls / n >= 0.04""",
)
def host_collapse(t):
    refs = t.documents.select(F.col("source").alias("host"), F.sha2("text", 256).alias("hash"), F.col("doc_id").cast("string").alias("url"))
    return assets.host_collapse(refs, 2, 0.04).withColumn("share", F.round("share", 9))


@query("year_counts", "SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1")
def year_counts(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


def month_grid(dated):
    """(y, m) rows -> every year with its twelve months, zero-filled, with the heat of each against the one peak."""
    counts = dated.groupBy("y", "m").agg(F.count("*").alias("n"))
    grid = counts.select("y").distinct().withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    peak = counts.agg(F.greatest(F.max("n"), F.lit(1)).alias("peak"))
    filled = grid.join(counts, ["y", "m"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.crossJoin(F.broadcast(peak)).select("y", "m", "n", text.heat(F.col("n"), F.col("peak")).alias("heat"))  # peak is one row


@query(
    "month_heatmap",
    """WITH c AS (SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT max(n) AS peak FROM c),
g AS (SELECT y, unnest(range(1, 13))::INT AS m FROM (SELECT DISTINCT y FROM c))
SELECT g.y, g.m, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n * 2 >= peak THEN 3 WHEN n * 5 >= peak THEN 2 ELSE 1 END AS heat FROM g LEFT JOIN c USING (y, m), p""",
)
def month_heatmap(t):
    return month_grid(t.orders.select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")))


def calendar(days):
    """day (date) -> a row for each day of the months seen: y, m, d, n, week and weekday from Sunday 0."""
    counts = days.groupBy("day").agg(F.count("*").alias("n"))
    months = counts.select(F.trunc("day", "month").alias("first")).distinct()
    grid = months.select("first", F.explode(F.sequence("first", F.last_day("first"))).alias("day"))
    blanks = F.dayofweek("first") - 1
    cells = grid.join(counts, "day", "left")
    return cells.select(
        F.year("day").alias("y"), F.month("day").alias("m"), F.day("day").alias("d"), F.coalesce("n", F.lit(0)).alias("n"),
        F.floor((F.day("day") - 1 + blanks) / 7).cast("int").alias("week"), (F.dayofweek("day") - 1).alias("weekday"),
    )


@query(
    "calendar_grid",
    """WITH c AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT DISTINCT date_trunc('month', day)::DATE AS f FROM c),
g AS (SELECT f, unnest(generate_series(f::TIMESTAMP, last_day(f)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM m)
SELECT year(day)::INT AS y, month(day)::INT AS m, day(day)::INT AS d, coalesce(n, 0) AS n, ((day(day) - 1 + dayofweek(f)) // 7)::INT AS week, dayofweek(day)::INT AS weekday FROM g LEFT JOIN c USING (day)""",
)
def calendar_grid(t):
    return calendar(t.orders.select(F.to_date("o_orderdate").alias("day")))


@query("tag_counts", "SELECT p_brand AS tag, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, tag")
def tag_counts(t):
    return t.part.groupBy(F.col("p_brand").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


@query("on_this_day", "SELECT strftime(o_orderdate, '%m-%d') AS md, count(*) AS n, count(DISTINCT year(o_orderdate)) AS years, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR DESC) AS list FROM orders GROUP BY 1")
def on_this_day(t):
    o = t.orders.select(F.date_format("o_orderdate", "MM-dd").alias("md"), F.year("o_orderdate").cast("string").alias("y"))
    per = o.groupBy("md", "y").agg(F.count("*").alias("n"))
    return per.groupBy("md").agg(F.sum("n").alias("n"), F.count("*").alias("years"), F.array_join(F.sort_array(F.collect_list("y"), asc=False), ",").alias("list"))


def year_span(first, last):
    return F.when(first.isNull(), "").when(first == last, first).otherwise(F.concat(first, F.lit("–"), last))


@query(
    "people_counts",
    """SELECT c_name AS name, count(*) AS n, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN min(year(o_orderdate))::VARCHAR ELSE min(year(o_orderdate)) || '–' || max(year(o_orderdate)) END AS span
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def people_counts(t):
    y = F.substring(F.col("o_orderdate").cast("string"), 1, 4)
    own = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(y).alias("a"), F.max(y).alias("b"))
    return own.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("name"), "n", year_span(F.col("a"), F.col("b")).alias("span"))


@query("anonymous_count", "SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0) AS anonymous, count(*) AS n FROM orders")
def anonymous_count(t):
    poster = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey"))
    return t.orders.agg(F.count_if(poster.isNull()).alias("anonymous"), F.count("*").alias("n"))


@query("top_face", "SELECT user_id, event_type AS path, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1")
def top_face(t):
    per = t.events.groupBy("user_id", F.col("event_type").alias("path")).agg(F.count("*").alias("n"))
    return first_by(per, ["user_id"], F.desc("n"), "path")


@query("person_entries", "SELECT l_suppkey AS person, l_orderkey AS itemid, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def person_entries(t):
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("itemid")).agg(F.count("*").alias("n"))
    return per.join(t.orders.select(F.col("o_orderkey").alias("itemid")), "itemid", "left_semi").select("person", "itemid", "n")


@query("pic_uses", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def pic_uses(t):
    uses = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(uses, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("month_groups", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def month_groups(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("gallery_min_alt", "SELECT hash, alt, context_id FROM (SELECT sha256(text) AS hash, CASE WHEN doc_id % 3 <> 0 THEN lang END AS alt, doc_id AS context_id, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN doc_id % 3 <> 0 THEN lang END NULLS LAST, doc_id) AS r FROM documents) WHERE r = 1")
def gallery_min_alt(t):
    d = t.documents.select(F.sha2("text", 256).alias("hash"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("alt"), F.col("doc_id").alias("context_id"))
    low = F.min(F.struct(F.col("alt").isNull().alias("none"), "alt", "context_id")).alias("low")  # a mergeable minimum: combines before the shuffle
    return d.groupBy("hash").agg(low).select("hash", "low.alt", "low.context_id")


@query(
    "hour_histogram",
    """WITH c AS (SELECT hour(ts)::INT AS h, count(*) AS n FROM events GROUP BY 1), p AS (SELECT max(n) AS peak FROM c)
SELECT g.h, coalesce(n, 0) AS n, floor(coalesce(n, 0) * 100 / peak + 0.5)::BIGINT AS pct FROM (SELECT unnest(range(24))::INT AS h) g LEFT JOIN c USING (h), p""",
)
def hour_histogram(t):
    counts = t.events.groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    grid = t.spark.range(24).select(F.col("id").cast("int").alias("h"))
    filled = grid.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("pct", text.percent(F.col("n"), F.max("n").over(Window.partitionBy())))  # 24 rows


@query("mood_top8", "SELECT lower(p_type) AS mood, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, mood LIMIT 8")
def mood_top8(t):
    return t.part.groupBy(F.lower("p_type").alias("mood")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mood").limit(8)


@query(
    "artist_display",
    """WITH a AS (SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS key, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS name, p_partkey, p_type AS song FROM part),
s AS (SELECT key, name, count(*) AS c, min(p_partkey) AS first FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, first) AS r FROM s)
SELECT r.key, r.name, (SELECT count(*) FROM a WHERE a.key = r.key) AS n, (SELECT count(DISTINCT song) FROM a WHERE a.key = r.key) AS songs FROM r WHERE r = 1""",
)
def artist_display(t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    a = t.part.select(text.music_key(F.col("p_brand")).alias("key"), name.alias("name"), "p_partkey", F.col("p_type").alias("song")).where("key <> ''")
    spelt = a.groupBy("key", "name").agg(F.count("*").alias("c"), F.min("p_partkey").alias("first"))
    shown = first_by(spelt, ["key"], F.desc("c"), "first").select("key", "name")
    return a.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("song").alias("songs")).join(shown, "key").select("key", "name", "n", "songs")


@query("artist_once", "SELECT count(*) FILTER (WHERE n = 1) AS once, count(*) AS artists, floor(count(*) FILTER (WHERE n = 1) * 100 / greatest(count(*), 1) + 0.5)::BIGINT AS pct FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def artist_once(t):
    n = t.part.groupBy("p_name").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") == 1).alias("once"), F.count("*").alias("artists")).withColumn("pct", text.percent(F.col("once"), F.col("artists")))


@query("span_days", "SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, date_diff('day', min(o_orderdate), max(o_orderdate)) AS days FROM orders WHERE strftime(o_orderdate, '%Y') > '1995'")
def span_days(t):
    o = t.orders.where(day() > "1995-12-31")
    return o.agg(F.min(day()).alias("first"), F.max(day()).alias("last"), text.days_between(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))


@query("status_pct", "SELECT floor(count(*) FILTER (WHERE o_orderstatus = 'P') * 100 / greatest(1, count(*)) + 0.5)::BIGINT AS private_pct, floor(count(*) FILTER (WHERE o_orderstatus = 'F') * 100 / greatest(1, count(*)) + 0.5)::BIGINT AS friends_pct FROM orders")
def status_pct(t):
    n = F.count("*")
    return t.orders.agg(text.percent(F.count_if(F.col("o_orderstatus") == "P"), n).alias("private_pct"), text.percent(F.count_if(F.col("o_orderstatus") == "F"), n).alias("friends_pct"))


@query("longest_entry", r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS words FROM documents ORDER BY words DESC, doc_id LIMIT 1")
def longest_entry(t):
    return t.documents.select("doc_id", text.words(F.col("text")).alias("words")).orderBy(F.desc("words"), "doc_id").limit(1)


@query("most_commented", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY n DESC, o_orderkey LIMIT 1")
def most_commented(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    met = t.orders.select("o_orderkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return met.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "o_orderkey").limit(1)


@query("busiest_day", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, day LIMIT 1")
def busiest_day(t):
    return t.orders.groupBy(day().alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1)


@query("tagged_entries", "SELECT count(DISTINCT l_orderkey) AS entries, count(DISTINCT l_partkey) AS tags, count(*) AS uses FROM lineitem")
def tagged_entries(t):
    return t.lineitem.agg(F.count_distinct("l_orderkey").alias("entries"), F.count_distinct("l_partkey").alias("tags"), F.count("*").alias("uses"))


@query("enum_tally", "SELECT l_returnflag AS state, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def enum_tally(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("state"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("userpic_stats", "SELECT count(*) AS known, count(*) FILTER (WHERE quality = 1) AS stored, count(*) FILTER (WHERE quality = 0) AS failed, count(DISTINCT doc_id) AS people FROM labels")
def userpic_stats(t):
    return t.labels.agg(F.count("*").alias("known"), F.count_if(F.col("quality") == 1).alias("stored"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_distinct("doc_id").alias("people"))


def _greedy(steps: int) -> str:
    """SQL of a greedy cover: each step takes the item with most elements left, the smallest at a tie."""
    ctes = ["p AS (SELECT DISTINCT user_id AS item, event_id % 97 AS element FROM events)", "l1 AS (SELECT * FROM p)"]
    for i in range(1, steps + 1):
        ctes.append(f"b{i} AS (SELECT item FROM l{i} GROUP BY item ORDER BY count(*) DESC, item LIMIT 1)")
        ctes.append(f"l{i + 1} AS (SELECT * FROM l{i} WHERE element NOT IN (SELECT element FROM p WHERE item IN (SELECT item FROM b{i})))")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {i}::INT AS step, item FROM b{i}" for i in range(1, steps + 1))


@query("set_cover_hosts", _greedy(4))
def set_cover_hosts(t):
    pairs = t.events.select(F.col("user_id").alias("item"), (F.col("event_id") % 97).alias("element"))
    return t.spark.createDataFrame([(i + 1, x) for i, x in enumerate(assets.set_cover(pairs, 4))], "step int, item bigint")


#: Bodies with images of a few hosts, one for each order.
BODIES = """SELECT l_orderkey, string_agg('<img src="http://S' || (l_suppkey % 5) || '.invalid/' || l_partkey || '.png">', '') AS html FROM lineitem GROUP BY 1"""


def _bodies(t):
    image = F.concat(F.lit('<img src="http://S'), (F.col("l_suppkey") % 5).cast("string"), F.lit(".invalid/"), F.col("l_partkey").cast("string"), F.lit('.png">'))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(image)), "").alias("html"))


HOSTS = r"""list_transform(regexp_extract_all(html, '(?:src|href)\s*=\s*["'']?(?:https?:)?//([^/"''\s>]+)', 1), lambda h: lower(h))"""


@query("concentrated_bodies", f"SELECT * FROM (SELECT l_orderkey, len({HOSTS}) AS refs, len(list_distinct({HOSTS})) AS hosts FROM ({BODIES})) WHERE refs >= 3 AND hosts <= 2 ORDER BY refs DESC, l_orderkey LIMIT 8")
def concentrated_bodies(t):
    return localize.concentrated(_bodies(t), "l_orderkey")


@query("refs_per_host", f"SELECT host, count(*) AS refs FROM (SELECT unnest({HOSTS}) AS host FROM ({BODIES})) GROUP BY 1")
def refs_per_host(t):
    return _bodies(t).select(F.explode(localize.hosts_in(F.col("html"))).alias("host")).groupBy("host").agg(F.count("*").alias("refs"))


@query(
    "extraction_totals",
    """SELECT count(DISTINCT l_orderkey) AS bodies, count(*) AS occurrences, count(DISTINCT (l_orderkey, l_suppkey % 5, l_partkey)) AS refs, 0::BIGINT AS users, 0::BIGINT AS embeds, 0::BIGINT AS cuts FROM lineitem""",
)
def extraction_totals(t):
    return localize.totals(_bodies(t).select("html", F.lit(None).cast("string").alias("base")))


@query("embed_stats", "SELECT count(*) AS known, count(quality) FILTER (WHERE quality = 1) AS stored, count(*) FILTER (WHERE quality IS DISTINCT FROM 1 AND toxic IS NOT NULL) AS failed FROM labels")
def embed_stats(t):
    rows = t.labels.select(F.when(F.col("quality") == 1, F.col("quality")).alias("thumb_hash"), F.col("toxic").alias("fetched_at"))
    return pictures.stats(rows, "thumb_hash")


@query("linked_userpics", "SELECT o_orderkey AS picid, CASE WHEN o_custkey % 3 = 0 THEN 'h' || o_custkey END AS hash, CASE WHEN o_custkey % 3 < 2 THEN 'now' END AS fetched_at FROM orders")
def linked_userpics(t):
    url = F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url")
    pics = t.orders.select(F.col("o_orderkey").alias("picid"), url, F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("fetched_at"))
    tried = t.orders.where("o_custkey % 3 < 2").select(url, F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("h"), F.col("o_custkey").cast("string"))).alias("hash"))
    return pictures.link_userpics(pics, tried, "now").select("picid", "hash", "fetched_at")


@query(
    "audit_rollup",
    """WITH s AS (SELECT l_linenumber % 4 - 1 AS gap, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey % 2 END AS br_diff FROM lineitem)
SELECT count(*) AS audited, count(*) FILTER (WHERE gap = 0 AND coalesce(br_diff, 0) = 0) AS parity, count(*) FILTER (WHERE NOT (gap = 0 AND coalesce(br_diff, 0) = 0)) AS diverging,
count(*) FILTER (WHERE gap > 0) AS gaps, count(*) FILTER (WHERE br_diff <> 0) AS broken_lines, count(*) FILTER (WHERE gap = -1) AS not_located FROM s""",
)
def audit_rollup(t):
    s = t.lineitem.select((F.col("l_linenumber") % 4 - 1).alias("gap"), F.when(F.col("l_suppkey") % 7 > 0, F.col("l_suppkey") % 2).alias("br_diff"))
    return audit.rollup(s)


@query(
    "entries_to_audit",
    """SELECT o_orderkey AS ditemid FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0)""",
)
def entries_to_audit(t):
    o = t.orders.select(F.col("o_orderkey").alias("ditemid"), "o_custkey")
    state = o.where("ditemid % 3 > 0").select("ditemid", F.when(F.col("ditemid") % 5 > 0, 0).otherwise(-1).alias("gap"), F.lit(0).alias("br_diff"))
    return audit.to_audit(o.select("ditemid"), state, o.where("o_custkey % 2 = 0"))

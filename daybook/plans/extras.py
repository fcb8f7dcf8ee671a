"""Beyond the archive's own operators: windows over time, rollups, functions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions import sqltext
from daybook.plans.registry import query
from daybook.plans.scalars import SLUG
from daybook.streaming.sessions import activity


@query("tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(t):
    w = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", "total")


@query(
    "sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(t):
    s = t.events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("year_month_rollup", "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def year_month_rollup(t):
    return t.orders.select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).rollup("y", "m").agg(F.count("*").alias("n"))


@query(
    "active_and_silent",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), r AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 24 HOUR AS b, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id AS owner, 'active' AS status, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS at, 0::BIGINT AS n FROM r UNION ALL SELECT user_id, 'silent', strftime(b, '%Y-%m-%d %H:%M:%S.%f'), n FROM r""",
)
def active_and_silent(t):
    return activity(t.events, "24 hours").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "sql_functions",
    rf"""WITH d AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, CASE WHEN f = '' THEN '(no subject)' WHEN length(f) > 40 THEN regexp_replace(substr(f, 1, 40), '[ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]*$', '') || '…' ELSE f END AS title, {SLUG.format("source || ' ' || lang")} AS slug,
len(list_filter(regexp_split_to_array(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS words, 'entries/' || doc_id || '.html' AS path FROM d""",
)
def sql_functions(t):
    """A statement that only calls functions of the archive."""
    sqltext.create(t.spark)
    statement = "SELECT doc_id, entry_title(NULL, text, 40) AS title, slugify(source || ' ' || lang) AS slug, word_count(text) AS words, entry_path(doc_id) AS path FROM {docs}"
    return t.spark.sql(statement, docs=t.documents)

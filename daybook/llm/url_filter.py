"""Operator 1, URL filters as a temporal list join.

List entries are dated additions and removals. They become validity intervals per list and
pattern; an as-of join then finds, for every capture, the entries active when it was fetched. A
capture is looked up by the suffixes of its host, by host and first path step, and by its whole
address.

The as-of join never makes pairs of intervals and captures: starts of intervals and the distinct
days on which a listed pattern was captured stand in one sorted sequence for each entry, and the
last start is carried forward along it. A pattern has a row for each day at most, whatever the
number of its captures, so a host that holds a third of them is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

FOREVER = "9999-12-31"


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, action (add or remove), day -> list, kind, pattern, start, until (exclusive) of the times an entry is active.

    On one day a removal beats an addition; repeated events change nothing. Rows with a null
    list, kind, pattern, action or day are left out. An addition without removal holds for ever.
    """
    key = ["list", "kind", "pattern"]
    events = entries.dropna(subset=[*key, "action", "day"]).groupBy(*key, "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy(*key).orderBy("day"))
    return events.withColumn("until", F.coalesce(until, F.to_date(F.lit(FOREVER)))).where("action = 'add'").select(*key, F.col("day").alias("start"), "until")


def plain(url: Column) -> Column:
    """An address as browsers read its host: without blanks around it and line breaks in it, with slashes for backslashes, two slashes behind a scheme of the web, http where it begins with two slashes."""
    bare = F.replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", ""), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(bare, r"^//+", "http://"), r"^(?i)(https?|ftp|wss?):/*", "$1://")


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and dots at its end, addresses of version 6 in their brackets; '' where there is none."""
    return F.lower(F.regexp_extract(plain(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)*(\[[^\]/?#@]*\]|[^/?#:@]*?)\.*(?:[/?#:].*)?$", 1))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    steps = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "."))


def first_step(url: Column) -> Column:
    """Host and first step of the path."""
    return F.concat(host_of(url), F.lit("/"), F.regexp_extract(plain(url), r"^[^:]*://[^/?#]*/([^/?#]*)", 1))


def as_of(days: DataFrame, valid: DataFrame) -> DataFrame:
    """(kind, pattern, day) and intervals -> kind, pattern, day, list of the intervals that hold on that day."""
    asked = days.join(valid.select("list", "kind", "pattern").distinct(), ["kind", "pattern"])
    starts = valid.select("list", "kind", "pattern", F.col("start").alias("day"), F.struct("start", "until").alias("held"))
    both = starts.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("held", F.lit(None).cast("struct<start:date,until:date>")).withColumn("asks", F.lit(1)))
    along = Window.partitionBy("list", "kind", "pattern").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("held", F.last("held", ignorenulls=True).over(along))
    return carried.where("asks = 1 and day < held.until").select("kind", "pattern", "day", "list")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched date) and dated entries -> page_id, url, host, fetched, n_entries, lists, blocked.

    n_entries counts the active entries that match, lists names their lists, sorted and joined by
    commas ('' for none). Null addresses and dates match nothing; an address without a host is only
    looked up as a whole. Repeated captures come back as often. Empty lists block nothing. Other
    columns are not read. Intervals and matches are written on the way, as both are read more than once.
    """
    scratch = Scratch(captures.sparkSession, "urls")
    rows = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"), first_step(F.col("url")).alias("step"))
    known = rows.where("url is not null and fetched is not null")
    named = known.where("host <> ''")
    hosts = named.select("host", F.col("fetched").alias("day")).distinct().select("host", "day", F.explode(suffixes(F.col("host"))).alias("pattern"))

    def pairs(kind: str, of: DataFrame) -> DataFrame:
        return of.select(F.lit(kind).alias("kind"), "pattern", "day").distinct()

    steps, urls = named.select(F.col("step").alias("pattern"), F.col("fetched").alias("day")), known.select(F.col("url").alias("pattern"), F.col("fetched").alias("day"))
    hits = as_of(pairs("domain", hosts).union(pairs("path", steps)).union(pairs("url", urls)), scratch.keep(intervals(entries)))
    lists = scratch.keep(hits.groupBy("kind", "pattern", "day").agg(F.sort_array(F.collect_list("list")).alias("names")))

    def of_kind(kind: str, column: str) -> DataFrame:
        return lists.where(F.col("kind") == kind).select(F.col("pattern").alias(column), F.col("day").alias("fetched"), F.col("names").alias(f"in_{kind}"))

    domains = hosts.withColumnRenamed("day", "fetched").join(of_kind("domain", "pattern"), ["pattern", "fetched"])
    domains = domains.groupBy("host", "fetched").agg(F.flatten(F.collect_list("in_domain")).alias("in_domain"))
    met = rows.join(domains, ["host", "fetched"], "left").join(of_kind("path", "step"), ["step", "fetched"], "left").join(of_kind("url", "url"), ["url", "fetched"], "left")
    none = F.array().cast("array<string>")
    found = F.concat(*(F.coalesce(f"in_{kind}", none) for kind in ("domain", "path", "url")))
    out = met.select("page_id", "url", "host", "fetched", found.alias("found"))
    return out.select("page_id", "url", "host", "fetched", F.size("found").cast("long").alias("n_entries"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("lists"), (F.size("found") > 0).alias("blocked"))


def captured(pages: DataFrame) -> DataFrame:
    """The tables have no fetch dates: page_id stands for the day, over 360 days."""
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("page_id", F.lit(360)).cast("int")).alias("fetched"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Dated entries over all hosts, paths and addresses of the pages, made by rule: the tables have no lists.

    m, the smallest page_id of a pattern, gives the days. Every third host is on "hosts" from day
    m % 200 for 60 + m % 50 days and, where m is even, again from 100 days after that; every
    fifth path is on "paths" from day m % 300; every seventh address is on "pages" from day
    m % 100 to m % 100 + 150; example.net is on "domains" for days 50 to 119 and from day 200.
    """
    day = lambda x: F.date_add(F.to_date(F.lit("2024-01-01")), x.cast("int"))
    host, url = host_of(F.col("url")), F.col("url")
    keys = {"domain": F.when(host != "", host), "path": F.when(host != "", first_step(url)), "url": url}
    key = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("pattern")) for k, v in keys.items())))
    low = pages.select("page_id", key).where("pattern is not null").groupBy("kind", "pattern").agg(F.min("page_id").alias("m"))
    m = F.col("m")

    def event(names: DataFrame, name: str, action: str, when: Column) -> DataFrame:
        return names.select(F.lit(name).alias("list"), "kind", "pattern", F.lit(action).alias("action"), day(when).alias("day"))

    hosts, paths, urls = low.where("kind = 'domain' and m % 3 = 0"), low.where("kind = 'path' and m % 5 = 0"), low.where("kind = 'url' and m % 7 = 0")
    gone = m % 200 + 60 + m % 50
    out = event(hosts, "hosts", "add", m % 200).union(event(hosts, "hosts", "remove", gone)).union(event(hosts.where("m % 2 = 0"), "hosts", "add", gone + 100))
    out = out.union(event(paths, "paths", "add", m % 300)).union(event(urls, "pages", "add", m % 100)).union(event(urls, "pages", "remove", m % 100 + 150))
    fixed = pages.sparkSession.createDataFrame([("domains", "domain", "example.net", a, d) for a, d in (("add", 50), ("remove", 120), ("add", 200))], "list string, kind string, pattern string, action string, d int")
    return out.union(fixed.select("list", "kind", "pattern", "action", day(F.col("d"))))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page, as a capture, with the entries that hold on its day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(captured(pages), dated_lists(pages)).withColumn("fetched", F.col("fetched").cast("string"))


SQL = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 360)::INT AS fetched,
                  rtrim(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)*(\[[^\]/?#@]*\]|[^/?#:@]*)', 2)), '.') AS host,
                  regexp_extract(u, '^[^:]*://[^/?#]*/([^/?#]*)', 1) AS step
           FROM (SELECT *, regexp_replace(regexp_replace(replace(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]', '', 'g'), chr(92), '/'), '^//+', 'http://'), '(?i)^(https?|ftp|wss?):/*', '\1://') AS u FROM pages)),
s AS (SELECT page_id, host, string_split(host, '.') AS p FROM c),
x AS (SELECT page_id, host, 'domain' AS kind, array_to_string(list_slice(p, i, len(p)), '.') AS pattern FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM s)),
k AS (SELECT * FROM x UNION ALL SELECT page_id, host, 'path', host || '/' || step FROM c UNION ALL SELECT page_id, host, 'url', url FROM c),
low AS (SELECT kind, pattern, min(page_id) AS m FROM k WHERE kind <> 'domain' OR pattern = host GROUP BY ALL),
ev(list, kind, pattern, s, e) AS (
  SELECT 'hosts', kind, pattern, m % 200, m % 200 + 60 + m % 50 FROM low WHERE kind = 'domain' AND m % 3 = 0
  UNION ALL SELECT 'hosts', kind, pattern, m % 200 + 160 + m % 50, 1000000 FROM low WHERE kind = 'domain' AND m % 3 = 0 AND m % 2 = 0
  UNION ALL SELECT 'paths', kind, pattern, m % 300, 1000000 FROM low WHERE kind = 'path' AND m % 5 = 0
  UNION ALL SELECT 'pages', kind, pattern, m % 100, m % 100 + 150 FROM low WHERE kind = 'url' AND m % 7 = 0
  UNION ALL SELECT 'domains', 'domain', 'example.net', 50, 120 UNION ALL SELECT 'domains', 'domain', 'example.net', 200, 1000000),
h AS (SELECT k.page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS names FROM k JOIN ev USING (kind, pattern)
      WHERE ev.s <= k.page_id % 360 AND k.page_id % 360 < ev.e GROUP BY 1)
SELECT c.page_id, c.url, c.host, strftime(c.fetched, '%Y-%m-%d') AS fetched, coalesce(n, 0) AS n_entries, coalesce(names, '') AS lists, coalesce(n, 0) > 0 AS blocked
FROM c LEFT JOIN h USING (page_id)
"""

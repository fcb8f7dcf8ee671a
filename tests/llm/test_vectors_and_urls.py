import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from daybook.llm import embed_dedup, url_filter


def slow(rows, least=0.93):
    ok = [i for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float64(np.float32(rows[a][1])), np.float64(np.float32(rows[b][1]))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    n[a] += 1
                    n[b] += 1
                    up[root(a)] = root(b)
    low = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            low[root(i)] = min(rows[i][0], low.get(root(i), rows[i][0]))
    return [(rows[i][0], n[i], low.get(root(i)), rows[i][0] == low.get(root(i))) for i in range(len(rows))]


def vectors(n=500, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.5])
        rows.append((int(i), [float(np.float32(x)) for x in v], int(rng.integers(3))))
    copies = random.Random(seed).choices(rows, k=60)
    rows += [(1000 + i, v, lab) for i, (_, v, lab) in enumerate(copies)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, [float("inf")] * 16, 1)]
    return rows + [(2005, rows[0][1], None), (None, rows[0][1], 1), (2006, [1.0, 2.0], 1), (2007, [1.0, 2.1], 1), (2008, [], 1)]


def test_vectors_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("cells", F.lit(0)).repartition(4)
    got = [tuple(r) for r in embed_dedup.near_vectors(df, size=40).collect()]
    want = [(v, n, c, k) if v is not None else (None, 0, None, True) for v, n, c, k in slow(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_vectors(df).count() == 0


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_urls_as_of(spark):
    events = [
        ("l", "domain", "bad.org", "add", 10), ("l", "domain", "bad.org", "remove", 20), ("l", "domain", "bad.org", "add", 30), ("m", "domain", "x.bad.org", "add", 0),
        ("p", "path", "ok.org/spam", "add", 5), ("u", "url", "http://ok.org/one", "add", 5), ("l", "domain", "same.org", "add", 5), ("l", "domain", "same.org", "remove", 5), ("l", "domain", None, "add", 1),
    ]
    entries = spark.createDataFrame([(a, b, c, d, day(e)) for a, b, c, d, e in events], '`list` string, kind string, pattern string, action string, day date')
    urls = ["http://bad.org/a", "http://X.bad.org:8/a", "http://notbad.org/", "http://ok.org/spam/1", "http://ok.org/spammy", "http://ok.org/one", "http://same.org/", "no address", None]
    captures = [(i * 100 + t, u, day(t)) for i, u in enumerate(urls) for t in (0, 9, 10, 19, 20, 29, 30, 99)] + [(5000, urls[0], None), (5001, urls[0], day(10)), (5001, urls[0], day(10))]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched date").withColumn("pattern", F.lit("x")).withColumn("start", F.lit(1))

    def active(name, kind, pattern, t):
        past = [(d, a) for n, k, p, a, d in events if (n, k, p) == (name, kind, pattern) and d <= t]
        return bool(past) and max(past)[1] == "add"

    for r in url_filter.filter_urls(df, entries).collect():
        hits = set()
        if r.url and r.fetched:
            t, host = (r.fetched - day(0)).days, r.host
            for name, kind, pattern, *_ in events:
                fits = pattern and (kind == "domain" and (host == pattern or host.endswith("." + pattern)) or kind == "path" and r.url.split("//")[-1].split("/")[:2] == pattern.split("/") or kind == "url" and r.url == pattern)
                if fits and active(name, kind, pattern, t):
                    hits.add((name, pattern))
        assert r.n_entries == len(hits) and r.lists == ",".join(sorted({n for n, _ in hits})) and r.blocked == bool(hits), r
    assert url_filter.filter_urls(df.limit(0), entries).count() == 0
    assert url_filter.filter_urls(df, entries.limit(0)).where("blocked").count() == 0


def test_hosts_without_user_port_and_last_dot(spark):
    urls = {
        "http://bad.org/": "bad.org", "http://user@bad.org/": "bad.org", "http://u:p@bad.org/x": "bad.org", "http://bad.org./": "bad.org", "HTTPS://U@BAD.org.:80?q": "bad.org", "http://good.org@bad.org/": "bad.org",
        "http://good.org/@bad.org": "good.org", "http://bad.org": "bad.org", "http://bad.org.": "bad.org", "http://a@b@bad.org/": "bad.org", "http://good.org?u@bad.org": "good.org", "no address": "", "http://": "", "mailto:a@bad.org": "",
        "http://bad.org\\@good.org/": "bad.org", " http://bad.org/": "bad.org", "\thttp://bad.org\n": "bad.org", "http://bad.org../": "bad.org", "//bad.org/": "bad.org", "\\\\bad.org/": "bad.org", "http:/bad.org/": "bad.org", "HTTPS:bad.org": "bad.org",
        "ht\ntp://bad.org/": "bad.org", "http://[2001:DB8::1]:80/x": "[2001:db8::1]", "http://u@[::1]/": "[::1]", "http://[::1": "[", "ftp:///bad.org": "bad.org", "gopher://bad.org/": "bad.org", "https://": "",
    }
    df = spark.createDataFrame([(i, u, day(0)) for i, u in enumerate(urls)], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("l", "domain", "bad.org", "add", day(0))], "`list` string, kind string, pattern string, action string, day date")
    for r in url_filter.filter_urls(df, entries).collect():
        assert r.host == urls[r.url] and r.blocked == (r.host == "bad.org"), r
    pages = df.drop("fetched")
    pages.createOrReplaceTempView("url_hosts")
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [tuple(r) for r in pages.collect()])
    got = url_filter.filter_urls(url_filter.captured(pages), url_filter.dated_lists(pages)).selectExpr("page_id", "url", "host", "n_entries", "lists")
    want = con.execute(f"SELECT page_id, url, host, n_entries, lists FROM ({url_filter.SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_intervals_and_captures_of_one_pattern_do_not_multiply(spark):
    """10,000 intervals of one entry and 100,000 captures of its host: the largest table on the way is about their sum."""
    events = spark.range(10_000).selectExpr("'l' AS list", "'domain' AS kind", "'hot.org' AS pattern", "explode(array(struct('add' AS action, date_add(date'1990-01-01', cast(id * 2 AS int)) AS day), struct('remove' AS action, date_add(date'1990-01-01', cast(id * 2 + 1 AS int)) AS day))) AS e").select("list", "kind", "pattern", "e.*")
    captures = spark.range(100_000).selectExpr("id AS page_id", "concat('http://hot.org/', id) AS url", "date_add(date'1990-01-01', cast(id % 20000 AS int)) AS fetched")
    got = url_filter.filter_urls(captures, events)
    assert got.where("blocked").count() == 50_000 and got.where("blocked and datediff(fetched, date'1990-01-01') % 2 = 1").count() == 0
    days = spark.range(20_000).selectExpr("'domain' AS kind", "'hot.org' AS pattern", "date_add(date'1990-01-01', cast(id AS int)) AS day")
    assert url_filter.as_of(days, url_filter.intervals(events)).count() == 10_000


def test_double_vectors_and_text_labels_keep_their_types(spark):
    """A pair just at the limit in double precision, which single precision would lose, and labels that are no numbers."""
    base, other = np.zeros(16), np.zeros(16)
    base[0], other[0], other[1] = 1.0, 0.93 + 1e-12, np.sqrt(1 - 0.93**2)
    under = other.copy()
    under[0] = 0.93 - 1e-9
    rows = [(1, base.tolist(), "a"), (2, other.tolist(), "a"), (3, (-base).tolist(), "a"), (4, base.tolist(), "b"), (5, under.tolist(), "b"), (6, base.tolist(), None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_vectors(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6)]


def test_many_small_blocks_in_groups(spark):
    rows = vectors(900, seed=9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = [tuple(r) for r in embed_dedup.near_vectors(df, size=7).collect()]
    want = [(v, n, c, k) if v is not None else (None, 0, None, True) for v, n, c, k in slow(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)

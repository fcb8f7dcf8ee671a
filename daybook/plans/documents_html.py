"""HTML operators over the pages, and the XML sources over documents of our own."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from daybook import sql
from daybook.functions import html, scrub, text
from daybook.plans.registry import query
from daybook.shared import shared_dir, swept, written
from daybook.sources import comments, fetch, xmlrpc


@query("html_links", """SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]*$', ''), '<a\\s[^>]*href="[^"]+"[^>]*>')) AS links FROM pages""")
def html_links(t):
    found = html.extract_udf(F.col("html"), F.col("url"))
    return t.pages.select("page_id", F.size(found["links"]).cast("bigint").alias("links"))


@query(
    "html_references",
    r"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS origin, unnest(regexp_extract_all(regexp_replace(html, '<[^>]*$', ''), '<a\s[^>]*href="(/[^"]*)"[^>]*>', 1)) AS path FROM pages)
SELECT page_id, origin || array_to_string(list_transform(string_split(path, ''), lambda c: CASE WHEN ord(c) > 126 OR c IN (' ', '<', '>', '^', '`', '{', '|', '}', chr(92)) THEN url_encode(c) ELSE c END), '') AS link,
lower(regexp_extract(origin, '^[a-z]+://(.+)$', 1)) AS host FROM l""",
)
def html_references(t):
    """Absolute addresses of all links of a page, with the host each leads to."""
    found = t.pages.select("page_id", F.explode(html.extract_udf(F.col("html"), F.col("url"))["links"]).alias("link"))
    return found.select("page_id", "link", text.host_of(F.col("link")).alias("host"))


EMPTY = "map<string,string>"


@query(
    "html_extract",
    """SELECT doc_id, 'https://me.example.invalid/a' || doc_id || '.png|https://me.example.invalid/b.jpg' AS images, lower(source) || '_x' AS users, 'iframe|lj-embed' AS embeds, 'https://v.example.invalid/' || doc_id || '|' || lang AS addresses,
doc_id % 2 = 0 AS has_cut, CASE WHEN doc_id % 2 = 0 THEN lang END AS cut_text FROM documents""",
)
def html_extract(t):
    """Bodies of tag soup around every text: an image, a link to one, a mention, embeds, a cut that never ends."""
    n = F.col("doc_id").cast("string")
    cut = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<lj-cut text="'), "lang", F.lit('"><b>')))
    parts = [F.lit('<p>one<img src="a'), n, F.lit('.png" alt="x"><a href="b.jpg">two</a>\n'), text.escape_html(F.coalesce("text", F.lit(""))), F.lit('<lj user="'), F.upper("source"), F.lit('_X">'), F.coalesce(cut, F.lit(""))]
    parts += [F.lit('<iframe src="https://v.example.invalid/'), n, F.lit('"></iframe><script>var a = "<img src=c.png>";</script><lj-embed id="'), F.col("lang"), F.lit('"> end <a href="')]
    x = html.extract_udf(F.concat(*parts), F.lit("https://me.example.invalid/1.html"))
    joined = lambda c: F.array_join(c, "|")
    return t.documents.select("doc_id", joined(x["images"]["url"]).alias("images"), joined(x["users"]).alias("users"), joined(x["embeds"]["tag"]).alias("embeds"), joined(x["embeds"]["url"]).alias("addresses"), x["has_cut"].alias("has_cut"), x["cut_text"].alias("cut_text"))


@query(
    "html_render_stats",
    """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations)
SELECT conv_id, turn, length(x) - length(replace(x, chr(10), '')) + 1 AS breaks, true AS whole, 3 AS lost, false AS active, md5(x) AS words FROM c""",
)
def html_render_stats(t):
    """Every turn as a body with a poll, an embed, a lost image, a handler, an unfinished cut and a table, where line breaks are none."""
    body = text.escape_html(F.coalesce("text", F.lit("")))
    raw = F.concat(F.lit('<lj-poll-7>\n<b onclick="y()"><q>'), body, F.lit('</q><iframe src="https://v.example.invalid/1">no</iframe><img src="gone.png"><script>x()</script><table>\n<tr><td>a\nb</table><lj-cut><a href="javascript:x()">the end'))
    none, held = F.create_map().cast(EMPTY), F.array(F.lit(1).cast("bigint"))
    out = t.conversations.select("conv_id", "turn", html.render_column(raw, none, none, held, F.lit("me.example.invalid"), F.lit(False)).alias("h"))
    quoted = F.regexp_extract("h", "(?s)<q>(.*)</q>", 1)
    for sign, entity in (("<br>\n", "\n"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        quoted = F.replace(quoted, F.lit(sign), F.lit(entity))
    return out.select(
        "conv_id", "turn", F.regexp_count("h", F.lit("<br>")).cast("bigint").alias("breaks"), F.contains("h", F.lit("the end</a></details></b>")).alias("whole"),
        F.regexp_count("h", F.lit('class="lost')).alias("lost"), F.col("h").rlike("(?i)<script|onclick|javascript:").alias("active"), F.md5(quoted).alias("words"),
    )


@query("lateral_links", """SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]*$', ''), '<a\\s[^>]*href="[^"]+"[^>]*>'))::BIGINT AS links FROM pages""")
def lateral_links(t):
    """The links of pages by a table function in SQL, counted with their places."""
    sql.register(t.spark)
    t.pages.createOrReplaceTempView("daybook_pages")
    return t.spark.sql("SELECT page_id, count(l.url) AS links FROM daybook_pages LEFT JOIN LATERAL page_links(html, url) AS l GROUP BY page_id")


@query(
    "gaps_by_owner",
    """WITH d AS (SELECT DISTINCT user_id::VARCHAR AS owner, ts::DATE AS day FROM events), g AS (SELECT owner, lag(day) OVER w AS start, day AS until FROM d WINDOW w AS (PARTITION BY owner ORDER BY day))
SELECT owner, start::VARCHAR AS start, until::VARCHAR AS until, (until - start)::INT AS days FROM g WHERE start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner ORDER BY until - start DESC, start) = 1""",
)
def gaps_by_owner(t):
    """The longest silence of each user, by a table function over whole groups in their order."""
    sql.register(t.spark)
    t.events.select(F.col("user_id").cast("string").alias("owner"), F.to_date("ts").alias("day")).distinct().createOrReplaceTempView("daybook_days")
    return t.spark.sql("SELECT * FROM longest_gaps(TABLE(SELECT owner, day FROM daybook_days) PARTITION BY owner ORDER BY day)")


@query(
    "html_sanitize",
    r"""WITH t AS (SELECT page_id, regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^>]*>|<[^>]*$', '', 'gs') AS x FROM pages)
SELECT page_id, false AS active, md5(regexp_replace(replace(replace(replace(x, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&(?:amp;?)?', '&amp;', 'g')) AS words FROM t""",
)
def html_sanitize(t):
    """Whether anything active is left of a page, and the digest of all its text, which is whole."""
    none, held = F.create_map().cast(EMPTY), F.array().cast("array<bigint>")
    out = t.pages.select("page_id", html.render_column(F.col("html"), none, none, held, F.lit(""), F.lit(True)).alias("h"))
    return out.select("page_id", F.col("h").rlike(r"(?i)<script|<style|\son[a-z]+=|javascript:").alias("active"), F.md5(F.regexp_replace("h", "<[^>]*>", "")).alias("words"))


def _mask_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\p{{L}}', 'x', 'g'), '\p{{N}}', '0', 'g')"


def _text_sql(x: str) -> str:
    """References that stay as they are, and all else masked."""
    kept = "&(?:amp|middot|copy|quot);?"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{kept}|[^&]+|&'), lambda p: CASE WHEN regexp_full_match(p, '{kept}') THEN p ELSE {_mask_sql('p')} END), '')"


@query(
    "redact_html",
    rf"""WITH t AS (SELECT page_id, regexp_extract_all(html, '<(?:script|style)>[^<]*(?:<[^s][^<]*|</[^s][^<]*)*</(?:script|style)>|<!--.*?-->|<[^>]*>|<[^>]*$|[^<]+', 0, 's') AS parts FROM pages)
SELECT page_id, md5(array_to_string(list_transform(parts, lambda x: CASE
WHEN x LIKE '<script>%' THEN '<script>' || {_mask_sql("x[9:-10]")} || '</script>'
WHEN x LIKE '<style>%' THEN '<style>' || {_mask_sql("x[8:-9]")} || '</style>'
WHEN x LIKE '<!--%' THEN '<!--' || {_mask_sql("x[5:-4]")} || '-->'
WHEN x LIKE '<a href="%' THEN '<a href="' || {_mask_sql("regexp_extract(x, '<a href=.([^\x22]*)', 1)")} || substr(x, length(regexp_extract(x, '<a href=.[^\x22]*', 0)) + 1)
WHEN x LIKE '<%' THEN x ELSE {_text_sql("x")} END), '')) AS redacted FROM t""",
)
def redact_html(t):
    """The digest of every redacted page, whole."""
    return t.pages.select("page_id", F.md5(html.redact_udf(F.col("html"))["html"]).alias("redacted"))


@query(
    "leaked_values",
    r"""WITH b AS (SELECT lower(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark), p AS (SELECT DISTINCT unnest(list_concat([trim(t)], string_split_regex(t, '[^\p{L}\p{N}]+'))) AS pattern FROM b)
SELECT pattern FROM p WHERE length(pattern) >= 9 AND EXISTS (SELECT 1 FROM pages WHERE contains(lower(html), pattern))""",
)
def leaked_values(t):
    """What of the benchmark's texts, whole or by their words, stands anywhere in a page, inside longer words too."""
    return scrub.leaks(t.benchmark.select(F.col("text").alias("value")), t.pages.select(F.col("html").alias("text")), least=9).select("pattern").distinct()


@query("leaked_after_redaction", "SELECT count(*) AS pages, 0 AS leaks FROM pages")
def leaked_after_redaction(t):
    """Words removed from pages that still stand in what redaction leaves of any page: there is none."""
    kept = written(t.pages.select(html.redact_udf(F.col("html")).alias("r")))  # once, for both sides
    found = scrub.leaks(kept.select(F.explode("r.removed").alias("value")), kept.select(F.col("r.html").alias("text")), allowed=scrub.names_of_markup())
    return t.pages.agg(F.count("*").alias("pages")).select("pages", F.lit(found.count()).cast("long").alias("leaks"))


@query("passages_found", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passages_found(t):
    """Which documents hold a benchmark text as it stands: many patterns looked for in many texts at once."""
    hits = scrub.found_in(t.benchmark.select(F.col("text").alias("pattern")), t.documents.where("text is not null").select(F.col("doc_id").alias("id"), "text"), 6)
    return hits.join(t.benchmark.select("item_id", F.col("text").alias("pattern")), "pattern").select("item_id", F.col("id").alias("doc_id"))


_COUNTED = ("p", "li", "ul", "h1", "nav", "article", "footer", "div")


@query("tag_balance", "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{n}[ >]')) AS {n}_open, len(regexp_extract_all(html, '<{n}[ >]')) AS {n}_shut" for n in _COUNTED) + " FROM pages")
def tag_balance(t):
    """Elements of every page as its tree is written: each that a page begins is there and ends, whatever the page leaves open."""
    none, held = F.create_map().cast(EMPTY), F.array().cast("array<bigint>")
    out = t.pages.select("page_id", html.render_column(F.col("html"), none, none, held, F.lit(""), F.lit(True)).alias("h"))
    of = lambda pattern: F.regexp_count("h", F.lit(pattern)).cast("bigint")
    return out.select("page_id", *(c for n in _COUNTED for c in (of(f"<{n}[ >]").alias(f"{n}_open"), of(f"</{n}>").alias(f"{n}_shut"))))


@query("missing_runs", "SELECT doc_id, (doc_id % 7)::INT AS run FROM documents")
def missing_runs(t):
    """Whole texts against themselves, with signs put in that the other doesn't have."""
    whole = F.coalesce("text", F.lit(""))
    more = F.concat(whole, F.repeat(F.lit("\x01"), (F.col("doc_id") % 7).cast("int")), whole, F.lit(""))
    return t.documents.select("doc_id", html.missing_run_udf(more, F.concat(whole, whole)).alias("run"))


@query("bogus_end_tags", "SELECT doc_id, md5(coalesce(text, '') || ' I &lt;/3 you &lt;/ </b>&lt;/' || doc_id) AS escaped FROM documents")
def bogus_end_tags(t):
    raw = F.concat(F.coalesce("text", F.lit("")), F.lit(" I </3 you </ </b></"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", F.md5(text.escape_bogus_end_tags(raw)).alias("escaped"))


#: Elements of a landed document, about.
LINES = 500_000


def _landed(t, lines, name: str) -> str:
    """Writes XML elements, a line each, as documents into a folder, by the executors; returns the folder."""
    path = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    swept(t.spark, path)

    def document(batches):
        yield pd.DataFrame({"line": ["<?xml version='1.0'?><journal>"]})
        for b in batches:
            yield b
        yield pd.DataFrame({"line": ["</journal>"]})

    parts = max(3, -(-lines.count() // LINES))
    lines.select(F.regexp_replace("line", "\n", "&#10;").alias("line")).repartition(parts).mapInPandas(document, "line string").write.text(path)
    return path


@query(
    "xml_comments",
    """SELECT event_id AS id, user_id AS jitemid, CASE WHEN event_id % 3 > 0 THEN event_id // 2 END AS parentid, CASE WHEN event_id % 5 > 0 THEN user_id + 1 END AS posterid,
CASE WHEN event_id % 4 > 0 THEN 'A & <b>' END AS subject, CASE WHEN event_id % 4 > 0 THEN '  ' || event_type || chr(10) || ' ' END AS body, CASE WHEN event_id % 4 = 0 THEN 'D' ELSE 'A' END AS state FROM events WHERE event_id > 1""",
)
def xml_comments(t):
    """An export with a comment for each event, landed in several files: roots and replies, anonymous ones, deleted ones without a body."""
    own = t.events.where("event_id > 1")
    head = F.concat(F.lit("<comment id='"), "event_id", F.lit("' jitemid='"), "user_id", F.lit("'"))
    reply = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(" parentid='"), F.floor(F.col("event_id") / 2), F.lit("'"))).otherwise("")
    poster = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit(" posterid='"), F.col("user_id") + 1, F.lit("'"))).otherwise("")
    told = F.concat(F.lit("><subject>A &amp; &lt;b&gt;</subject><body>  "), "event_type", F.lit("\n </body><date>2004-01-02T03:04:05Z</date></comment>"))
    end = F.when(F.col("event_id") % 4 == 0, " state='D'/>").otherwise(told)
    return comments.comment_bodies(t.spark, _landed(t, own.select(F.concat(head, reply, poster, end).alias("line")), "export")).drop("date")


@query("xml_posters", "SELECT c_custkey AS posterid, 'user_' || c_name AS username FROM customer")
def xml_posters(t):
    lines = t.customer.select(F.concat(F.lit("<usermap id='"), "c_custkey", F.lit("' user='user_"), "c_name", F.lit("'/>")).alias("line"))
    return comments.posters(t.spark, _landed(t, lines, "posters"))


@query(
    "xml_entries",
    """SELECT o_orderkey AS itemid, o_orderkey * 256 + 17 AS ditemid, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS eventtime, 'ä ' || o_orderpriority AS body, CASE WHEN o_orderkey % 3 = 0 THEN 'private' ELSE 'public' END AS security,
'a|' || o_orderstatus || '|c' AS tags, o_orderkey % 2 = 0 AS preformatted FROM orders""",
)
def xml_entries(t):
    """Responses of fifty entries each, made of all orders: bodies in base64, props that may lack, values with and without a type."""
    member = lambda name, value: F.concat(F.lit(f"<member><name>{name}</name><value>"), value, F.lit("</value></member>"))
    typed = lambda kind, value: F.concat(F.lit(f"<{kind}>"), value, F.lit(f"</{kind}>"))
    pre = F.when(F.col("o_orderkey") % 2 == 0, member("opt_preformatted", F.lit("<int>1</int>"))).otherwise("")
    props = typed("struct", F.concat(member("taglist", F.concat(F.lit("a, "), "o_orderstatus", F.lit(",,c"))), pre))
    entry = F.concat(
        F.lit("<value><struct>"), member("itemid", typed("int", F.col("o_orderkey").cast("string"))), member("anum", F.lit("<i4>17</i4>")), member("eventtime", typed("string", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))),
        member("event", typed("base64", F.base64(F.encode(F.concat(F.lit("ä "), "o_orderpriority"), "UTF-8")))), F.when(F.col("o_orderkey") % 3 == 0, member("security", F.lit("private"))).otherwise(""), member("props", props), F.lit("</struct></value>"),
    )
    pages = t.orders.select(F.floor(F.col("o_orderkey") / 50).alias("page"), entry.alias("entry")).groupBy("page").agg(F.array_join(F.collect_list("entry"), "").alias("entries"))
    xml = F.concat(F.lit("<?xml version='1.0'?><methodResponse><params><param><value><struct><member><name>events</name><value><array><data>"), "entries", F.lit("</data></array></value></member></struct></value></param></params></methodResponse>"))
    rows = xmlrpc.entries(pages.select(xml.alias("xml")))
    return rows.select("itemid", "ditemid", "eventtime", "body", "security", F.array_join("tags", "|").alias("tags"), F.coalesce(F.map_contains_key("props", "opt_preformatted"), F.lit(False)).alias("preformatted"))


@query("challenge_auth", "SELECT page_id, md5(url || md5('secret')) AS reply FROM pages")
def challenge_auth(t):
    return t.pages.select("page_id", xmlrpc.challenge_response(F.col("url"), F.lit("secret")).alias("reply"))


@query("recorded_fetch", "SELECT 'u' || page_id AS url, CASE WHEN page_id % 3 <> 0 THEN 200 END AS http_status, CASE WHEN page_id % 3 = 0 THEN 'not recorded' END AS error FROM pages")
def recorded_fetch(t):
    urls = t.pages.select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"))
    held = t.pages.where("page_id % 3 <> 0").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), F.lit(200).alias("http_status"), F.encode("html", "UTF-8").alias("content"))
    return fetch.recorded(urls, held).select("url", "http_status", "error")

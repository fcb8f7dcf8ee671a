"""Projections, filters and scalar functions on the analogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions import media, text
from daybook.plans.registry import query

DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"


@query("scan_filter_project", "SELECT o_orderkey AS itemid, o_orderstatus AS security, round(o_totalprice, 2) AS total FROM orders WHERE o_totalprice > 100000 AND o_orderpriority IS NOT NULL")
def scan_filter_project(t):
    return t.orders.where("o_totalprice > 100000 and o_orderpriority is not null").select(F.col("o_orderkey").alias("itemid"), F.col("o_orderstatus").alias("security"), F.round("o_totalprice", 2).alias("total"))


@query("date_text_filter", "SELECT o_orderkey AS itemid, strftime(o_orderdate, '%Y-%m-%d') AS eventtime FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '2000'")
def date_text_filter(t):
    return t.orders.select(F.col("o_orderkey").alias("itemid"), F.expr(DAY).alias("eventtime")).where("eventtime > '2000'")


@query("parse_parts", "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, strftime(ts, '%H') AS hh FROM events")
def parse_parts(t):
    p = text.parts(F.col("ts").cast("string"))
    return t.events.select("event_id", *(c.alias(k) for k, c in p.items()))


@query(
    "parse_parts_bad",
    """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN year(ts)::INT ELSE 0 END AS y, CASE WHEN event_id % 4 < 2 THEN month(ts)::INT ELSE 1 END AS m, CASE WHEN event_id % 4 < 2 THEN day(ts)::INT ELSE 1 END AS d,
CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%H') ELSE '00' END AS hh FROM events""",
)
def parse_parts_bad(t):
    """Stamps that are a time, a date alone, something else or empty."""
    k = F.col("event_id") % 4
    stamp = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).when(k == 2, F.col("event_type")).otherwise(F.lit(""))
    return t.events.select("event_id", *(c.alias(n) for n, c in text.parts(stamp).items()))


SLUG = "CASE WHEN trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') <> '' THEN trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') ELSE 't-' || substr(lower(hex(encode({0}))), 1, 12) END"


@query("slugify", f"SELECT p_partkey, {SLUG.format('p_name')} AS slug, {SLUG.format('p_type')} AS type_slug FROM part")
def slugify(t):
    return t.part.select("p_partkey", text.slugify(F.col("p_name")).alias("slug"), text.slugify(F.col("p_type")).alias("type_slug"))


_TAG = "CASE doc_id % 3 WHEN 0 THEN ' ' || lang || ' & ' || source || '++!' WHEN 1 THEN regexp_replace(coalesce(text, ''), '[A-Za-z0-9]+', '', 'g') || '…' ELSE source || ' Ünder ' || doc_id END"


@query("slugify_signs", f"SELECT doc_id, {SLUG.format('tag')} AS slug FROM (SELECT doc_id, {_TAG} AS tag FROM documents)")
def slugify_signs(t):
    """Tags with signs around them, of signs and other scripts alone, with umlauts."""
    k, whole = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    tag = F.when(k == 0, F.concat(F.lit(" "), "lang", F.lit(" & "), "source", F.lit("++!"))).when(k == 1, F.concat(F.regexp_replace(whole, "[A-Za-z0-9]+", ""), F.lit("…")))
    return t.documents.select("doc_id", text.slugify(tag.otherwise(F.concat("source", F.lit(" Ünder "), F.col("doc_id").cast("string")))).alias("slug"))


@query(
    "title_excerpt",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, CASE WHEN f = '' THEN '(no subject)' WHEN length(f) > 70 THEN regexp_replace(substr(f, 1, 70), '[ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]*$', '') || '…' ELSE f END AS title FROM d""",
)
def title_excerpt(t):
    return t.documents.select("doc_id", text.title(F.lit(None).cast("string"), F.col("text")).alias("title"))


@query("word_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS words FROM documents")
def word_count(t):
    return t.documents.select("doc_id", text.words(F.col("text")).alias("words"))


@query(
    "music_split",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN p_name WHEN 3 THEN '- ' || p_name ELSE p_name || ' BY ' || p_brand END AS artist,
CASE p_partkey % 5 WHEN 0 THEN p_name || ' - ' || p_type WHEN 1 THEN p_name WHEN 4 THEN p_type END AS song FROM part""",
)
def music_split(t):
    """An artist and a song by a dash, of which the first counts, or by the word; a name alone; a dash that begins; both ways at once."""
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.concat_ws(" - ", "p_brand", "p_name", "p_type")).when(k == 1, F.concat("p_name", F.lit(" by "), "p_brand", F.lit("  "))).when(k == 2, F.col("p_name"))
    artist, song = text.split_music(raw.when(k == 3, F.concat(F.lit(" - "), "p_name")).otherwise(F.concat("p_name", F.lit(" BY "), "p_brand", F.lit(" - "), "p_type")))
    return t.part.select("p_partkey", artist.alias("artist"), song.alias("song"))


@query("music_key", r"SELECT p_partkey, regexp_replace(regexp_replace(replace(lower('The ' || p_name), '&amp;', '&'), '^\s*the\s+', ''), '[^a-z0-9]', '', 'g') AS key FROM part")
def music_key(t):
    return t.part.select("p_partkey", text.music_key(F.concat(F.lit("The "), "p_name")).alias("key"))


@query("decode_entities", "SELECT doc_id, md5(coalesce(text, '')) AS decoded FROM documents")
def decode_entities(t):
    """Whole texts, written with decimal, hexadecimal and named references, once or twice over, and read back."""
    raw = text.escape_html(F.coalesce("text", F.lit("")))
    for sign, code in (("é", "&#233;"), ("ü", "&#xFC;"), ("ä", "&#xe4;"), ("è", "&#0232;"), ("e", "&#101;")):
        raw = F.replace(raw, F.lit(sign), F.lit(code))
    twice = F.when(F.col("doc_id") % 2 == 0, text.escape_html(raw)).otherwise(raw)
    return t.documents.select("doc_id", F.md5(text.decode_entities(twice)).alias("decoded"))


@query("escape_html", """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM pages""")
def escape_html(t):
    return t.pages.select("page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped"))


@query("host_of", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages")
def host_of(t):
    return t.pages.select("page_id", text.host_of(F.col("url")).alias("host"))


@query("self_link", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey END AS itemid FROM orders")
def self_link(t):
    """Own pages, with a query and capital letters too, those of others, other pages and what is no address."""
    k, number = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://me.example.invalid/"), number, F.lit(".html"))).when(k == 1, F.concat(F.lit("http://ME.example.invalid/"), number, F.lit(".html?thread=1#t1")))
    url = url.when(k == 2, F.concat(F.lit("https://other.example.invalid/"), number, F.lit(".html"))).when(k == 3, F.concat(F.lit("https://me.example.invalid/tag/"), number)).otherwise(F.concat(F.lit("not a link "), number))
    return t.orders.select("o_orderkey", text.self_item(url, F.lit("me.example.invalid")).alias("itemid"))


@query(
    "repair_links",
    r"""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 4 WHEN 0 THEN '.PNG?x=1' WHEN 1 THEN '/x.jpgs' WHEN 2 THEN '.jpeg#top' ELSE '' END AS bare FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://' || bare WHEN 1 THEN 'https://' || bare ELSE '/' || bare END AS repaired, page_id % 4 IN (0, 2) AS is_image FROM u""",
)
def repair_links(t):
    """Addresses without a scheme, with one, and paths; with the endings of images and others."""
    k, e = F.col("page_id") % 3, F.col("page_id") % 4
    end = F.when(e == 0, ".PNG?x=1").when(e == 1, "/x.jpgs").when(e == 2, ".jpeg#top").otherwise("")
    bare = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), end)
    url = F.when(k == 0, bare).when(k == 1, F.concat(F.lit("https://"), bare)).otherwise(F.concat(F.lit("/"), bare))
    return t.pages.select("page_id", text.repair_scheme(url).alias("repaired"), text.is_image_link(url).alias("is_image"))


@query(
    "thumb_url",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'https://img.youtube.com/vi/' || event_type || event_id || '/hqdefault.jpg' WHEN 1 THEN 'https://img.youtube.com/vi/a%20' || event_id || '/hqdefault.jpg' END AS thumb FROM events",
)
def thumb_url(t):
    """Addresses of an embedding proxy: both orders, another source, no id, no address."""
    k, n, q = F.col("event_id") % 5, F.col("event_id").cast("string"), F.lit("https://p.example.invalid/?")
    url = F.when(k == 0, F.concat(q, F.lit("source=youtube&vid="), "event_type", n)).when(k == 1, F.concat(q, F.lit("vid=a%20"), n, F.lit("&source=youtube")))
    url = url.when(k == 2, F.concat(q, F.lit("source=vimeo&vid="), n)).when(k == 3, F.concat(q, F.lit("source=youtube&vid="))).otherwise(F.concat(F.lit("nothing "), n))
    return t.events.select("event_id", text.video_thumb(url).alias("thumb"))


@query("json_key_probe", "SELECT event_id, json_exists(props, '$.k') AS has_k, (props->>'k')::BIGINT AS k FROM events")
def json_key_probe(t):
    props = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.coalesce(F.map_contains_key(props, "k"), F.lit(False)).alias("has_k"), props["k"].try_cast("bigint").alias("k"))


@query("rescue_props", "SELECT event_id, CASE WHEN (props->>'k')::BIGINT % 2 = 0 THEN props->>'k' END AS kept FROM events")
def rescue_props(t):
    props = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: ~k.isin("taglist", "current_mood") & (v != "") & (v.try_cast("bigint") % 2 == 0))
    return t.events.select("event_id", props["k"].alias("kept"))


@query("tag_split", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM part")
def tag_split(t):
    return t.part.select("p_partkey", F.array_join(text.split_tags(F.replace("p_type", F.lit(" "), F.lit(" , "))), "|").alias("tags"))


@query("enum_default", "SELECT l_returnflag, CASE WHEN l_returnflag IN ('A', 'D', 'S', 'F') THEN l_returnflag ELSE 'A' END AS state, count(*) AS n FROM lineitem GROUP BY ALL")
def enum_default(t):
    return t.lineitem.select("l_returnflag", text.comment_state(F.col("l_returnflag")).alias("state")).groupBy("l_returnflag", "state").agg(F.count("*").alias("n"))


@query("hash_address", "SELECT doc_id, 'blobs/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.bin' AS path, md5(text) AS md5 FROM documents")
def hash_address(t):
    digest = F.sha2("text", 256)
    return t.documents.select("doc_id", text.blob_path(digest, F.lit(None).cast("string")).alias("path"), F.md5("text").alias("md5"))


@query("coalesce_reason", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'timeout' END, 'HTTP ' || CASE WHEN o_orderstatus = 'O' THEN 404 END, 'not recovered') AS reason FROM orders")
def coalesce_reason(t):
    status = F.when(F.col("o_orderstatus") == "O", 404).cast("string")
    return t.orders.select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", "timeout"), F.concat(F.lit("HTTP "), status), F.lit("not recovered")).alias("reason"))


@query("like_shape", "SELECT page_id, html ILIKE '%<TABLE%' AS has_table, html ILIKE '%<script%' AND html NOT ILIKE '%</html>%' AS cut_off FROM pages")
def like_shape(t):
    return t.pages.select("page_id", F.expr("html ilike '%<TABLE%'").alias("has_table"), F.expr("html ilike '%<script%' and not html ilike '%</html>%'").alias("cut_off"))


@query("occurrences", "SELECT page_id, ((length(html) - length(replace(lower(html), '<a ', ''))) // 3)::BIGINT AS links FROM pages WHERE (length(html) - length(replace(lower(html), '<a ', ''))) // 3 >= 3")
def occurrences(t):
    n = F.regexp_count(F.lower("html"), F.lit("<a "))
    return t.pages.select("page_id", n.cast("bigint").alias("links")).where("links >= 3")


@query("permalinks", "SELECT o_orderkey AS itemid, 'entry' AS context, 'https://me.example.invalid/' || (o_orderkey * 256 + o_orderkey % 251) || '.html' AS permalink FROM orders")
def permalinks(t):
    ditemid = F.col("o_orderkey") * 256 + F.col("o_orderkey") % 251
    return t.orders.select(F.col("o_orderkey").alias("itemid"), F.lit("entry").alias("context"), F.concat(F.lit("https://me.example.invalid/"), ditemid.cast("string"), F.lit(".html")).alias("permalink"))


@query("display_dates", "SELECT event_id, strftime(ts, '%B ') || day(ts) || strftime(ts, ', %Y — %H:%M') AS shown, format('{:,}', event_id) AS num FROM events")
def display_dates(t):
    return t.events.select("event_id", text.display_date(F.col("ts")).alias("shown"), F.format_number("event_id", 0).alias("num"))


@query("lost_labels", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'poll ' || event_id WHEN 1 THEN 'template' ELSE event_type END AS label FROM events")
def lost_labels(t):
    k = F.col("event_id") % 3
    tag = F.when(k == 0, F.concat(F.lit("lj-poll-"), F.col("event_id").cast("string"))).when(k == 1, "lj-template").otherwise(F.concat(F.lit("lj-"), "event_type"))
    return t.events.select("event_id", text.lost_label(tag).alias("label"))


@query("page_paths", "SELECT o_orderkey, 'entries/' || o_orderkey || '.html' AS path, '../' AS root FROM orders")
def page_paths(t):
    path = text.page_path("entry", F.col("o_orderkey"))
    return t.orders.select("o_orderkey", path.alias("path"), text.root_for(path).alias("root"))


@query("shifted_ids", "SELECT l_orderkey, l_linenumber, ((l_orderkey * 256 + l_linenumber) >> 8)::BIGINT AS talkid FROM lineitem")
def shifted_ids(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.shiftright(F.col("l_orderkey") * 256 + F.col("l_linenumber"), 8).alias("talkid"))


def _bytes(t):
    """Files of every kind, one for each part: nine kinds by its number, wide as the part is long."""
    n = lambda c, digits: F.unhex(F.lpad(F.hex(c), digits, "0"))
    size, k, hex_ = F.col("p_size"), F.col("p_partkey") % 9, lambda h: F.unhex(F.lit(h))
    little = F.concat(F.unhex(F.lpad(F.hex(size % 256), 2, "0")), hex_("000000"))
    kinds = [
        F.concat(hex_("FFD8FFE0000400001700FFC0000B080258"), n(size, 4), hex_("012200")),
        F.concat(hex_("89504E470D0A1A0A0000000D49484452"), n(size, 8), n(size + 1, 8)),
        hex_("47494638396101000100"),
        F.concat(hex_("424D0000000000000000000000000000000028000000"[:36]), little, hex_("F6FFFFFF")),
        F.concat(F.encode(F.concat(F.lit(" <!DOCTYPE html><html>"), "p_name"), "UTF-8")),
        hex_("89504E470D0A1A0A"),
        F.unhex(F.substring(F.lit("FFD8"), 1, 4)),
        F.concat(hex_("524946460000000057454250"), n(size, 4)),
        F.encode("p_name", "UTF-8"),
    ]
    content = F.when(k == 0, kinds[0])
    for i, c in enumerate(kinds[1:], 1):
        content = content.when(k == i, c)
    return t.part.select("p_partkey", "p_size", content.alias("content"))


@query("sniff_mime", "SELECT p_partkey, ['image/jpeg', 'image/png', 'image/gif', 'image/bmp', 'text/html', 'image/png', NULL, 'image/webp', NULL][p_partkey % 9 + 1] AS mime FROM part")
def sniff_mime(t):
    return _bytes(t).select("p_partkey", media.sniff_mime(F.col("content")).alias("mime"))


@query(
    "read_size",
    "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 1 WHEN 3 THEN p_size % 256 END AS width, CASE p_partkey % 9 WHEN 0 THEN 600 WHEN 1 THEN p_size + 1 WHEN 2 THEN 1 WHEN 3 THEN 10 END AS height FROM part",
)
def read_size(t):
    """Headers of four kinds: behind stray bytes, from the top down, cut off, none."""
    size = media.read_size(F.col("content"))
    return _bytes(t).select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query(
    "classify_fetch",
    """SELECT p_partkey, CASE WHEN p_size % 5 < 3 OR p_partkey % 9 IN (2, 4, 6, 8) THEN 'dead' ELSE 'ok' END AS status, CASE p_size % 5 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'no such host' WHEN 2 THEN 'empty'
ELSE CASE WHEN p_partkey % 9 = 2 THEN 'tracking pixel' WHEN p_partkey % 9 = 4 THEN 'a page, not an image' WHEN p_partkey % 9 IN (6, 8) THEN 'unknown type' END END AS reason FROM part""",
)
def classify_fetch(t):
    """Every kind of file, not found, unreachable, empty, or fetched."""
    k = F.col("p_size") % 5
    rows = _bytes(t).select("p_partkey", F.when(k == 0, 404).when(k > 1, 200).alias("s"), F.when(k == 1, "no such host").alias("e"), F.when(k == 2, F.unhex(F.lit(""))).otherwise(F.col("content")).alias("content"))
    met = rows.withColumn("size", media.read_size(F.col("content")))
    c = media.classify(F.col("s"), F.col("e"), F.col("content"), F.col("size"))
    return met.select("p_partkey", c["status"].alias("status"), c["reason"].alias("reason"))

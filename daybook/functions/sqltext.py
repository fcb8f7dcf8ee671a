"""The scalar functions of the archive as SQL functions, which Catalyst inlines: no Python runs for them.

Each is (parameters, type, body); they give what the column expressions of ``text`` give.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from daybook.functions.text import NAMED


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _numeric(s: str, lead: str, digits: str, base: int) -> str:
    n = f"CAST(conv(digits, {base}, 10) AS BIGINT)"
    valid = f"({n} > 0 AND {n} <= 1114111 AND {n} NOT BETWEEN 55296 AND 57343)"
    char = f"decode(unhex(lpad(hex(if({valid}, {n}, 63)), 8, '0')), 'UTF-32')"
    return f"aggregate(array_distinct(regexp_extract_all({s}, '{lead}({digits});', 1)), {s}, (done, digits) -> if({valid}, replace(done, concat('{lead}', digits, ';'), {char}), done))"


def _decoded(s: str) -> str:
    """Entities of s decoded once."""
    s = _numeric(_numeric(s, "&#", "[0-9]{1,7}", 10), "&#x", "[0-9A-Fa-f]{1,6}", 16)
    for name, char in NAMED:
        s = f"replace({s}, '&{name};', {_quoted(char)})"
    return f"replace({s}, '&amp;', '&')"


def _escaped(s: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = f"replace({s}, '{sign}', '{entity}')"
    return s


_STAMP = r"r'^(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2}))?'"


def _part(k: int, other: int) -> str:
    return f"coalesce(try_cast(regexp_extract(stamp, {_STAMP}, {k}) AS INT), {other})"


#: Later ones may call earlier ones.
FUNCTIONS = {
    "slugify": ("tag STRING", "STRING", "coalesce(nullif(btrim(regexp_replace(lower(tag), '[^a-z0-9]+', '-'), '-'), ''), concat('t-', substring(lower(hex(encode(tag, 'UTF-8'))), 1, 12)))"),
    "strip_tags": ("html STRING", "STRING", "regexp_replace(html, '<[^>]*>', ' ')"),
    "squeeze": ("txt STRING", "STRING", r"btrim(regexp_replace(txt, r'\s+', ' '))"),
    "decode_entities": ("txt STRING", "STRING", f"aggregate(sequence(1, 6), txt, (s, _i) -> if(contains(s, '&'), {_decoded('s')}, s))"),
    "excerpt": (
        "flat STRING, most INT", "STRING",
        r"CASE WHEN flat = '' THEN '(no subject)' WHEN length(flat) > most THEN concat(regexp_replace(substring(flat, 1, most), r'\s+\S*$', ''), '…') ELSE flat END",
    ),
    "entry_title": ("subject STRING, body STRING, most INT DEFAULT 70", "STRING", "CASE WHEN btrim(coalesce(subject, '')) <> '' THEN subject ELSE excerpt(squeeze(decode_entities(strip_tags(coalesce(body, '')))), most) END"),
    "date_parts": (
        "stamp STRING", "STRUCT<y: INT, m: INT, d: INT, hh: STRING>",
        f"named_struct('y', {_part(1, 0)}, 'm', {_part(2, 1)}, 'd', {_part(3, 1)}, 'hh', coalesce(nullif(regexp_extract(stamp, {_STAMP}, 4), ''), '00'))",
    ),
    "music_artist": ("raw STRING", "STRING", "CASE WHEN instr(btrim(raw), ' - ') > 1 THEN btrim(left(btrim(raw), instr(btrim(raw), ' - ') - 1)) WHEN locate(' by ', lower(btrim(raw))) > 1 THEN btrim(substr(btrim(raw), locate(' by ', lower(btrim(raw))) + 4)) ELSE btrim(raw) END"),
    "music_song": ("raw STRING", "STRING", "nullif(CASE WHEN instr(btrim(raw), ' - ') > 1 THEN btrim(substr(btrim(raw), instr(btrim(raw), ' - ') + 3)) WHEN locate(' by ', lower(btrim(raw))) > 1 THEN btrim(left(btrim(raw), locate(' by ', lower(btrim(raw))) - 1)) END, '')"),
    "music_key": ("name STRING", "STRING", r"regexp_replace(regexp_replace(replace(lower(name), '&amp;', '&'), r'^\s*the\s+', ''), '[^a-z0-9]', '')"),
    "escape_html": ("txt STRING", "STRING", _escaped("txt")),
    "word_count": ("html STRING", "BIGINT", r"CAST(size(filter(split(regexp_replace(html, '<[^>]*>', ' '), r'\s+'), w -> w <> '')) AS BIGINT)"),
    "host_of": ("url STRING", "STRING", "lower(try_parse_url(url, 'HOST'))"),
    "self_item": ("url STRING, host STRING", "BIGINT", r"CASE WHEN host_of(url) = host THEN try_cast(nullif(regexp_extract(coalesce(try_parse_url(url, 'PATH'), ''), r'^/(\d+)\.html$', 1), '') AS BIGINT) END"),
    "repair_scheme": ("url STRING", "STRING", r"CASE WHEN url RLIKE r'^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+([/?#:]|$)' AND NOT url RLIKE '^[A-Za-z][A-Za-z0-9+.-]*://' THEN concat('http://', url) ELSE url END"),
    "is_image_link": ("url STRING", "BOOLEAN", r"url RLIKE r'(?i)\.(jpe?g|png|gif|bmp|webp|tiff?)([?#]|$)'"),
    "tags_of": ("taglist STRING", "ARRAY<STRING>", "filter(transform(split(taglist, ','), t -> btrim(t)), t -> t <> '')"),
    "security_of": ("value STRING", "STRING", "CASE WHEN value IN ('public', 'private', 'usemask') THEN value ELSE 'public' END"),
    "comment_state": ("value STRING", "STRING", "CASE WHEN value IN ('A', 'D', 'S', 'F') THEN value ELSE 'A' END"),
    "blob_path": ("digest STRING, ext STRING", "STRING", "concat('blobs/', substring(digest, 1, 2), '/', digest, '.', coalesce(ext, 'bin'))"),
    "heat": ("n BIGINT, peak BIGINT", "INT", "CASE WHEN n = 0 THEN 0 WHEN n * 2 >= peak THEN 3 WHEN n * 5 >= peak THEN 2 ELSE 1 END"),
    "percent_of": ("part BIGINT, whole BIGINT", "BIGINT", "CAST(floor(part * 100 / greatest(whole, 1) + 0.5) AS BIGINT)"),
    "display_date": ("ts TIMESTAMP", "STRING", "date_format(ts, 'MMMM d, yyyy — HH:mm')"),
    "entry_path": ("id BIGINT", "STRING", "concat('entries/', CAST(id AS STRING), '.html')"),
}

#: Those that others call.
CALLED = ("strip_tags", "squeeze", "decode_entities", "excerpt", "host_of")


def create(spark: SparkSession, schema: str | None = None) -> list[str]:
    """Creates the functions for the session, or for good in a schema of the catalog; returns their names."""
    kind, lead = ("TEMPORARY FUNCTION", "") if schema is None else ("FUNCTION", f"{schema}.")
    calls = re.compile(rf"\b({'|'.join(CALLED)})\(")
    for name, (args, type_, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE {kind} {lead}{name}({args}) RETURNS {type_} RETURN {calls.sub(lambda m: lead + m[0], body)}")
    return [f"{lead}{name}" for name in FUNCTIONS]

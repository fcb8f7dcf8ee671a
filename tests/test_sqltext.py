"""SQL functions against the column expressions, on cases that decide and on whole texts."""

import os

import pytest
from daybook.functions import sqltext, text
from pyspark.sql import functions as F

SF = os.environ.get("DAYBOOK_TEST_SF", "/root/testdata/sf0.001")
CASES = [
    None, "", " ", "  Ünder & ++ ", "…", "Rock & Roll!", "The Beatles - Let It Be", "Yesterday BY The Beatles", " - x", "a - ", "by you", " the  &amp;x",
    "&#65;&#x42;&amp;lt;&lt;b&gt;", "&#0;&#55296;&#9999999;&#x10FFFF;&#xD800;", "&amp;amp;amp;amp;amp;amp;amp;lt;", "&nbsp;&apos;&quot;", "<b>one</b> two<br/>three <", "word " * 40, "x" * 90,
    "2004-02-29 13:05", "2004-02-29", "2004-2-9", "2004-02-29T07:00:00", "http://Me.Example/123.html", "http://me.example/12x.html", "me.example/pic.JPG?x", "HTTP://a.b/c.png#x", "a, b,, c ,", "private", "A", "Q", "a\nb\tc", "\\d \\' '",
]

def pairs():
    c = F.col("x")
    artist, song = text.split_music(c)
    return {
        "slugify(x)": text.slugify(c),
        "strip_tags(x)": text.strip_tags(c),
        "squeeze(x)": text.squeeze(c),
        "decode_entities(x)": text.decode_entities(c),
        "entry_title(NULL, x)": text.title(F.lit(None).cast("string"), c),
        "entry_title(x, 'body')": text.title(c, F.lit("body")),
        "entry_title('', x, 20)": text.title(F.lit(""), c, 20),
        "date_parts(x)": F.struct(*(p.alias(n) for n, p in text.parts(c).items())),
        "music_artist(x)": artist,
        "music_song(x)": song,
        "music_key(x)": text.music_key(c),
        "escape_html(x)": text.escape_html(c),
        "word_count(x)": text.words(c),
        "host_of(x)": text.host_of(c),
        "self_item(x, 'me.example')": text.self_item(c, F.lit("me.example")),
        "repair_scheme(x)": text.repair_scheme(c),
        "is_image_link(x)": text.is_image_link(c),
        "tags_of(x)": text.split_tags(c),
        "security_of(x)": text.security(c),
        "comment_state(x)": text.comment_state(c),
        "blob_path(x, NULL)": text.blob_path(c, F.lit(None).cast("string")),
        "heat(length(x), 40)": text.heat(F.length(c), F.lit(40)),
        "percent_of(length(x), 30)": text.percent(F.length(c), F.lit(30)),
        "display_date(try_cast(x AS TIMESTAMP))": text.display_date(c.try_cast("timestamp")),
        "entry_path(length(x))": text.page_path("entry", F.length(c)),
    }


@pytest.fixture(scope="module")
def texts(spark):
    sqltext.create(spark)
    own = spark.createDataFrame([(c,) for c in CASES], "x string")
    return own.union(spark.read.parquet(f"{SF}/documents.parquet").select("text")).union(spark.read.parquet(f"{SF}/pages.parquet").select("html")).cache()


def test_every_function_is_compared(spark):
    assert {p.split("(")[0] for p in pairs()} == set(sqltext.FUNCTIONS) - {"excerpt"}


def test_sql_equals_columns(spark, texts):
    differs = texts.select(*(F.sum((~F.expr(sql).eqNullSafe(c)).cast("int")).alias(sql) for sql, c in pairs().items())).first().asDict()
    assert {k: n for k, n in differs.items() if n} == {}


def test_no_python_in_the_plan(spark, texts):
    plan = texts.select(*(F.expr(sql) for sql in pairs()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_functions_for_good(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS daybook_fns")
    sqltext.create(spark, "daybook_fns")
    got = spark.sql("SELECT daybook_fns.entry_title('', '<b>a</b> &amp;amp; b'), daybook_fns.slugify('A b'), daybook_fns.self_item('http://M/7.html', 'm')").first()
    assert tuple(got) == ("a & b", "a-b", 7)
    spark.sql("DROP SCHEMA daybook_fns CASCADE")

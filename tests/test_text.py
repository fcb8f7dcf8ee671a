"""Scalar functions on the cases that decide."""

import pytest
from pyspark.sql import functions as F

from daybook.functions import media, text


def over(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r[0]: tuple(r)[1:] for r in df.select("v", *columns).collect()}


def V():
    return F.col("v")


def test_stamps(spark):
    p = text.parts(V())
    got = over(spark, ["2004-02-29 13:05", "2004-02-29", "never", ""], p["y"], p["m"], p["d"], p["hh"])
    assert got == {"2004-02-29 13:05": (2004, 2, 29, "13"), "2004-02-29": (2004, 2, 29, "00"), "never": (0, 1, 1, "00"), "": (0, 1, 1, "00")}


def test_slugs(spark):
    got = over(spark, ["C++", "Über uns!", "...", "日本", " a  b "], text.slugify(V()))
    assert got == {"C++": ("c",), "Über uns!": ("ber-uns",), "...": ("t-2e2e2e",), "日本": ("t-e697a5e69cac",), " a  b ": ("a-b",)}


def test_music(spark):
    want = {"Artist - Song": ("Artist", "Song"), "Song by Artist": ("Artist", "Song"), "A-ha - Take On Me": ("A-ha", "Take On Me"), "Just a name": ("Just a name", None), "One - Two - Three": ("One", "Two - Three"), " - x": ("- x", None), "by by by": ("by", "by"), "X by Y - Z": ("X by Y", "Z")}
    assert over(spark, list(want), *text.split_music(V())) == want


def test_references(spark):
    want = {"&lt;b&gt;": "<b>", "&amp;amp;lt;": "<", "&#8217;": "’", "&#x2019;": "’", "&#128512;": "😀", "a&nbsp;b": "a b", "&quot;&apos;": "\"'", "&#9999999;": "&#9999999;", "plain & simple": "plain & simple", "&amp;#65;": "A"}
    assert {k: v[0].replace("\xa0", " ") for k, v in over(spark, list(want), text.decode_entities(V())).items()} == want


def test_links(spark):
    own = over(spark, ["https://me.invalid/12.html", "http://ME.invalid/7.html?t=1", "https://other.invalid/12.html", "https://me.invalid/tag/x", "no link"], text.self_item(V(), F.lit("me.invalid")))
    assert [v[0] for v in own.values()] == [12, 7, None, None, None]
    fixed = over(spark, ["www.example.com/x", "https://a.example/b.PNG?x=1", "/local.jpg", "#top", "mailto:x@example.com"], text.repair_scheme(V()), text.is_image_link(V()))
    assert list(fixed.values()) == [("http://www.example.com/x", False), ("https://a.example/b.PNG?x=1", True), ("/local.jpg", True), ("#top", False), ("mailto:x@example.com", False)]
    q = "https://p.invalid/?"
    thumbs = over(spark, [f"{q}source=youtube&vid=abc", f"{q}vid=a%20b&source=youtube", f"{q}source=vimeo&vid=1", f"{q}source=youtube&vid=", "nothing"], text.video_thumb(V()))
    assert [v[0] for v in thumbs.values()] == ["https://img.youtube.com/vi/abc/hqdefault.jpg", "https://img.youtube.com/vi/a%20b/hqdefault.jpg", None, None, None]


def test_labels_and_end_tags(spark):
    assert [v[0] for v in over(spark, ["lj-poll-12", "lj-template", "lj-map"], text.lost_label(V())).values()] == ["poll 12", "template", "map"]
    assert [v[0] for v in over(spark, ["I </3 you", "<b>x</b>", "</"], text.escape_bogus_end_tags(V())).values()] == ["I &lt;/3 you", "<b>x</b>", "&lt;/"]


@pytest.mark.parametrize(
    "content, mime, size",
    [
        ("FFD8FFE000040000FFC0000B080258032003012200", "image/jpeg", (800, 600)), ("89504E470D0A1A0A0000000D494844520000032000000258", "image/png", (800, 600)), ("47494638396101000100", "image/gif", (1, 1)),
        ("424D00000000000000000000000000000000280000000500000A00000000"[:52], "image/bmp", None), ("3C21444F43545950452068746D6C3E3C68746D6C3E", "text/html", None), ("89504E470D0A1A0A", "image/png", None),
        ("FFD8", None, None), ("524946460000000057454250", "image/webp", None), ("0102030405060708", None, None),
    ],
)
def test_bytes(spark, content, mime, size):
    c = F.unhex(F.lit(content))
    got = spark.range(1).select(media.sniff_mime(c).alias("m"), media.read_size(c).alias("s")).first()
    assert got.m == mime and (size is None or tuple(got.s) == size)

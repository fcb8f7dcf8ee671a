"""Redaction by places in the source, and the search for what was removed."""

import base64
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daybook.functions import redact as r
from daybook.functions import scrub
from daybook.functions.markup import tokens
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "source, out",
    [
        ('<a data-title="x1" title="Alice Smith">', '<a xxxx-xxxxx="x" title="x">'),
        ('<img alt="see src=foo" src="http://secret.example/alice.png?k=1">', '<img alt="x" src="http://xxxxxx.xxxxxxx/xxxxx.png?x=0">'),
        ("<!-- Alice 12 -->", "<!-- xxxxx 00 -->"),
        ("<![CDATA[Bob]]>", "<![xxxxx[xxx]]>"),
        ("<?php Carol ?>", "<?xxx xxxxx ?>"),
        ("&#65;&#x42;&eacute;&amp;&nbsp;&Eacute x", "xxx&amp;&nbsp;x x"),
        ('<a href="one" href="alice">', '<a href="xxx" href="xxxxx">'),
        ('<a href="alice', '<a href="xxxxx'),
        ("<a href=alice", "<a href=xxxxx"),
        ("<a href='ali<ce'>", "<a href='xxx<xx'>"),
        ("<alice@example.invalid> hi", "<xxxxx@xxxxxxx.xxxxxxx> xx"),
        ("<b alice smith=1>", "<b xxxxx xxxxx=x>"),
        ("<script>var a='Dora</p>';</script>", "<script>xxx x='xxxx</x>';</script>"),
        ("<textarea>Ann</b></textarea>", "<textarea>xxx</x></textarea>"),
        ("<!DOCTYPE html><p class=k>", "<!DOCTYPE html><p class=k>"),
        ("a < b </3 <", "x < x </0 <"),
        ("<input value='1073987828'>", "<input value='x'>"),
        ("<a href='mailto:alice@b.invalid'>", "<a href='mailto:xxxxx@x.xxxxxxx'>"),
        ("<a href='alice:secret'>", "<a href='xxxxx:xxxxxx'>"),
        ("<img src='/alice' BORDER=0 / onclick='go(Bob)'>", "<img src='/xxxxx' BORDER=0 / onclick='x'>"),
        ("", ""),
    ],
)
def test_nothing_but_structure_stays(source, out):
    assert r.redact(source)[0] == out
    assert r.redact(out)[0] == out or "xxxx-xxxxx" in out


def test_users_have_one_pseudonym():
    out, removed = r.redact('<lj user="Some_One"><lj-user comm=other><lj user="some_one">', "pepper")
    names = re.findall(r'(?:user|comm)="?(\w+)', out)
    assert names[0] == names[2] != names[1] and names[0].startswith("u") and "Some_One" in removed and "some" not in out.lower()
    assert r.redact('<lj user="Some_One">', "salt")[0] != r.redact('<lj user="Some_One">', "pepper")[0]


SOUP = ["Anna", "12", " ", "\n", "<b>", "</b>", '<p title="Anna 7">', "<p title=Anna", "<!-- Anna", "-->", "<script>", "</script>", "&#65;", "&eacute;", "<![CDATA[", "]]>", "<", ">", "'", '"', "=", "</", "<Anna", "&", ";", "Anna="]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SOUP), max_size=25))
def test_no_soup_keeps_a_word(parts):
    source = "".join(parts)
    out, removed = r.redact(source)
    assert "anna" not in out.lower() and "12" not in out.replace("u12", "")
    joined = "".join(source[slice(*t.at)] for t in tokens(source))
    assert joined == source  # the tokens are all of the source
    if "Anna" in source:
        assert any("Anna" in x for x in removed)


def test_xml_of_any_form():
    out, removed = r.COMMENTS.apply('<comment id="3" user="Alice_B"><subject/><body a="1"><![CDATA[Dear <b>Carol</b>]]> x &lt;i&gt;Bob&lt;/i&gt; &amp; 42</body><!-- Eve --></comment>')
    assert "<body a=\"1\"><![CDATA[xxxx <b>xxxxx</b>]]> x &lt;i&gt;xxx&lt;/i&gt; &amp; 00</body><!-- xxx -->" in out and "Alice" not in out
    assert {"Alice_B", "Dear", "Carol", "Bob", "42"} <= set(removed)
    coded = base64.b64encode("Für Dora <i>7</i>".encode()).decode()
    for value in ("Alice Dora", "<string>Alice Dora</string>", "<![CDATA[Alice Dora]]>", f"<base64>\n{coded}\n</base64>"):
        event = f"<member><name>itemid</name><value><int>5</int></value></member><member><name>event</name><value>{value}</value></member>"
        out, removed = r.EVENTS.apply(event)
        assert "Alice" not in out and coded not in out and "Dora" in removed and "<int>5</int>" in out
    nested = "<member><name>props</name><value><struct><member><name>taglist</name><value>a, Bob</value></member></struct></value></member>"
    assert "Bob" not in r.EVENTS.apply(nested)[0]
    with pytest.raises(ValueError):
        r.EVENTS.apply("<member><name>event</name><value><struct><member><name>x</name><value>Alice</value></member></struct></value></member>")


def leaked(spark, removed, outputs, **options):
    values = spark.createDataFrame([(v,) for v in removed], "value string")
    texts = spark.createDataFrame([(t,) for t in outputs], "text string")
    return {x["value"] for x in scrub.leaks(values, texts, **options).collect()}


def test_what_leaks_is_found(spark):
    removed = ["http://secret.example/alice", "Alice Smith", "Margarete", "42", "xxxxx", "Größenwahn", None, "kept apart", "strong"]
    assert leaked(spark, removed, ["see http://secret.example/alice"]) == {"http://secret.example/alice", "Alice Smith"}  # by the whole and by a word
    assert leaked(spark, removed, ["by aliceSMITHson"]) >= {"Alice Smith"}
    assert leaked(spark, removed, ["MARGARETEN und Gr&#246;&#xDF;enwahn"]) == {"Margarete", "Größenwahn"}
    assert leaked(spark, removed, [f"<base64>{base64.b64encode(b'for Margarete').decode()}</base64>"]) == {"Margarete"}
    assert leaked(spark, removed, ["a%20Marga%72ete"]) == {"Margarete"}
    assert leaked(spark, removed, ["kept\n apart", None, "", "xxxxx 42"]) == {"kept apart"}
    assert leaked(spark, removed, ["<strong>"], allowed=["strong"]) == set()
    assert leaked(spark, removed, ["<base64>no base64 at all=</base64> %zz &#99999999;"]) == set()
    assert leaked(spark, [], ["x"]) == set() and leaked(spark, removed, []) == set()


@pytest.mark.parametrize("n", [3, 5])
def test_every_pattern_in_every_text_is_found(spark, n):
    """Against a search of each pattern in each text: patterns across the cuts of long texts, overlapping and repeated ones."""
    any_of = random.Random(n)
    texts = [(i, "".join(any_of.choice("abä 👍") for _ in range(any_of.choice([0, 2, n, 200, scrub.PIECE + n - 1, 3000])))) for i in range(40)]
    long = texts[-1][1] + "needle" * 3
    texts += [(100, long * 3)]
    patterns = {t[k : k + m] for _, t in texts for k in (0, 5, scrub.PIECE - 2, len(t) - n) for m in (n, n + 1, 30, 600)} | {"zzzzzz", "ababab" * 5}
    patterns = sorted(p for p in patterns if len(p) >= n)
    got = scrub.found_in(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame(texts, "id long, text string"), n)
    assert {tuple(x) for x in got.collect()} == {(p, i) for p in patterns for i, t in texts if p in t}


def test_publish_is_all_or_nothing(spark, tmp_path):
    removed = spark.createDataFrame([("Alice Smith",)], "value string")
    bad, good = (spark.createDataFrame([(t,)], "text string") for t in ("dear alicesmith", "dear xxxxx"))
    with pytest.raises(ValueError):
        scrub.publish(bad, removed, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()
    scrub.publish(good, removed, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 1


def test_redacted_columns(spark):
    df = spark.createDataFrame([("<p>Alice</p>",), (None,), ("",)], "h string")
    got = [tuple(x["r"]) for x in df.select(r.redact_udf(F.col("h")).alias("r")).collect()]
    assert got == [("<p>xxxxx</p>", ["Alice"]), (None, None), ("", [])]

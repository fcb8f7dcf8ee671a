import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daybook.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    rows = pii.find_pii(df).select("doc_id", "pii").collect()
    return {r.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.pii] for r in rows}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789 .-+()@ab_\n\u0001é\U0001f600", max_size=60), min_size=20, max_size=60))
def test_base_spans_equal_the_plain_patterns(spark, texts):
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[3] in pii.BASE] == base(t)


@pytest.mark.parametrize("text", [None, "", "a" * 100_000, "1" * 50_000, "a@b" + ".c" * 30_000, "+1" + " " * 50_000, "1.1.1.1 " * 3000])
def test_long_and_empty(spark, text):
    assert [s for s in found(spark, [text])[0] if s[3] in pii.BASE] == base(text or "")


def test_added_kinds_need_checksum_or_context(spark):
    good, bad = "pay DE89 3704 0044 0532 0130 00 now", "pay DE88 3704 0044 0532 0130 00 now"
    got = found(spark, [good, bad, "social security 123-45-6789", "part 123-45-6789"])
    assert [s[3] for s in got[0]].count("iban") == 1 and not [s for s in got[1] if s[3] == "iban"]
    assert [s[3] for s in got[2]] == ["ssn"] and got[3] == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail me@x.org or +1 (234) 567-8901."), (2, "nothing"), (3, None)], "doc_id long, text string")
    rows = pii.find_pii(df).select("doc_id", pii.redact(F.coalesce("text", F.lit("")), F.col("pii")).alias("t")).collect()
    assert {r.doc_id: r.t for r in rows} == {1: "mail [EMAIL] or [PHONE].", 2: "nothing", 3: ""}


def redacted(text, spans):
    out, at = "", 0
    for start, _, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def cleaned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find_pii(df).select("doc_id", "pii", pii.redact(F.coalesce("text", F.lit("")), F.col("pii")).alias("t")).collect()
    return {r.doc_id: (r.t, [(s.start, s.rank, s.end, s.kind) for s in r.pii]) for r in rows}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a@b.co", "1.2.3.4", "+1 234 567 8901", "4111 1111 1111 1111", "4111111111111111@x.org", "word ", "\n", "\U0001f600", "é" * 600, " ", "1", "."]), max_size=12).map("".join), min_size=15, max_size=40))
def test_redaction_equals_the_plain_one(spark, texts):
    got = cleaned(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == redacted(t, got[i][1])
        assert [s for s in got[i][1] if s[3] in pii.BASE] == base(t)


def test_a_hundred_thousand_addresses_in_one_text(spark):
    text = " ".join(f"a{i}@b.co" for i in range(100_000))
    began = time.time()
    got, spans = cleaned(spark, [text])[0]
    assert len(spans) == 100_000 and got == " ".join(["[EMAIL]"] * 100_000)
    assert time.time() - began < 60


def kinds(spark, *texts):
    got = found(spark, list(texts))
    return [[(t[s[0] : s[2]], s[3]) for s in got[i] if s[3] not in pii.BASE] for i, t in enumerate(texts)]


def test_account_numbers_end_where_their_country_says(spark):
    want = ("DE89 3704 0044 0532 0130 00", "iban")
    assert kinds(spark, f"{want[0]} BIC COBADEFF", "DE89370400440532013000 ABC", f"{want[0]}1", "NO9386011117947 AND MORE", "ZZ89370400440532013000", "GB82 WEST 1234 5698 7654 32") == [
        [want], [("DE89370400440532013000", "iban")], [], [("NO9386011117947", "iban")], [], [("GB82 WEST 1234 5698 7654 32", "iban")],
    ]


def test_context_counts_on_both_sides_and_both_ways(spark):
    ssn = [("123-45-6789", "ssn")]
    texts = ["123-45-6789 is my social security number", "ssn 123-45-6789", "123-45-6789", "social part no 123-45-6789", "123-45-6789" + " " * 50 + "social", "ssn 000-12-3456", "ssn 123-00-4567", "ssn 123-45-0000", "ssn 666-12-3456", "ssn 912-34-5678"]
    assert kinds(spark, *texts) == [ssn, ssn, [], [], [], [], [], [], [], []]
    df = spark.createDataFrame([(1, "server 10.0.0.1"), (2, "10.0.0.1"), (3, "version 10.0.0.1"), (4, "10.0.0.1 is the host of version 2")], "doc_id long, text string")
    assert {r.doc_id: r.pii[0].score for r in pii.find_pii(df).collect()} == {1: 0.8, 2: 0.6, 3: 0.4, 4: 0.6}


def test_clashing_columns_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a@b.co", 5)] * 2 + [(None, None, 6)], "doc_id long, text string, score long").withColumn("pii", F.lit("x"))
    rows = pii.find_pii(df).collect()
    assert sorted((str(r.doc_id), len(r.pii), r.score) for r in rows) == [("1", 1, 5), ("1", 1, 5), ("None", 0, 6)]
    assert pii.find_pii(df.limit(0)).count() == 0

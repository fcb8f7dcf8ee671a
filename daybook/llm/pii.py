"""Operator 3, personal data. DataFrame functions only.

Regular expressions propose spans, validators (Luhn, mod 97, part and digit counts) confirm them,
words nearby raise or lower a score. Matches are found by writing a mark around each one and
splitting at the marks; running sums of the pieces' lengths then give the positions, in code
points. All steps are linear in the text but for the running sums, which take log n linear passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

MARK, INSTEAD = "\u0001", "\u0002"
#: How far beside a span words count as context; code points of a text that are cut out together.
NEAR, BLOCK = 40, 1024
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

# The length of an account number (IBAN) by country.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_ACCOUNT = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN.items())

# The kinds in their order, with pattern, a cheap test of the whole text, the score without context, and the words nearby that raise and lower it.
# The patterns are those of the contract, possessive where nothing can be given back, so that long runs cost linear time and no stack.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write|kontakt|correo|courriel", "example|sample"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|address|host|server|adresse", "version|release|section|chapter"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|credit|karte|carte|tarjeta", "isbn|serial|tracking|order"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|call|tel|mobile|fax", "score|total"),
    "iban": (rf"(?<![A-Za-z0-9])(?:{_ACCOUNT})(?![A-Za-z0-9])", None, 0.8, "iban|account|bank|konto|compte|cuenta", "example|sample"),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", 0.4, "ssn|social|security", "part|order|serial|model|invoice|isbn"),
}
BASE = ("email", "ip", "card", "phone")
SHIFT, ENOUGH = 0.2, 0.6


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, both) -> Column:
    """For each place of an array of numbers, ``both`` (a sum, a maximum) over all up to it. Each pass doubles how far back a place has looked."""

    def scanned(v: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(2)))).cast("int") - 1)
        steps = F.transform(rounds, lambda d: F.pow(F.lit(2), d).cast("int"))
        return F.aggregate(steps, v, lambda a, n: F.transform(a, lambda x, i: F.when(i >= n, both(x, F.get(a, i - n))).otherwise(x)))

    return let(values, scanned)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: start, end (exclusive), the text, and what stands before and after it up to the next match."""

    def spans(s: Column) -> Column:
        def span(i: Column) -> Column:
            piece = lambda k: F.get(s["pieces"], k)
            ends = lambda k: F.get(s["ends"], k)
            return F.struct(ends(i - 1).alias("start"), ends(i).alias("end"), piece(i).alias("value"), F.right(piece(i - 1), F.lit(NEAR)).alias("before"), F.left(piece(i + 1), F.lit(NEAR)).alias("after"))

        return F.transform(F.sequence(F.lit(1), F.size(s["pieces"]) - 2, F.lit(2)), span)

    def placed(pieces: Column) -> Column:
        ends = running(F.transform(pieces, F.length), lambda x, y: x + y)
        return F.when(F.size(pieces) > 1, let(F.struct(pieces.alias("pieces"), ends.alias("ends")), spans)).otherwise(F.array().cast(SPAN))

    return let(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """The remainder of an account number by ISO 7064: the first four signs go last, letters count as 10 to 35."""
    v = F.replace(value, F.lit(" "))
    signs = F.split(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4))), "")
    number = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(signs, F.lit(0), lambda a, c: F.pmod(F.when(c == "", a).when(c.between("0", "9"), a * 10 + number(c)).otherwise(a * 100 + number(c)), F.lit(97)))


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value) == 1
    return F.lit(True)


def _of_kind(text: Column, clean: Column, rank: int, kind: str) -> Column:
    pattern, sign, score, up, down = KINDS[kind]
    maybe = F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9]")
    proposed = F.when(maybe, matches(clean, pattern)).otherwise(F.array().cast(SPAN))

    def scored(s: Column) -> Column:
        beside = F.lower(F.concat(s["before"], F.lit(" \n "), s["after"]))
        near = lambda words: F.when(beside.rlike(rf"\b(?:{words})"), SHIFT).otherwise(0.0)
        points = F.round(F.least(F.lit(1.0), F.lit(score) + near(up) - near(down)), 2)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), points.alias("score"))

    spans = F.transform(F.filter(proposed, lambda s: confirmed(kind, s["value"])), scored)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= ENOUGH)


def spans_of(text: Column) -> Column:
    """All confirmed spans of a text as array<struct<start, rank, end, kind, score>>, by start and then kind.

    Those of the base kinds stay whatever their score; the others need ENOUGH. Words in the NEAR
    code points before and after a span, as far as its neighbours of the same kind, move its score by
    SHIFT: up for words that go with the kind, down for those of other numbers.
    """
    clean = F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit(INSTEAD))).otherwise(text)
    found = [_of_kind(text, clean, rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with ``text`` (null: empty) -> the same rows and columns plus ``pii``, the spans of the whole text.

    Empty texts have none. Other columns pass through untouched; one named pii is replaced.
    """
    return docs.withColumn("pii", spans_of(F.coalesce(F.col("text"), F.lit(""))))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text given as its blocks: work in proportion to what is cut."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    block = lambda k: F.get(blocks, k)
    one = F.substr(block(first), start % BLOCK + 1, end - start)
    more = F.concat(F.substr(block(first), start % BLOCK + 1), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substr(block(last), F.lit(1), end - last * BLOCK))
    return F.when(start >= end, "").when(first == last, one).otherwise(more)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the gap. ``spans`` must be in their order."""

    def written(s: Column) -> Column:
        until = lambda k: F.coalesce(F.get(s["until"], k), F.lit(0))

        def part(x: Column, i: Column) -> Column:
            return F.when(x["start"] >= until(i - 1), F.concat(cut(s["blocks"], until(i - 1), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(s["spans"], part), ""), cut(s["blocks"], until(F.size(s["until"]) - 1), s["size"]))

    until = running(F.transform(spans, lambda x: x["end"]), F.greatest)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = F.struct(blocks.alias("blocks"), spans.alias("spans"), until.alias("until"), F.length(text).alias("size"))
    return F.when(F.size(spans) == 0, text).otherwise(let(whole, written))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and a digest of the base spans, all spans and their scores, for each row of documents."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), scores.alias("scores"))

"""Fixtures without personal data: stable pseudonyms, and proof that nothing removed is left."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.functions.text import decode_entities
from daybook.shared import shared_dir, swept, written


def pseudonyms(names: DataFrame, prefix: str = "user") -> DataFrame:
    """(name, at) -> name, pseudonym: numbered by first appearance, ties by name.

    Names are numbered within ranges first and the ranges' offsets added, so no task sees them all.
    """
    first = names.where("name is not null").groupBy("name").agg(F.min("at").alias("at"))
    ranged = first.withColumn("range", F.floor(F.col("at") / 10_000))
    own = ranged.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy("at", "name")))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return own.join(before, "range").select("name", F.concat(F.lit(prefix), (F.col("before") + F.col("own")).cast("string")).alias("pseudonym"))


def redact_url(url: Column) -> Column:
    """The address with its shape kept: letters to x, digits to 0, scheme and separators as they are."""
    scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    rest = F.substr(url, F.length(scheme) + 1)
    return F.concat(scheme, F.regexp_replace(F.regexp_replace(rest, r"\p{L}", "x"), "[0-9]", "0"))


def redact_prose(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}", "x"), r"\p{N}", "0")


#: Signs of a run in an index of long patterns; most signs from one run to the next.
RUN, PIECE = 16, 256


def readings(text: Column) -> Column:
    """What a text says, as an array: itself, with references decoded, with percent signs decoded, and what its base64 elements hold; in lower case, blanks as one space."""
    coded = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<base64>\s*([A-Za-z0-9+/=\s]*?)\s*</base64>"), F.lit(1)), lambda b: F.make_valid_utf8(F.try_to_binary(F.regexp_replace(b, r"\s", ""), F.lit("base64")).cast("string")))
    percent = lambda d: F.coalesce(F.try_url_decode(F.replace(d, F.lit("+"), F.lit("%2B"))), d)
    # arrays of one hand a value on, so that it is worked out once
    plain = F.flatten(F.transform(F.array(decode_entities(text)), lambda d: F.array(text, d, percent(d))))
    every = F.flatten(F.transform(F.array(coded), lambda c: F.concat(plain, c, F.transform(c, decode_entities))))
    return F.array_distinct(F.transform(F.filter(every, lambda t: t.isNotNull()), lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))))


def patterns(removed: DataFrame, least: int, allowed: list[str] | None = None) -> DataFrame:
    """removed (value) -> value, pattern: what may not be found, the value as it reads and the words in it; none shorter than ``least``, of filler (x and 0) alone, or ``allowed``."""
    reads = removed.where("value is not null").select("value").distinct().select("value", F.explode(readings(F.col("value"))).alias("read")).distinct()
    words = F.filter(F.split("read", r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least)
    every = reads.select("value", F.explode(F.array_distinct(F.concat(F.array(F.btrim("read")), words))).alias("pattern"))
    kept = every.where((F.length("pattern") >= least) & ~F.col("pattern").rlike(r"^(?:x|0|[^\p{L}\p{N}])*$"))
    if allowed:
        kept = kept.where(~F.col("pattern").isin([w.lower() for w in allowed]))
    return kept.distinct()


def grams(text: Column, n: int, step: int = 1) -> Column:
    """The runs of n signs that begin at every ``step``-th sign of a text, as an array, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}})).{{1,{step}}}"), F.lit(1))


def found_in(wanted: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(pattern), (id, text) -> pattern, id wherever the text holds the pattern, of n signs at least, anywhere.

    An index from runs of signs to the texts that hold them, taken at every ``step``-th sign: where the shortest pattern is longer than
    a run, wherever it stands one of its first ``step`` runs is in the index, and so it is for any ``step`` runs of a pattern that
    follow each other. A pattern asks for those that fewest texts hold; one of which no text holds any is out. What is left is looked
    up in the texts themselves. Every pattern that stands in a text is found.
    """
    every = wanted.select("pattern").where(F.length("pattern") >= n).distinct()
    shortest = every.agg(F.min(F.length("pattern"))).first()[0]
    if shortest is None:
        return texts.where("false").select(F.lit("").alias("pattern"), "id")
    run = max(n, min(RUN, (shortest + 1) // 2))
    step = min(shortest - run + 1, PIECE)
    indexed = texts.select("id", F.explode(F.array_distinct(grams(F.col("text"), run, step))).alias("gram"))
    asked = every.select("pattern", F.posexplode(grams(F.col("pattern"), run)).alias("at", "gram")).withColumn("group", F.floor(F.col("at") / step))
    asked = written(asked.where((F.col("group") + 1) * step + run - 1 <= F.length("pattern")).select("pattern", "group", "gram").distinct())
    indexed = written(indexed.join(asked.select("gram").distinct(), "gram", "left_semi"))
    held = indexed.groupBy("gram").agg(F.count("*").alias("held"))
    counted = asked.join(held, "gram", "left").groupBy("pattern", "group").agg(F.sum(F.coalesce("held", F.lit(0))).alias("held"))
    # no occurrence without a run of every group
    best = counted.groupBy("pattern").agg(F.min(F.struct("held", "group")).alias("best")).where("best.held > 0").select("pattern", F.col("best.group").alias("group"))
    maybe = indexed.join(asked.join(best, ["pattern", "group"]).select("pattern", "gram"), "gram").select("pattern", "id").distinct()
    return maybe.join(texts, "id").where(F.contains("text", "pattern")).select("pattern", "id")


def names_of_markup() -> list[str]:
    """Names that redaction leaves: words like them, removed from a text, stand in every output."""
    from daybook.functions import redact

    return sorted({part for name in redact.ELEMENTS | redact.STRUCTURE | redact.ADDRESSES | redact.USERS | redact.OTHERS for part in (name, *re.split("[^a-z0-9]+", name))})


def leaks(removed: DataFrame, outputs: DataFrame, least: int = 5, allowed: list[str] | None = None) -> DataFrame:
    """Values removed somewhere (value) of which something is still in some output (text): value, pattern; must be empty before publishing.

    A value is looked for as a whole and by its words, inside longer words too, in the outputs as they stand and as they read
    (``readings``). Null values and texts are nothing. Words of fewer than ``least`` signs are not looked for: they are everywhere.
    ``allowed`` are words that may stand, say names of elements.
    """
    spark = outputs.sparkSession
    kept = f"{shared_dir(spark)}/leaks-{uuid.uuid4().hex}"
    swept(spark, kept)
    wanted = patterns(removed, least, allowed)
    wanted.write.parquet(f"{kept}/wanted")
    outputs.where("text is not null").select(F.explode(readings(F.col("text"))).alias("text")).distinct().withColumn("id", F.xxhash64("text")).write.parquet(f"{kept}/texts")
    wanted, texts = spark.read.parquet(f"{kept}/wanted"), spark.read.parquet(f"{kept}/texts")
    return wanted.join(found_in(wanted, texts, min(least, 6)).select("pattern").distinct(), "pattern").select("value", "pattern").distinct()


def publish(outputs: DataFrame, removed: DataFrame, path: str, allowed: list[str] | None = None) -> None:
    """All or nothing: writes only if nothing leaks."""
    if leaks(removed, outputs, allowed=allowed).take(1):
        raise ValueError("removed values are still in the output")
    outputs.write.mode("overwrite").json(path)

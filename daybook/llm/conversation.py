"""Operator 11, conversation structure repair by a fold of Spark SQL's higher-order functions.

Windows flag each turn's fault. Turns are collected, sorted, in segments of bounded length, and
``aggregate`` carries four (cost, audit) structs through a segment, one for each state that the
roles so far can be in: nothing yet, a system turn, a user turn that waits for its answer, whole
exchanges. Every edit is a candidate struct and ``least`` picks the cheapest, among equals the one
whose audit is least. A segment is folded from each state it could begin in; a second ``aggregate``
chains the segments of a conversation, so no task holds a conversation's turns at once.

Picking in each state is safe: of two audits that consumed the same turns, reached the same state
and cost the same, neither begins the other (the longer one would have more inserts and cost more),
so what follows can't change which is less.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, Scratch, bounded_batches, table

#: What edits cost: keep, rerole, delete, insert; and an undeleted truncated turn besides.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More than any repair costs.
NEVER = 1 << 60
#: The states: nothing yet, after a system turn, after a user turn, after whole exchanges.
STATES = ("none", "system", "asked", "answered")
#: Ends the part of an audit that belongs to one segment; it sorts before every edit.
MARK = "/"


def _state(cost: Column | int, audit: Column | str) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))


def _more(s: Column, cost: Column | int, edit: str) -> Column:
    return _state(s["cost"] + cost, F.concat(s["audit"], F.lit(edit)))


def _all(*states: Column) -> Column:
    return F.struct(*(s.alias(n) for s, n in zip(states, STATES)))


def _inserted(acc: Column) -> Column:
    """The states after the inserts that may stand here: a user turn from any state but ``asked``, an assistant turn from that."""
    asked = F.least(acc["asked"], *(_more(acc[s], INSERT, "I") for s in ("none", "system", "answered")))
    return _all(acc["none"], acc["system"], asked, F.least(acc["answered"], _more(asked, INSERT, "I")))


def _turned(acc: Column, turn: Column) -> Column:
    """The states after one more turn: deleted, kept where its role is the one due, or given that role. No turn is given the role of a system turn."""
    bad, extra = turn["deleted"], turn["truncated"].cast("long") * TRUNCATED

    def due(initial: str, rerole: bool, *before: str) -> list[Column]:
        fits = turn["initial"] == initial
        keep = F.when(bad | ~fits, F.lit(NEVER)).otherwise(extra)
        change = F.when(bad, F.lit(NEVER)).otherwise(extra + REROLE)
        return [x for s in before for x in ([_more(acc[s], keep, "K"), _more(acc[s], change, "R")] if rerole else [_more(acc[s], keep, "K")])]

    gone = {s: _more(acc[s], DELETE, "D") for s in STATES}
    return _all(
        gone["none"],
        F.least(gone["system"], *due("s", False, "none")),
        F.least(gone["asked"], *due("u", True, "none", "system", "answered")),
        F.least(gone["answered"], *due("a", True, "asked")),
    )


def _begin(name: str) -> Column:
    return _all(*(_state(0 if s == name else NEVER, "") for s in STATES))


def _chained(now: Column, paths: Column) -> Column:
    """States before a segment and the segment's paths by the state it begins in -> states after it."""
    return _all(*(F.least(*(_state(now[a]["cost"] + paths[i][b]["cost"], F.concat(now[a]["audit"], paths[i][b]["audit"], F.lit(MARK))) for i, a in enumerate(STATES))) for b in STATES))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: one space) -> the same with some turns dropped, emptied, without full stops, repeated or given the role user.

    Which, is told by the CRC-32 of ``conv_id:turn``. A conversation's dropped turns stay as rows with ``copy`` null, so that it is not forgotten.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 0, F.array().cast("array<int>")).when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode_outer(copies).alias("copy"))


def flagged(turns: DataFrame) -> DataFrame:
    """Turns, plain or as ``damage`` gives them, with their place in the conversation, their first fault (blank, duplicate, truncated or null), whether their role may not follow the one before and whether they are the first of their turn number.

    Turns that were dropped come last and have none of these.
    """
    order = [F.col("copy").isNull(), F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    own = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", F.col("copy").isNull(), "role", "text").orderBy(*order)
    live, initial, full = F.col("copy").isNotNull(), F.substring("role", 1, 1), F.rtrim("text", F.lit(BLANKS))
    seen = turns.withColumn("initial", initial).withColumn("seen", F.row_number().over(same))
    rows = seen.withColumn("place", F.row_number().over(own) - 1).withColumn("pair", F.concat(F.lag("initial").over(own), F.col("initial"))).withColumn("last", F.lag("turn").over(own))
    fault = F.when(full == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.substring(full, -1, 1).isin(".", "!", "?"), "truncated")
    return rows.select(
        "conv_id", "turn", "role", "text", "copy", "initial", "place",
        F.when(live, fault).alias("fault"),
        (live & F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False))).alias("illegal"),
        (live & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last"))).alias("fresh"),
    )


def parts_of(turns: DataFrame, segment: int) -> DataFrame:
    """A row for each ``segment`` turns of a conversation: its turns, counts of faults, and for each state it may begin in the four cheapest audits."""
    live = F.col("copy").isNotNull()
    turn = F.struct("place", "role", "text", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("deleted"), F.col("fault").eqNullSafe("truncated").alias("truncated"))
    rows = flagged(turns.repartition("conv_id")).withColumn("part", F.floor(F.col("place") / segment).cast("int"))
    parts = rows.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.when(live, turn))).alias("turns"),
        *(F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")),
        F.count_if("illegal").alias("illegal"),
        F.count_if("fresh").alias("fresh"),
        F.min(F.when(live, F.col("turn"))).alias("low"),
        F.max(F.when(live, F.col("turn"))).alias("high"),
    )
    step = lambda acc, turn: F.transform(F.array(_inserted(acc)), lambda now: _turned(now, turn))[0]
    return parts.withColumn("paths", F.array(*(F.aggregate("turns", _begin(name), step) for name in STATES)))


def audits_of(parts: DataFrame) -> DataFrame:
    """Parts -> a row for each conversation: counts, cost and audit, with a mark at the end of each part."""
    counts = ("blank", "duplicate", "truncated", "illegal")
    whole = parts.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "paths"))), lambda p: p["paths"]).alias("paths"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("fresh"), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in counts),
    )
    ends = F.aggregate("paths", _begin("none"), _chained, lambda acc: F.transform(F.array(_inserted(acc)), lambda now: F.least(now["none"], now["answered"]))[0])
    return whole.withColumn("best", ends).select("conv_id", "gaps", *counts, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


def edited(piece: str, turns: list[dict], odd: int, done: int):
    """(role, text) of the turns that a piece of an audit leaves; ``done`` such turns came before, ``odd`` tells whether a system turn is the first."""
    at = iter(turns)
    for edit in piece:
        turn = next(at) if edit != "I" else None
        if edit == "D":
            continue
        due = "assistant" if (done + odd) % 2 else "user"
        yield (turn["role"] if edit == "K" else due), (turn["text"] if turn else "")
        done += 1


def repair(turns: DataFrame, segment: int = 256, digests: bool = False) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> a row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired, an array of (role, text); with ``digests`` repaired_sha256 instead.

    Rows as ``damage`` gives them, or plain ones. Null roles and texts count as one space. Turns go in order of turn (nulls
    first), then role and text, so that rows repeated as a whole stand side by side and the later ones are duplicates. A null
    conv_id is a conversation like any other. A conversation whose turns were all dropped has zeros, an empty audit and the
    hash of nothing. Other columns are not read. No rows, no result. ``segment`` bounds the turns that are collected at once;
    results don't depend on it. The digest is fed turn by turn, so only the audit stands whole in a row, and ``repaired`` where it is asked for.
    """
    bounded_batches(turns.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copy = F.col("copy") if "copy" in turns.columns else F.lit(0)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), copy.alias("copy"))
    parts = Scratch(turns.sparkSession, "conversations").keep(parts_of(rows, segment))
    found = audits_of(parts.drop("turns"))
    counts = [c for c in found.columns if c not in ("conv_id", "audit")]
    none = [F.lit(None).cast("long").alias(c) for c in counts]
    lean = F.transform("turns", lambda t: F.struct(t["role"], t["text"]))
    kind = "array<struct<role:string,text:string>>"
    lines = found.select("conv_id", F.lit(-1).alias("part"), *counts, "audit", F.lit(None).cast(kind).alias("turns"))
    lines = lines.union(parts.select("conv_id", "part", *none, F.lit(None).cast("string"), lean.cast(kind)))
    id_kind = turns.schema["conv_id"].dataType.simpleString()
    last = "repaired_sha256 string" if digests else f"repaired {kind}"
    schema = f"conv_id {id_kind}, {', '.join(f'{c} long' for c in counts)}, audit string, {last}"

    def run(batches):
        """Each conversation's audit comes first, then its parts in order."""
        out = None

        def ended(now):
            row, pieces, odd, done, digest, kept = now
            for role, text in edited(pieces[-1], [], odd, done):
                digest.update(f"\n{role}:{text}".encode() if done else f"{role}:{text}".encode())
                kept.append({"role": role, "text": text})
                done += 1
            row["audit"] = "".join(pieces)
            row[last.split()[0]] = digest.hexdigest() if digests else kept
            return row

        def batch(rows):
            return pa.RecordBatch.from_pylist(rows, arrow)

        for b in batches:
            ready = []
            for d in b.to_pylist():
                if d["part"] < 0:
                    if out:
                        ready.append(ended(out))
                    pieces = d["audit"].split(MARK)
                    odd = sum(len(p) - p.count("D") for p in pieces) % 2
                    out = [{c: d[c] for c in ("conv_id", *counts)}, pieces, odd, 0, hashlib.sha256(), []]
                    continue
                _, pieces, odd, done, digest, kept = out
                for role, text in edited(pieces[d["part"]], d["turns"], odd, done):
                    digest.update(f"\n{role}:{text}".encode() if done else f"{role}:{text}".encode())
                    if not digests:
                        kept.append({"role": role, "text": text})
                    done += 1
                out[3] = done
            yield batch(ready)
        if out:
            yield batch([ended(out)])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation of the damaged table."""
    return repair(damage(table(spark, sf_dir, "conversations")), digests=True)

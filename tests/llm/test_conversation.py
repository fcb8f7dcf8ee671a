import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from daybook.llm.conversation import damage, op11_conversation_repair, repair

BLANK = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        kept += [(turn, "user" if harm == 4 else role, text, n) for n in range({0: 0, 3: 2}.get(harm, 1))]
    return out


def cheapest(turns, faults):
    """(cost, audit, repaired) by a search over all edits, in order of cost and audit."""
    step, name = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}, {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ("", "a"):
            return cost, audit, out
        for role in "ua":
            if (state, role) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role, (*out, (name[role], ""))))
        if i < len(turns):
            _, role, text, _ = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, (role, text))))
                for r in "ua":
                    if (state, r) in step:
                        heapq.heappush(heap, (cost + extra + 2, audit + "R", i + 1, r, (*out, (name[r], text))))


def brute(rows):
    out = []
    for conv, turns in damaged(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))
        seen, faults = set(), []
        for _, role, text, _ in turns:
            bare = text.rstrip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, kept = cheapest(turns, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_conversation_repair(spark, "/root/testdata/sf0.001")) == brute(rows)


@pytest.mark.parametrize("segment", [256, 3, 1])
def test_odd_rows(spark, segment):
    """Nulls in every column, blanks, ties, repeated rows, roles of no kind, long texts, extra columns with names used inside."""
    any_of = random.Random(segment)
    texts = [None, "", "a.", "b", "c!\n", " \t", "long? ", "x" * 50_000]
    rows = [
        (c, any_of.choice([None, 0, 1, 2, 3, 5, *range(40)]), any_of.choice([None, "", "user", "assistant", "system", "tool", "user", "assistant"]), any_of.choice(texts))
        for c in [None, *range(60)]
        for _ in range(any_of.choice([1, 2, 5, 9, 30]))
    ]
    rows += rows[:10]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("part", F.lit("x")).withColumn("a.b", F.lit(0)).withColumn("turns", F.lit(2)).repartition(3)
    assert found(repair(damage(df), segment=segment, digests=True)) == brute(rows)


def test_all_dropped_and_none(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, turn, "user", "hi.")], SCHEMA)
    assert found(repair(damage(df), digests=True)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair(damage(df.where("false"))).count() == 0


def test_repaired_turns(spark):
    """The turns themselves, of rows that were not damaged."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Yes."), (1, 2, "user", "Why?"), (1, 3, "user", "Why?"), (1, 4, "assistant", "So"), (2, 0, "user", "Alone.")]
    got = {r.conv_id: (r.cost, r.audit, [tuple(t) for t in r.repaired]) for r in repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (6, "KIKKDK", [("system", "Be kind."), ("user", ""), ("assistant", "Yes."), ("user", "Why?"), ("assistant", "So")])
    assert got[2] == (2, "KI", [("user", "Alone."), ("assistant", "")])


def test_a_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(3000) if i % 500 != 7]
    got = repair(spark.createDataFrame(rows, SCHEMA), segment=64, digests=True).first()
    faults = [None] * len(rows)
    cost, audit, kept = cheapest([(t, r, x, 0) for _, t, r, x in rows], faults)
    assert (got.gaps, got.cost, got.audit) == (6, cost, audit)
    assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()

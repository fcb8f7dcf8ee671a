"""Operator 7, best-fit packing by bin completion.

Pieces of equal length are alike, so the packing is worked out on the histogram of lengths, which
has at most ``capacity`` rows whatever the corpus: best-fit decreasing gives an incumbent, bin
completion (branch and bound around the largest piece left) packs its bins with waste anew, into
fewer, until the bound is met, and the solution is a short list of fillings with how often each is
used. Pieces then find their places by their rank
among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import PIECE, read_ranks
from .common import Scratch, bounded_batches, table

#: A filling: ((length, how often in the bin), ...) from the longest; with how many bins use it.
Filling = tuple[tuple[int, int], ...]


def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest bins that the lengths can need: pieces over capacity - k stand alone, those over half apart, the rest fill up (Martello and Toth's L2)."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    many, much = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    k = np.unique([0, *np.nonzero(n[: half + 1])[0]])
    alone = many[-1] - many[capacity - k]
    apart = many[capacity - k] - many[half]
    room = apart * capacity - (much[capacity - k] - much[half])
    small = much[half] - np.where(k > 0, much[k - 1], 0)
    return int((alone + apart + np.maximum(0, -((room - small) // capacity))).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on the histogram; bins with equal contents are handled together."""
    room: dict[int, list[list]] = {}
    free: list[int] = []

    def put(space: int, filling: list, n: int) -> None:
        if space not in room:
            room[space] = []
            insort(free, space)
        room[space].append([filling, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(free, length)
            if i == len(free):
                put(capacity, [], left)
                continue
            space = free[i]
            filling, n = room[space].pop()
            if not room[space]:
                del room[space], free[i]
            # the tightest bin takes pieces until they fit no more, before the next bin of its kind does
            each = min(space // length, left)
            used = min(n, left // each)
            left -= used * each
            put(space - each * length, [*filling, (length, each)], used)
            if n > used:
                put(space, filling, n - used)
    return [(tuple(f), n) for bins in room.values() for f, n in bins if f]


def completions(left: dict[int, int], capacity: int, most: int) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of the bins that hold the longest piece left, fullest first and those of long pieces first, up to a waste of ``most``.

    Undominated ones only: none to which a piece left over could be added, or in which one could be
    swapped for a longer one that fits. Bit s of reach[i] says whether pieces of lengths[i:] can sum
    to s, so the search never enters a branch that has no filling. No filling is left out.
    """
    lengths = sorted((x for x, n in left.items() if n), reverse=True)
    top, space = lengths[0], capacity - lengths[0]
    spare = left | {top: left[top] - 1}
    lengths = [x for x in lengths if x <= space and spare[x]]
    reach, mask = [1], (1 << (space + 1)) - 1
    for x in reversed(lengths):
        r, n, step = reach[-1], min(spare[x], space // x), 1
        while n > 0:
            r |= r << (min(step, n) * x) & mask
            n, step = n - step, step * 2
        reach.append(r)
    reach.reverse()

    def summing(i: int, total: int) -> Iterator[Filling]:
        if not total:
            yield ()
            return
        for j in range(max(i, bisect_left(lengths, -total, key=int.__neg__)), len(lengths)):
            if not reach[j] >> total & 1:
                return
            x = lengths[j]
            for n in range(min(spare[x], total // x), 0, -1):
                if reach[j + 1] >> (total - n * x) & 1:
                    for rest in summing(j + 1, total - n * x):
                        yield ((x, n), *rest)

    def dominated(waste: int, filling: Filling) -> bool:
        used = dict(filling)
        over = [x for x in lengths if spare[x] > used.get(x, 0)]
        return bool(over) and (over[-1] <= waste or any(0 < y - x <= waste for x in used for y in over))

    for waste in range(min(most, space) + 1):
        for filling in summing(0, space - waste):
            if not waste or not dominated(waste, filling):
                whole = dict(filling)
                whole[top] = whole.get(top, 0) + 1
                yield waste, tuple(sorted(whole.items(), reverse=True))


def search(counts: dict[int, int], capacity: int, goal: int, nodes: int) -> list[tuple[Filling, int]] | None:
    """A packing of at most ``goal`` bins by bin completion, depth first; None where there is none, or none within ``nodes`` nodes.

    A node fills bins around the longest piece left, each filling as often as the counts allow, half
    as often or once. A branch ends when its waste exceeds what the goal allows or the bound of what
    is left does, and succeeds when nothing is left or best fit, tried now and then, packs what is left.
    """
    stack: list[tuple[Iterator, list]] = []

    def enter(left: dict[int, int], done: list) -> list | None:
        bins = goal - sum(n for _, n in done)
        allowed = bins * capacity - sum(x * n for x, n in left.items())
        if allowed < 0 or waste_bound(left, capacity) > bins:
            return None
        if not left:
            return done
        if len(done) % 8 == 0 or sum(left.values()) < 100:
            quick = best_fit(left, capacity)
            if sum(n for _, n in quick) <= bins:
                return done + quick
        stack.append((children(left, allowed), done))
        return None

    def children(left: dict[int, int], allowed: int) -> Iterator[tuple[dict, tuple]]:
        for waste, filling in completions(left, capacity, allowed):
            times = min(left[x] // n for x, n in filling)
            times = min(times, allowed // waste) if waste else times
            for t in sorted({times, (times + 1) // 2, 1} - {0}, reverse=True):
                rest = left | {x: left[x] - n * t for x, n in filling}
                yield {x: n for x, n in rest.items() if n}, (filling, t)

    found = enter({x: n for x, n in counts.items() if n}, [])
    while found is None and stack and nodes > 0:
        step = next(stack[-1][0], None)
        if step is None:
            stack.pop()
            continue
        nodes -= 1
        found = enter(step[0], [*stack[-1][1], step[1]])
    return found


def histogram(fillings: list[tuple[Filling, int]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for filling, times in fillings:
        for x, n in filling:
            out[x] = out.get(x, 0) + n * times
    return out


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 800, opening: tuple[int, ...] = (0, 512, 16), small: int = 60) -> tuple[list[tuple[Filling, int]], int]:
    """-> (fillings with how often each is used, the lower bound).

    Best-fit decreasing is the first incumbent. While it is above the bound, some of its bins are
    opened and their pieces packed anew by ``search`` into fewer: the bins that have waste and, by
    and by, up to ``opening`` kinds of the full ones. A search aims at one bin less, and after each
    success at twice as many, as far as the bound. Up to ``small`` bins all are opened at once, and within the
    nodes the search then is exhaustive. The limits bound the effort: every incumbent is a whole packing.
    """
    bound = waste_bound(counts, capacity)
    best = best_fit({x: n for x, n in counts.items() if n}, capacity)
    size = sum(n for _, n in best)
    for few in opening:
        step = min(1, size - bound)
        while step:
            wasteful = [sum(x * n for x, n in filling) < capacity for filling, _ in best]
            opened, shut = [b for b, w in zip(best, wasteful) if w], [b for b, w in zip(best, wasteful) if not w]
            # full bins of short pieces help most: those fit into any gap
            shut.sort(key=lambda b: (b[0][0][0], b))
            each = max(4, sum(n for _, n in opened) // 128)
            opened, shut = opened + [(f, min(n, each)) for f, n in shut[:few]], [(f, n - each) for f, n in shut[:few] if n > each] + shut[few:]
            if size <= small:
                opened, shut = best, []
            better = search(histogram(opened), capacity, sum(n for _, n in opened) - step, nodes)
            if better is None:
                step = int(step > 1)
            else:
                best = shut + better
                size = sum(n for _, n in best)
                step = min(2 * step, size - bound)
    return best, bound


class Places:
    """Where the r-th piece of a length goes: sequence and offset, by tables with a row for each (filling, length)."""

    def __init__(self, fillings: list[tuple[Filling, int]]):
        slots: dict[int, list] = {}
        first = 0
        taken: dict[int, int] = {}
        for filling, times in fillings:
            offset = 0
            for length, each in filling:
                slots.setdefault(length, []).append((taken.get(length, 0), first, each, offset))
                taken[length] = taken.get(length, 0) + each * times
                offset += length * each
            first += times
        self.slots = {length: np.array(rows, np.int64) for length, rows in slots.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            at, rows = np.nonzero(length == x)[0], self.slots[int(x)]
            row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            n = rank[at] - row[:, 0]
            sequence[at], offset[at] = row[:, 1] + n // row[:, 2], row[:, 3] + n % row[:, 2] * x
        return sequence, offset


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes; pieces between blanks are remembered, up to a bound.

    The strings of added tokens have ids of their own wherever they stand, as in the library; what
    lies between them is encoded piece by piece.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[str, int] | None = None, remember: int = 500_000):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = {token: np.array([i], "<u4").tobytes() for token, i in (added or {}).items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.remember, self.memo = remember, {}

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return b"".join([self.added.get(part) or self.plain(part) for part in self.split.split(text)])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        pieces, memo = PIECE.findall(text), self.memo
        if len(memo) > self.remember:
            memo.clear()
        for p in {p for p in pieces if p not in memo}:
            memo[p] = np.array(self.encoding.encode_ordinary(p), "<u4").tobytes()
        return b"".join([memo[p] for p in pieces])


def vocabulary_of(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(merge ranks, added tokens) of a rank file, which has no added tokens, or of a tokenizer's JSON file that holds a byte-level BPE."""
    if not path.endswith(".json"):
        return read_ranks(path), {}
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in signs)}
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    added = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
    if any(t.get(k) for t in whole.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take blanks or whole words only are not supported")
    return {bytes(byte[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in added}, added


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end: int = 2, ids: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, tag, piece, start, length, ids_crc32 (and ids).

    A document is its ids and then ``end``; null text counts as empty, so each row gives a piece at
    least. Only longer ones are cut, into pieces of ``capacity``; the first one has the remainder.
    ``tag`` tells repeated rows of one doc_id apart where their texts differ.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_of(vocabulary))
    bounded_batches(spark)
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        ranks, added = shared.value
        encoder = Encoder(ranks, pattern, added)
        for b in batches:
            out = []
            for doc, tag, text in zip(*(c.to_pylist() for c in b.columns)):
                whole = encoder(text or "") + last
                n = len(whole) // 4
                at, k = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    part = whole[4 * at : 4 * (at + k)]
                    out.append((doc, tag, piece, at, k, zlib.crc32(part), part))
                    at, k = at + k, capacity
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            if ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in cols[6]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    schema = "doc_id long, tag long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, schema)


def pack(cut: DataFrame, capacity: int = 1024, block: int = 512, nodes: int = 800) -> DataFrame:
    """Pieces (with length) -> the same rows plus sequence_id and offset.

    The driver gets the histogram alone. Ranks within a length are counted in blocks of about
    ``block`` pieces, so the length that most pieces have is spread over many tasks. Equal rows
    (a row repeated as a whole) share a block and take neighbouring places. No pieces, no rows.
    """
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    fillings, _ = bin_completion(counts, capacity, nodes)
    blocks = spark.createDataFrame([(x, max(1, min(1 << 16, n // block))) for x, n in counts.items()], "length long, blocks int")
    order = ["doc_id", "tag", "piece"]
    dealt = cut.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64(*order), F.col("blocks")))
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "block", F.coalesce("first", F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy(*order))
    ranked = dealt.withColumn("own", own - 1).join(before, ["length", "block"]).withColumn("rank", F.col("first") + F.col("own"))
    names = cut.columns
    places = spark.sparkContext.broadcast(Places(fillings))

    def place(batches):
        for b in batches:
            sequence, offset = places.value.find(np.asarray(b.column("length")), np.asarray(b.column("rank")))
            kept = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*names, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, text -> a row for each piece with its place. The pieces, without their ids, are written once: a few bytes each."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.keep(pieces(docs, vocabulary, pattern, capacity, end)), capacity)


def sequences(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int> with at most ``capacity`` ids."""
    scratch = Scratch(docs.sparkSession, "sequences")
    placed = pack(scratch.keep(pieces(docs, vocabulary, pattern, capacity, end, ids=True)), capacity)
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def production() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The place of each piece of every document."""
    return packed(table(spark, sf_dir, "documents"), *production()).drop("tag")

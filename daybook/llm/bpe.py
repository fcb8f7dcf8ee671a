"""Operator 2, byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as a whole; the
rest go through the merges, with a heap over linked bytes. Each worker looks up the distinct
pre-tokens of a batch at once and remembers their ids, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Unicode's White_Space, as a character class.
WHITE = "\t-\r \x85\xa0  -     　"
#: Blank run and following word: pre-tokens never reach from one such piece into the next.
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def hash_bytes(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """64-bit polynomial hashes of slices of a byte array, mixed at the end."""
    base = np.uint64(0x9E3779B97F4A7C15 ^ (seed * 2 + 1))
    h = np.full(len(starts), np.uint64(seed + 1)) ^ (lengths.astype(np.uint64) << np.uint64(32))
    order = np.argsort(-lengths, kind="stable")
    starts, falling, part = starts[order], -lengths[order], h[order]
    for i in range(int(lengths.max(initial=0))):
        count = int(np.searchsorted(falling, -i, side="left"))
        part[:count] = part[:count] * base + blob[starts[:count] + i] + np.uint64(1)
    h[order] = part
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class PerfectHash:
    """A minimal perfect hash (hash and displace) from byte strings to 0..n-1, with the strings kept to reject others."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        lengths = np.array([len(k) for k in keys], np.int64)
        blob = np.frombuffer(b"".join(keys) + b"\0", np.uint8)
        starts = np.cumsum(lengths) - lengths
        self.seed = 0
        while len(np.unique(h := hash_bytes(blob, starts, lengths, self.seed))) < self.n:
            self.seed += 1
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift, taken, slot = np.zeros(self.buckets, np.uint64), np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        sizes = np.bincount(bucket, minlength=self.buckets)
        by = np.split(np.argsort(bucket, kind="stable"), np.cumsum(sizes)[:-1])
        tries = np.arange(512, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            members, first = by[b], np.uint64(0)
            while len(members):
                at = self._slot(h[members][None, :], (first + tries)[:, None])
                ranked = np.sort(at, axis=1)
                good = np.nonzero(~taken[at].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1))[0]
                if len(good):
                    taken[at[good[0]]], slot[members], self.shift[b] = True, at[good[0]], first + tries[good[0]]
                    break
                first += np.uint64(len(tries))
        order = np.argsort(slot)
        self.which = order
        self.lengths, self.starts, self.blob = lengths[order], starts[order], blob

    def _slot(self, h: np.ndarray, d) -> np.ndarray:
        x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key its position among the strings the table was built of, or -1."""
        lengths = np.array([len(k) for k in keys], np.int64)
        blob = np.frombuffer(b"".join(keys) + b"\0", np.uint8)
        starts = np.cumsum(lengths) - lengths
        h = hash_bytes(blob, starts, lengths, self.seed)
        at = self._slot(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)])
        ok = np.nonzero(self.lengths[at] == lengths)[0]
        n = lengths[ok]
        each = np.repeat(np.arange(len(ok)), n)
        step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        differ = blob[starts[ok][each] + step] != self.blob[self.starts[at[ok]][each] + step]
        ok = ok[np.bincount(each[differ], minlength=len(ok)) == 0]
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.which[at[ok]]
        return out


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: lowest rank first, leftmost among equals; linked parts, a heap of candidate merges."""
    n = len(token)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(token[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(token[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(token[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with one vocabulary. ``remember`` bounds the pieces whose ids a worker keeps."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None, remember: int = 400_000):
        self.ranks, self.keys = ranks, list(ranks)
        self.table = table or PerfectHash(self.keys)
        self.rank_of = np.array([ranks[k] for k in self.keys], np.int64)
        self.pattern, self.remember = regex.compile(pattern), remember
        by_id = {r: k for k, r in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.decoded, self.decimal = self._column(tokens), self._column([b"%d," % i for i in range(len(tokens))])
        self.memo: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _column(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(v) for v in values], np.int64)
        return np.frombuffer(b"".join(values) + b"\0", np.uint8), np.cumsum(lengths) - lengths, lengths

    @staticmethod
    def _gather(column: tuple, ids: np.ndarray) -> bytes:
        blob, starts, lengths = column
        n = lengths[ids]
        at = np.repeat(starts[ids] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return blob[at].tobytes()

    def _learn(self, pieces: set[str]) -> None:
        split = {p: self.pattern.findall(p) for p in pieces}
        new = [t for t in dict.fromkeys(t for ts in split.values() for t in ts) if t not in self.known]
        raw = [t.encode() for t in new]
        if raw:
            found = self.table.find(raw)
            ids = self.rank_of[found]
            for t, b, f, i in zip(new, raw, found.tolist(), ids.tolist()):
                self.known[t] = np.array([i] if f >= 0 else merge(b, self.ranks), "<u4").tobytes()
        for p, ts in split.items():
            self.memo[p] = b"".join([self.known[t] for t in ts])

    def encode_batch(self, texts: list[str]):
        """Yields the ids of each text, as unsigned 32-bit numbers."""
        split = [PIECE.findall(text) for text in texts]
        if len(self.memo) > self.remember or len(self.known) > self.remember:
            self.memo, self.known = {}, {}
        self._learn({p for pieces in split for p in pieces if p not in self.memo})
        for pieces in split:
            yield np.frombuffer(b"".join([self.memo[p] for p in pieces]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self._gather(self.decoded, ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self._gather(self.decimal, ids)[:-1]


_codec: list = [None, None]


def codec_of(run_id: str, shared) -> Codec:
    """The codec of a run, kept by a worker process from task to task, with what it remembers; only the latest run's."""
    if _codec[0] != run_id:
        _codec[:] = [run_id, Codec(*shared.value)]
    return _codec[1]


def encode(docs: DataFrame, vocabulary: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, ids array<int>, decoded binary; with ``digests``, n_tokens and two SHA-256 instead.

    Null counts as empty; empty texts have no ids. A row for each row of docs; only doc_id and text are read.
    The vocabulary is read on the driver and broadcast: its size is fixed, whatever the input.
    """
    spark = docs.sparkSession
    ranks = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((ranks, pattern, PerfectHash(list(ranks))))
    bounded_batches(spark)
    run_id = uuid.uuid4().hex

    def run(batches):
        codec = codec_of(run_id, shared)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            a, c, d = [], [], []
            for ids in codec.encode_batch(texts):
                if digests:
                    a.append(len(ids))
                    c.append(hashlib.sha256(codec.decimals(ids)).hexdigest())
                    d.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                else:
                    c.append(ids.astype(np.int32))
                    d.append(codec.decode(ids))
            if digests:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.list_(pa.int32())), pa.array(d, pa.binary())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)

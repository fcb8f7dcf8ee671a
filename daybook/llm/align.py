"""Operator 12, cross-tokenizer alignment by a two-pointer merge of cumulative token ends.

Inside ``mapInArrow`` the ends of both tokenizations of a text, counted in bytes, are merged: where
one pointer stands when the other reaches an end says which tokens overlap there, a link, and ends
that both reach close a group. The texts of a batch follow each other in one such merge. Spark then
counts in how many documents each pair of ids is linked, takes the maxima of both sides and brings
them back.

Two facts keep this small. Neither tokenizer has a token that reaches from a sign that isn't blank
into a following space, so a text is cut there and the ids of such a piece are remembered, up to a
bound. And documents come in blocks, the batches: a block sends each of its pairs once, with the
number of its documents that hold it, and gets each back once, with the corpus's counts.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE
from .common import Scratch, bounded_batches, table
from .packing import vocabulary_of

#: Pieces of a text: a new one begins at a space behind a sign that isn't blank.
PIECES = re.compile(f" *[^ ]+(?:(?<=[{WHITE}]) +[^ ]*)*| +")
#: Tokens that are written out at once.
AT_ONCE = 1 << 18


class Aligner:
    """Both tokenizers, and the ids of the pieces seen so far. ``remember`` bounds the pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes, remember: int = 1_000_000):
        import sentencepiece
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        by_id = {i: b for b, i in ranks.items()}
        self.bytes_a = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.bytes_b = [self._bytes(i) for i in range(self.model.vocab_size())]
        if len(self.bytes_b) > 1 << 16:
            raise ValueError("the second tokenizer has more than 65,536 ids")
        self.sizes_a, self.sizes_b = (np.array([len(b) for b in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # decimal ids with what may follow them: a comma, or the end of a group's first and second half
        signs = [b"%d%s" % (i, sign) for side, end in ((self.bytes_a, b"|"), (self.bytes_b, b";")) for i in range(len(side)) for sign in (b",", end)]
        self.sign_sizes = np.array([len(x) for x in signs], np.int64)
        self.sign_starts, self.signs = np.cumsum(self.sign_sizes) - self.sign_sizes, np.frombuffer(b"".join(signs), np.uint8)
        self.remember, self.known = remember, {}

    def _bytes(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[1:-1], 16)])
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        return self.model.id_to_piece(i).replace("\u2581", " ").encode()

    def tokens(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Both sides' ids, as unsigned 32-bit numbers, of texts that begin with a space, which the second tokenizer adds itself; None where the tokens of a side don't join to the text."""
        out = []
        for text, b in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1)):
            a, raw = self.bpe.encode_ordinary(text), text.encode()
            fine = b"".join([self.bytes_b[i] for i in b]) == raw and b"".join([self.bytes_a[i] for i in a]) == raw
            out.append((np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if fine else None)
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Both sides' ids of each text; none of empty ones and of those that don't come back."""
        cut, known = [PIECES.findall(" " + t) if t else [] for t in texts], self.known
        if len(known) > self.remember:
            known.clear()
        new = list({p for pieces in cut for p in pieces if p not in known})
        for at in range(0, len(new), 4096):
            known.update(zip(new[at : at + 4096], self.tokens(new[at : at + 4096])))
        out = []
        for text, pieces in zip(texts, cut):
            parts = [known[p] for p in pieces]
            if None in parts:  # a piece doesn't come back: the text as a whole decides
                parts = [p for p in self.tokens([" " + text]) if p]
            out.append((b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])))
        return out

    def written(self, signs: np.ndarray):
        """Yields the bytes of tokens and what follows them, some at a time."""
        for at in range(0, len(signs), AT_ONCE):
            part = signs[at : at + AT_ONCE]
            n = self.sign_sizes[part]
            where = np.repeat(self.sign_starts[part] - (np.cumsum(n) - n), n)
            where += np.arange(len(where))
            yield self.signs[where].tobytes()


class Merged:
    """The merged token ends of a batch of texts. Both sides of every text have the same bytes, so a text's last end closes a group."""

    def __init__(self, aligner: Aligner, texts: list[tuple[bytes, bytes]]):
        self.aligner = aligner
        self.n_a, self.n_b = (np.array([len(t[side]) // 4 for t in texts], np.int64) for side in (0, 1))
        a, b = (np.frombuffer(b"".join([t[side] for t in texts]), "<u4").astype(np.int64) for side in (0, 1))
        end_a, end_b = np.cumsum(aligner.sizes_a[a]), np.cumsum(aligner.sizes_b[b])
        doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (self.n_a, self.n_b))
        # where the other pointer stands when one reaches an end
        at_b, at_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
        both_a, both_b = end_b[at_b] == end_a, end_a[at_a] == end_b
        self.n_groups = np.bincount(doc_a[both_a], minlength=len(texts))
        only = ~both_b
        links = np.concatenate([a << 16 | b[at_b], a[at_a[only]] << 16 | b[only]])
        docs = np.concatenate([doc_a, doc_b[only]])
        held, self.times = np.unique(docs << 32 | links, return_counts=True)
        self.pairs, self.n_pairs = held & 0xFFFFFFFF, np.bincount(held >> 32, minlength=len(texts))
        # groups: the ids of a side behind those of the other, with the sign that follows each
        group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        ends = np.bincount(group_b, minlength=int(both_a.sum()))
        self.order = np.empty(len(a) + len(b), np.int64)
        self.order[np.arange(len(a)) + (np.cumsum(ends) - ends)[group_a]] = a * 2 + both_a
        ends = np.cumsum(np.bincount(group_a, minlength=len(ends)))
        self.order[np.arange(len(b)) + ends[group_b]] = (b + len(aligner.sizes_a)) * 2 + both_b

    def groups(self):
        """Yields for each text the bytes of its groups as ``a1,a2|b1;a3|b2,b3;``, in parts."""
        at = 0
        for n in (self.n_a + self.n_b).tolist():
            yield self.aligner.written(self.order[at : at + n])
            at += n


_aligner: list = [None, None]


def aligner_of(run_id: str, shared) -> Aligner:
    """The aligner of a run, kept by a worker process from task to task with what it remembers; only the latest run's."""
    if _aligner[0] != run_id:
        _aligner[:] = [run_id, Aligner(*shared.value)]
    return _aligner[1]


_PAIRS = "block long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary, a int, b int, docs long, place int"


def linked(docs: DataFrame, first: str, pattern: str, second: str, digests: bool) -> DataFrame:
    """Blocks: a row for each document (a is null), with places of its pairs in the block and how often each is linked; a row for each pair of the block, with the documents that hold it."""
    spark = docs.sparkSession
    with open(second, "rb") as f:
        shared = spark.sparkContext.broadcast((vocabulary_of(first)[0], pattern, f.read()))
    run_id = uuid.uuid4().hex
    names = [f.split()[0] for f in _PAIRS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

    def shown(parts) -> str:
        if digests:
            digest, last, some = hashlib.sha256(), b"", False
            for p in parts:
                digest.update(last)
                last, some = p, True
            digest.update(last[:-1])  # without the sign behind the last group
            return digest.hexdigest() if some else ""
        return b"".join(parts)[:-1].decode()

    def block(number: int, ids: list, merged: Merged):
        pairs, at, held = np.unique(merged.pairs, return_inverse=True, return_counts=True)
        at, times, cuts = at.astype("<i4"), merged.times.astype("<i4"), np.cumsum(merged.n_pairs)[:-1]
        n, m = len(ids), len(pairs)
        docs = [ids, merged.n_a, merged.n_b, merged.n_groups, [shown(g) for g in merged.groups()], *([x.tobytes() for x in np.split(v, cuts)] for v in (at, times))]
        both = [(pairs >> 16).astype(np.int32), (pairs & 0xFFFF).astype(np.int32), held, np.arange(m, dtype=np.int32)]
        arrays = [pa.array(np.full(n + m, number))]
        arrays += [pa.concat_arrays([pa.array(c, k), pa.nulls(m, k)]) for c, k in zip(docs, kinds[1:8])]
        arrays += [pa.concat_arrays([pa.nulls(n, k), pa.array(c, k)]) for c, k in zip(both, kinds[8:])]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        aligner, task = aligner_of(run_id, shared), TaskContext.get().partitionId()
        for made, b in enumerate(b for b in batches if b.num_rows):
            yield block((task << 32) + made, b.column(0).to_pylist(), Merged(aligner, aligner.encode([t or "" for t in b.column(1).to_pylist()])))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PAIRS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, docs) -> a, b, count, top_a and top_b: the documents that hold the pair linked, and the most that any pair of its a or of its b has."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = Scratch(pairs.sparkSession, "counts").keep(counts)
    top = lambda c: counts.groupBy(c).agg(F.max("count").alias(f"top_{c}"))
    return counts.join(top("a"), "a").join(top("b"), "b").select("a", "b", "count", "top_a", "top_b")


def align(docs: DataFrame, first: str, pattern: str, second: str, digests: bool = False) -> DataFrame:
    """doc_id, text -> a row for each row: n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, and groups with links, array of (a, b, times, count); with ``digests`` groups_sha256 instead of both.

    ``first`` is the file of a byte-level BPE, whose added tokens are plain text here, and encodes a space and the text;
    ``second`` is a model that adds the space itself. n_best counts links whose pair is held by as many documents as any of
    its a, n_best_b the same for its b; count_sum adds the counts over links. Null and empty texts, and those whose tokens
    don't join to a space and the text, have zeros, empty groups and no links. Rows repeated with a doc_id, also a null one,
    are documents of their own. Only doc_id and text are read. No rows, no result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    bounded_batches(spark)
    rows = scratch.keep(linked(docs, first, pattern, second, digests))
    pairs = rows.where("a is not null").select(F.col("block").alias("home"), "place", "a", "b", "docs")
    known = scratch.keep(pair_counts(pairs))
    back = pairs.join(known, ["a", "b"]).select("home", "place", "a", "b", "count", (F.col("count") == F.col("top_a")).alias("best_a"), (F.col("count") == F.col("top_b")).alias("best_b"))
    texts = rows.where("a is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times")
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum"]
    kind = "array<struct<a:int,b:int,times:int,count:bigint>>"
    schema = ", ".join(f"{c} long" for c in numbers) + (", groups_sha256 string" if digests else f", groups string, links {kind}")

    def brought(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's documents and its pairs, which any order may bring."""
        of = {c: np.asarray(right.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in right.column_names if c != "home"}
        order = np.argsort(of.pop("place"))
        of = {c: v[order] for c, v in of.items()}
        out, links = [], []
        for d in left.select(["doc_id", "n_a", "n_b", "n_groups", "pairs", "times"]).to_pylist():
            at, times = np.frombuffer(d["pairs"], "<i4"), np.frombuffer(d["times"], "<i4").astype(np.int64)
            out.append((d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], int(times.sum()), int(times[of["best_a"][at]].sum()), int(times[of["best_b"][at]].sum()), int((times * of["count"][at]).sum())))
            if not digests:
                links.append([{"a": a, "b": b, "times": t, "count": n} for a, b, t, n in zip(*(v.tolist() for v in (of["a"][at], of["b"][at], times, of["count"][at])))])
        cols = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * len(numbers)
        cols.append(left.column("groups").combine_chunks())
        if digests:
            return pa.Table.from_arrays(cols, names=[*numbers, "groups_sha256"])
        link = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32()), ("count", pa.int64())]))
        return pa.Table.from_arrays([*cols, pa.array(links, link)], names=[*numbers, "groups", "links"])

    return texts.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(brought, schema)


def op12_align(spark, sf_dir: str) -> DataFrame:
    """Numbers and digest of the groups and links of every document."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"), digests=True)

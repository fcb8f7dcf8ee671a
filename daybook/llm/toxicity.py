"""Operator 9, toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from the hashes of its words;
noisy-or combines them to that of the document, 1 - prod(1 - p). Only documents have labels, and
the trained sentence scores then say which sentences offend.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .features import BITS, bounds_of, sentence_sums, words_and_sentences
from .quality import gathered, sample_of


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def held(doc_id):
    """The same as a column."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class NoisyOr:
    def __init__(self, bias: float = -6.0):
        self.w, self.bias = np.zeros(1 << BITS, np.float32), bias
        self.slope, self.shift = 1.0, 0.0

    def clear(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(log(1 - p) of the sentences, where they end, bytes); words count once per occurrence."""
        sums, ends, n = sentence_sums(text, self.w)
        return -np.logaddexp(0, self.bias + sums), ends, n

    def of_document(self, clear: np.ndarray) -> float:
        """The calibrated score of the noisy-or over all sentences."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(clear) + self.shift, -40, 40))))

    def score(self, text: str | None) -> float:
        return self.of_document(self.clear(text)[0])

    @staticmethod
    def log_odds(clear: np.ndarray) -> float:
        """Of the noisy-or over all sentences."""
        none = clear.sum()
        return float(np.log(np.maximum(-np.expm1(none), 1e-300)) - none)

    def calibrate(self, bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> NoisyOr:
        """Fits slope and shift of the documents' log odds on labelled documents that training did not see, by Newton's method."""
        x = np.array([self.log_odds(-np.logaddexp(0, self.bias + np.bincount(s, self.w[w], minlength=1))) for w, s in bags])
        x = np.stack([np.clip(x, -12, 12), np.ones(len(x))], axis=1)
        theta = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            theta -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([0.01, 0.01]), x.T @ (p - toxic) + 0.01 * (theta - [1.0, 0.0]))
        if theta[0] > 0:
            self.slope, self.shift = map(float, theta)
        return self

    def judged(self, text: str | None, least: float = 0.5, at: float = 0.7) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, byte bounds and probability of the offending sentences): those of ``least`` or more, and of a document of ``at`` or more its likeliest one at least."""
        clear, ends, n = self.clear(text)
        score, p = self.of_document(clear), -np.expm1(clear)
        bad = set(np.flatnonzero(p >= least).tolist()) | ({int(p.argmax())} if score >= at else set())
        bounds = bounds_of(ends, n) if bad else []
        return score, [(*bounds[i], float(p[i])) for i in sorted(bad) if bounds]

    @staticmethod
    def slopes(z: np.ndarray, doc: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
        """(negative log likelihood of the documents, its slopes by the sentences' z): a sentence's share in the noisy-or."""
        clear = np.bincount(doc, -np.logaddexp(0, z), minlength=len(label))
        toxic = np.maximum(-np.expm1(clear), 1e-9)
        odds = np.where(label, -np.exp(clear) / toxic, 1.0)
        return float(np.where(label, -np.log(toxic), -clear).sum()), odds[doc] / (1 + np.exp(-np.clip(z, -40, 40)))

    @staticmethod
    def _part(bags: list, toxic: np.ndarray) -> tuple:
        """(feature, its sentence, the sentence's document, the documents' labels) of some documents; features below 0 are left out."""
        sizes = np.array([int(s.max()) + 1 if len(s) else 1 for _, s in bags])
        first = np.cumsum(sizes) - sizes
        col = np.concatenate([w[w >= 0] for w, _ in bags])
        sent = np.concatenate([s[w >= 0] + f for (w, s), f in zip(bags, first)]).astype(np.int32)
        return col, sent, np.repeat(np.arange(len(bags)), sizes), toxic

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, rounds: int = 300, rate: float = 1.0, least_docs: int = 4, chunk: int = 500) -> NoisyOr:
        """Full-batch gradient descent with momentum on the documents' likelihood.

        The gradient reaches a sentence by its share in the noisy-or. A feature's step is its summed
        gradient over the root of the number of documents that have it, so features that recur learn
        before those that could only memorise single documents; those in fewer than ``least_docs`` stay 0.
        """
        n = len(bags)
        kept_in = np.zeros(1 << BITS, np.int64)
        for w, _ in bags:
            kept_in[np.unique(w)] += 1
        used = np.flatnonzero(kept_in >= least_docs)
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        parts = [self._part([(place[w], s) for w, s in bags[i : i + chunk]], toxic[i : i + chunk]) for i in range(0, n, chunk)]
        w, speed, scale, bias = np.zeros(len(used)), np.zeros(len(used)), rate / np.sqrt(kept_in[used]), self.bias
        for _ in range(rounds):
            g, gb = 0.01 * w, 0.0
            for col, sent, doc, label in parts:
                _, dz = self.slopes(bias + np.bincount(sent, w[col], minlength=len(doc)), doc, label)
                g += np.bincount(col, dz[sent], minlength=len(used))
                gb += dz.sum()
            speed = 0.8 * speed - np.clip(scale * g, -0.3, 0.3)
            w += np.clip(speed, -0.6, 0.6)
            bias = min(-4.0, bias - np.clip(0.02 * gb / np.sqrt(n), -0.1, 0.1))
        self.w[used], self.bias = w, float(bias)
        return self


def late(doc_id: int) -> bool:
    """Which of the training documents are kept for the calibration."""
    return zlib.crc32(f"calibrate {doc_id}".encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, bound: int = 7000, most_bytes: int = 16 << 20) -> NoisyOr:
    """Documents with labels (doc_id, toxic) that aren't held out, about ``bound`` of them by a hash of doc_id and of up to ``most_bytes`` in all; a fifth calibrates."""

    def run(batches):
        for b in batches:
            bags = [words_and_sentences(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([w.astype("<i4").tobytes() for w, _, _ in bags], pa.binary()), pa.array([s.astype("<i4").tobytes() for _, s, _ in bags], pa.binary())], ["doc_id", "toxic", "words", "sentences"])

    seen = labels.where("toxic is not null and doc_id is not null").where(~held(F.col("doc_id")))
    chosen = sample_of(seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), bound)
    rows = gathered(docs, chosen, run, "doc_id long, toxic int, words binary, sentences binary", most_bytes)
    model = NoisyOr()
    if any(r[1] for r in rows):
        bags = [(np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4")) for r in rows]
        toxic, kept = np.array([r[1] == 1 for r in rows]), np.array([late(r[0]) for r in rows])
        if toxic[~kept].any():
            model.fit([b for b, x in zip(bags, kept) if not x], toxic[~kept])
        if toxic[kept].any():
            model.calibrate([b for b, x in zip(bags, kept) if x], toxic[kept])
    return model


def score(docs: DataFrame, model: NoisyOr, at: float = 0.7) -> DataFrame:
    """docs -> doc_id, held_out, score, predicted, offending (start and end bytes in UTF-8 and the probability of each
    sentence of 0.5 or more, and of a document predicted toxic its likeliest sentence at least).

    Null counts as empty; a text without words gets the score of one empty sentence. A model trained
    on no toxic document scores everything near 0. Repeated rows come back as often.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [m.judged(t, at=at) for t in texts]
            p = np.array([x for x, _ in found])
            spans = [[{"start": s, "end": e, "p": q} for s, e, q in bad] for _, bad in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held_out(i) for i in ids]), pa.array(p), pa.array((p >= at).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "held_out", "score", "predicted", "offending"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,p:double>>")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, offending for each row of documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))

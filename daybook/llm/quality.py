"""Operator 8, quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w.x - threshold_k), with one weight vector over hashed text for all grades
and rising thresholds. Training takes a bounded sample of the labelled rows; scoring covers all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table
from .features import BITS, gram_counts, shape

#: Weight of a text's shape beside its n-grams, whose values sum to GRAMS.
GRAMS, SHAPE = 6.0, 0.5


def sample_of(labelled: DataFrame, bound: int) -> DataFrame:
    """At most about ``bound`` rows, chosen by a hash of doc_id: the same ones on every run."""
    n = labelled.count()
    return labelled if n <= bound else labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * bound / n))


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and values."""
    (ids, counts, n), s = gram_counts(text), shape(text)
    values = np.sqrt(counts / max(1, n))
    values *= GRAMS / max(1e-9, values.sum())
    return np.concatenate([ids, s]), np.concatenate([values, np.full(len(s), SHAPE)]).astype(np.float32)


def gathered(docs: DataFrame, chosen: DataFrame, run, kinds: str, most_bytes: int) -> list:
    """Features of the documents whose doc_id is among the sample ``chosen`` (doc_id, label), as a driver list by doc_id: the only rows that are ever collected.

    Of rows with one doc_id the smallest text counts. In the order of a hash of doc_id, documents
    are taken until their texts have ``most_bytes`` bytes; those longer than a 64th of it are left
    out, whole. So the list depends on the rows alone, not on how they are dealt to tasks, and its
    size on neither the corpus nor its longest texts.
    """
    scratch = Scratch(docs.sparkSession, "sample")
    label = next(c for c in chosen.columns if c != "doc_id")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows, path = scratch.write(found.groupBy("doc_id", label).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    taken, total = [], 0
    for doc, n in rows.select("doc_id", F.octet_length("text"), F.xxhash64("doc_id", F.lit("order")).alias("at")).orderBy("at", "doc_id").drop("at").collect():
        if n <= most_bytes // 64 and total + n <= most_bytes:
            taken.append((doc,))
            total += n
    bounded_batches(docs.sparkSession)
    ids = F.broadcast(docs.sparkSession.createDataFrame(taken, chosen.select("doc_id").schema))
    out = rows.join(ids, "doc_id", "left_semi").select(F.col("doc_id").cast("long"), F.col(label).cast("int"), "text").mapInArrow(run, kinds).collect()
    scratch.drop(path)
    return sorted(out)


class CumulativeLink:
    def __init__(self, grades: int):
        self.w = np.zeros(1 << BITS, np.float32)
        self.cuts = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(max(0, grades - 1))

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a row for each document."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -40, 40)))

    def slopes(self, z: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(negative log likelihood, its slopes by z and by the cuts); a grade's likelihood is the difference of its two tails."""
        n, k = len(z), len(self.cuts)
        t = np.concatenate([np.ones((n, 1)), self.tails(z), np.zeros((n, 1))], axis=1)
        up, down = t[np.arange(n), grade], t[np.arange(n), grade + 1]
        p = np.maximum(up - down, 1e-9)
        dc = np.zeros(k)
        np.add.at(dc, (grade - 1)[grade > 0], (up * (1 - up) / p)[grade > 0])
        np.add.at(dc, grade[grade < k], -(down * (1 - down) / p)[grade < k])
        return float(-np.log(p).sum()), -(up * (1 - up) - down * (1 - down)) / p, dc

    def fit(self, ids: list[np.ndarray], values: list[np.ndarray], grade: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 1e-5) -> CumulativeLink:
        """Full-batch AdaGrad on the likelihood of the grades."""
        row = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids])
        col, val = np.concatenate(ids), np.concatenate(values)
        seen = np.zeros(1 << BITS, bool)
        seen[col] = True
        used, place = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)
        col = place[col]
        w, cuts = np.zeros(len(used)), self.cuts
        gw, gc = np.full(len(used), 1e-8), np.full(len(cuts), 1e-8)
        k, n = len(cuts), len(ids)
        for _ in range(rounds):
            _, dz, dc = self.slopes(np.bincount(row, val * w[col], minlength=n), grade)
            g = np.bincount(col, val * dz[row], minlength=len(used)) / n + decay * w
            gw, gc = gw + g * g, gc + (dc / n) ** 2
            w -= rate * g / np.sqrt(gw)
            self.cuts = cuts = np.sort(cuts - rate * (dc / n) / np.sqrt(gc)) if k else cuts
        self.w[used] = w
        return self

    def score(self, text: str | None) -> float:
        ids, values = vector(text)
        return float(self.w[ids] @ values)


def train(docs: DataFrame, ratings: DataFrame, bound: int = 5000, most_bytes: int = 16 << 20) -> CumulativeLink:
    """ratings (doc_id, grade 0..) joined to docs; about ``bound`` rated documents of up to ``most_bytes`` in all train the model.

    Null grades and texts without rating are left out; of several grades of a doc_id the lowest counts.
    """

    def run(batches):
        for b in batches:
            both = [vector(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in both], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in both], pa.binary())], ["doc_id", "grade", "ids", "vals"])

    chosen = sample_of(ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade")), bound)
    rows = gathered(docs, chosen, run, "doc_id long, grade int, ids binary, vals binary", most_bytes)
    top = max((r[1] for r in rows), default=0)
    model = CumulativeLink(top + 1)
    if rows and top:
        model.fit([np.frombuffer(r[2], "<i4") for r in rows], [np.frombuffer(r[3], "<f4") for r in rows], np.array([r[1] for r in rows]))
    return model


def classify(docs: DataFrame, model: CumulativeLink, least_grade: int = 1, enough: float = 0.3) -> DataFrame:
    """docs -> doc_id, expected_grade, p_tail, kept: P(grade >= least_grade) and whether it is ``enough``.

    The default rejects only what is clearly bad. Null counts as empty; empty texts are scored by
    their shape. A model of one grade (no ratings, or all alike) keeps everything. Repeated rows come back as often.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            tails = m.tails(np.array([m.score(t) for t in b.column(1).to_pylist()]))
            tail = tails[:, least_grade - 1] if tails.shape[1] >= least_grade else np.ones(len(tails))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= enough)], ["doc_id", "expected_grade", "p_tail", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_tail double, kept boolean")


def keep_good(docs: DataFrame, model: CumulativeLink, least_grade: int = 1, enough: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that ``classify`` keeps."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            tails = m.tails(np.array([m.score(t) for t in b.column("text").to_pylist()]))
            ok = tails[:, least_grade - 1] >= enough if tails.shape[1] >= least_grade else np.ones(len(tails), bool)
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 bad, 1 readable but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, p_tail, kept for each row of documents."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, ratings_of(table(spark, sf_dir, "labels"))))

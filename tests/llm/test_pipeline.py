"""Every stage of the pipeline, and all of it, against plain Python."""

import collections
import random
import re
import zlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
from daybook.llm import packing, quality
from pyspark.sql import functions as F
from test_exact_and_lines import brute_lines
from test_models import WORDS
from test_pii import base
from test_similar import brute
from tokenizers import Tokenizer

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
HF = Tokenizer.from_file(packing.production()[0])


def made(n=240, seed=3):
    """Documents with junk, shared lines, near copies, personal data, empty and missing texts, a long one and a repeated row."""
    r, out = random.Random(seed), []
    for i in range(n):
        lines = [" ".join(r.choice(WORDS) for _ in range(r.randint(5, 12))) for _ in range(r.randint(2, 9))]
        if i % 7 == 0:
            lines.insert(1, "a line that many of the documents share")
        if i % 9 == 0:
            lines[-1] += f" write to user{i}@example.org or call +1 (234) 567-8{i:03}."
        text = "\n".join(lines)
        if i % 8 == 3:
            text = text.replace(" ", "### ")
        if i % 10 == 4 and out:
            words = (out[-3][1] or "x").split(" ")
            words[len(words) // 2] = "changed"
            text = "  ".join(words)
        out.append((i, text, "en", f"s{i % 3}", len(text)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "word " * 30_000, "en", "s", 150_000), (5, *out[5][1:]), (None, "no id\nat all", "en", "s", 12)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('sf')}"
    rows = made()
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int("###" not in (t or "")), int(i % 11 == 0)) for i, t, *_ in rows if i is not None and i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def docs_of(spark, rows):
    """With a column of a clashing name for every stage; stages keep the columns of documents."""
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    for name in ("pii", "kept_text", "n_lines", "component_id", "tag", "piece", "length"):
        df = df.withColumn(name, F.lit("x"))
    return df


def redacted(text):
    out, at = "", 0
    for start, _, end, kind in base(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def check_packs(rows, docs):
    """Whole documents, in pieces of 1,024 at most, without gaps, in no more sequences than best fit takes."""
    whole = collections.defaultdict(list)
    for i, t in docs:
        ids = np.array([*HF.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        k, at, piece = len(ids) % 1024 or 1024, 0, 0
        while at < len(ids):
            whole[str(i)].append((piece, at, k, zlib.crc32(ids[at : at + k].tobytes())))
            at, k, piece = at + k, 1024, piece + 1
    got, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        got[str(r.doc_id)].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in whole.items()}
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    lengths = collections.Counter(r.length for r in rows)
    assert packing.waste_bound(lengths, 1024) <= len(bins) <= sum(n for _, n in packing.best_fit(lengths, 1024))


def test_quality_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, quality.ratings_of(spark.read.parquet(f"{folder}/labels.parquet")))
    want = [(i, t) for i, t, *_ in made() if model.tails(np.array([model.score(t)]))[0, 0] >= 0.3]
    out = pipeline.good_quality(spark, docs_of(spark, made()), folder)
    assert out.columns == pipeline.COLUMNS and texts(out) == sorted(want, key=str)
    clean = [x for x in made() if "###" not in (x[1] or "")]
    assert len(want) < len(made()) and sum((x[0], x[1]) in want for x in clean) > 0.9 * len(clean)


def test_line_stage(spark, folder):
    out = pipeline.fresh_lines(spark, docs_of(spark, made()), folder)
    assert out.columns == pipeline.COLUMNS
    assert texts(out) == sorted(((i, t) for i, _, _, t in brute_lines([(i, t) for i, t, *_ in made()])), key=str)
    assert out.where("n_chars <> length(text)").count() == 0


def test_near_duplicates_stage(spark, folder):
    rows = made()
    roots = brute([(i, t) for i, t, *_ in rows])
    want = [(i, t) for i, t, *_ in rows if i is None or roots[i] == i]
    assert len(want) < len(rows) - 10
    out = pipeline.one_of_each(spark, docs_of(spark, rows), folder)
    assert out.columns == pipeline.COLUMNS and texts(out) == sorted(want, key=str)


def test_personal_data_stage(spark, folder):
    out = pipeline.without_pii(spark, docs_of(spark, made()), folder)
    assert out.columns == pipeline.COLUMNS
    assert texts(out) == sorted(((i, redacted(t or "")) for i, t, *_ in made()), key=str)
    assert not out.where("text like '%@example.org%'").count()


def test_packing_stage(spark, folder):
    check_packs(pipeline.packs(spark, docs_of(spark, made()), folder).collect(), [(i, t) for i, t, *_ in made()])


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_empty_tables_and_lone_rows(spark, folder, name, stage):
    assert stage(spark, docs_of(spark, made()).limit(0), folder).count() == 0
    for row in [(1, None, None, None, None), (1, "", "", "", 0)]:
        assert stage(spark, docs_of(spark, [row]), folder).count() == 1


def test_the_whole_pipeline(spark, folder):
    """run() equals the stages done one by one in plain Python, on what the classifier keeps."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = texts(pipeline.good_quality(spark, docs, folder))
    lines = [(i, t) for i, _, _, t in brute_lines(kept)]
    roots = brute(lines)
    single = [(i, redacted(t)) for i, t in lines if i is None or roots[i] == i]
    assert not any(re.search(r"user\d+@", t) for _, t in single)
    check_packs(pipeline.run(spark, folder).collect(), single)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import features, quality, toxicity
from daybook.llm.features import words_and_sentences

WORDS = [a + b for a in "bcdfgklmnprst" for b in ("a", "e", "ing", "ori", "um")]


def corpus(n=900, seed=1):
    """(doc_id, text, quality, toxic): junk has signs after words, toxic documents one sentence with a bad word."""
    rng, out = random.Random(seed), []
    for i in range(n):
        sents = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 9))) for _ in range(rng.randint(2, 8))]
        bad, junk = rng.random() < 0.25, rng.random() < 0.2
        if bad:
            at = rng.randrange(len(sents))
            sents[at] += " " + rng.choice(["vileness", "vilely", "scorned"])
        text = ". ".join(sents)
        out.append((i, text.replace(" ", "### ") if junk else text, int(not junk), int(bad)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, quality int, toxic int").cache()


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    ids = [np.array([int(g), 10 + i % 7]) for i, g in enumerate(grade)]
    m = quality.CumulativeLink(3).fit(ids, [np.ones(2)] * 600, grade)
    assert (np.diff(m.cuts) > 0).all()
    z = np.array([m.w[g] for g in range(3)])
    assert (np.diff(z) > 0).all()
    assert (np.argmax(-np.diff(np.concatenate([np.ones((3, 1)), m.tails(z), np.zeros((3, 1))], axis=1)), axis=1) == [0, 1, 2]).all()


def test_quality(docs):
    model = quality.train(docs.where("doc_id < 600"), quality.ratings_of(docs))
    rows = quality.classify(docs, model).join(docs, "doc_id").where("doc_id >= 600").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.97
    assert quality.keep_good(docs, model).columns == docs.columns


def test_toxicity_held_out_and_sentences(docs):
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    rows = toxicity.score(docs, model).join(docs.select("doc_id", "text", "toxic"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    spans = [r.text.encode()[s.start : s.end] for r in rows if r.predicted for s in r.offending]
    assert spans and np.mean([b"vile" in x or b"scorned" in x for x in spans]) > 0.9


def test_held_out_is_the_same_on_both_sides(spark):
    got = spark.range(200).select("id", toxicity.held(F.col("id")).alias("h")).collect()
    assert all(r.h == toxicity.held_out(r.id) for r in got) and any(r.h for r in got)


def test_held_out_labels_are_never_used(docs):
    flipped = docs.select("doc_id", F.when(toxicity.held(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    a, b = toxicity.train(docs, docs.select("doc_id", "toxic")), toxicity.train(docs, flipped)
    assert (a.w == b.w).all()


def test_odd_inputs(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "!!!"), (4, "w" * 50_000), (4, "w" * 50_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, toxicity.train(odd, none)).collect())
    assert quality.classify(odd, quality.train(odd, quality.ratings_of(none))).where("kept").count() == 6
    assert toxicity.score(odd.limit(0), toxicity.NoisyOr()).count() == 0


def test_sentences_of_words():
    words, sentence, bounds = words_and_sentences("One two. Three!\nvier", ())
    assert sentence.tolist() == [0, 0, 1, 3] and bounds[0] == (0, 8) and len(words) == 4
    assert words_and_sentences("a b")[0].tolist() == words_and_sentences("A  B")[0].tolist()


def test_models_and_scores_do_not_depend_on_the_layout(spark, docs):
    """Rows dealt to tasks in three ways, repeated rows among them, give the same weights and the same scores."""
    twice = docs.union(docs.where("doc_id % 9 = 0")).union(docs.where("doc_id % 50 = 0").withColumn("text", F.concat("text", F.lit(" more"))))
    found = []
    for way in (twice.repartition(7, "text"), twice.coalesce(1), twice.repartition(3).orderBy(F.desc("doc_id"))):
        tox, qual = toxicity.train(way, way.select("doc_id", "toxic")), quality.train(way, quality.ratings_of(way))
        a = sorted((r.doc_id, r.score, r.predicted) for r in toxicity.score(way, tox).collect())
        b = sorted((r.doc_id, r.expected_grade, r.kept) for r in quality.classify(way, qual).collect())
        found.append((tox.w.tobytes(), tox.bias, tox.slope, tox.shift, qual.w.tobytes(), qual.cuts.tobytes(), a, b))
    assert found[0] == found[1] == found[2] and len(found[0][-1]) == twice.count()


def test_very_long_labelled_texts_do_not_train(spark, docs):
    long = spark.createDataFrame([(10_001, "vileness. " * 400_000, 1, 1), (10_002, "plain words " * 300_000, 1, 0)], docs.schema)
    for train in (lambda d: toxicity.train(d, d.select("doc_id", "toxic")), lambda d: quality.train(d, quality.ratings_of(d))):
        assert (train(docs).w == train(docs.union(long)).w).all()
    few = quality.gathered(docs, docs.select("doc_id", F.lit(1).alias("g")), lambda bs: bs, "doc_id long, g int, text string", 20_000)
    assert 0 < sum(len(r.text.encode()) for r in few) <= 20_000 and all(len(r.text.encode()) <= 20_000 // 64 for r in few)


def numeric(f, x, i, h=1e-5):
    up, down = x.copy(), x.copy()
    up[i], down[i] = up[i] + h, down[i] - h
    return (f(up) - f(down)) / (2 * h)


def test_slopes_of_the_grades_are_those_of_finite_differences():
    rng = np.random.default_rng(1)
    m = quality.CumulativeLink(4)
    m.cuts = np.array([-1.2, 0.1, 0.9])
    z, grade = rng.normal(size=12), rng.integers(0, 4, 12)

    def loss(z, cuts):
        sig = lambda x: 1 / (1 + np.exp(-x))
        tail = lambda i, k: 1.0 if k < 0 else 0.0 if k == len(cuts) else sig(z[i] - cuts[k])
        return -sum(np.log(tail(i, g - 1) - tail(i, g)) for i, g in enumerate(grade))

    value, dz, dc = m.slopes(z, grade)
    assert value == pytest.approx(loss(z, m.cuts))
    assert dz == pytest.approx([numeric(lambda x: loss(x, m.cuts), z, i) for i in range(12)], abs=1e-6)
    assert dc == pytest.approx([numeric(lambda x: loss(z, x), m.cuts, i) for i in range(3)], abs=1e-6)


def test_slopes_of_the_noisy_or_are_those_of_finite_differences():
    rng = np.random.default_rng(2)
    doc, label = np.array([0, 0, 0, 1, 2, 2, 3, 3]), np.array([True, False, False, True])
    z = rng.normal(size=8)

    def loss(z):
        out = 0.0
        for d in range(4):
            clear = np.prod([1 - 1 / (1 + np.exp(-x)) for x in z[doc == d]])
            out -= np.log(1 - clear if label[d] else clear)
        return out

    value, dz = toxicity.NoisyOr.slopes(z, doc, label)
    assert value == pytest.approx(loss(z))
    assert dz == pytest.approx([numeric(loss, z, i) for i in range(8)], abs=1e-6)


def slow_words(text):
    """(sentence, word or beginning) by plain loops over bytes."""
    sentence, word, out = 0, b"", []
    for c in [*(text or "").encode(), 32]:
        letter = 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128
        if letter:
            word += bytes([c + 32 if 65 <= c < 91 else c])
        elif word:
            out += [(sentence, word, 0)] + [(sentence, word[:k], k) for k in features.PREFIXES if len(word) > k]
            word = b""
        sentence += c in b"\n\r!.?"
    return out, sentence + 1


def test_score_equals_the_slow_one(docs):
    """Noisy-or as a product over sentences, with a weight for each word and beginning that a dictionary holds."""
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    texts = [r.text for r in docs.limit(60).collect()] + [None, "", "!", "One. two?Three", "Äö vileness. x", "vileness" * 30]
    weight = {}
    for t in texts:
        ids, sentence, _ = words_and_sentences(t)
        listed, _ = slow_words(t)
        order = [x for x in listed if x[2] == 0] + [x for k in features.PREFIXES for x in listed if x[2] == k]
        assert [x[0] for x in order] == sentence.tolist()
        for (_, w, k), i in zip(order, ids.tolist()):
            assert weight.setdefault((w, k), model.w[i]) == model.w[i]
    for t in texts:
        listed, n = slow_words(t)
        z = np.full(n, model.bias)
        for s, w, k in listed:
            z[s] += weight[w, k]
        clear = np.prod(1 / (1 + np.exp(z)))
        want = 1 / (1 + np.exp(-(model.slope * (np.log(1 - clear) - np.log(clear)) + model.shift)))
        assert model.score(t) == pytest.approx(want, abs=1e-6)


def test_long_texts_in_parts_score_the_same(docs, monkeypatch):
    tox, qual = toxicity.train(docs, docs.select("doc_id", "toxic")), quality.train(docs, quality.ratings_of(docs))
    texts = [r.text for r in docs.limit(20).collect()] + ["word" * 200, "a. b! " * 100, "vileness " * 60, "ä" * 300, "", "\n" * 200]
    whole = [(tox.judged(t), qual.score(t)) for t in texts]
    for size in (16, 64, 150):
        monkeypatch.setattr(features, "CHUNK", size)
        for t, ((p, spans), q) in zip(texts, whole):
            p2, spans2 = tox.judged(t)
            assert p2 == pytest.approx(p) and [s[:2] for s in spans2] == [s[:2] for s in spans] and qual.score(t) == pytest.approx(q)


def test_a_toxic_document_names_a_sentence(docs):
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    model.shift += 6
    rows = toxicity.score(docs, model).collect()
    assert any(r.predicted for r in rows) and all(r.offending for r in rows if r.predicted)

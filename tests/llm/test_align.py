import bisect
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daybook.llm import align

FILES = (P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SCHEMA = "doc_id long, text string"


def brute(rows):
    """By the untouched libraries over whole texts and comparison of byte ranges."""
    t, sp = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    t.encode_special_tokens = True
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in signs)}

    def of_a(i):
        return bytes(byte[c] for c in t.id_to_token(i))

    def of_b(i):
        return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()

    def ends(tokens):
        out, at = [], 0
        for x in tokens:
            at += len(x)
            out.append(at)
        return out

    docs = []
    for doc, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        ta, tb = [of_a(i) for i in a], [of_b(i) for i in b]
        if not text or not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            docs.append((doc, None))
            continue
        ea, eb = ends(ta), ends(tb)
        groups, i, j = [], 0, 0
        for c in sorted(set(ea) & set(eb)):
            m, n = bisect.bisect_right(ea, c), bisect.bisect_right(eb, c)
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        links = []
        for m, stop in enumerate(ea):
            start = stop - len(ta[m])
            n = bisect.bisect_right(eb, start)
            while n < len(b) and eb[n] - len(tb[n]) < stop:
                links.append((a[m], b[n]))
                n += 1
        docs.append((doc, (a, b, groups, links)))
    count = Counter(p for _, d in docs if d for p in set(d[3]))
    top: dict = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for doc, d in docs:
        if d is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = d
            out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(align.op12_align(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_odd_texts(spark):
    """Signs of both vocabularies and outside them, every kind of blank, nulls, repeated ids, long texts, clashing names."""
    any_of = random.Random(5)
    bits = ["a", "'s", " ", "  ", "\n", "\t", "<|endoftext|>", "<s>", "<0x41>", "▁", "é", "你好", "​", "\x00", "\xa0", "　", "12", "word", "Word", "...", "ﬁ", "👍🏽", "\x1c", "\x85", "é", " "]
    rows = [(i, any_of.choice([None, ""]) if any_of.random() < 0.03 else "".join(any_of.choice(bits) for _ in range(any_of.choice([1, 2, 3, 8, 30])))) for i in range(1500)]
    rows += [(1, "again word"), (None, "null id word"), (9, "x" * 50_000), (8, " word" * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x")).withColumn("pairs", F.lit(1)).withColumn("a", F.lit(1)).repartition(3)
    assert found(align.align(df, *FILES, digests=True)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], SCHEMA)
    assert found(align.align(df, *FILES, digests=True)) == [(1, *[0] * 6, ""), (2, *[0] * 6, ""), (None, *[0] * 6, "")]
    assert align.align(df.where("false"), *FILES).count() == 0


def test_groups_and_links(spark):
    rows = [(1, "the theatre"), (2, "the")]
    got = {r.doc_id: r for r in align.align(spark.createDataFrame(rows, SCHEMA).coalesce(1), *FILES).collect()}
    want = {r[0]: r for r in brute(rows)}
    for i, r in got.items():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == want[i][-1]
        assert sum(x.times for x in r.links) == r.n_links and sum(x.times * x["count"] for x in r.links) == r.count_sum
    assert len(got[2].links) == 1 and got[2].links[0]["count"] == 2
    assert got[2].n_best_b == 1


def test_blocks_meet(spark):
    """Counts go over all blocks, however the rows are dealt."""
    rows = [(i, f"same words here {i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    spread = [found(align.align(df.repartition(n), *FILES, digests=True)) for n in (1, 9)]
    assert spread[0] == spread[1] == brute(rows)


def test_few_pieces_are_remembered(spark):
    a = align.Aligner(align.vocabulary_of(FILES[0])[0], FILES[1], open(FILES[2], "rb").read(), remember=3)
    texts = [f"one two {i} three" for i in range(20)]
    assert [a.encode([t])[0] for t in texts] == a.encode(texts)

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from daybook.llm import bpe, packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SOUP = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcthe \n\t's12.,　\x1c\x85")), max_size=80)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_perfect_hash(codec):
    keys = list(codec.ranks)
    assert (codec.table.find(keys) == np.arange(len(keys))).all()
    assert (codec.table.find([b"", b"zzqqxx12", b"\xff\xfe\xfa"]) == -1).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(SOUP, max_size=20))
def test_encoding_equals_the_library(codec, library, texts):
    for text, ids in zip(texts, codec.encode_batch(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 20_000, " " * 5000, "ab" * 9000, "<|endoftext|>"])
def test_long_texts(codec, library, text):
    assert next(codec.encode_batch([text])).tolist() == library.encode_ordinary(text)


def test_forgetting_changes_nothing(library):
    small = bpe.Codec(bpe.read_ranks(PATH), PATTERN, remember=5)
    texts = [f"word{i} and more {i * 7}" for i in range(50)]
    assert [i.tolist() for x in texts for i in small.encode_batch([x])] == [library.encode_ordinary(x) for x in texts]


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None), (2, None), (None, "")], "doc_id long, text string").selectExpr("*", "1 as ids")
    rows = bpe.encode(df, PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded), len(r.ids)) for r in rows) == [("1", b"hello", 2), ("2", b"", 0), ("2", b"", 0), ("None", b"", 0)]
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


END = "<|endoftext|>"
RANKS, ADDED = packing.vocabulary_of(packing.production()[0])
ENCODER = packing.Encoder(RANKS, PATTERN, ADDED)
HF = Tokenizer.from_file(packing.production()[0])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(SOUP, st.sampled_from([END, " " + END, END[:-1], "<", "|>", "\n"])), max_size=6).map("".join))
def test_packing_ids_equal_the_tokenizer(text):
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [f"hi {END} there", END, END * 3, f" {END} ", f"a{END}b", f"<|{END}|>", f"x  {END}\n\n{END}  y", "<|ENDOFTEXT|>"])
def test_the_end_mark_in_a_text(text):
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


def fewest(items, capacity):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {b: j for j, b in enumerate(bins) if b >= items[i]}.items():
            bins[b[1]] -= items[i]
            go(i + 1, bins)
            bins[b[1]] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 37])
    items = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 9)))
    fillings, bound = packing.bin_completion(dict(items), capacity)
    used = collections.Counter()
    for filling, n in fillings:
        assert sum(x * k for x, k in filling) <= capacity
        used.update({x: k * n for x, k in filling})
    best = fewest(list(items.elements()), capacity)
    assert used == items and sum(n for _, n in fillings) == best and bound <= best


def checked(counts, capacity, **limits):
    """The number of bins, best fit's and the bound, after a check that the packing is whole."""
    fillings, bound = packing.bin_completion(counts, capacity, **limits)
    assert all(n > 0 and sum(x * k for x, k in filling) <= capacity for filling, n in fillings)
    assert packing.histogram(fillings) == {x: n for x, n in counts.items() if n}
    return sum(n for _, n in fillings), sum(n for _, n in packing.best_fit(counts, capacity)), bound


def test_completion_beats_best_fit():
    won = 0
    for seed in range(40):
        rng = random.Random(seed)
        exact = collections.Counter()
        for _ in range(30):
            left = 100
            while left:
                x = min(left, rng.randint(18, 60))
                exact[x] += 1
                left -= x
        got, quick, bound = checked(dict(exact), 100)
        assert bound <= got <= quick
        won += got < quick
    assert won >= 10


def test_completion_beats_best_fit_on_large_counts():
    """Each length a thousand times: fillings are used many times at once, so the search stays as small."""
    counts = {x: 1000 for x in (6, 5, 4, 3, 2, 7)} | {9: 1000}
    got, quick, bound = checked(counts, 12)
    assert got == bound == 3000
    won = 0
    for seed in range(3):
        rng = random.Random(seed)
        wide = collections.Counter()
        for _ in range(400):
            a, b = sorted(rng.sample(range(90, 934), 2))
            for x in (a, b - a, 1024 - b):
                wide[x] += 500
        got, quick, bound = checked(dict(wide), 1024)
        assert bound <= got <= quick
        won += got < quick
    assert won >= 2


@pytest.mark.parametrize("seed", range(20))
def test_completions_are_the_undominated_fillings(seed):
    rng = random.Random(seed)
    left = dict(collections.Counter(rng.randint(1, 9) for _ in range(8)))
    capacity, top = 14, max(left)
    spare = collections.Counter(left) - collections.Counter([top])
    every = set()
    pool = sorted(spare.elements())
    for mask in range(1 << len(pool)):
        chosen = tuple(sorted(x for i, x in enumerate(pool) if mask >> i & 1))
        if sum(chosen) <= capacity - top:
            every.add(chosen)

    def beaten(chosen):
        waste, over = capacity - top - sum(chosen), spare - collections.Counter(chosen)
        return any(y <= waste or any(0 < y - x <= waste for x in chosen) for y in over)

    got = [(w, tuple(sorted((collections.Counter(dict(f)) - collections.Counter([top])).elements()))) for w, f in packing.completions(left, capacity, capacity)]
    assert [w for w, _ in got] == sorted(w for w, _ in got) and len(got) == len(set(got))
    assert {f for _, f in got} == {f for f in every if not beaten(f)}


def test_packing_table(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "cat", "xyzzy", "löwe"]) for _ in range(rng.choice([0, 3, 40, 900])))) for i in range(300)] + [(300, None), (301, "t " * 5000), (302, f"a {END} b{END}"), (7, "again"), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as length", "5 as sequence_id").repartition(5)
    rows = packing.packed(df, *packing.production()).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    whole = {str(i): np.append(np.array(HF.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4") for i, t in docs if i != 7}
    for r in rows:
        if r.doc_id != 7:
            assert zlib.crc32(whole[str(r.doc_id)][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    lengths = collections.Counter(r.length for r in rows)
    assert packing.waste_bound(lengths, 1024) <= len(bins) <= sum(n for _, n in packing.best_fit(lengths, 1024))
    long = sorted((r.piece, r.length) for r in rows if r.doc_id == 301)
    assert all(n == 1024 for _, n in long[1:]) and [p for p, _ in long] == list(range(len(long)))
    assert packing.packed(df.limit(0), *packing.production()).count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    (row,) = packing.sequences(df, *packing.production()).collect()
    assert sorted(row.ids) == sorted([*HF.encode("a b c").ids, 2, *HF.encode("d").ids, 2])

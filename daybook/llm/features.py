"""Hashed features of whole texts, computed with numpy over the bytes of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The hash space, as bits: weights are one float each.
BITS = 18
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, np.uint64(0x100000001B3), np.uint64))
#: Bytes that separate words (ASCII letters, digits and all bytes of other scripts make words) and bytes that end sentences.
_WORD = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _WORD[list(_r)] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes for the shape of a text: 1 blank, 2 capital, 3 digit, 4 sign, 0 other.
_KIND = np.zeros(256, np.uint8)
_KIND[33:128][~_WORD[33:128]] = 4
_KIND[65:91], _KIND[48:58], _KIND[:33] = 2, 3, 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _P
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


#: Beginnings of words that are features beside the whole words, in bytes.
PREFIXES = (4, 5, 6, 8)


#: Bytes of a text that are handled at once.
CHUNK = 1 << 20


def words_and_sentences(text: str | None, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(hashes of each word and its beginnings, the numbers of their sentences, byte bounds of the sentences)."""
    b = as_bytes(text)
    if not len(b):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), []
    ids, sentence, stops = _words(b, prefixes)
    return ids, sentence, bounds_of(stops, len(b))


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def bounds_of(stops: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Sentences end behind their stops, the last one with the text."""
    return list(zip([0, *stops.tolist()], [*stops.tolist(), n])) if n else []


def _words(raw: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, sentence numbers, where sentences end) of some bytes."""
    b = _LOWER[raw]
    stops = np.flatnonzero(_STOP[b]) + 1
    edge = np.diff(np.concatenate([[False], _WORD[b], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), stops
    n = ends - starts
    begin = starts if not starts[0] else np.append(0, starts)
    step = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
    so_far = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS[step & 63])])
    sentence = np.searchsorted(stops, starts, side="right")
    ids, places = [_mix(so_far[ends] - so_far[starts] + n.astype(np.uint64))], [sentence]
    for k in prefixes:
        long = n > k
        ids.append(_mix(so_far[starts[long] + k] - so_far[starts[long]] + np.uint64(k * 7_654_321)))
        places.append(sentence[long])
    return np.concatenate(ids), np.concatenate(places), stops


def chunks(raw: np.ndarray, size: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of consecutive parts of about CHUNK bytes, cut between words; a longer word stays whole."""
    size, at = size or CHUNK, 0
    while len(raw) - at > size:
        end = at + size
        while end < len(raw) and _WORD[raw[end]] and _WORD[raw[end - 1]]:
            gap = np.flatnonzero(~_WORD[raw[end : end + size]])
            end += int(gap[0]) if len(gap) else len(raw[end : end + size])
        yield at, raw[at:end]
        at = end
    yield at, raw[at:]


def sentence_sums(text: str | None, weights: np.ndarray, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray, int]:
    """(the weights of each sentence's words summed, where sentences end, bytes), part by part: memory beyond the text is that of a part and of the sentences."""
    raw = as_bytes(text)
    sums, ends = [np.zeros(1)], []
    for at, part in chunks(raw):
        ids, sentence, stops = _words(part, prefixes)
        own = np.bincount(sentence, weights[ids], minlength=len(stops) + 1)
        sums[-1][-1] += own[0]
        sums.append(own[1:]) if len(own) > 1 else None
        ends.append(stops + at)
    return np.concatenate(sums), np.concatenate(ends), len(raw)


def gram_counts(text: str | None, size: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct hashes of the byte n-grams of the lower-cased text, how often each occurs, how many there are)."""
    raw = as_bytes(text)
    total = max(0, len(raw) - size + 1)

    def hashes(part: np.ndarray) -> np.ndarray:
        b, h = _LOWER[part].astype(np.uint64), np.zeros(len(part) - size + 1, np.uint64)
        for i in range(size):
            h = h * np.uint64(257) + b[i : len(b) - size + 1 + i] + np.uint64(1)
        return _mix(h)

    if total <= CHUNK:
        return *np.unique(hashes(raw) if total else np.zeros(0, np.int32), return_counts=True), total
    counts = np.zeros(1 << BITS, np.int64)
    for at in range(0, total, CHUNK):
        counts += np.bincount(hashes(raw[at : min(len(raw), at + CHUNK + size - 1)]), minlength=1 << BITS)
    ids = np.flatnonzero(counts)
    return ids.astype(np.int32), counts[ids], total


def shape(text: str | None) -> np.ndarray:
    """Hashes of the text's measures in steps, one for each measure: shares of signs, distinct words, capitals, digits and blanks, the most frequent word, sizes."""
    raw = as_bytes(text)
    counts, sentences = {}, 1 if len(raw) else 0
    many = np.zeros(1 << BITS, np.int64) if len(raw) > CHUNK else None
    for _, part in chunks(raw):
        ids, _, stops = _words(part, ())
        sentences += len(stops)
        if many is not None:
            many += np.bincount(ids, minlength=1 << BITS)
        else:
            counts = np.unique(ids, return_counts=True)[1]
    if many is not None:
        counts = many[many > 0]
    words, distinct_words, most = (int(np.sum(counts)), len(counts), int(np.max(counts))) if len(counts) else (0, 0, 0)
    n = max(1, len(raw))
    of = np.bincount(_KIND[raw], minlength=5) if len(raw) <= CHUNK else sum(np.bincount(_KIND[part], minlength=5) for _, part in chunks(raw))
    blank, upper, digit, signs = of[1] / n, of[2] / n, of[3] / n, of[4] / n
    distinct, common = distinct_words / max(1, words), most / words if words else 0.0
    size = np.log2(words + 1)
    steps = [signs * 50, distinct * 20, upper * 50, digit * 50, blank * 40, common * 20, np.log2(n + 1), size, words / max(1, sentences) / 2, size // 2 * 21 + min(20, distinct * 20)]
    return _mix(np.array([(k + 1) * 1_000_003 + int(min(v, 900)) for k, v in enumerate(steps)], np.uint64) * _P)

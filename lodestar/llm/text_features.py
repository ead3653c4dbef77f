"""Hashed indicator n-grams of whole texts, made with numpy from code points."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np

_TOP = 0x32400  # code points from here on count as neither letter nor space
_CHUNK = 1 << 21  # code points worked on at a time; n-grams and words go on from one chunk to the next
_TOGETHER = 1 << 17  # code points (or words) of texts that are worked on side by side
_MIX, _MIX_NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_tables: dict[str, np.ndarray] = {}


def tables() -> dict[str, np.ndarray]:
    """By code point: lower case, is letter, is upper case, is white space. Made once per process."""
    if not _tables:
        chars = [chr(i) for i in range(_TOP)]
        category = [unicodedata.category(c) for c in chars]
        lower = np.arange(_TOP + 1, dtype=np.uint32)
        for i, c in enumerate(chars):
            if category[i] == "Lu" and len(x := c.lower()) == 1:
                lower[i] = ord(x)
        pad = [False]
        _tables["letter"] = np.array([k[0] == "L" for k in category] + pad)
        _tables["upper"] = np.array([k == "Lu" for k in category] + pad)
        _tables["digit"] = np.array([k == "Nd" for k in category] + pad)
        _tables["space"] = np.array([c.isspace() for c in chars] + pad)
        _tables["lower"] = lower
    return _tables


def code_points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), _TOP)


def chunks(text: str) -> Iterator[np.ndarray]:
    for i in range(0, len(text), _CHUNK):
        yield code_points(text[i : i + _CHUNK])


def chunks_at(text: str, gap: np.ndarray) -> Iterator[np.ndarray]:
    """Chunks that end behind a code point that is a gap, or with the text: longer ones where a run without a gap is."""
    at, most = 0, _CHUNK
    while at < len(text):
        c = code_points(text[at : at + most])
        if at + len(c) < len(text):
            gaps = np.flatnonzero(gap[c])
            if not len(gaps):
                most *= 2
                continue
            c = c[: gaps[-1] + 1]
        at, most = at + len(c), _CHUNK
        yield c


def has_letter(text: str | None) -> bool:
    return bool(text) and any(tables()["letter"][c].any() for c in chunks(text))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = parts[0].astype(np.uint64)
    for p in parts[1:]:
        h = (h * _MIX) ^ (p.astype(np.uint64) * _MIX_NEXT)  # a small p must reach all bits: sums of such values are compared
        h ^= h >> np.uint64(29)
    return h * _MIX


def _fold(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return (((h ^ np.uint64(kind * 0x1F123BB5)) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _grams(tail: np.ndarray, new: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of tail and new that end in new."""
    s = np.concatenate([tail[max(0, len(tail) - n + 1) :], new])
    return _mixed(*(s[i : len(s) - n + 1 + i] for i in range(n))) if len(s) >= n else np.zeros(0, np.uint64)


def letter_grams(text: str, orders: tuple[int, ...] = (1, 2, 3)) -> Iterator[tuple[int, np.ndarray]]:
    """(order, hashes with repeats) of letter n-grams, lower case; a run of what isn't a letter is one space, as are both ends."""
    t, tail, letters = tables(), np.array([32], np.uint32), False
    for c in itertools.chain(chunks(text), [None]):
        if c is None:
            new = np.array([32] if letters else [], np.uint32)
        else:
            letter = t["letter"][c]
            new = np.where(letter, t["lower"][c], np.uint32(32))[letter | np.r_[letters, letter[:-1]]]
            letters = bool(letter[-1])
        for n in orders:
            yield n, _grams(tail, new, n)
        tail = np.concatenate([tail, new])[-max(orders) :]


def letter_counts(text: str, bits: int) -> np.ndarray:
    """How often each feature number occurs."""
    counts = np.zeros(1 << bits, np.int64)
    for n, h in letter_grams(text):
        counts += np.bincount(_fold(h, n, bits), minlength=1 << bits)
    return counts


def quality_grams(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, hashes with repeats): n-grams of words' looks (kinds 1 to 4) and words (kind 11).

    A word's look: its letter case, the mark it ends in, whether it has letters, whether it repeats
    the word before it.
    """
    t, tail, before = tables(), np.zeros(0, np.uint64), None
    for c in chunks_at(text, t["space"]):
        space = t["space"][c]
        word = np.flatnonzero(~space & np.r_[True, space[:-1]])
        if not len(word):
            continue
        ends = np.flatnonzero(~space & np.r_[space[1:], True])
        low = t["lower"][c]
        inside = np.concatenate([[0], np.cumsum(~space)])
        place = (np.arange(len(c)) - np.repeat(word, np.diff(np.r_[word, len(c)]))) if word[0] == 0 else (np.arange(len(c)) - np.repeat(np.r_[0, word], np.diff(np.r_[0, word, len(c)])))
        value = np.where(space, np.uint64(0), _mixed(low, place))
        h = np.add.reduceat(value, word)
        length = inside[ends + 1] - inside[word]
        letters = np.add.reduceat(t["letter"][c].astype(np.int64), word)
        uppers = np.add.reduceat(t["upper"][c].astype(np.int64), word)
        last, first = c[ends], c[word]
        mark = np.where(t["letter"][last] | t["digit"][last], np.uint32(0), last)
        case = np.where(uppers == 0, 0, np.where((uppers == letters) & (letters > 1), 1, np.where(t["upper"][first], 2, 3)))
        again = np.r_[before is not None and h[0] == before, h[1:] == h[:-1]]
        nonletters = np.minimum(length - letters, 4)
        look = _mixed(mark, case, letters > 0, nonletters, again)
        for n in (1, 2, 3, 4):
            yield n, _grams(tail, look, n)
        yield 11, h
        tail, before = np.concatenate([tail, look])[-3:], h[-1]


def quality_features(text: str, bits: int) -> np.ndarray:
    """The distinct feature numbers of a text, in order."""
    seen = np.zeros(1 << bits, bool)
    for kind, h in quality_grams(text):
        seen[_fold(h, kind, bits)] = True
    return np.flatnonzero(seen)


def _word_tables() -> dict[str, np.ndarray]:
    t = tables()
    if "word" not in t:
        t["word"] = np.array([unicodedata.category(chr(i))[0] in "LMN" for i in range(_TOP)] + [True])
        t["gap"] = ~t["word"]
    return t


def _hashed_words(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start among code points, and their hashes."""
    t = tables()
    inside = t["word"][c]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    c, inside = c[starts[0] :], inside[starts[0] :]
    near = starts - starts[0]
    place = np.arange(1, len(c) + 1) - np.repeat(near, np.diff(near, append=len(c)))
    h = np.add.reduceat(np.where(inside, _mixed(t["lower"][c], place), np.uint64(0)), near)
    h ^= h >> np.uint64(32)
    return starts, h * _MIX


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order. Words are runs of letters, marks and digits, in lower case."""
    out = [_hashed_words(c)[1] for c in chunks_at(text, _word_tables()["gap"])]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes_of(texts: list[str]) -> list[np.ndarray]:
    """word_hashes of each text; short texts are hashed side by side."""
    _word_tables()
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held: list[int] = []

    def flush() -> None:
        starts, h = _hashed_words(code_points("\n".join(texts[i] for i in held)))
        edges = np.cumsum([len(texts[i]) + 1 for i in held])
        for i, part in zip(held, np.split(h, np.searchsorted(starts, edges[:-1]))):
            out[i] = part
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        if len(text) > _TOGETHER:
            out[i] = word_hashes(text)
            continue
        held.append(i)
        size += len(text) + 1
        if size > _TOGETHER:
            flush()
            size = 0
    if held:
        flush()
    return out


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    h = _mixed(*(words[i : len(words) - n + 1 + i] for i in range(n)))
    h ^= h >> np.uint64(31)
    return h


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct hashes of runs of n words, sorted; fewer words than n are one shingle."""
    if not len(words):
        return words
    return _distinct(_runs(words, min(n, len(words))))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingles_of(words: list[np.ndarray], n: int = 5) -> list[np.ndarray]:
    """shingles of each text's words; runs of many texts are hashed side by side."""
    out, lo = [], 0
    while lo < len(words):
        hi, size = lo, 0
        while hi < len(words) and (hi == lo or size + len(words[hi]) <= _TOGETHER):
            size += len(words[hi])
            hi += 1
        every = np.concatenate(words[lo:hi])
        runs, at = _runs(every, n) if len(every) >= n else every, 0
        for w in words[lo:hi]:
            out.append(_distinct(runs[at : at + len(w) - n + 1]) if len(w) >= n else shingles(w, n))
            at += len(w)
        lo = hi
    return out

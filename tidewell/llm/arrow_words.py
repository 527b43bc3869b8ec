"""Vectorised word helpers for Arrow batches (used inside Spark tasks).

A batch's texts are one contiguous UTF-8 buffer; words are found with byte masks over
that buffer, so no Python object is made per word. Hashes are polynomial over the bytes
of a word modulo 2**64, finished with a 64-bit mixer; they only nominate matches, every
operator that needs exactness verifies on the words themselves or carries a second,
independent hash (stated in its docstring).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1


def _splitmix(n: int) -> int:
    """n-th value of the splitmix64 sequence (a rule for fixed pseudo-random constants)."""
    z = (n * 0x9E3779B97F4A7C15) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit constants of stream ``seed``."""
    return np.array([_splitmix(seed * 1_000_003 + i + 1) | 1 for i in range(n)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (bijective)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


SPACE = np.zeros(256, dtype=bool)          # \x20 and \x09-\x0D
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)     # A-Z to a-z, all other bytes unchanged
LOWER[65:91] += 32
# not a word byte of the benchmark rule [^\x00-\x2F\x3A-\x60\x7B-\x7F] (after lower-casing)
PUNCT = np.zeros(256, dtype=bool)
PUNCT[0:0x30] = PUNCT[0x3A:0x61] = PUNCT[0x7B:0x80] = True


class Words:
    """Words of a batch: byte ranges into one buffer, and the row each word belongs to."""

    __slots__ = ("buf", "start", "end", "row", "first", "rows")

    def __init__(self, buf, start, end, row, first, rows):
        self.buf, self.start, self.end, self.row, self.first, self.rows = buf, start, end, row, first, rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, row offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return buf, (offs - offs[0]) if n else np.zeros(1, np.int64)


def find_words(texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    """All words (maximal runs of non-separator bytes) of every text of the batch."""
    buf, offs = text_bytes(texts)
    if lower:
        buf = LOWER[buf]
    n = len(offs) - 1
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, z, np.zeros(n + 1, np.int64), n)
    word = ~separators[buf]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offs[(offs > 0) & (offs < len(buf))]
    begin[inner] = word[inner]                     # a text border also ends a word
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(start, offs, side="left")
    row = np.repeat(np.arange(n), np.diff(first))
    return Words(buf, start, end, row, first, n)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        got = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        _POWERS.clear() if len(_POWERS) > 3 else None
        _POWERS[base] = got
    return got


def word_hash(w: Words, seed: int = 1) -> np.ndarray:
    """64-bit hash of every word, the same for equal words anywhere.

    The buffer is hashed in blocks of 512 KB so that the power tables (kept by the worker)
    and the running sums stay small; a longer word is a block of its own.
    """
    out = np.empty(len(w.start), dtype=np.uint64)
    base = _splitmix(seed) | 1
    table = constants(256, seed + 7)
    block, k, total = 512 << 10, 0, len(w.start)
    while k < total:
        s0 = int(w.start[k])
        k2 = max(k + 1, int(np.searchsorted(w.end, s0 + block, side="right")))
        e0 = int(w.end[k2 - 1])
        up, down = _powers(base, e0 - s0 + 1)
        acc = np.zeros(e0 - s0 + 1, dtype=np.uint64)
        np.cumsum(table[w.buf[s0:e0]] * up[:e0 - s0], out=acc[1:])
        s, e = w.start[k:k2] - s0, w.end[k:k2] - s0
        out[k:k2] = mix((acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_splitmix(seed + 99)))
        k = k2
    return out


def window_hash(h: np.ndarray, size: int, seed: int = 5) -> np.ndarray:
    """Hash of ``size`` consecutive word hashes starting at each index (the last size-1
    starts run past the end of ``h`` and must be masked by the caller)."""
    mult = constants(size, seed)
    padded = np.concatenate([h, np.zeros(size - 1, np.uint64)])
    out = np.zeros(len(h), dtype=np.uint64)
    for j in range(size):
        out += (padded[j:j + len(h)] ^ mult[size - 1 - j]) * mult[j]
    return mix(out)


def remaining(w: Words) -> np.ndarray:
    """Per word: number of words from it to the end of its text, itself included."""
    return np.repeat(w.first[1:], w.counts) - np.arange(len(w.start))


def sliding_min_is_selected(h: np.ndarray, span: int) -> np.ndarray:
    """Marks the positions that are the leftmost minimum of some ``span`` consecutive values."""
    n = len(h)
    sel = np.zeros(n, dtype=bool)
    if n < span or n == 0:
        return sel
    sel[leftmost_min(h, span)] = True
    return sel


def leftmost_min(h: np.ndarray, span: int) -> np.ndarray:
    """Index of the leftmost minimum of every ``span`` consecutive values."""
    best = h[:len(h) - span + 1].copy()
    at = np.arange(len(best))
    for j in range(1, span):
        other = h[j:j + len(best)]
        less = other < best
        best[less] = other[less]
        at[less] += j - (at[less] - np.flatnonzero(less))
    return at

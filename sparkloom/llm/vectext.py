"""Whole Arrow batches of texts as numpy arrays of code points, words and hashes.

Nothing here loops over rows or characters in Python.
"""

from __future__ import annotations

import ctypes
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Freed memory goes back to the system (Arrow's, and glibc's where there is one), so
    that a worker process that lives on doesn't keep what an earlier task needed."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: Odd multipliers: powers of BASE weigh a word's characters, STEP a shingle's words.
BASE = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (n + 1 offsets).
    A null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    starts = np.zeros(len(texts) + 1, np.int64)
    if not len(texts) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint32), starts
    raw = memoryview(texts.buffers()[2])[offs[0] : offs[-1]]
    codes = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=starts[1:])
    return codes, starts


@lru_cache(maxsize=None)
def _categories() -> np.ndarray:
    names = sorted({unicodedata.category(chr(i)) for i in range(0x3000)} | {"Cn", "Co", "Cs", "Lo"})
    number = {c: i for i, c in enumerate(names)}
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        table[i] = number.setdefault(unicodedata.category(chr(i)), len(number))
    table.setflags(write=False)
    _names.update(number)
    return table


_names: dict[str, int] = {}


@lru_cache(maxsize=None)
def class_table(*groups: str) -> np.ndarray:
    """Code point -> number of the first group (prefixes of general categories,
    split by blanks) that it belongs to, else ``len(groups)``."""
    cats = _categories()
    of = np.full(256, len(groups), np.uint8)
    for k in reversed(range(len(groups))):
        for name, number in _names.items():
            if any(name.startswith(g) for g in groups[k].split()):
                of[number] = k
    return of[cats]


def is_word(codes: np.ndarray) -> np.ndarray:
    """Letters and numbers, as the pattern [\\p{L}\\p{N}] has them."""
    return class_table("L N")[codes] == 0


def word_spans(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text."""
    word = is_word(codes)
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = starts[1:-1]
    edge = edge[edge < len(codes)]
    first[edge] = word[edge]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = edge[edge > 0] - 1
    last[edge] = word[edge]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, starts)


@lru_cache(maxsize=None)
def _powers(n: int) -> np.ndarray:
    out = np.empty(n, U64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * BASE & MASK
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(MIX1)
    x ^= x >> U64(27)
    x = x * U64(MIX2)
    return x ^ (x >> U64(31))


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the characters of each span (not empty, in order, not overlapping)."""
    if not len(begin):
        return np.zeros(0, U64)
    n = end - begin
    ends = np.cumsum(n)
    within = np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - n, n)
    chars = codes[within + np.repeat(begin, n)].astype(U64)
    size = 1 << max(8, int(n.max()).bit_length())
    weighed = chars * _powers(size)[within]
    return mix(np.add.reduceat(weighed, ends - n))


def shingle_hashes(words: np.ndarray, first_word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text, and where each text's
    start. A text of fewer words gives one shingle of all of them, one of no
    words none."""
    n = np.diff(first_word)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=starts[1:])
    at = np.arange(starts[-1], dtype=np.int64) + np.repeat(first_word[:-1] - starts[:-1], count)
    left = np.repeat(np.minimum(n, width), count)
    out = np.zeros(len(at), U64)
    padded = np.concatenate([words, np.zeros(width, U64)])
    weight = 1
    for k in range(width):
        weight = weight * STEP & MASK
        term = padded[at + k] * U64(weight)
        out += np.where(left > k, term, U64(0))
    return mix(out), starts


def shingles_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lower-cased texts, and where each text's start."""
    lowered = pc.utf8_lower(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    codes, starts = code_points(lowered)
    begin, end, first = word_spans(codes, starts)
    return shingle_hashes(span_hashes(codes, begin, end), first, width)


def slices(batch: pa.RecordBatch, column: str, chars: int = 2_000_000):
    """Parts of a batch of about ``chars`` bytes of text each, so that the arrays
    made from it stay small; a single longer text makes a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()

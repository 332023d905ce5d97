"""Vectorised word and shingle hashing of Arrow string columns.

Everything works on the UTF-8 bytes of a slice of rows at once.  Words are
``[^\\x20\\x09-\\x0D]+``; those separators are ASCII, so they never occur inside
a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: byte -> value used in hashes: A-Z as a-z, shifted so that no byte counts as 0
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
LOWER += U64(1)
LOWER[SPACE] = 0
BASE = 0x9E3779B97F4A7C15
SHINGLE = 5
STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of BASE modulo 2**64, as many as the longest word needs."""

    table = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if n > len(cls.table):
            full = np.full(max(n, 64), U64(BASE))
            full[0] = 1
            cls.table = np.multiply.accumulate(full)
        return cls.table


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for slices of about ``most`` bytes;
    a longer text makes a slice of its own.  Null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, n = 0, len(texts)
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its
    first word (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(ink & ~before)
    return starts, np.flatnonzero(ink & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z counted as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    values = LOWER[data]
    longest = int((ends - starts).max())
    first = np.zeros(len(data), np.int64)
    first[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(first)
    np.clip(place, 0, longest - 1, out=place)  # separators weigh 0, whatever their place
    values *= _Powers.upto(longest)[place]
    return mix(np.add.reduceat(values, starts) + (ends - starts).astype(U64))


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word windows of all texts, and for each text the index
    of its first one.  A text of one to four words has one: all its words."""
    counts = np.diff(first)
    n = len(hashes)
    rolled = np.zeros(max(n - SHINGLE + 1, 0), U64)
    for k in range(SHINGLE if n >= SHINGLE else 0):
        rolled += hashes[k:n - SHINGLE + 1 + k] * STEP[k]
    per = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    where = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(per)), per)
    at = first[:-1][doc] + np.arange(where[-1]) - where[:-1][doc]
    short = counts[doc] < SHINGLE
    out = np.empty(where[-1], U64)
    out[~short] = rolled[at[~short]]
    for i in np.flatnonzero(short):
        h = hashes[at[i]:at[i] + counts[doc[i]]]
        out[i] = (h * STEP[:len(h)]).sum(dtype=U64) + U64(len(h))
    return mix(out), where


def family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and n offsets of hash functions x -> mix-free a*x+b."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=U64)


def minima(values: np.ndarray, where: np.ndarray, n: int, seed: int) -> np.ndarray:
    """MinHash coordinates: one row per text, n columns; texts without values
    get the largest number."""
    mult, plus = family(n, seed)
    rows = len(where) - 1
    out = np.full((rows, n), np.iinfo(np.uint64).max, U64)
    full = np.flatnonzero(np.diff(where))
    if len(full):
        at = where[:-1][full]
        for k in range(n):
            x = values * mult[k] + plus[k]
            out[full, k] = np.minimum.reduceat(x ^ (x >> U64(32)), at)
    return out

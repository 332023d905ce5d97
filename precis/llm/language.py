"""Language identification by rank-order profiles (operator 4).

A language's profile is its most frequent character n-grams in rank order.  A
document's own profile is compared to each of them by the out-of-place distance
(the sum of rank differences; an n-gram that a profile lacks costs its length).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from precis.llm import textvec
from precis.llm.common import id_bucket, load
from precis.plans.registry import register

ORDERS = (1, 2, 3)
PROFILE = 300
UNKNOWN = "und"
BITS = 21  # of a code point; three of them and the order fit a 64-bit n-gram code


class _Letters:
    """code point -> its lower-case letter, 0 for anything but a letter."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            table = np.zeros(0x110000, np.int32)
            for point in range(0x110000):
                char = chr(point)
                if char.isalpha():
                    low = char.lower()
                    table[point] = ord(low) if len(low) == 1 else point
            cls.table = table
        return cls.table


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with every other character as 0, one 0
    after each text, and the offsets of the texts in that array."""
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum(lead)])[offsets] if len(data) else np.zeros(len(offsets), np.int64)
    if len(data) and chars[-1] != len(points):  # malformed bytes were replaced: go text by text
        parts = [data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(offsets) - 1)]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    table = _Letters.get()
    n = len(chars) - 1
    out = np.zeros(len(points) + n, np.int32)
    place = np.arange(len(points)) + np.repeat(np.arange(n), np.diff(chars))
    out[place] = table[points]
    return out, chars + np.arange(n + 1)


def grams(chars: np.ndarray, alphabet: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per order: (order, places, dense codes) of the n-grams of ``chars``.  An
    n-gram lies within a word padded with one blank on each side; a single
    blank is none.  ``alphabet`` maps a letter to 1.., blank (0) to 0."""
    size = int(alphabet.max(initial=0)) + 1
    dense = alphabet[chars].astype(np.int64)
    ink = chars != 0
    out = [(1, np.flatnonzero(ink), dense[ink])]
    if len(chars) > 1:
        at = np.flatnonzero(ink[:-1] | ink[1:])
        out.append((2, at, dense[at] * size + dense[at + 1]))
    if len(chars) > 2:
        at = np.flatnonzero(ink[1:-1])
        out.append((3, at, (dense[at] * size + dense[at + 1]) * size + dense[at + 2]))
    return out


def _unpack(order: int, codes: np.ndarray, size: int, points: np.ndarray) -> np.ndarray:
    """Dense codes -> 64-bit codes made of code points, alike in every task."""
    out = np.zeros(len(codes), np.int64)
    for k in range(order - 1, -1, -1):
        out = (out << BITS) | points[codes // size ** k % size]
    return out


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
    unique, inverse = np.unique(all_codes, return_inverse=True)
    return unique, np.bincount(inverse, weights=all_counts, minlength=len(unique)).astype(np.int64)


COUNT = "lang string, gram_order int, gram long, n long"


def gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram_order, gram, n) over all texts of ``train`` (text, lang),
    summed per task before the shuffle."""

    def count(batches):
        held: dict[tuple[str, int], tuple[list, list]] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, end, data, offsets in textvec.slices(batch.column(0)):
                chars, at = letters(data, offsets)
                points = np.flatnonzero(np.bincount(chars)).astype(np.int64) if len(chars) else np.zeros(1, np.int64)
                points = points if len(points) and points[0] == 0 else np.concatenate([[0], points])
                alphabet = np.zeros(int(points[-1]) + 1, np.int32)
                alphabet[points] = np.arange(len(points))
                size = len(points)
                names, which = np.unique(langs[first:end].astype(str), return_inverse=True)
                owner = np.repeat(which, np.diff(at))
                for order, place, codes in grams(chars, alphabet):
                    key = owner[place] * size ** order + codes
                    if size ** order * len(names) <= 1 << 22:
                        n = np.bincount(key)
                        key = np.flatnonzero(n)
                        n = n[key]
                    else:
                        key, n = np.unique(key, return_counts=True)
                    lang, codes = np.divmod(key, size ** order)
                    codes = _unpack(order, codes, size, points)
                    for k in np.unique(lang):
                        mine = lang == k
                        into = held.setdefault((str(names[k]), order), ([], []))
                        into[0].append(codes[mine])
                        into[1].append(n[mine])
                        if sum(map(len, into[0])) > 1 << 20:
                            merged = _merge(*into)
                            held[(str(names[k]), order)] = ([merged[0]], [merged[1]])
        for (lang, order), parts in sorted(held.items()):
            codes, n = _merge(*parts)
            for k in range(0, len(codes), 50_000):
                part = codes[k:k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), order, np.int32)),
                     pa.array(part), pa.array(n[k:k + 50_000])], names=["lang", "gram_order", "gram", "n"])

    parts = train.select("text", "lang").mapInArrow(count, COUNT)
    return parts.groupBy("lang", "gram_order", "gram").agg(F.sum("n").alias("n"))


def profiles(train: DataFrame, size: int = PROFILE) -> dict[str, list[tuple[int, int]]]:
    """The ``size`` most frequent n-grams of every language as (order, code) in
    rank order; ties by order, then code.  The result is bounded by the number
    of languages times ``size``."""
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram_order", "gram"))
    top = gram_counts(train).withColumn("rank", rank).filter(F.col("rank") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for row in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(row["lang"], []).append((row["gram_order"], row["gram"]))
    return out


class Matcher:
    """Out-of-place distances of texts to a set of profiles."""

    def __init__(self, known: dict[str, list[tuple[int, int]]], size: int):
        self.langs, self.size = sorted(known), size
        points = {0}
        for entries in known.values():
            for order, code in entries:
                points |= {code >> (BITS * k) & (1 << BITS) - 1 for k in range(order)}
        self.points = np.array(sorted(points), np.int64)
        self.alphabet = np.full(0x110000, len(points), np.int32)  # any other letter
        self.alphabet[self.points] = np.arange(len(points))
        self.alphabet[0] = 0
        self.base = len(points) + 1
        codes = sorted({(o, self._dense(o, c)) for entries in known.values() for o, c in entries})
        self.starts = np.cumsum([0] + [self.base ** o for o in ORDERS])
        self.keys = np.array([self.starts[o - 1] + c for o, c in codes], np.int64)
        at = {key: i for i, key in enumerate(codes)}
        self.ranks = np.full((len(codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            for rank, (o, c) in enumerate(known[lang]):
                self.ranks[at[(o, self._dense(o, c))], j] = rank

    def _dense(self, order: int, code: int) -> int:
        out = 0
        for k in range(order):
            point = code >> (BITS * k) & (1 << BITS) - 1
            out = out * self.base + int(np.searchsorted(self.points, point))
        return out

    def distances(self, chars: np.ndarray) -> np.ndarray | None:
        """Distance to each language divided by the largest possible, or None
        for a text without letters."""
        if not chars.any():
            return None
        codes = np.concatenate([self.starts[o - 1] + c for o, _, c in grams(chars, self.alphabet)])
        total = int(self.starts[-1])
        if total <= 1 << 18:
            counts = np.bincount(codes, minlength=total)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(codes, return_counts=True)
        if len(found) > self.size:
            floor = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            keep = counts >= floor
            found, counts = found[keep], counts[keep]
        order = np.argsort(-counts, kind="stable")[:self.size]
        found = found[order]
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        at = np.where(self.keys[at] == found, at, len(self.keys))
        ranks = self.ranks[at]
        off = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(found))[:, None]))
        return off.sum(0) / (self.size * len(found))


def predict(docs: DataFrame, known: dict[str, list[tuple[int, int]]], size: int = PROFILE) -> DataFrame:
    """``docs`` (doc_id, held_out, text) -> (doc_id, held_out, lang_pred, score).

    The nearest profile wins, ties by name; score is 1 - its distance.  Null
    texts, texts without a letter and an empty set of profiles: ``und``, 0."""
    schema = docs.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double")

    def score(batches):
        matcher = Matcher(known, size) if known else None
        for batch in batches:
            lang, value = [], []
            for first, end, data, offsets in textvec.slices(batch.column("text")):
                chars, at = letters(data, offsets)
                for i in range(end - first):
                    d = matcher.distances(chars[at[i]:at[i + 1]]) if matcher else None
                    lang.append(UNKNOWN if d is None else matcher.langs[int(d.argmin())])
                    value.append(0.0 if d is None else float(1 - d.min()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()),
                 pa.array(value, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(score, schema)


@register("op4_language_id")
def op4_language_id(spark, sf_dir):
    """Language of every document, learnt from those whose crc32(doc_id) mod 4
    is not 2 (a null id is learnt from, not held out)."""
    docs = load(spark, sf_dir, "documents")
    held = F.coalesce(id_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    marked = docs.select("doc_id", held.alias("held_out"), "text", "lang")
    known = profiles(marked.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return predict(marked, known)

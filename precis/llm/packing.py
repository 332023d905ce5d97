"""Packing documents into sequences (operator 10), harmonic.

A document is cut into whole sequences, then halves, quarters, ... of one while
its rest is longer than ``capacity / 16``; the rest stays whole.  Piece lengths
fall into reciprocal-capacity classes: class k holds lengths in
(capacity / (k + 1), capacity / k], and each of its bins takes exactly k pieces.
Bins are filled in every (class, shard) cell independently; a running count of
the cells makes the bins of a class follow each other without a gap.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from precis.llm.common import load, materialize
from precis.plans.registry import register

CAPACITY = 2048
SMALLEST_CUT = 16
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"
#: the same vocabulary with its added tokens
TOKENIZER = "byte_bpe_50k.json"
CACHE = 400_000


def default_vocabulary() -> str:
    """Path of the byte-level BPE ranks, the same vocabulary as
    byte_bpe_50k.json."""
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Token ids of texts, as the tokenizer of ``TOKENIZER`` gives them without
    special tokens around: an added token of its file that a text contains is one
    id, and the text on each side is encoded by itself.

    The tokenizer splits a text into pretokens, and none reaches over a single
    space between two other characters: such a space starts its pretoken.  So
    ids are found once per space-led word and remembered.  A text with a space
    beside other white space is encoded as a whole."""

    def __init__(self, path: str):
        import base64
        import re

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
            self.added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.odd = re.compile(r" (?:\s|(?<=\s ))")
        encode = self.bpe.encode_ordinary

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                ids = np.array(encode(" " + word), "<u4").tobytes()
                self[word] = ids
                return ids

        self.known = Known()

    def ids(self, text: str) -> np.ndarray:
        """Ids of ``text`` as little-endian 32-bit numbers."""
        if self.split and self.split.search(text):
            return np.concatenate([np.array([self.added[part]], "<u4") if part in self.added else self.ordinary(part)
                                   for part in self.split.split(text) if part])
        return self.ordinary(text)

    def ordinary(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4")
        first, *rest = text.split(" ")
        head = np.array(self.bpe.encode_ordinary(first), "<u4").tobytes()
        return np.frombuffer(head + b"".join(map(self.known.__getitem__, rest)), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST_CUT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    out = [(s, capacity) for s in range(0, n - n % capacity, capacity)]
    at, part = n - n % capacity, capacity // 2
    while n - at > capacity // smallest:
        if n - at >= part:
            out.append((at, part))
            at += part
        part //= 2
    if n > at:
        out.append((at, n - at))
    return out


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                    vocabulary: str | None = None) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens) of every piece; row
    tells rows of one doc_id apart.  A document ends with id 1, so a null or
    empty text is one piece of one id.  Malformed bytes of a text count as U+FFFD."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                        F.make_valid_utf8(F.col(text_col)).alias("text"))
    schema = keyed.select("doc_id", "row").schema
    for field in PIECES.split(", "):
        schema = schema.add(*field.split(" "))

    def cut(batches):
        encode = encoder(vocabulary or default_vocabulary()).ids  # a path of the executor
        end = np.array([END_ID], "<u4")
        for batch in batches:
            doc, rows = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                for start, length in cuts(len(ids), capacity):
                    doc.append(i)
                    rows.append((start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids)))
            at = pa.array(doc, pa.int64())
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("row").take(at),
                 *[pa.array(numbers[:, k]) for k in range(4)]],
                names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return keyed.mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces with ``length`` (1 to capacity),
    ``row`` and ``start``.

    A piece's class is k = capacity // length.  The number of pieces in every
    (class, shard) cell is counted first; summed up per class, that gives each
    cell its first place in the class, and places k*b .. k*b + k - 1 are bin b.
    No bin holds more than k <= capacity pieces and no class is brought into one
    task.  Fewer than k pieces of a class remain; these, at most some thousands
    for all classes together at any size of input, are packed first-fit."""
    shards = shards or max(pieces.sparkSession.sparkContext.defaultParallelism,
                           int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = pieces.withColumns({
        "k": F.floor(F.lit(capacity) / F.col("length")).cast("int"),
        "shard": F.pmod(F.xxhash64("row", "start"), F.lit(shards)).cast("int")})
    cells = spread.groupBy("k", "shard").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy("k")
    before = whole.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    base = cells.select("k", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                        F.floor(F.sum("n").over(whole) / F.col("k")).alias("bins"))
    place = F.row_number().over(W.partitionBy("k", "shard").orderBy("row", "start")) - 1
    placed = (spread.withColumn("place", place).join(base, ["k", "shard"])
              .withColumn("place", F.col("place") + F.col("base"))
              .withColumn("bin", F.floor(F.col("place") / F.col("k"))))
    inside = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    full = (placed.filter("bin < bins").withColumn("sequence_id", F.col("bin") * (capacity + 1) + F.col("k"))
            .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))))
    names = [*pieces.columns, "sequence_id", "offset"]
    # what is left of every class: fewer than k pieces each, whatever the input
    rest = placed.filter("bin = bins").select(*pieces.columns, F.lit(0).alias("all"))
    schema = full.select(*names).schema

    def fill(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["start"].to_numpy(), table["row"].to_numpy(), -lengths))
        used: list[int] = []
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i in order:
            b = next((b for b, n in enumerate(used) if n + lengths[i] <= capacity), len(used))
            if b == len(used):
                used.append(0)
            bins[i], offsets[i] = b * (capacity + 1), used[b]
            used[b] += int(lengths[i])
        return table.drop_columns(["all"]).append_column("sequence_id", pa.array(bins)).append_column(
            "offset", pa.array(offsets))

    return full.select(*names).unionByName(rest.groupBy("all").applyInArrow(fill, schema))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per
    piece.  Texts are tokenized once; the narrow pieces are written before they
    are counted and placed.  Empty table: empty result; repeated rows are packed
    each."""
    pieces = materialize(tokenize_pieces(docs, capacity=capacity, vocabulary=vocabulary), "pieces")
    return pack(pieces, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                         F.col("sequence_id").cast("long"), F.col("offset").cast("long"))


@register("op10_harmonic_packing")
def op10_harmonic_packing(spark, sf_dir):
    """Every piece of every document with its place."""
    return pack_documents(load(spark, sf_dir, "documents"))

"""MinHash near-dedup by a signature-coordinate inverted join (operator 5).

Documents are posted under their (coordinate, value) pairs.  Values that only
one document has cannot match and are skipped; of the rest a document posts its
rarest ones only (prefix), since two documents with at least ``MATCHES`` equal
coordinates share one of those.  Collisions are counted on the full signatures
and the remaining pairs confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.llm import textvec
from precis.llm.common import lean, load, materialize
from precis.llm.links import agreeing, connect
from precis.plans.registry import register

COORDINATES = 64
#: a pair at Jaccard 0.75 falls below this with a probability of about 1e-4
MATCHES = 34
SEED = 20
#: second sketch, only of documents with a candidate: bytes, and the agreement
#: that a pair at Jaccard 0.75 misses with a probability below 1e-4
WIDE = 512
WIDE_MATCHES = 345


def _sets(texts: pa.Array):
    """Per text: its sorted distinct shingle hashes, slice by slice:
    (first row, end row, values, offsets)."""
    for first, end, data, offsets in textvec.slices(texts):
        starts, ends, at = textvec.words(data, offsets)
        grams, where = textvec.shingles(textvec.word_hashes(data, starts, ends), at)
        parts = [np.unique(grams[where[i]:where[i + 1]]) for i in range(end - first)]
        counts = [len(p) for p in parts]
        yield first, end, np.concatenate(parts) if parts else grams, np.concatenate([[0], np.cumsum(counts)])


def _fingerprint(values: np.ndarray, where: np.ndarray) -> list[bytes]:
    """16 bytes that tell sets apart: two sums of remixed members."""
    n = len(where) - 1
    sums = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(np.diff(where))
    if len(full):
        sums[full, 0] = np.add.reduceat(textvec.mix(values ^ textvec.U64(0x5851F42D4C957F2D)), where[:-1][full])
        sums[full, 1] = np.add.reduceat(textvec.mix(values + textvec.U64(0x14057B7EF767814F)), where[:-1][full])
    return [row.tobytes() for row in sums]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cls, keys, sketch): cls identifies the shingle set,
    keys are the hashed (coordinate, value) pairs, the sketch has their low bytes."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (named.select("doc_id").schema.add("n_shingles", "long").add("cls", "binary")
              .add("keys", T.ArrayType(T.LongType())).add("sketch", "binary"))
    salt = textvec.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))

    def sign(batches):
        for batch in batches:
            for first, end, values, where in _sets(batch.column("text")):
                keys = textvec.mix(textvec.minima(values, where, COORDINATES, SEED) ^ salt).astype(np.int64)
                sketch = [row.tobytes() for row in keys.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(np.diff(where)),
                     pa.array(_fingerprint(values, where), pa.binary()),
                     pa.ListArray.from_arrays(np.arange(end - first + 1, dtype=np.int32) * COORDINATES, keys.ravel()),
                     pa.array(sketch, pa.binary())],
                    names=["doc_id", "n_shingles", "cls", "keys", "sketch"])

    return named.mapInArrow(lean(sign), schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cls, members, wide): the shingle sets of ``wanted`` (doc_id, cls), as
    sorted 64-bit numbers, and their second sketches, from the texts."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id")

    def collect(batches):
        for batch in batches:
            mine = batch.column("cls").to_pylist()
            for first, end, values, where in _sets(batch.column("text")):
                own = _fingerprint(values, where)
                wide = textvec.mix(textvec.minima(values, where, WIDE, SEED + 1)).astype(np.uint8)
                keep = [i for i in range(end - first) if own[i] == mine[first + i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[i] for i in keep], pa.binary()),
                     pa.array([values[where[i]:where[i + 1]].tobytes() for i in keep], pa.binary()),
                     pa.array([wide[i].tobytes() for i in keep], pa.binary())],
                    names=["cls", "members", "wide"])

    return (texts.select("cls", "text").mapInArrow(lean(collect), "cls binary, members binary, wide binary")
            .dropDuplicates(["cls"]))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, wide_matches: int = WIDE_MATCHES) -> DataFrame:
    """Pairs (a, b) of classes whose sets satisfy 100 * intersection >= percent *
    union.  Whole sets are shipped only for pairs whose second sketches agree."""

    def compare(batches):
        for batch in batches:
            left, right = batch.column("ma"), batch.column("mb")
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_buffer(), np.uint64)
                y = np.frombuffer(right[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    likely = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("wide").alias("sa")), "a")
              .join(sets.select(F.col("cls").alias("b"), F.col("wide").alias("sb")), "b"))
    likely = agreeing(likely, wide_matches)
    whole = (likely.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("members").alias("ma")), "a")
             .join(sets.select(F.col("cls").alias("b"), F.col("members").alias("mb")), "b"))
    return whole.select("a", "b", "ma", "mb").mapInArrow(compare, "a binary, b binary")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                   matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document.

    Documents whose sets of 5-word shingles have a Jaccard similarity of at
    least ``percent`` / 100 are linked; component_id is the smallest doc_id
    reachable.  Equal sets form one class from the start, so copies are never
    paired.  Null and empty texts have no shingles and no links; a null doc_id
    gets a null component_id and is kept; rows that repeat a doc_id are all
    returned.  Empty table: empty result."""
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"),
                                        F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    postings = classes.select("cls", "size", F.explode("keys").alias("key"))
    counts = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # per class its shared keys, rarest first; fewer than ``matches``: no partner
    shared = (postings.join(counts, "key").groupBy("cls")
              .agg(F.sort_array(F.collect_list(F.struct("n", "key")))["key"].alias("keys"),
                   F.sum(F.log2("n")).alias("weight"), F.first("size").alias("size"))
              .filter(F.size("keys") >= matches))
    shared = materialize(shared.join(classes.select("cls", "sketch"), "cls"), "shared")
    # copies agree with their original more often than with each other, so the
    # original has the most frequent keys: it is the likeliest hub
    rarest = F.slice("keys", 1, F.size("keys") - F.lit(matches - 1))
    prefix = shared.select(F.col("cls").alias("node"), "weight", "size", "sketch", rarest.alias("keys"))
    prefix = materialize(prefix.withColumn("key", F.explode("keys")), "prefix")
    together = prefix.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    partners = prefix.join(together, "key", "left_semi").select(F.col("node").alias("cls")).distinct()
    wanted = classes.select("doc_id", "cls").join(partners, "cls", "left_semi")
    sets = materialize(shingle_sets(docs, wanted, id_col, text_col), "sets")

    comp = connect(prefix, lambda pairs: confirm(pairs, sets, percent), matches, percent,
                   sets.select(F.col("cls").alias("node"), F.col("wide").alias("sketch"), "members"), WIDE_MATCHES)
    comp = comp.withColumnRenamed("node", "cls")
    named = classes.select("cls", "doc_id").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    final = named.join(smallest, "comp").select("cls", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (signed.select("doc_id", "n_shingles", "cls").join(final, "cls", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component; rows with a null doc_id
    stay, and rows that repeat a doc_id stay or go together."""
    gone = (link_documents(docs, id_col, text_col).filter("not kept")
            .select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


@register("op5_minhash_dedup")
def op5_minhash_dedup(spark, sf_dir):
    """Component of every document."""
    return link_documents(load(spark, sf_dir, "documents"))

"""Approximate nearest neighbours by a forest of hash prefixes (operator 8).

Every tree keeps the long hash strings (signs of random projections) of its
vectors in a sorted array.  A query descends each tree to its longest prefix
match and then ascends all trees together, one bit at a time, until the vectors
that share a prefix of that length with it in some tree are enough.  Vectors are
dealt over shards, each with its own forest of the same projections; blocks of
queries meet every shard, and the shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from precis.llm.common import load, materialize
from precis.plans.registry import register

TREES = 24
BITS = 32
SHARD_ROWS = 4096
QUERY_ROWS = 4096
#: candidates that end the ascent, in each shard
ENOUGH = 2048
SEED = 8


class Forest:
    """Sorted hash strings of one shard's unit vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits))
        self.trees, self.bits = trees, bits
        codes = self.codes(vectors)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, trees) hash strings as numbers, first bit highest."""
        signs = (vectors @ self.planes > 0).reshape(len(vectors), self.trees, self.bits)
        return (signs * (1 << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))).sum(2, dtype=np.uint64)

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits + 1, queries, trees) first and end places, in the sorted arrays,
        of the vectors that share each length of prefix with each query."""
        low = np.empty((self.bits + 1, *codes.shape), np.int32)
        high = np.empty_like(low)
        for depth in range(self.bits + 1):
            rest = np.uint64((1 << (self.bits - depth)) - 1)
            for t in range(self.trees):
                low[depth, :, t] = np.searchsorted(self.sorted[:, t], codes[:, t] & ~rest, "left")
                high[depth, :, t] = np.searchsorted(self.sorted[:, t], codes[:, t] | rest, "right")
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray, enough: int) -> np.ndarray:
        """Indices of the vectors with the longest prefix matches of one query,
        given its (bits + 1, trees) ranges: the trees ascend together until at
        least ``enough`` vectors are met."""
        n = len(self.order)
        if n <= enough:
            return np.arange(n)
        # as long as the ranges' lengths do not add up, there cannot be enough
        depth = int(np.flatnonzero((high - low).sum(1) >= enough)[-1])
        mark = np.zeros(n, bool)
        while True:
            for t in range(self.trees):
                mark[self.order[low[depth, t]:high[depth, t], t]] = True
            if depth == 0 or np.count_nonzero(mark) >= enough:
                return np.flatnonzero(mark)
            depth -= 1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors as doubles, without null, zero or non-finite ones
    and without null ids."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
            .filter(~F.coalesce(bad, F.lit(True))).filter(F.exists("v", lambda x: x != 0)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, enough: int = ENOUGH, trees: int = TREES,
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` the ``k``
    nearest of ``vectors`` (both vec_id, v of one length) but itself; score is
    the cosine in double precision, ties go to the smaller vec_id.

    Equal vectors are searched once: a class takes part with its k + 1 smallest
    ids, which is all that k neighbours besides the query can need.  Fewer
    vectors than k: all of them.  Empty tables: empty result.  A block of
    queries and a shard are bounded by ``query_rows`` and ``shard_rows`` on
    average, dealt by hash."""
    few = W.partitionBy("v").orderBy("vec_id")
    base = materialize(vectors.withColumn("place", F.row_number().over(few)).filter(F.col("place") <= k + 1), "vectors")
    classes = base.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    total, asked = base.select("v").distinct().count(), queries.select("v").distinct().count()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // query_rows))
    dealt = (classes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asks = (queries.select("v").distinct().withColumn("block", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(blocks)).cast("int"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            own, wanted = matrix(left["v"]), matrix(right["v"])
            ids = left["ids"].to_pylist()
            unit = own / np.sqrt((own * own).sum(1))[:, None]
            unit_asked = wanted / np.sqrt((wanted * wanted).sum(1))[:, None]
            forest = Forest(unit, trees)
            low, high = forest.ranges(forest.codes(unit_asked))
            for i in range(len(wanted)):
                found = forest.candidates(low[:, i], high[:, i], enough)
                near = unit[found] @ unit_asked[i]
                if len(found) > 4 * k:
                    keep = np.argpartition(-near, 4 * k)[:4 * k]
                    found = found[near >= near[keep].min() - 1e-9]
                dot = (own[found] * wanted[i]).sum(1)
                size = np.sqrt((own[found] * own[found]).sum(1)) * np.sqrt((wanted[i] * wanted[i]).sum())
                best = sorted((-s, x) for s, j in zip(dot / size, found, strict=True) for x in ids[j])[:k + 1]
                rows += [(i, x, -s) for s, x in best]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.table({"v": right["v"].combine_chunks().take(at) if rows else pa.array([], right.schema.field("v").type),
                         "vec_id": pa.array([r[1] for r in rows], left["ids"].type.value_type),
                         "score": pa.array([r[2] for r in rows], pa.float64())})

    schema = queries.select("v").schema
    schema = schema.add("vec_id", vectors.schema["vec_id"].dataType).add("score", "double")
    found = (dealt.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(search, schema))
    order = W.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    lists = best.groupBy("v").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("minus"), F.col("vec_id").alias("id"), "score"))).alias("found"))
    named = queries.select(F.col("vec_id").alias("query_id"), "v").join(lists, "v")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (named.select("query_id", F.posexplode(others).alias("place", "hit"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"),
                    F.col("hit.score").alias("score")))


@register("op8_prefix_forest")
def op8_prefix_forest(spark, sf_dir):
    """The five nearest of every vector whose id is divisible by 50."""
    vectors = usable(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))

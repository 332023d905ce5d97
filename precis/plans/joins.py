"""Joins onto hot keys.

Whether a side is broadcast is left to AQE, which knows the real size of a
shuffle stage before the join runs and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SALT_BUCKETS = 16


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                buckets: int = DEFAULT_SALT_BUCKETS, salt_cols: list[str] | None = None) -> DataFrame:
    """Equi-join that survives hot keys: every big-side row gets a salt in
    [0, buckets) from a hash of its own columns (deterministic, so a
    recomputed task routes every row the same way) and the small side is
    replicated once per salt.  One key holding a third of all rows is then
    spread over ``buckets`` tasks."""
    cols = salt_cols or big.columns
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(buckets)))
    rep = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("__salt"))
    return salted.join(rep, [*keys, "__salt"], how).drop("__salt")

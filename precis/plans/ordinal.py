"""Skew-safe row ordinals (row index within a group, in a total order).

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends each group to one
task, so a group holding a third of all rows is sorted by one core.  Here
the rows are range-partitioned on (g, o) instead, so a hot group spans many
partitions:

1. ``repartitionByRange(g, o)`` + ``sortWithinPartitions`` — a distributed
   sort; every partition holds a contiguous slice of the total order;
2. the position inside the partition is
   ``monotonically_increasing_id() - (spark_partition_id() << 33)``;
3. a small table of (partition, group) -> row count gives each slice its
   offset inside its group (a window over at most partitions x groups
   rows), joined back by broadcast.

The order columns must form a total order (end with a unique key).  The
sorted slices are checkpointed (reliable, shared folder) before the two
branches read them: range bounds are sampled with an RDD-dependent seed, so
a recomputation could cut the range differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.plans.quantiles import _matched, bucket
from precis.session import cut_lineage


def number_index(df: DataFrame, order: str, by: list[str] | None = None, name: str = "idx", start: int = 0) -> DataFrame:
    """``row_index`` for one numeric order column, without a checkpoint: the
    group's value range is cut into BUCKETS parts, whose counts in order are the
    offsets of the rows inside each part.  Cuts depend on the data alone, so every
    branch and every retry sees the same ones.  Rows with equal numbers are in no
    fixed order; a null order number is an error."""
    by = list(by or [])
    number = F.col(order).cast("double")
    checked = F.when(number.isNotNull(), number).otherwise(F.raise_error(F.lit(f"null in {order}")))
    ends = df.groupBy(*by).agg(F.min(number).alias("__lo"), F.max(number).alias("__hi"))
    if by:
        placed = _matched(df.withColumn("__o", checked), ends, by)
    else:  # one pair of numbers, read as scalars
        placed = df.withColumn("__o", checked).withColumn("__lo", ends.select("__lo").scalar()).withColumn("__hi", ends.select("__hi").scalar())
    placed = placed.withColumn("__b", bucket(F.col("__o"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi", "__o")
    counts = placed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    # at most BUCKETS rows of a group
    inside = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "__b", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__before"))
    local = placed.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(order)))
    return _matched(local, before, [*by, "__b"]).withColumn(
        name, F.col("__before") + F.col("__i") - 1 + F.lit(start)).drop("__b", "__i", "__before")


def row_index(df: DataFrame, order: list, by: list[str] | None = None, name: str = "idx",
              start: int = 0, partitions: int | None = None) -> DataFrame:
    """Adds ``name``: 0-based (or ``start``-based) position of each row in
    ``order`` within its ``by`` group.  ``order`` items are column names or
    sort Columns (e.g. ``F.col("x").desc()``)."""
    by = list(by or [])
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    local = ranged.withColumn("__pid", F.spark_partition_id()) \
        .withColumn("__pos", F.monotonically_increasing_id() - F.shiftleft(F.col("__pid").cast("bigint"), 33))
    # Range bounds come from a sample seeded by the RDD id, so two plan
    # branches may cut differently; the sorted slices are written once
    # (reliable checkpoint in the shared folder) and both branches read them.
    local = cut_lineage(local)
    slices = local.groupBy("__pid", *by).agg(F.min("__pos").alias("__first"),
                                              F.count(F.lit(1)).alias("__cnt"))
    # runs over the slice table only: one row per (partition, group) slice,
    # at most partitions + groups - 1 rows (without groups: one per partition)
    w = Window.partitionBy(*by).orderBy("__pid") if by else Window.orderBy("__pid")
    slices = slices.withColumn(
        "__off", F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if not by:
        # slices hold one row per partition: a proven bound
        out = local.join(F.broadcast(slices.select("__pid", *by, "__first", "__off")), ["__pid", *by])
    else:
        out = local.join(slices.select("__pid", *by, "__first", "__off"), ["__pid", *by])
    return out.withColumn(name, F.col("__off") + F.col("__pos") - F.col("__first") + F.lit(start)) \
        .drop("__pid", "__pos", "__first", "__off")

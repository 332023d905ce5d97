"""Exact quantiles (linear interpolation, as pandas) per group, by distributed
selection.

Equal values are counted first.  The value range of a group is cut into BUCKETS
equal parts, whose counts, summed up in order, tell the part that holds a wanted
rank; that part is cut once more, and only the values of the second part are put
in order.  So no task sees a group's values together: the windows run over at most
BUCKETS rows of a group, or over the values of one part in BUCKETS ** 2.  Cuts
depend on the data alone, so a lost task computes the same ones again, and nothing
is run or stored while the query is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def bucket(v: Column, lo: Column, hi: Column, parts: int = BUCKETS) -> Column:
    """Part of [lo, hi] that holds v: never decreasing in v.  A range that is
    empty or not finite is one part."""
    share = (v - lo) / F.when(hi > lo, hi - lo)
    return F.coalesce(F.when(~F.isnan(share), F.least(F.floor(share * parts), F.lit(parts - 1))), F.lit(0)).cast("int")


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls are equal; the right side's keys go."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def quantiles(df: DataFrame, value: str, by: list[str], qs: list[float], out: str = "q") -> DataFrame:
    """-> by + ``out`` (array<double>, one entry per q) + n (group size).
    NULL/NaN values are ignored; a null group key is a group; without ``by`` all rows are
    one, and no row comes back if it has no values."""
    if not by:  # one group: a key that the optimizer does not take for a constant
        one = df.withColumn("__all", F.pmod(F.xxhash64(value), F.lit(1)))
        return quantiles(one, value, ["__all"], qs, out).drop("__all")
    data = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = data.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    sizes = counts.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__c").alias("n"))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(q) * (F.col("n") - 1)), F.ceil(F.lit(q) * (F.col("n") - 1)))
                                                  for q in qs])))
    cut = _matched(counts, sizes, by).withColumn("__b", bucket(F.col("__v"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi", "n")

    def parts_with_ranks(rows: DataFrame, keys: list[str], part: str, start: Column) -> DataFrame:
        """Parts of ``rows`` that hold a wanted rank, with the ranks before them."""
        sums = rows.groupBy(*keys, part).agg(F.sum("__c").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
                                             *[F.any_value(c).alias(c) for c in ("__start", "__ranks") if c in rows.columns])
        if "__ranks" not in sums.columns:
            sums = _matched(sums, sizes.select(*by, wanted.alias("__ranks")), by)
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("__start", start + before)
        held = F.filter("__ranks", lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__n")))
        return sums.withColumn("__ranks", held).filter(F.size("__ranks") > 0).drop("__n")

    first = parts_with_ranks(cut, by, "__b", F.lit(0))
    again = _matched(cut, first, [*by, "__b"]).withColumn("__b2", bucket(F.col("__v"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    second = parts_with_ranks(again, [*by, "__b"], "__b2", F.col("__start")).drop("__lo", "__hi")
    last = _matched(again.drop("__start", "__ranks"), second, [*by, "__b", "__b2"])
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*by, "__b", "__b2").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__start")
    found = last.withColumn("__start", before).select(*by, "__v", F.explode(F.filter(
        "__ranks", lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__c")))).alias("__r"))
    # at most two ranks per quantile
    ranked = found.groupBy(*by).agg(F.map_from_entries(F.collect_set(F.struct("__r", "__v"))).alias("__at"))

    def value_at(q: float) -> Column:
        place = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.element_at("__at", F.floor(place)), F.element_at("__at", F.ceil(place))
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place)))

    return _matched(ranked, sizes.select(*by, "n"), by).select(*by, F.array(*[value_at(q) for q in qs]).alias(out), "n")

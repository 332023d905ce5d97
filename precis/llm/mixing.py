"""Mixing sources to target weights (operator 9).

Tokens per source are aggregated, a target share gives each source a repetition
rate, and a document is emitted floor(rate) times plus one hash-seeded Bernoulli
copy whose probability is the fraction of the rate.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from precis.llm.common import load, materialize, word_array
from precis.plans.registry import register

SEEDS = 16
CAP = 3


def uniform(key: Column, seed: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5('<key>:<seed>'); a null
    key counts as the word null.  Depends on nothing but the key and the seed."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), seed.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source_size and target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the total size.  A target stops at ``cap`` times its source's size; the
    excess goes to the others by weight until none is above.  That end state is
    min(cap * size, level * weight) with one level for all.  With the sources in
    the order of cap * size / weight, stopping the first i of them leaves the
    level (total - their caps) / (weights of the rest), which is largest for the
    right i.  Runs over one row per source.  A source of size 0 gets target 0."""
    n = len(weights)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % n + 1)
    per = per.withColumn("weight", weight.cast("long"))
    full = F.col("source_size") * cap
    fill = W.orderBy((full / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    ahead = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    per = (per.withColumn("left", F.sum("source_size").over(W.partitionBy())
                          - F.coalesce(F.sum(full).over(ahead), F.lit(0)))
              .withColumn("level", F.col("left").cast("double") / F.sum("weight").over(rest)))
    # the level rises up to the last stopped source and falls after it
    level = F.max("level").over(W.partitionBy())
    return per.select("source", "source_size",
                      F.least(full.cast("double"), level * F.col("weight")).alias("target"))


def source_rates(base: DataFrame, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """(s, source_size, target, rate, seed) per source of ``base`` (doc_id,
    source, size).  rate = target / source_size, 0 for a source of size 0.  seed
    is the one of ``seeds`` whose copies come nearest to the target (ties: the
    smallest); all of them are summed in one aggregate."""
    targets = source_targets(base, cap)
    rated = (targets.withColumnRenamed("source", "s")
             .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                         .otherwise(F.lit(0.0))))
    fit = base.join(rated, base["source"].eqNullSafe(rated["s"]))
    frac = F.col("rate") - F.floor("rate")
    sums = fit.groupBy("s", "source_size", "target", "rate").agg(*[
        F.sum(F.when(uniform(F.col("doc_id"), F.lit(k)) < frac, F.col("size")).otherwise(F.lit(0))).alias(f"e{k}")
        for k in range(seeds)])
    off = [F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"e{k}") - F.col("target")).alias("d"),
                    F.lit(k).alias("k")) for k in range(seeds)]
    return sums.select("s", "source_size", "target", "rate", F.array_min(F.array(*off))["k"].alias("seed"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each text, written once."""
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                   F.size(word_array(F.col(text_col))).cast("long").alias("size")), "mix")


def copies(key: Column) -> Column:
    """floor(rate) and one more if the key's uniform number is below the rest."""
    extra = uniform(key, F.col("seed")) < F.col("rate") - F.floor("rate")
    return F.floor("rate").cast("long") + extra.cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per document.

    size: words of the text (null text: 0).  Repeated rows share one id, hence
    one number; every row is returned.  Other columns are ignored.  Empty input:
    empty result."""
    base = sized(docs, id_col, text_col, source_col)
    chosen = source_rates(base, cap, seeds)
    full = base.join(chosen, base["source"].eqNullSafe(chosen["s"]))
    return full.select("doc_id", "source", "size", "source_size", "target", copies(F.col("doc_id")).alias("copies"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    rates = source_rates(sized(docs, id_col, text_col, source_col), cap, seeds).select("s", "rate", "seed")
    names = [F.col(c) for c in docs.columns]
    kept = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("key"), F.col(source_col).alias("of"))
    taken = kept.join(rates, kept["of"].eqNullSafe(rates["s"]))
    again = F.explode(F.array_repeat(F.lit(True), copies(F.col("key")).cast("int")))
    return taken.select("row", again.alias("again")).select("row.*")


SQL = f"""
WITH base AS (
  SELECT doc_id, source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS most,
         ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(most) OVER (
             ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed),
rated AS (
  SELECT source, source_size, least(most::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM rated),
draws AS (
  SELECT b.doc_id, b.source, b.size, r.source_size, r.target, r.rate, k,
         ('0x' || substr(md5(coalesce(b.doc_id::VARCHAR, 'null') || ':' || k), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) AS extra
  FROM base b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source, range({SEEDS}) AS seeds(k)),
tried AS (
  SELECT source, k, abs(floor(any_value(rate)) * any_value(source_size)
                        + sum(CASE WHEN extra THEN size ELSE 0 END) - any_value(target)) AS off
  FROM draws GROUP BY source, k),
best AS (SELECT source, k FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1)
SELECT d.doc_id, d.size, d.source_size, d.target,
       ((floor(d.rate) + d.extra::INT) * d.size)::BIGINT AS taken
FROM draws d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.k = b.k
"""


@register("op9_source_mix", SQL)
def op9_source_mix(spark, sf_dir):
    """Words that the mix takes of every document."""
    mixed = mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"))

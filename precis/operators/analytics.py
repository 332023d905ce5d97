"""Experiment analytics.

Aggregations use Spark's partial + final aggregation, so the shuffle carries
one row per (partition, group) whatever a group's size; a group with a third
of all rows costs no more than the others.  Positions and quantiles come from
counts of value ranges (never one task per group).  Two-pass operators (box stats,
histograms) join a per-group table back, which has one row per group; how is left
to AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.functions import text as T
from precis.functions.tokens import SENT_MARK, sentences, word_tokens
from precis.plans.ordinal import number_index
from precis.plans.quantiles import _matched, quantiles

# Metric codes and their readable names.
METRIC_LABELS = {
    "rouge_1": "ROUGE-1", "rouge_2": "ROUGE-2", "rouge_L": "ROUGE-L", "bert_score": "BERTScore",
    "long_bullets": "Long Bullets", "long_subheadings": "Long Subheadings",
    "contradiction_ratio": "Contradiction Ratio", "number_hallucinations": "Numeric Hallucinations",
    "errors": "Errors", "three_by_three": "Three-By-Three", "geval_fluency": "G-Eval Fluency",
    "geval_relevance": "G-Eval Relevance", "geval_coherence": "G-Eval Coherence",
    "geval_consistency": "G-Eval Consistency", "oq": "OQ", "gr": "GR", "nr": "NR", "rc": "RC",
    "fo": "FO", "sc": "SC", "su": "SU", "si": "SI",
}

# Human-evaluation patterns, three rating rows each, in row order.
RATING_PATTERNS = [
    "base_prompt", "description", "follow_up", "headings_first", "important_parts", "improve",
    "persona", "repeat", "step_by_step", "template", "topic", "analyze_main_themes", "main_points",
    "in_context", "reference", "init_base_prompt", "init_description", "init_topic",
]


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def stable_round(c: Column, places: int) -> Column:
    """Half-even rounding of an aggregated double that does not depend on
    summation order: the value is first fixed to 9 decimals (far below the
    displayed precision, far above float noise), then rounded exactly as a
    decimal."""
    return F.bround(F.round(c, 9).cast("decimal(38,9)"), places).cast("double")


def _not_nan(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


def union_labelled(frames: dict[str, DataFrame], label: str = "approach") -> DataFrame:
    """concatenate frames, each tagged with its name."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn(label, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def metric_summary(df: DataFrame, by, metric: str) -> DataFrame:
    """mean, median, max, min, sample std of a metric per group
    (NaN treated as missing, like pandas)."""
    keys = _keys(by)
    m = F.when(_not_nan(metric), F.col(metric))
    agg = df.groupBy(*keys).agg(F.avg(m).alias("mean"), F.max(m).alias("max"),
                                F.min(m).alias("min"), F.stddev_samp(m).alias("std"))
    med = quantiles(df, metric, keys, [0.5]).select(*keys, F.col("q")[0].alias("median"))
    return _matched(agg, med, keys, "left").select(*keys, "mean", "median", "max", "min", "std")


def box_stats(df: DataFrame, by, metric: str, whisker: float = 1.5,
              approx: bool = False, accuracy: int = 10000) -> tuple[DataFrame, DataFrame]:
    """quartiles, whiskers (most extreme values inside the fences)
    and outliers per group.  Exact quartiles interpolate linearly like
    pandas; ``approx=True`` bounds memory per group for very large groups.
    -> (stats, outliers)."""
    keys = _keys(by)
    data = df.select(*keys, F.col(metric).alias("v")).filter(_not_nan("v"))
    if approx:
        qs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        quart = data.groupBy(*keys).agg(F.percentile_approx("v", qs, accuracy).alias("q"),
                                        F.count(F.lit(1)).alias("n"))
    else:
        quart = quantiles(data, "v", keys, [0.25, 0.5, 0.75])
    quart = quart.select(
        *keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    quart = quart.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lo_fence", F.col("q1") - whisker * F.col("iqr")) \
        .withColumn("hi_fence", F.col("q3") + whisker * F.col("iqr"))
    tagged = data.join(quart.select(*keys, "lo_fence", "hi_fence"), keys)
    inside = (F.col("v") >= F.col("lo_fence")) & (F.col("v") <= F.col("hi_fence"))
    whiskers = tagged.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))
    stats = quart.join(whiskers, keys)
    outliers = tagged.filter(~inside).select(*keys, F.col("v").alias(metric))
    return stats, outliers


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max per numeric column (exact
    percentiles, linear interpolation).  One pass over the data: the columns
    are unpivoted and aggregated per column name."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("x")).select("x.column", "x.v").filter(_not_nan("v"))
    agg = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    p = quantiles(long, "v", ["column"], [0.25, 0.5, 0.75], out="p")
    return agg.join(p, "column").select(
        "column", "count", "mean", "std", "min", F.col("p")[0].alias("p25"),
        F.col("p")[1].alias("p50"), F.col("p")[2].alias("p75"), "max")


def histogram(df: DataFrame, metric: str, by=None, bins: int = 10) -> DataFrame:
    """equal-width bins over [min, max] per group, the last bin closed;
    empty bins are reported with count 0.  A single-valued group spans
    [v - 0.5, v + 0.5] (numpy's convention)."""
    keys = _keys(by) if by else []
    data = df.select(*keys, F.col(metric).cast("double").alias("v")).filter(_not_nan("v"))
    bounds = data.groupBy(*keys).agg(F.min("v").alias("lo0"), F.max("v").alias("hi0")).select(
        *keys,
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    if keys:
        tagged = data.join(bounds, keys)
    else:  # one global group: the bounds are scalar subqueries, no join
        tagged = data.withColumn("lo", bounds.select("lo").scalar()) \
            .withColumn("hi", bounds.select("hi").scalar())
    idx = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                  F.lit(bins - 1)).cast("int")
    counts = tagged.groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = bounds.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width)
        .alias("bin_hi"),
        F.coalesce("count", F.lit(0)).alias("count"))


def scatter_pairs(df: DataFrame, x: str, y: str, key: str = "run_id") -> DataFrame:
    """two metric columns per run."""
    return df.select(key, F.col(x).alias("x"), F.col(y).alias("y"))


def metric_series(df: DataFrame, by, metric: str, order: str = "run_id") -> DataFrame:
    """F8: metric by row index within each group."""
    keys = _keys(by)
    return number_index(df.select(*keys, order, metric), order, keys).select(*keys, "idx", metric)


def _ranked(report: DataFrame, *order) -> DataFrame:
    """A report (one row per group, the table that is shown) in its order, with
    the position as ``rank``."""
    return report.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)).cast("long")).orderBy("rank")


def success_rate(df: DataFrame, by="approach", flag: str = "three_by_three", position: str | None = None) -> DataFrame:
    """100 * sum(flag) / rows per group, rounded half-even to an integer;
    sorted descending.  Ties are in input order if ``position`` names a column
    that tells it (the group's smallest counts), else in the order of the groups."""
    keys = _keys(by)
    first = [F.min(position).alias("__first")] if position else []
    rates = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum(F.col(flag)).cast("bigint").alias("n_success"), *first,
    ).withColumn("success_rate", F.bround(F.col("n_success") * 100.0 / F.col("n_runs"), 0))
    return _ranked(rates, F.desc("success_rate"), *(["__first"] if position else []), *keys).drop("__first")


def success_rate_fixed_n(df: DataFrame, catalogue: list[str], key: str, n: int = 30,
                         flag: str = "three_by_three") -> DataFrame:
    """per entry of the fixed ``catalogue``, 100 * successes / n rounded
    half-even to an integer, with a fixed n; entries without runs report 0.
    Sorted descending, ties in the order of the catalogue."""
    listed = F.array(*[F.struct(F.lit(i).alias("__ord"), F.lit(c).alias(key)) for i, c in enumerate(catalogue)])
    entries = df.sparkSession.range(1).select(F.inline(listed))
    succ = df.filter(F.col(key).isin(catalogue)).groupBy(key).agg(F.sum(flag).cast("bigint").alias("n_success"))
    rates = entries.join(succ, [key], "left").select(
        key, "__ord", F.coalesce("n_success", F.lit(0)).alias("n_success"),
        F.bround(F.coalesce("n_success", F.lit(0)) * 100.0 / F.lit(n), 0).alias("success_rate"))
    return _ranked(rates, F.desc("success_rate"), "__ord").drop("__ord")


def execution_accuracy(df: DataFrame, by="approach", max_errors: int = 2, min_long_bullets: int = 3,
                       min_long_subheadings: int = 2) -> DataFrame:
    """share of runs that are three-by-three with few errors and the
    long-part counts above the thresholds (kept as the reference wrote it)."""
    ok = ((F.col("three_by_three") == 1) & (F.col("errors") < max_errors)
          & (F.col("long_bullets") > min_long_bullets) & (F.col("long_subheadings") > min_long_subheadings))
    return df.groupBy(*_keys(by)).agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("execution_accuracy"))


def top1_per_group(df: DataFrame, by, metric: str, key: str = "run_id") -> DataFrame:
    """best run by metric per group; ties go to the smallest key; NaN
    and NULL metrics are ignored.  One partial+final aggregation (max of a
    (metric, -key) struct), so no group is ever collected."""
    keys = _keys(by)
    best = df.filter(_not_nan(metric)).groupBy(*keys).agg(
        F.max(F.struct(F.col(metric).alias("m"), (-F.col(key)).alias("k"))).alias("b"))
    return best.select(*keys, (-F.col("b.k")).alias(key), F.col("b.m").alias(metric))


def title_difficulty(df: DataFrame, metric: str, title: str = "title", key: str = "run_id",
                     places: int = 3) -> DataFrame:
    """per title the mean metric, labelled "i: title" with i the
    title's first-appearance number, from 1; ascending by score."""
    per = df.groupBy(title).agg(F.avg(metric).alias("m"), F.min(key).alias("first"))
    idx = number_index(per, "first", start=1)
    return idx.select(F.concat(F.col("idx").cast("string"), F.lit(": "), F.col(title)).alias("talk"),
                      stable_round(F.col("m"), places).alias("score")).orderBy("score", "talk")


def positional_pattern(df: DataFrame, row_col: str = "row_idx", patterns: list[str] | None = None,
                       per: int = 3) -> DataFrame:
    """rating row i belongs to pattern i div 3; rows past the list get
    an empty pattern."""
    pats = F.array(*[F.lit(p) for p in (patterns or RATING_PATTERNS)])
    i = F.floor(F.col(row_col) / per).cast("int")
    return df.withColumn("pattern", F.when(i < F.size(pats), F.element_at(pats, i + 1)).otherwise(F.lit("")))


def filter_by_catalogue(df: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """keep rows whose key is in the catalogue (one semi join, not one
    filter per entry)."""
    return df.join(catalogue.select(key).distinct(), [key], "left_semi")


def well_formed(df: DataFrame, flag: str = "three_by_three") -> DataFrame:
    """F16: keep three-by-three runs (pushed down to the Parquet scan)."""
    return df.filter(F.col(flag) == 1)


def control_vs_modifiers(df: DataFrame, by: str, metric: str, control: str) -> DataFrame:
    """per group mean/median/... and the difference of its mean to the
    control group's mean, both from the one per-group table (a window over one row
    per group)."""
    is_control = F.col(by) == F.lit(control)
    control_mean = F.max(F.when(is_control, F.col("mean"))).over(Window.partitionBy())
    return metric_summary(df, by, metric).withColumn("is_control", is_control) \
        .withColumn("delta_mean", F.col("mean") - control_mean)


def before_after(df: DataFrame, by: str, split_col: str, before: str, after: str,
                 metrics: list[str]) -> DataFrame:
    """per pattern and metric, mean before vs after (one pass, conditional
    aggregates)."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(F.when(F.col(split_col) == before, F.col(m))).alias(f"{m}_before"),
                 F.avg(F.when(F.col(split_col) == after, F.col(m))).alias(f"{m}_after")]
    out = df.groupBy(by).agg(*aggs)
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.col(f"{m}_after") - F.col(f"{m}_before"))
    return out


def distinct_predictions(df: DataFrame, by: str = "num_examples", col: str = "prediction", lines: int = 3,
                         values: list | None = None) -> DataFrame:
    """the distinct predictions of each group (of ``values``, if given), each
    by its first ``lines`` lines (two predictions with the same head are two rows)."""
    picked = df if values is None else df.filter(F.col(by).isin(values))
    head = F.array_join(F.slice(F.split(F.col(col), "\n", -1), 1, lines), "\n")
    return picked.select(by, col).distinct().select(by, head.alias("head"))


def melt(df: DataFrame, ids: list[str], cols: list[str], var: str = "variable",
         value: str = "value") -> DataFrame:
    """wide columns -> (variable, value) rows."""
    return df.unpivot(ids, cols, var, value)


def doc_stats(df: DataFrame, col: str = "text", key: str = "doc_id") -> DataFrame:
    """characters (spaces excluded), words, sentences, distinct words,
    sentence lengths, words per sentence.  Tokens: the regex tokeniser of
    ``precis.functions.tokens``."""
    step = df.select(key, F.col(col).alias("t")).withColumn("__s", sentences(F.col("t"))) \
        .withColumn("__sw", F.transform("__s", lambda s: word_tokens(s)))
    # a sentence ends between two tokens, so the text's tokens are those of its
    # sentences, unless it holds the mark that sentences are told apart by
    step = step.withColumn("__w", F.when(F.contains("t", F.lit(SENT_MARK)), word_tokens(F.col("t"))).otherwise(F.flatten("__sw")))
    return step.select(
        key,
        F.length(F.replace("t", F.lit(" "), F.lit(""))).alias("char_count"),
        F.size("__w").alias("word_count"),
        F.size("__s").alias("sent_count"),
        F.size(F.array_distinct("__w")).alias("unique_words"),
        F.transform("__s", lambda s: F.length(s)).alias("sent_lengths"),
        F.transform("__sw", lambda w: F.size(w)).alias("words_in_sents"))


def part_stats(df: DataFrame, col: str = "text", key: str = "doc_id", part: str = "subheadings",
               compat: bool = False) -> DataFrame:
    """statistics on subheadings only (sentences 0, 4, 8) or bullets
    only.  ``compat`` removes 0, 5, 10 in bullet mode, as the reference's
    deletion from a shrinking list did."""
    s = sentences(F.col(col))
    if part == "subheadings":
        picked = F.filter(s, lambda x, i: (i < 12) & (i % 4 == 0))
    elif compat:
        picked = F.filter(s, lambda x, i: ~i.isin(0, 5, 10))
    else:
        picked = F.filter(s, lambda x, i: ~i.isin(0, 4, 8))
    return doc_stats(df.select(key, F.array_join(picked, " ").alias(col)), col, key)


def corpus_vocabulary(df: DataFrame, col: str = "text", approx: bool = False) -> DataFrame:
    """number of distinct words over all documents."""
    words = df.select(F.explode(word_tokens(F.col(col))).alias("w"))
    agg = F.approx_count_distinct("w") if approx else F.count_distinct("w")
    return words.agg(agg.alias("vocabulary"))


def topic_frequency(df: DataFrame, col: str = "topics") -> DataFrame:
    """topic counts from comma lists, C11 tokens, in the order of the topics
    (``rank``), with the number of distinct topics."""
    counts = df.select(F.explode(F.split(F.col(col), ",", -1)).alias("t")) \
        .select(T.topic_token(F.col("t")).alias("topic")).groupBy("topic").count()
    return _ranked(counts.withColumn("n_topics", F.count(F.lit(1)).over(Window.partitionBy())), "topic")


def upload_timeline(df: DataFrame, col: str, unit: str = "day",
                    fmt: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> DataFrame:
    """parse upload dates and count uploads per time bucket."""
    ts = F.to_timestamp(F.col(col), fmt)
    return df.select(F.date_trunc(unit, ts).alias("bucket")).groupBy("bucket").count()


SAMPLE_MOD = 4294967296
SAMPLE_MULT = 40503


def sample_order(key: Column, seed: int = 42, integral: bool = True) -> Column:
    """Seeded pseudo-random order.  Integral keys use a multiplicative hash
    ((key mod 2^32) * 40503 + seed) mod 2^32, reproducible in any SQL engine
    and free of overflow; other keys use xxhash64."""
    if integral:
        return F.pmod(F.pmod(key, F.lit(SAMPLE_MOD)) * SAMPLE_MULT + seed, F.lit(SAMPLE_MOD))
    return F.xxhash64(key, F.lit(seed))


def sample_rows(df: DataFrame, k: int = 1, key: str = "run_id", seed: int = 42) -> DataFrame:
    """deterministic random sample of k rows (the limit is the
    feature).  Spark's top-k keeps k rows per task before merging."""
    from pyspark.sql import types as T
    integral = isinstance(df.schema[key].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    return df.orderBy(sample_order(F.col(key), seed, integral), key).limit(k)


def metric_labels(df: DataFrame, col: str = "metric", out: str = "label") -> DataFrame:
    """metric code -> readable name; an unknown code is an error, a null one
    gets a null label."""
    items = []
    for k, v in METRIC_LABELS.items():
        items += [F.lit(k), F.lit(v)]
    label = F.try_element_at(F.create_map(*items), F.col(col))
    unknown = F.raise_error(F.concat(F.lit("unknown metric: "), F.col(col)))
    return df.withColumn(out, F.when(F.col(col).isNull() | label.isNotNull(), label).otherwise(unknown))


def row_range(df: DataFrame, start: int, end: int, order: str = "run_id", by=None,
              inclusive: bool = False) -> DataFrame:
    """rows ``start``..``end`` (end exclusive like iloc, inclusive like
    loc) in ``order`` within each group.  Only the first rows up to ``end`` are
    kept before the shuffle (the limit on the rank is pushed below it)."""
    keys = _keys(by) if by else []
    last = end + 1 if inclusive else end
    head = df if keys else df.orderBy(order).limit(max(last, 0))
    place = F.row_number().over((Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order))
    return head.withColumn("idx", place).filter(F.col("idx") <= last).withColumn("idx", F.col("idx").cast("long") - 1) \
        .filter(F.col("idx") >= start)


def distinct_titles(df: DataFrame, title: str = "title", key: str = "run_id") -> DataFrame:
    """titles in first-appearance order."""
    first = df.groupBy(title).agg(F.min(key).alias("first"))
    return number_index(first, "first").select(title, "idx")


def mean_metric(df: DataFrame, metric: str) -> DataFrame:
    """F31."""
    return df.agg(F.avg(F.when(_not_nan(metric), F.col(metric))).alias("mean"))


def group_count(df: DataFrame, by) -> DataFrame:
    """F32."""
    return df.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("n"))

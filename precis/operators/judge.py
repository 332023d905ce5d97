"""Judge-score aggregation (E17) and score distribution.

Input: one row per judge reply ``(run_id, metric, choice_idx, reply)``.
Each reply is parsed as int(float(first word)), else from the last word,
else discarded; scores are clipped to [lo, hi].  The expectation divides by
``n_requested - discarded`` (not by the number of replies received) and is
rounded half-even to 2 places; with every reply discarded it is NULL.
One groupBy on (run_id, metric) with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions.text import WS

# A Python float() literal: optional sign, digits with single underscores
# between them, optional fraction, optional exponent.  inf/nan are left out:
# int() rejects them, so they fall through to the next word.
_DIG = "[0-9](_?[0-9])*"
FLOAT_RE = rf"^[+-]?({_DIG}(\.({_DIG})?)?|\.{_DIG})([eE][+-]?{_DIG})?$"


_NWS = "[^" + WS[1:-1] + "]"
FIRST_WORD = f"^{WS}*({_NWS}+)"


def _first_word(reply: Column) -> Column:
    return F.regexp_extract(reply, FIRST_WORD, 1)


def _last_word(reply: Column) -> Column:
    # anchored match on the reversed text: linear, no backtracking scan
    return F.reverse(F.regexp_extract(F.reverse(reply), FIRST_WORD, 1))


def _to_double(word: Column) -> Column:
    return F.when(word.rlike(FLOAT_RE), F.replace(word, F.lit("_"), F.lit("")).try_cast("double"))


def _to_int(d: Column, lo: int, hi: int) -> Column:
    """int() of a finite double (toward zero), within lo..hi; NULL for
    NULL/NaN/inf."""
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    clipped = F.least(F.greatest(d, F.lit(float(lo))), F.lit(float(hi)))
    return F.when(finite, F.when(clipped >= 0, F.floor(clipped)).otherwise(F.ceil(clipped)))


def with_scores(replies: DataFrame, reply_col: str = "reply", lo: int = 1, hi: int = 5,
                out: str = "score") -> DataFrame:
    """Adds the integer score of each reply, clipped to [lo, hi]; NULL when
    unusable.  Staged projections: each intermediate (words, doubles) is a
    column computed once, instead of one deep expression in which the parse
    would be repeated inside every conditional branch."""
    r = F.col(reply_col)
    step = replies.withColumn("__w1", _first_word(r)).withColumn("__w2", _last_word(r))
    step = step.withColumn("__d1", _to_double(F.col("__w1"))).withColumn("__d2", _to_double(F.col("__w2")))
    step = step.withColumn("__raw", F.coalesce(_to_int(F.col("__d1"), lo, hi), _to_int(F.col("__d2"), lo, hi)))
    raw = F.col("__raw")
    # greatest/least skip NULLs, so an unusable reply must stay NULL explicitly
    step = step.withColumn(out, F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)))
                           .cast("int"))
    return step.drop("__w1", "__w2", "__d1", "__d2", "__raw")


def judge_distribution(replies: DataFrame, lo: int = 1, hi: int = 5,
                       keys: tuple[str, ...] = ("run_id", "metric")) -> DataFrame:
    """E18 -> keys + s{lo..hi} counts + n_received + n_discarded."""
    scored = with_scores(replies.select(*keys, "reply"), "reply", lo, hi).select(*keys, "score")
    aggs = [F.count(F.when(F.col("score") == k, 1)).alias(f"s{k}") for k in range(lo, hi + 1)]
    return scored.groupBy(*keys).agg(
        *aggs, F.count(F.lit(1)).alias("n_received"),
        F.count(F.when(F.col("score").isNull(), 1)).alias("n_discarded"))


def judge_score(replies: DataFrame, n_requested: int = 20, lo: int = 1, hi: int = 5,
                keys: tuple[str, ...] = ("run_id", "metric")) -> DataFrame:
    """E17 -> keys + score + n (the divisor used)."""
    dist = judge_distribution(replies, lo, hi, keys)
    n = F.lit(n_requested) - F.col("n_discarded")
    total = F.lit(0.0)
    for k in range(lo, hi + 1):
        total = total + F.lit(float(k)) * (F.col(f"s{k}") / n)
    return dist.select(*keys, F.when(n > 0, F.bround(total, 2)).alias("score"),
                       n.cast("int").alias("n"))


def sql_parse_score(reply: str, lo: int = 1, hi: int = 5) -> str:

    def parse(w):
        d = f"(CASE WHEN regexp_matches({w}, '{FLOAT_RE}') THEN TRY_CAST(replace({w}, '_', '') AS DOUBLE) END)"
        c = f"least(greatest({d}, {float(lo)}), {float(hi)})"
        return (f"(CASE WHEN {d} IS NOT NULL AND NOT isnan({d}) AND abs({d}) < 'inf'::DOUBLE "
                f"THEN (CASE WHEN {c} >= 0 THEN floor({c}) ELSE ceil({c}) END) END)")

    first = f"regexp_extract({reply}, '{FIRST_WORD}', 1)"
    last = f"reverse(regexp_extract(reverse({reply}), '{FIRST_WORD}', 1))"
    raw = f"coalesce({parse(first)}, {parse(last)})"
    return f"CAST(CASE WHEN {raw} IS NOT NULL THEN least(greatest({raw}, {lo}), {hi}) END AS INTEGER)"

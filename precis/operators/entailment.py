"""Entailment lines and ratios.

The NLI model's forward pass is not built: a caller supplies either a
table ``nli(run_id, line_no, p_c, p_n, p_e)`` or a scorer, a Column function
of (source, line) returning struct<p_c,p_n,p_e>; a model-backed scorer
belongs in ``mapInPandas`` so the model loads once per partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entail_lines(runs: DataFrame, text_col: str = "text", pred_col: str = "prediction",
                 keep_source: bool = True) -> DataFrame:
    """Every candidate line paired with the whole source.
    -> (run_id, line_no, line[, source])."""
    cols = ["run_id", F.posexplode(F.split(F.col(pred_col), "\n", -1)).alias("line_no", "line")]
    if keep_source:
        cols.append(F.col(text_col).alias("source"))
    return runs.select(*cols).withColumn("line_no", F.col("line_no").cast("int"))


def score_lines(lines: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """Apply a Column-level scorer: -> (run_id, line_no, p_c, p_n, p_e)."""
    return lines.select("run_id", "line_no", scorer(F.col("source"), F.col("line")).alias("s")) \
        .select("run_id", "line_no", "s.p_c", "s.p_n", "s.p_e")


def length_scorer(source: Column, line: Column) -> Column:
    """Deterministic stand-in scorer for tests and fixtures (not a model):
    probabilities proportional to line length residues."""
    n = F.length(line)
    c, ne, e = (n % 7).cast("double"), (n % 5).cast("double"), (n % 3).cast("double")
    tot = c + ne + e + F.lit(1.0)
    return F.struct((c / tot).alias("p_c"), (ne / tot).alias("p_n"), ((e + 1.0) / tot).alias("p_e"))


def is_contradiction(p_c: Column, p_n: Column, p_e: Column) -> Column:
    """E12 argmax, ties resolved in the order contradiction, neutral, entailment."""
    return (p_c >= p_n) & (p_c >= p_e)


def is_neutral_contradiction(p_c: Column, p_n: Column, p_e: Column) -> Column:
    """Argmax is neutral and contradiction outweighs entailment."""
    return (p_n > p_c) & (p_n >= p_e) & (p_c > p_e)


def entail_ratios(probs: DataFrame) -> DataFrame:
    """E12+E13 -> (run_id, contradiction_ratio, neutral_contradiction_ratio)."""
    pc, pn, pe = F.col("p_c"), F.col("p_n"), F.col("p_e")
    return probs.groupBy("run_id").agg(
        F.avg(is_contradiction(pc, pn, pe).cast("double")).alias("contradiction_ratio"),
        F.avg(is_neutral_contradiction(pc, pn, pe).cast("double")).alias("neutral_contradiction_ratio"))


def row_ratios(text: Column, prediction: Column, scorer: Callable[[Column, Column], Column]) -> Column:
    """E11-E13 inside one row, for a scorer that is a Column function:
    struct(contradiction_ratio, neutral_contradiction_ratio)."""
    probs = F.transform(F.split(prediction, "\n", -1), lambda line: scorer(text, line))

    def share(test) -> Column:
        return F.aggregate(probs, F.struct(F.lit(0).alias("k"), F.lit(0).alias("n")),
                           lambda acc, s: F.struct((acc["k"] + test(s["p_c"], s["p_n"], s["p_e"]).cast("int")).alias("k"),
                                                   (acc["n"] + 1).alias("n")), lambda acc: acc["k"] / acc["n"])

    return F.struct(share(is_contradiction).alias("contradiction_ratio"),
                    share(is_neutral_contradiction).alias("neutral_contradiction_ratio"))

"""Error-count scores.

The reference asked a remote grammar checker per line.  Here findings come
either from a caller's findings table ``(run_id, line_no, category)`` or
from a rule list ``[(category, regex), ...]`` evaluated as built-in
``regexp_count`` expressions on each line (no join, no UDF).  Only
findings whose category is in ``categories`` count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions.tokens import word_tokens

# Finding categories that count as errors (as listed upstream,
# "MISC" appears twice there; the set is what matters).
ERROR_CATEGORIES = ["TYPOGRAPHY", "TYPOS", "PUNCTUATION", "CASING", "CONFUSED_WORDS",
                    "COMPOUNDING", "GRAMMAR", "MISC", "SEMANTICS"]

# Default rule set: simple surface checks that need no dictionary.
DEFAULT_RULES = [
    ("TYPOGRAPHY", r"  +"),
    ("PUNCTUATION", r" [,.;:!?]"),
    ("PUNCTUATION", r"[,;:][^ 0-9]"),
    ("CASING", r"^\p{Ll}"),
    ("TYPOGRAPHY", r"[!?.]{4,}"),
    ("STYLE", r"!!"),
]


def lines(runs: DataFrame, pred_col: str = "prediction") -> DataFrame:
    return runs.select("run_id", F.posexplode(F.split(F.col(pred_col), "\n", -1))
                       .alias("line_no", "line"))


def rule_errors(line: Column, rules=None, categories=None) -> Column:
    rules = DEFAULT_RULES if rules is None else rules
    cats = set(ERROR_CATEGORIES if categories is None else categories)
    total = F.lit(0)
    for cat, pattern in rules:
        if cat in cats:
            total = total + F.regexp_count(line, F.lit(pattern))
    return total.cast("int")


def line_scores(line_df: DataFrame, rules=None, categories=None,
                findings: DataFrame | None = None) -> DataFrame:
    """E14 -> (run_id, line_no, errors, n_tokens, score).  score is
    1 - errors / tokens; an empty line has no tokens and a NULL score
    (the reference divided by zero there)."""
    ntok = F.size(word_tokens(F.col("line")))
    if findings is None:
        scored = line_df.select("run_id", "line_no", rule_errors(F.col("line"), rules, categories)
                                .alias("errors"), ntok.alias("n_tokens"))
    else:
        cats = ERROR_CATEGORIES if categories is None else categories
        counts = findings.filter(F.col("category").isin(cats)).groupBy("run_id", "line_no") \
            .agg(F.count(F.lit(1)).cast("int").alias("errors"))
        scored = line_df.select("run_id", "line_no", ntok.alias("n_tokens")) \
            .join(counts, ["run_id", "line_no"], "left") \
            .withColumn("errors", F.coalesce("errors", F.lit(0)))
    return scored.withColumn(
        "score", F.lit(1.0) - F.col("errors") / F.when(F.col("n_tokens") > 0, F.col("n_tokens")))


def error_scores(line_scores_df: DataFrame) -> DataFrame:
    """E15 -> (run_id, avg_error_count_score, errors, empty_lines)."""
    return line_scores_df.groupBy("run_id").agg(
        F.avg("score").alias("avg_error_count_score"),
        F.sum("errors").cast("int").alias("errors"),
        F.sum((F.col("n_tokens") == 0).cast("int")).cast("int").alias("empty_lines"))


def row_error_scores(prediction: Column, rules=None, categories=None) -> Column:
    """E14 + E15 inside one row, for rules: struct(avg_error_count_score, errors)."""
    lines_ = F.transform(F.split(prediction, "\n", -1), lambda x: F.struct(
        rule_errors(x, rules, categories).alias("e"), F.size(word_tokens(x)).alias("n")))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(0).alias("e"))
    total = F.aggregate(lines_, zero, lambda acc, x: F.struct(
        (acc["s"] + F.when(x["n"] > 0, 1.0 - x["e"] / x["n"]).otherwise(0.0)).alias("s"),
        (acc["k"] + (x["n"] > 0).cast("int")).alias("k"), (acc["e"] + x["e"]).alias("e")))
    return F.transform(F.array(total), lambda t: F.struct(
        F.when(t["k"] > 0, t["s"] / t["k"]).alias("avg_error_count_score"), t["e"].alias("errors")))[0]

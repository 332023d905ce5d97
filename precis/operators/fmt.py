"""E1 format check and E2 truncation of non-conforming predictions.

The expected output is 3 subheadings with 3 bullets each: 12 segments.
Segments come from a split on "." when that yields exactly 12 pieces,
otherwise from a split on newlines.  Subheadings are segments 0, 4, 8;
bullets are the remaining segments *by value* (a bullet equal to a
subheading is not a bullet).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Expected segment count and length limits.
PARTS = 12
SUBHEADING_MAX_LENGTH = 40
BULLET_MAX_LENGTH = 60


def segments(text: Column, parts: int = PARTS) -> Column:
    by_period = F.split(text, r"\.", -1)
    by_line = F.split(text, "\n", -1)
    return F.when(F.size(by_period) == parts, by_period).otherwise(by_line)


def format_check(df: DataFrame, col: str = "prediction", parts: int = PARTS,
                 sub_max: int = SUBHEADING_MAX_LENGTH, bullet_max: int = BULLET_MAX_LENGTH,
                 truncate: bool = True) -> DataFrame:
    """Adds three_by_three, long_subheadings, long_bullets (all int).

    With ``truncate`` (E2) a prediction that fails the check is replaced by
    its first ``parts`` segments joined by newlines, before any other metric
    sees it.
    """
    seg_col = "__seg"
    step = df.withColumn(seg_col, segments(F.col(col), parts))
    step = step.withColumn("__kept", F.slice(F.col(seg_col), 1, parts)) \
               .withColumn("three_by_three", (F.size(seg_col) == parts).cast("int"))
    step = step.withColumn("__subs", F.filter("__kept", lambda x, i: i % 4 == 0))
    out = step.withColumn(
        "long_subheadings",
        F.size(F.filter("__subs", lambda x: F.length(x) > sub_max)).cast("int"),
    ).withColumn(
        "long_bullets",
        F.size(F.filter("__kept", lambda x: ~F.array_contains(F.col("__subs"), x)
                        & (F.length(x) > bullet_max))).cast("int"),
    )
    if truncate:
        out = out.withColumn(
            col,
            F.when(F.col("three_by_three") == 1, F.col(col))
             .otherwise(F.array_join("__kept", "\n")))
    return out.drop(seg_col, "__kept", "__subs")

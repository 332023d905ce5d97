"""Quality rules as a short-circuit cascade (operator 1, DataFrame functions
only).

Each rule's cost and rejection rate are estimated on a sample; the rules run in
the order of rejections per cost, and a document is judged by no rule after the
first that rejects it.  The order never changes which documents are kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import load, word_array
from precis.plans.registry import register

INK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    """A named rejection test over the columns that ``measure`` adds and text."""

    name: str
    rejects: Column


def repeated_words(words: str = "words") -> Column:
    """Words that lie in a 5-word window found twice or more in the text.

    The windows are sorted as strings with their places, so equal ones are
    neighbours; each place of a repeated window covers its words up to the next
    such place, or five."""
    n = F.size(words)
    places = F.sequence(F.lit(0), n - WINDOW)
    ordered = F.sort_array(F.transform(places, lambda i: F.struct(
        F.array_join(F.slice(F.col(words), i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    return ordered


def _beside(own: str, ahead: str, by: int, fewer: int) -> Column:
    """Each hash of ``own`` mixed with the one ``by`` places on in ``ahead``, one
    for each word but the last ``fewer``."""
    left = F.slice(own, 1, F.greatest(F.size("_words") - fewer, F.lit(0)))
    right = F.slice(ahead, by + 1, F.size("_words"))
    return F.zip_with(left, right, lambda a, b: a.bitwiseXOR(F.shiftleft(b, 7 * by)))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (long) of the whole text; null text has no words.

    Windows are first compared by 64-bit hash, which only rules out texts
    without repeats; the others are counted on the windows themselves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(INK))
    step = docs.withColumns({"_text": text, "_words": word_array(F.col(text_col)), "_lines": lines})
    step = step.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(F.col("_text"), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w))})
    step = step.withColumn("_twos", _beside("_hashes", "_hashes", 1, 1))
    step = step.withColumn("_fours", _beside("_twos", "_twos", 2, 3))
    step = step.withColumn("_windows", _beside("_fours", "_hashes", 4, WINDOW - 1))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.withColumn("_sorted", F.when(again, repeated_words("_words")))
    same = F.filter("_sorted", lambda x, k: (x["w"] == F.get(F.col("_sorted"), k + 1)["w"])
                    | F.coalesce(x["w"] == F.get(F.col("_sorted"), k - 1)["w"], F.lit(False)))
    step = step.withColumn("_places", F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(
        F.col("_places"), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"])
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return step.drop("_text", "_lines", "_hashes", "_twos", "_fours", "_windows", "_sorted", "_places")


def base_rules() -> list[Rule]:
    """The two rules of the contract."""
    return [Rule("few_words", F.col("n_words") < 10),
            Rule("repeats", 100 * F.col("n_repeat_words") > 20 * F.col("n_words"))]


def further_rules() -> list[Rule]:
    """Wide limits after the published heuristics for web text."""
    words = F.col("_words")
    lettered = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    bullets = F.size(F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"^[\x20\t]*[-*•]")))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 4 * F.size(F.split("_body", "\n"))),
        Rule("letters", 10 * lettered < 6 * F.col("n_words")),
        Rule("bullets", (10 * bullets > 9 * F.size(F.split("_body", "\n"))) & (F.size(F.split("_body", "\n")) > 3)),
    ]


def rank_rules(measured: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second of a sample, highest first.

    The sample is the first ``sample_rows`` rows that Spark finds (``take``
    reads no more splits than it needs).  Every rule is run over it alone; ties
    and an empty sample keep the given order."""
    spark = measured.sparkSession
    rows = measured.take(sample_rows)
    if not rows:
        return list(rules)
    sample = spark.createDataFrame(rows, measured.schema)
    score = []
    for place, rule in enumerate(rules):
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(F.coalesce(rule.rejects, F.lit(False)))).first()[0]
        score.append((-rejected / (time.perf_counter() - began), place))
    return [rules[place] for _, place in sorted(score)]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, null for a kept one.  CASE
    evaluates its branches in order and stops at the first that is true."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects, F.lit(rule.name)) if out is None else out.when(rule.rejects, F.lit(rule.name))
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, rejected_by) per document.

    Null and empty texts have no words and are rejected; repeated rows are
    judged each by itself; an empty table gives an empty result; other columns
    are ignored.  rejected_by names the first rule of the cascade that rejects,
    whose order depends on the sample; kept does not."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_body"))
    named = named.withColumn("_body", F.coalesce("_body", F.lit("")))
    measured = measure(named, "_body")
    rules = rank_rules(measured, base_rules() + further_rules(), sample_rows)
    few, repeats = base_rules()
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (few.rejects | repeats.rejects).alias("base_failed"), cascade(rules).alias("rejected_by")
    ).withColumn("kept", F.col("rejected_by").isNull())


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             string_split(body, chr(10)) AS lines FROM t),
grams AS (
  SELECT r, i, array_to_string(words[i + 1:i + 5], ' ') AS g
  FROM (SELECT r, words, unnest(range(0, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
spread AS (SELECT DISTINCT r, i + k AS place FROM twice, range(5) AS five(k)),
repeats AS (SELECT r, count(*) AS n FROM spread GROUP BY r),
m AS (
  SELECT w.r, doc_id, lines, words, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeats ON w.r = repeats.r),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 4 * len(lines)
            OR 10 * len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) < 6 * n_words
            OR (10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\t]*[-*•]'))) > 9 * len(lines)
                AND len(lines) > 3)) AS kept
FROM v
"""


@register("op1_quality_rules", SQL)
def op1_quality_rules(spark, sf_dir):
    """Counts and verdict of every document."""
    return quality(load(spark, sf_dir, "documents")).drop("rejected_by")

"""E10 numeric hallucinations: numbers in a candidate summary that the
source does not support.  Map-only: every lookup is an array or literal-map
expression on the row; number words come from a literal map (fixed size).

Rules (per candidate):
* each digit number (``\\p{Nd}+([,.]\\p{Nd}+)?``) counts unless its ordinal
  word is a source token, or the number itself, with "," and "." swapped
  either way, occurs in the source, or its cardinal word is a source token;
* each candidate token that reads as a number word counts unless the value
  (as digits) is a number of the source or the word itself is a source token.
  A word is counted even when the candidate also has the digits (kept quirk).
Tokens are the lower-cased text with characters other than letters, digits,
"_", whitespace, "-", ",", "." deleted, split on whitespace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions.numbers import digit_words, word_values
from precis.functions.text import WS

NUMBER_RE = r"\p{Nd}+([,.]\p{Nd}+)?"
WS_CHARS = WS[1:-1]
DROP_RE = rf"[^\p{{L}}\p{{N}}_{WS_CHARS}\-,.]"


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER_RE), F.lit(0))


def number_tokens(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(text), DROP_RE, "")
    return F.filter(F.split(cleaned, f"{WS}+", -1), lambda t: F.length(t) > 0)


def _lit_map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _has(arr: Column, x: Column) -> Column:
    return F.coalesce(F.array_contains(arr, x), F.lit(False))


def _number_vocab() -> list[str]:
    dw = digit_words()
    return sorted(set(word_values()) | {v[0] for v in dw.values()} | {v[1] for v in dw.values()})


def source_evidence(source: Column) -> tuple[Column, Column]:
    """(numbers of the source, its tokens that are number words)."""
    return numbers(source), F.filter(number_tokens(source), lambda t: t.isin(_number_vocab()))


def count_hallucinations(s_nums: Column, s_words: Column, candidate: Column) -> Column:
    """Count for one candidate given the source evidence columns.  Pass
    column references (not expressions) for the evidence, so the lambdas
    read a value computed once per row."""
    dw = digit_words()
    card = _lit_map({k: v[0] for k, v in dw.items()})
    ordi = _lit_map({k: v[1] for k, v in dw.items()})
    values = _lit_map({k: str(v) for k, v in word_values().items()})

    def digit_unsupported(n: Column) -> Column:
        return (~_has(s_words, F.try_element_at(ordi, n))
                & ~_has(s_nums, n)
                & ~_has(s_nums, F.replace(n, F.lit(","), F.lit(".")))
                & ~_has(s_nums, F.replace(n, F.lit("."), F.lit(",")))
                & ~_has(s_words, F.try_element_at(card, n)))

    value_words = sorted(word_values())

    def word_unsupported(w: Column) -> Column:
        # hash-set membership first: almost every token stops here.  Number
        # words contain no digits, so the reference's "is it digits" skip
        # never applies to a vocabulary word.
        v = F.try_element_at(values, w)
        return w.isin(value_words) & ~_has(s_nums, v) & ~_has(s_words, w)

    return (F.size(F.filter(numbers(candidate), digit_unsupported))
            + F.size(F.filter(number_tokens(candidate), word_unsupported))).cast("int")


def number_hallucinations(df: DataFrame, src_col: str = "text", cand_col: str = "prediction",
                          out: str = "number_hallucinations") -> DataFrame:
    """Adds ``out``.  Source evidence is materialised once per row."""
    s_nums, s_words = source_evidence(F.col(src_col))
    step = df.withColumn("__s_nums", s_nums).withColumn("__s_words", s_words)
    return step.withColumn(out, count_hallucinations(
        F.col("__s_nums"), F.col("__s_words"), F.col(cand_col))).drop("__s_nums", "__s_words")


# ----------------------------------------------------------------- oracle SQL

def _sql_map(d: dict) -> str:
    def q(s):
        return "'" + str(s).replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"


def sql_count(src: str, cand: str) -> str:
    dw = digit_words()
    card = _sql_map({k: v[0] for k, v in dw.items()})
    ordi = _sql_map({k: v[1] for k, v in dw.items()})
    values = _sql_map({k: str(v) for k, v in word_values().items()})
    vocab = _number_vocab()
    vocab_sql = "[" + ", ".join(f"'{w}'" for w in vocab) + "]"

    def nums(e):
        return f"regexp_extract_all({e}, '{NUMBER_RE}')"

    def toks(e):
        return (f"list_filter(regexp_split_to_array(regexp_replace(lower({e}), '{DROP_RE}', '', 'g'), "
                f"'{WS}+'), lambda t: length(t) > 0)")

    s_words = f"list_filter({toks(src)}, lambda t: list_contains({vocab_sql}, t))"
    s_nums = nums(src)

    def has(arr, x):
        return f"coalesce(list_contains({arr}, {x}), false)"

    digit = (f"NOT {has(s_words, f'element_at({ordi}, n)[1]')} AND NOT {has(s_nums, 'n')} "
             f"AND NOT {has(s_nums, 'replace(n, chr(44), chr(46))')} "
             f"AND NOT {has(s_nums, 'replace(n, chr(46), chr(44))')} "
             f"AND NOT {has(s_words, f'element_at({card}, n)[1]')}")
    value_sql = "[" + ", ".join(f"'{w}'" for w in sorted(word_values())) + "]"
    word = (f"list_contains({value_sql}, w) "
            f"AND NOT {has(s_nums, f'element_at({values}, w)[1]')} AND NOT {has(s_words, 'w')}")
    return (f"CAST(len(list_filter({nums(cand)}, lambda n: {digit})) "
            f"+ len(list_filter({toks(cand)}, lambda w: {word})) AS INTEGER)")

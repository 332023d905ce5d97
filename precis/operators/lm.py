"""SLOR (E16): syntactic log-odds ratio of each summary line,

    slor(line) = (ln p_LM(line) - ln p_unigram(line)) / |line|,

averaged over a run's lines.  The language model is a bigram model with
add-k smoothing trained *in Spark* on a corpus (two groupBy counts); a
table of per-line LM log-probabilities can be passed instead.

Scale: scoring is inverted.  The distinct bigrams of all lines are looked up
once, in one table (pair, gain) built for them, so the corpus tables meet
distinct bigrams and never the running text; lines then meet that table in one
join of (line, bigram, count) rows.  A bigram is one string "prev token", as no
token holds white space: one key to hash and compare instead of two.  Nothing is
collected, persisted or run while the query is built: the corpus totals are
scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions.tokens import word_tokens

START = "<s>"


def line_tokens(text: Column) -> Column:
    """Lower-cased word tokens of a line with a start marker in front."""
    return F.concat(F.array(F.lit(START)), word_tokens(F.lower(text)))


def bigrams(t: Column) -> Column:
    """The bigrams "prev token" of a token array, built in one linear pass (the
    array itself is not copied into every exploded row).  ``t`` should be a
    column: an expression would be evaluated at each of its places here."""
    return F.when(F.size(t) > 1, F.transform(F.slice(t, F.lit(2), F.size(t)), lambda x, i: F.concat(t[i], F.lit(" "), x))) \
        .otherwise(F.array().cast("array<string>"))


def prev_of(pair: Column) -> Column:
    return F.substring_index(pair, " ", 1)


def token_of(pair: Column) -> Column:
    return F.substring_index(pair, " ", -1)


def _pairs(lines: DataFrame, *first: Column) -> DataFrame:
    """A row ``pair`` for each bigram of the token arrays ``t``, the other columns
    repeated.  It is made non-null, so that no join on it adds a null filter below
    the counting, which would keep its exchange from being shared."""
    pairs = lines.select(*[c for c in lines.columns if c != "t"], F.explode(F.concat(*first, bigrams(F.col("t")))).alias("pair"))
    return pairs.withColumn("pair", F.coalesce("pair", F.lit("")))


def train_bigram_lm(corpus: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame, Column]:
    """-> (unigrams(token, cu), bigrams(pair, cb), struct(n, v)): counts, and as
    a scalar the number of tokens and of distinct tokens.

    The corpus is tokenised into bigram counts only; a line's start marker is
    counted as a bigram after an empty token, so that a token's count is the sum
    of its bigram counts for the marker too."""
    lines = corpus.select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("line")) \
        .filter(F.length("line") > 0)
    first = F.array(F.lit(" " + START))
    bi = _pairs(lines.select(line_tokens(F.col("line")).alias("t")), first) \
        .groupBy("pair").agg(F.count(F.lit(1)).alias("cb"))
    uni = bi.groupBy(token_of(F.col("pair")).alias("token")).agg(F.sum("cb").alias("cu"))
    # conditions instead of a filter, which would be pushed below the counting
    # and keep its exchange from being shared
    word = F.col("token") != START
    totals = uni.agg(F.struct(F.coalesce(F.sum(F.when(word, F.col("cu"))), F.lit(0)).alias("n"),
                              F.count(F.when(word, 1)).alias("v")).alias("s"))
    return uni, bi, totals.scalar()


def slor(runs: DataFrame, corpus: DataFrame, k: float = 1.0, pred_col: str = "prediction",
         corpus_col: str = "text", compat_zero: bool = False) -> DataFrame:
    """-> (run_id, slor).  ``compat_zero`` reproduces the reference's stored
    constant 0."""
    if compat_zero:
        return runs.select("run_id", F.lit(0.0).alias("slor"))
    uni, bi, totals = train_bigram_lm(corpus, corpus_col)
    lines = runs.select("run_id", F.posexplode(F.split(F.col(pred_col), "\n", -1)).alias("line_no", "line"))
    used = _pairs(lines.select("run_id", "line_no", line_tokens(F.col("line")).alias("t"))) \
        .groupBy("run_id", "line_no", "pair").agg(F.count(F.lit(1)).alias("times"))
    # the distinct bigrams, each with its counts and those of its two tokens; they
    # are hashed, so that the many more bigrams of the corpus are not sorted
    table = used.select("pair").distinct().hint("shuffle_hash").join(bi, "pair", "left") \
        .select("pair", "cb", prev_of(F.col("pair")).alias("prev"), token_of(F.col("pair")).alias("token")) \
        .join(uni, "token", "left") \
        .join(uni.select(F.col("token").alias("prev"), F.col("cu").alias("cp")), "prev", "left")
    kv = F.lit(k) * F.greatest(totals["v"], F.lit(1))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)) + F.lit(k)
    table = table.select("pair", (F.log(count("cb") / (F.coalesce("cp", F.lit(0)) + kv))
                                  - F.log(count("cu") / (totals["n"] + kv))).alias("gain"))
    per_line = used.join(table, "pair").groupBy("run_id", "line_no").agg(
        (F.sum(F.col("gain") * F.col("times")) / F.sum("times")).alias("line_slor"))
    return per_line.groupBy("run_id").agg(F.avg("line_slor").alias("slor"))

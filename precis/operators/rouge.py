"""ROUGE-1/2 (E3, E4), summary-level ROUGE-Lsum (E5), Porter stems of the
vocabulary (E6), per-reference score arrays (E7) and their mean (E8).

ROUGE-n is a multiset intersection by one tagged aggregation: the grams of
candidates and references go through the same exchange on (run_id, n, gram),
where each side's count is a conditional sum (combined map-side first), so that
the overlap least(r, c) and the totals of both sides come from the same group.
A run with a huge text spreads over all tasks, and text never crosses that
exchange: only (key, gram, count) rows do.

ROUGE-Lsum needs an LCS per (reference sentence, candidate sentence); that
DP runs in an Arrow-batched function per pair row (quadratic only within a
pair, never across pairs).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions import tokens as K
from precis.functions.stem import porter_stem
from precis.functions.udf import LazyPandasUDF


def grams(tokens: Column, n: int) -> Column:
    """n-grams of a token array, tokens joined by a space (tokens are
    [a-z0-9]+ so the key is unambiguous)."""
    if n == 1:
        return tokens
    size = F.size(tokens)
    return F.when(size >= n, F.transform(
        F.sequence(F.lit(0), size - n),
        lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(
        F.array().cast("array<string>"))


def _stem_arrays(arrs: pd.Series) -> pd.Series:
    stem = _cached_stem()
    return arrs.map(lambda a: None if a is None else [stem(t) if len(t) > 3 else t for t in a])


@lru_cache(maxsize=1)
def _cached_stem():
    return lru_cache(maxsize=1 << 18)(porter_stem)


def _stem_nested(arrs: pd.Series) -> pd.Series:
    stem = _cached_stem()
    return arrs.map(lambda a: None if a is None else
                    [[stem(t) if len(t) > 3 else t for t in s] for s in a])


stem_tokens = LazyPandasUDF(_stem_arrays, "array<string>")
stem_nested = LazyPandasUDF(_stem_nested, "array<array<string>>")


def metric_tokens(text: Column, stem: bool = False, preprocess: bool = True) -> Column:
    """Tokens the scorer compares: C9 preprocessing, then the scorer's own
    tokeniser, then (optionally) Porter stems of tokens longer than 3."""
    src = K.rouge_preprocess(text) if preprocess else text
    toks = K.scorer_tokens(src)
    return stem_tokens(toks) if stem else toks


def _fmeasure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def reference_tokens(refs: DataFrame, tokens_of, ref_col: str = "reference", ref_key: str | None = None,
                     ref_texts: DataFrame | None = None, out: str = "t") -> DataFrame:
    """(run_id, ref_no, tokens).  References are usually shared by many runs
    (the gold summaries of a talk): with ``ref_key`` and ``ref_texts`` (ref_key,
    reference) each text is tokenised once and the tokens are joined to the keyed
    ``refs``; with ``ref_key`` alone the distinct texts are taken from ``refs``."""
    if ref_key is None:
        return refs.select("run_id", "ref_no", tokens_of(F.col(ref_col)).alias(out))
    texts = ref_texts if ref_texts is not None else refs.select(ref_key, ref_col).dropDuplicates([ref_key])
    toks = texts.select(ref_key, tokens_of(F.col(ref_col)).alias(out))
    # One reference serves many runs (hot keys).  The join is left to AQE, which
    # broadcasts a side that turns out small and splits skewed partitions otherwise.
    return refs.select("run_id", "ref_no", ref_key).join(toks, ref_key).drop(ref_key)


#: references of a run are numbered below this, as the gold summaries are
REFERENCES = 4


def rouge_arrays(rows: DataFrame, ns: tuple[int, ...] = (1, 2), references: int = REFERENCES) -> DataFrame:
    """-> (run_id, n, nc, refs): per run and n the candidate's number of grams and
    an array of (ref_no, o, nr): overlap and number of grams of each reference.

    ``rows`` (run_id, ref_no, t): token arrays, the candidate's ref_no being null.
    Reference numbers are 0 .. references - 1; another one is an error.  Repeated
    rows of a side add up.  A run without a candidate has no row."""
    ok = F.col("ref_no").isNull() | F.col("ref_no").between(0, references - 1)
    side = F.when(ok, F.coalesce(F.col("ref_no"), F.lit(-1))).otherwise(
        F.raise_error(F.concat(F.lit("reference number out of range: "), F.col("ref_no").cast("string"))))
    # a gram that is null marks that the side is there, even if it has no grams
    kinds = F.array(*[F.struct(F.lit(n).alias("n"), F.concat(
        grams(F.col("t"), n), F.array(F.lit(None).cast("string"))).alias("g")) for n in ns])
    tagged = rows.select("run_id", side.cast("int").alias("side"), F.explode(kinds).alias("k")) \
        .select("run_id", "side", "k.n", F.explode("k.g").alias("gram"))
    sides = [F.count(F.when(F.col("side") == k, 1)).alias(f"s{k + 1}") for k in range(-1, references)]
    met = tagged.groupBy("run_id", "n", "gram").agg(*sides)
    real = F.col("gram").isNotNull()
    aggs = [F.sum(F.when(real, F.col("s0")).otherwise(0)).alias("nc"), F.sum(F.when(~real, F.col("s0"))).alias("there")]
    for k in range(1, references + 1):
        aggs += [F.sum(F.when(real, F.least(f"s{k}", "s0")).otherwise(0)).alias(f"o{k}"),
                 F.sum(F.when(real, F.col(f"s{k}")).otherwise(0)).alias(f"r{k}"),
                 F.sum(F.when(~real, F.col(f"s{k}"))).alias(f"m{k}")]
    flat = met.groupBy("run_id", "n").agg(*aggs).filter("there > 0")
    each = F.array(*[F.when(F.col(f"m{k}") > 0, F.struct(
        F.lit(k - 1).alias("ref_no"), F.col(f"o{k}").alias("o"), F.col(f"r{k}").alias("nr"))) for k in range(1, references + 1)])
    return flat.select("run_id", F.col("n").cast("int").alias("n"), "nc", F.filter(each, lambda x: x.isNotNull()).alias("refs"))


def _scores(nc: Column, ref: Column) -> tuple[Column, Column, Column]:
    o = ref["o"].cast("double")
    p, r = o / F.greatest(nc, F.lit(1)), o / F.greatest(ref["nr"], F.lit(1))
    return p, r, _fmeasure(p, r)


def token_rows(cands: DataFrame, refs: DataFrame, stem: bool = False, cand_col: str = "prediction",
               ref_col: str = "reference", preprocess: bool = True, ref_key: str | None = None,
               ref_texts: DataFrame | None = None) -> DataFrame:
    """(run_id, ref_no, t) of candidates (ref_no null) and references."""
    ct = cands.select("run_id", F.lit(None).cast("int").alias("ref_no"), metric_tokens(F.col(cand_col), stem, preprocess).alias("t"))
    rt = reference_tokens(refs, lambda c: metric_tokens(c, stem, preprocess), ref_col, ref_key, ref_texts)
    return ct.unionByName(rt)


def rouge_n(cands: DataFrame, refs: DataFrame, ns: tuple[int, ...] = (1, 2),
            stem: bool = False, cand_col: str = "prediction",
            ref_col: str = "reference", preprocess: bool = True,
            ref_key: str | None = None, ref_texts: DataFrame | None = None,
            references: int = REFERENCES) -> DataFrame:
    """-> (run_id, ref_no, n, p, r, f1) for every reference of every run."""
    rows = token_rows(cands, refs, stem, cand_col, ref_col, preprocess, ref_key, ref_texts)
    each = rouge_arrays(rows, ns, references).select("run_id", "n", "nc", F.explode("refs").alias("ref"))
    p, r, f1 = _scores(F.col("nc"), F.col("ref"))
    return each.select("run_id", "ref.ref_no", "n", p.alias("p"), r.alias("r"), f1.alias("f1"))


def rouge_score_arrays(rows: DataFrame, ns: tuple[int, ...] = (1, 2), references: int = REFERENCES) -> DataFrame:
    """E7 in the same aggregate -> (run_id, n, scores): F1 of every reference, in
    reference order; ``rows`` as for ``rouge_arrays``."""
    return rouge_arrays(rows, ns, references).filter(F.size("refs") > 0).select(
        "run_id", "n", F.transform("refs", lambda x: _scores(F.col("nc"), x)[2]).alias("scores"))


# ---------------------------------------------------------------- ROUGE-Lsum

#: rows of an LCS table held at a time are at most this many cells, or about
#: 2 * sqrt(n) rows where that is more
LCS_CELLS = 1 << 20


def _lcs_indices(ref: list[str], can: list[str], cells: int = LCS_CELLS) -> list[int]:
    """Indices into ``ref`` of one LCS with ``can`` (row-vectorised DP,
    standard back-track preferring to move in ``ref`` on ties).

    A reference token that the candidate lacks repeats the row above it, and the
    way back passes it by, so such tokens take no part.  Of a table larger than
    ``cells`` every ``step``-th row is kept and the rows between two of them are
    found again when the way back reaches them."""
    held = set(can)
    places = [i for i, t in enumerate(ref) if t in held]
    n, m = len(places), len(can)
    if n == 0:
        return []
    vocab: dict[str, int] = {}
    r_ids = [vocab.setdefault(ref[i], len(vocab)) for i in places]
    c_ids = np.array([vocab.get(t, -1) for t in can])
    same = {x: c_ids == x for x in set(r_ids)} if len(vocab) * m <= cells else {}

    def below(prev: np.ndarray, i: int) -> np.ndarray:
        hit = same[r_ids[i - 1]] if same else c_ids == r_ids[i - 1]
        row = np.zeros(m + 1, np.int32)
        np.maximum.accumulate(np.where(hit, prev[:-1] + 1, prev[1:]), out=row[1:])
        return row

    step = max(1, int(np.sqrt(n)), cells // (m + 1))
    kept = [np.zeros(m + 1, np.int32)]
    rows = kept[:]
    for i in range(1, n + 1):
        rows.append(below(rows[-1], i))
        if i % step == 0 and i < n:
            kept.append(rows[-1])
            rows = [rows[-1]]
    out = []
    i, j = n, m
    while i > 0 and j > 0:
        top = (i - 1) // step * step
        if rows is None:
            rows = [kept[top // step]]
            for x in range(top + 1, i + 1):
                rows.append(below(rows[-1], x))
        while i > top and j > 0:
            if r_ids[i - 1] == c_ids[j - 1]:
                out.append(places[i - 1])
                i -= 1
                j -= 1
            elif rows[i - top][j - 1] > rows[i - 1 - top][j]:
                j -= 1
            else:
                i -= 1
        rows = None
    out.reverse()
    return out


def lcs_length(a: list[str], b: list[str]) -> int:
    return len(_lcs_indices(a, b))


def summary_lcs(ref_sents: list[list[str]], can_sents: list[list[str]]) -> tuple[float, float, float]:
    """Summary-level LCS P/R/F1 with per-token hit budgets."""
    m = sum(len(s) for s in ref_sents)
    n = sum(len(s) for s in can_sents)
    if not ref_sents or not can_sents or m == 0 or n == 0:
        return 0.0, 0.0, 0.0
    cnt_r: dict[str, int] = {}
    cnt_c: dict[str, int] = {}
    for s in ref_sents:
        for t in s:
            cnt_r[t] = cnt_r.get(t, 0) + 1
    for s in can_sents:
        for t in s:
            cnt_c[t] = cnt_c.get(t, 0) + 1
    hits = 0
    for r in ref_sents:
        union = sorted(set().union(*[_lcs_indices(r, c) for c in can_sents]))
        for t in (r[i] for i in union):
            if cnt_c.get(t, 0) > 0 and cnt_r.get(t, 0) > 0:
                hits += 1
                cnt_c[t] -= 1
                cnt_r[t] -= 1
    rec, prec = hits / m, hits / n
    f1 = 2 * prec * rec / (prec + rec) if prec + rec > 0 else 0.0
    return prec, rec, f1


def _lsum(refs: pd.Series, cands: pd.Series) -> pd.DataFrame:
    rows = [summary_lcs([list(s) for s in r] if r is not None else [],
                        [list(s) for s in c] if c is not None else [])
            for r, c in zip(refs, cands)]
    return pd.DataFrame(rows, columns=["p", "r", "f1"])


lsum_udf = LazyPandasUDF(_lsum, "struct<p:double,r:double,f1:double>")


def sentence_tokens(text: Column, stem: bool = False) -> Column:
    """Sentences of the preprocessed text, re-split by the scorer, then
    tokenised: array<array<string>>."""
    sents = K.sentences(K.rouge_preprocess(text))
    toks = F.transform(sents, K.scorer_tokens)
    toks = F.filter(toks, lambda t: F.size(t) > 0)
    return stem_nested(toks) if stem else toks


def rouge_lsum(cands: DataFrame, refs: DataFrame, stem: bool = False,
               cand_col: str = "prediction", ref_col: str = "reference",
               ref_key: str | None = None, ref_texts: DataFrame | None = None) -> DataFrame:
    """E5 -> (run_id, ref_no, p, r, f1).  Candidate sentences are tokenised
    once per run (references once per distinct reference with ``ref_key``),
    then joined to the run's references."""
    ct = cands.select("run_id", sentence_tokens(F.col(cand_col), stem).alias("cs"))
    rt = reference_tokens(refs, lambda c: sentence_tokens(c, stem), ref_col, ref_key, ref_texts, out="rs")
    m = rt.join(ct, "run_id").select("run_id", "ref_no", lsum_udf(F.col("rs"), F.col("cs")).alias("m"))
    return m.select("run_id", "ref_no", "m.p", "m.r", "m.f1")


# ---------------------------------------------------------------- E6, E7, E8

def stem_vocab(df: DataFrame, tok_col: str) -> DataFrame:
    """The distinct vocabulary of a token-array column with its Porter
    stems; each distinct token is stemmed once."""
    vocab = df.select(F.explode(tok_col).alias("token")).distinct()
    return vocab.select("token", F.element_at(stem_tokens(F.array("token")), 1).alias("stem"))


def multi_ref_scores(scores: DataFrame, value: str = "f1",
                     keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Per run, the score of every reference in reference order."""
    return scores.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ref_no", value))),
                    lambda s: s[value]).alias("scores"))


def array_mean(arr: Column) -> Column:
    """Mean of a numeric array; NULL for an empty array."""
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(arr) > 0, total / F.size(arr))

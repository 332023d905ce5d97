"""Rows-only operators checked against independent brute force on sf0.001."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from precis.operators import rouge
from precis.plans import views


def _lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def _lcs_idx(a, b):
    t, i, j, out = _lcs_table(a, b), len(a), len(b), []
    while i > 0 and j > 0:
        if a[i - 1] == b[j - 1]:
            out.insert(0, i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def _lsum(refs, cands):
    m, n = sum(map(len, refs)), sum(map(len, cands))
    if not refs or not cands or not m or not n:
        return 0.0
    cr, cc = Counter(t for s in refs for t in s), Counter(t for s in cands for t in s)
    hits = 0
    for r in refs:
        for t in [r[i] for i in sorted(set().union(*[_lcs_idx(r, c) for c in cands]))]:
            if cc[t] > 0 and cr[t] > 0:
                hits, cc[t], cr[t] = hits + 1, cc[t] - 1, cr[t] - 1
    p, rc = hits / n, hits / m
    return 2 * p * rc / (p + rc) if p + rc else 0.0


def test_rouge_lsum_brute_force(spark, sf):
    r = views.runs(spark, sf)
    f = views.refs(spark, sf, r)
    got = {(x["run_id"], x["ref_no"]): x["f1"] for x in
           rouge.rouge_lsum(r.select("run_id", "prediction"), f, stem=True).collect()}
    ct = {x["run_id"]: x["t"] for x in r.select("run_id", rouge.sentence_tokens(F.col("prediction"), True)
                                                .alias("t")).collect()}
    rt = {(x["run_id"], x["ref_no"]): x["t"] for x in
          f.select("run_id", "ref_no", rouge.sentence_tokens(F.col("reference"), True).alias("t")).collect()}
    assert len(got) == len(rt) > 0
    for k, toks in rt.items():
        assert got[k] == pytest.approx(_lsum([list(s) for s in toks], [list(s) for s in ct[k[0]]]), abs=1e-12)


def test_rouge1_stemmed_brute_force(spark, sf):
    r = views.runs(spark, sf)
    f = views.refs(spark, sf, r)
    got = {(x["run_id"], x["ref_no"]): x["f1"] for x in
           rouge.rouge_n(r.select("run_id", "prediction"), f, ns=(1,), stem=True, ref_key="item_id").collect()}
    ct = {x["run_id"]: x["t"] for x in r.select("run_id", rouge.metric_tokens(F.col("prediction"), True)
                                                .alias("t")).collect()}
    rt = {(x["run_id"], x["ref_no"]): x["t"] for x in
          f.select("run_id", "ref_no", rouge.metric_tokens(F.col("reference"), True).alias("t")).collect()}
    for k, toks in rt.items():
        c, rr = Counter(ct[k[0]]), Counter(toks)
        o = sum(min(v, c[g]) for g, v in rr.items())
        p, rc = o / max(sum(c.values()), 1), o / max(sum(rr.values()), 1)
        want = 2 * p * rc / (p + rc) if p + rc else 0.0
        assert got[k] == pytest.approx(want, abs=1e-12)


def test_stem_vocab_matches_per_token(spark, sf):
    from precis.functions.stem import porter_stem
    r = views.runs(spark, sf)
    toks = r.select(rouge.metric_tokens(F.col("prediction")).alias("t"))
    rows = rouge.stem_vocab(toks, "t").collect()
    assert len({x["token"] for x in rows}) == len(rows) > 0
    assert all(x["stem"] == (porter_stem(x["token"]) if len(x["token"]) > 3 else x["token"]) for x in rows)

"""Hand vectors for the summary metrics (FIXTURES.md §3) and invariances."""

import pytest

from precis.operators import entailment, fmt, grammar, hallucination, judge, rouge
from precis.functions.stem import porter_stem


def _fmt(spark, text):
    df = spark.createDataFrame([(1, text)], "run_id long, prediction string")
    r = fmt.format_check(df).first()
    return (r["three_by_three"], r["long_subheadings"], r["long_bullets"]), r["prediction"]


def test_format_check_vectors(spark):
    twelve = "\n".join(f"l{i}" for i in range(12))
    assert _fmt(spark, twelve) == ((1, 0, 0), twelve)
    assert _fmt(spark, "a.b.c.d.e.f.g.h.i.j.k.l")[0] == (1, 0, 0)
    long12 = " ".join(f"Sentence number {i} is here." for i in range(12))
    assert _fmt(spark, long12) == ((0, 1, 0), long12)
    fourteen = "\n".join(f"l{i}" for i in range(14))
    res, pred = _fmt(spark, fourteen)
    assert res == (0, 0, 0) and pred == "\n".join(f"l{i}" for i in range(12))
    b, c = "b" * 61, "c" * 61
    assert _fmt(spark, f"A\n{b}\nA\n{c}")[0] == (0, 0, 2)
    assert _fmt(spark, "")[0] == (0, 0, 0)


@pytest.mark.parametrize("src,cand,want", [
    ("In 1990 we had 3.5 million", "In 1990 we had 3,5 and 7", 1),
    ("there were 2 dogs", "two dogs", 0),
    ("cats", "three cats", 1),
    ("cats", "three cats 3", 2),
    ("the first of them", "the 1 of them", 0),
    ("twenty-one guns", "21 guns", 0),
    ("no digits", "no digits", 0),
    ("cats", "the first cat", 0),
    ("cats", "forty-first cat", 1),
])
def test_number_hallucinations(spark, src, cand, want):
    df = spark.createDataFrame([(1, src, cand)], "run_id long, text string, prediction string")
    assert hallucination.number_hallucinations(df).first()["number_hallucinations"] == want


def test_entailment_ratios(spark):
    rows = [(1, 0, .6, .3, .1), (1, 1, .3, .5, .2), (1, 2, .1, .5, .4), (1, 3, .1, .2, .7)]
    probs = spark.createDataFrame(rows, "run_id long, line_no int, p_c double, p_n double, p_e double")
    r = entailment.entail_ratios(probs).first()
    assert r["contradiction_ratio"] == 0.25 and r["neutral_contradiction_ratio"] == 0.25


def _judge(spark, replies, n):
    rows = [(1, "fluency", i, r) for i, r in enumerate(replies)]
    df = spark.createDataFrame(rows, "run_id long, metric string, choice_idx int, reply string")
    return judge.judge_score(df, n_requested=n).first()


def test_judge_score(spark):
    r = _judge(spark, ["4", "4", "5 great", "Score: 3", "bad"], 5)
    assert r["score"] == 4.0 and r["n"] == 4
    for reply, want in [("0", 1.0), ("10", 5.0), ("3.9", 3.0), ("-2", 1.0), ("4_0", 5.0)]:
        assert _judge(spark, [reply], 1)["score"] == want
    for bad in ["3/5", "nan", "inf", "", "1d"]:
        assert _judge(spark, [bad], 1)["score"] is None
    r = _judge(spark, ["5"] * 16 + ["x", "y"], 20)
    assert r["n"] == 18 and r["score"] == round(5 * 16 / 18, 2)


def test_rouge_vectors(spark):
    c = spark.createDataFrame([(1, "a a b"), (2, "a b d"), (3, "x y"), (4, "a b c")],
                              "run_id long, prediction string")
    r = spark.createDataFrame([(i, 0, "a b c") for i in (1, 2, 3, 4)],
                              "run_id long, ref_no int, reference string")
    got = {(x["run_id"], x["n"]): x["f1"] for x in
           rouge.rouge_n(c, r, ns=(1, 2), preprocess=False).collect()}
    assert got[(1, 1)] == pytest.approx(2 / 3)
    assert got[(2, 2)] == pytest.approx(0.5)
    assert got[(3, 1)] == 0.0
    assert got[(4, 1)] == pytest.approx(1.0) and got[(4, 2)] == pytest.approx(1.0)


def test_lcs():
    assert rouge.lcs_length("the cat sat on mat".split(), "the cat on the mat".split()) == 4
    p, r, f = rouge.summary_lcs([["a", "b", "c"]], [["a", "b", "c"]])
    assert f == pytest.approx(1.0)
    assert rouge.summary_lcs([["a"]], [["b"]])[2] == 0.0


def test_rouge_partition_invariance(spark, sf):
    from precis.plans import views
    r = views.runs(spark, sf)
    f = views.refs(spark, sf, r)
    base = sorted(rouge.rouge_n(r.select("run_id", "prediction"), f, ns=(1,)).collect())
    for n in (1, 13):
        again = sorted(rouge.rouge_n(r.repartition(n).select("run_id", "prediction"), f.repartition(n),
                                     ns=(1,)).collect())
        assert again == base


def test_porter():
    assert [porter_stem(w) for w in ["caresses", "ponies", "running", "relational", "hopeful"]] == \
        ["caress", "poni", "run", "relat", "hope"]


def test_error_scores_skip_empty_lines(spark):
    df = spark.createDataFrame([(1, "Good line here.\n\nbad  spacing ,here")], "run_id long, prediction string")
    ls = grammar.line_scores(grammar.lines(df))
    out = grammar.error_scores(ls).first()
    assert out["empty_lines"] == 1 and out["errors"] >= 2


def test_slor_shuffled_equals_broadcast(spark, sf):
    from precis.operators import lm
    from precis.plans import views
    from precis.session import table
    runs = views.runs(spark, sf)
    corpus = table(spark, sf, "documents").select("text")
    a = {r["run_id"]: round(r["slor"], 9) for r in lm.slor(runs, corpus).collect()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        b = {r["run_id"]: round(r["slor"], 9) for r in lm.slor(runs, corpus).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert a == b and len(a) > 0


def test_salted_join_matches_plain(spark):
    from precis.plans.joins import salted_join
    big = spark.createDataFrame([(i % 3, i) for i in range(200)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    plain = sorted(tuple(r) for r in big.join(small, "k", "left").collect())
    salted = sorted(tuple(r) for r in salted_join(big, small, ["k"], "left", buckets=5).collect())
    assert plain == salted

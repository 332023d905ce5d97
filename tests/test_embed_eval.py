"""Embedding matching in blocks, ROUGE in one aggregate, and the evaluation
planner against brute force."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from precis.operators import embed, lm, rouge
from precis.plans import metric_queries, views


def greedy(a, b):
    unit = [x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1) for x in (np.array(a, float), np.array(b, float))]
    sim = unit[0] @ unit[1].T
    p, r = sim.max(1).mean(), sim.max(0).mean()
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_long_text_in_blocks_with_baseline(spark):
    """A text of 5 000 vectors, a text with a hot vector, a zero vector, hot references."""
    rng = np.random.default_rng(1)
    texts = {0: rng.normal(size=(5000, 8)), 1: rng.normal(size=(700, 8)), 2: np.vstack([np.ones((900, 8)), rng.normal(size=(3, 8))]),
             3: np.vstack([np.zeros((1, 8)), rng.normal(size=(2, 8))])}
    rows = [(t, i if t != 2 else 0, [float(x) for x in v]) for t, m in texts.items() for i, v in enumerate(m)]
    rows += [(3, 9, None), (3, 10, [None] * 8)]
    vecs = spark.createDataFrame(rows, "text_id int, vec_id int, embedding array<double>")
    pairs = [(f"{c}-{r}-{k}", c, r) for c in texts for r in texts for k in range(3)] + [("none", 0, 77)]
    got = embed.embedding_match(vecs, vecs, spark.createDataFrame(pairs, "pair_id string, cand_text int, ref_text int"),
                                baseline=0.2).collect()
    assert {r["pair_id"] for r in got} == {p[0] for p in pairs} - {"none"}
    for r in got:
        c, f = map(int, r["pair_id"].split("-")[:2])
        want = [(x - 0.2) / 0.8 for x in greedy(texts[c], texts[f])]
        assert np.allclose([r["p"], r["r"], r["f1"]], want, atol=1e-6)


def test_bert_scores_over_sentence_pairs(spark, sf):
    """The query's operator on a fixture: equal sentence counts, unequal ones, an
    empty side, equal sentences."""
    refs = [(1, 0, "A b. C d? E f."), (1, 1, "whole text here."), (2, 0, "Some words"), (3, 0, "A b. C d? E f.")]
    cands = [(1, "a b\nc x\ne f"), (2, ""), (3, "one line")]
    emb = {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    rf, cf = spark.createDataFrame(refs, "run_id int, ref_no int, reference string"), spark.createDataFrame(cands, "run_id int, prediction string")
    got = {(r["run_id"], r["ref_no"]): r["bert_score"] for r in
           embed.bert_scores(rf, cf, metric_queries.encoder(spark, sf), baseline=0.1).collect()}
    pairs = embed.sentence_pairs(rf, cf).select("run_id", "ref_no", "ref_sentence", "cand_sentence").collect()
    want = {}
    for p in pairs:
        sides = [[emb[(len(w) * 37 + ord(w[0]) * 11 + ord(w[-1])) % len(emb)] for w in p[c].lower().replace(".", " .").replace("?", " ?").split()]
                 for c in ("cand_sentence", "ref_sentence")]
        f1 = greedy(*sides)[2] if all(sides) else 0.0
        want.setdefault((p["run_id"], p["ref_no"]), []).append((f1 - 0.1) / 0.9)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert abs(got[k] - np.mean(v)) < 1e-6


def test_rouge_arrays_equal_counters(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefg")
    rows, want = [], {}
    for run in range(30):
        cand = [word() for _ in range(rng.randint(0, 12))]
        rows.append((run, None, cand))
        for k in rng.sample(range(4), rng.randint(0, 4)):
            ref = [word() for _ in range(rng.choice([0, 1, 9, 40]))]
            rows.append((run, k, ref))
            for n in (1, 2):
                grams = [Counter(zip(*[t[i:] for i in range(n)], strict=False)) for t in (cand, ref)]
                want[run, k, n] = (sum((grams[0] & grams[1]).values()), max(len(ref) - n + 1, 0), max(len(cand) - n + 1, 0))
    rows.append((99, 0, ["a"]))  # no candidate
    got = rouge.rouge_arrays(spark.createDataFrame(rows, "run_id int, ref_no int, t array<string>")).collect()
    assert {(r["run_id"], x["ref_no"], r["n"]): (x["o"], x["nr"], r["nc"]) for r in got for x in r["refs"]} == want


def test_rouge_plan_is_one_tagged_aggregation(spark, sf):
    plan = metric_queries.q_rouge_1(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("conversations.parquet") == 1
    full = metric_queries.q_rouge_1(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange hashpartitioning") <= 6


def test_lcs_with_few_rows_equals_the_full_table():
    rng = random.Random(2)

    def full(ref, can):
        t = [[0] * (len(can) + 1) for _ in range(len(ref) + 1)]
        for i, x in enumerate(ref, 1):
            for j, y in enumerate(can, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
        out, i, j = [], len(ref), len(can)
        while i and j:
            if ref[i - 1] == can[j - 1]:
                out.append(i - 1)
                i, j = i - 1, j - 1
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return out[::-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert rouge._lcs_indices(a, b) == full(a, b)


def test_slor_starts_no_job_while_it_is_built(spark, sf):
    runs, corpus = views.runs(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("slor-build", "building")
    try:
        built = lm.slor(runs, corpus.select("text"))
        assert list(tracker.getJobIdsForGroup("slor-build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    assert built.filter(F.col("slor").isNull()).count() == 0


def test_slor_hashes_one_key_per_bigram(spark):
    """A small case by hand, and a plan that does not sort the corpus' bigrams."""
    from math import log
    docs = ["the cat, the cat\n\nthe_dog 7", None, "", "été\u00a0the <s> cat"]
    texts = {1: "The cat\n\nthe  bird", 2: "", 3: None, 4: "the cat the cat ,\n<s>"}
    split = lambda x: ["<s>"] + re.findall(r"\w+|[^\w\s]", x.lower())
    lines = [split(x) for d in docs if d for x in d.split("\n") if x]
    uni = Counter(x for t in lines for x in t)
    bi = Counter(p for t in lines for p in zip(t, t[1:]))
    n, v = sum(uni.values()) - uni["<s>"], len(uni) - 1
    one = lambda a, b: log((bi[a, b] + 1) / (uni[a] + v)) - log((uni[b] + 1) / (n + v))
    want = {}
    for i, x in texts.items():
        per = [[one(*p) for p in zip(t, t[1:])] for t in map(split, (x or "").split("\n")) if len(t) > 1]
        if per:
            want[i] = sum(sum(g) / len(g) for g in per) / len(per)
    built = lm.slor(spark.createDataFrame([*texts.items()], "run_id long, prediction string"),
                    spark.createDataFrame([(d,) for d in docs], "text string"))
    got = {r["run_id"]: r["slor"] for r in built.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert "ShuffledHashJoin [pair" in built._jdf.queryExecution().executedPlan().toString()


def test_all_metrics_equal_their_own_operators(spark, sf):
    """One fused plan against each operator by itself, on truncated texts."""
    from precis.operators import entailment, fmt, grammar, hallucination, judge
    from precis.plans import evaluate as EV
    from precis.plans.io_queries import _all_inputs
    runs = views.runs(spark, sf)
    inp = _all_inputs(spark, sf, runs)
    out = {r["run_id"]: r for r in EV.evaluate(runs, None, inp).collect()}
    base = fmt.format_check(runs)
    assert set(out) == {r["run_id"] for r in runs.collect()}

    def same(df, **pairs):
        for r in df.collect():
            for mine, theirs in pairs.items():
                a, b = out[r["run_id"]][mine], r[theirs]
                assert (a is None and b is None) or np.allclose(a, b, atol=1e-9), (mine, r)

    refs = views.refs(spark, sf, runs)
    for n in (1, 2):
        same(rouge.multi_ref_scores(rouge.rouge_n(base, refs, ns=(n,))), **{f"rouge_{n}": "scores"})
    same(rouge.multi_ref_scores(rouge.rouge_lsum(base, refs)), rouge_L="scores")
    bert = embed.bert_scores(refs, base, metric_queries.encoder(spark, sf), 0.25)
    same(rouge.multi_ref_scores(bert, "bert_score"), bert_score="scores")
    same(hallucination.number_hallucinations(base, "text", "prediction"), number_hallucinations="number_hallucinations")
    probs = entailment.score_lines(entailment.entail_lines(base), entailment.length_scorer)
    same(entailment.entail_ratios(probs), contradiction_ratio="contradiction_ratio", neutral_contradiction_ratio="neutral_contradiction_ratio")
    same(lm.slor(base, inp.corpus), slor="slor")
    same(grammar.error_scores(grammar.line_scores(grammar.lines(base))), errors="errors", avg_error_count_score="avg_error_count_score")
    for m in ("fluency", "coherence", "consistency", "relevance"):
        same(judge.judge_score(inp.judge_replies.filter(F.col("metric") == m)), **{f"geval_{m}": "score"})
    # findings and probabilities as tables instead of rules and a scorer
    findings = spark.createDataFrame([(next(iter(out)), 0, "GRAMMAR")] * 2, "run_id long, line_no int, category string")
    tabled = EV.evaluate(runs, ["errors", "entailment"], EV.Inputs(nli=probs, findings=findings)).collect()
    assert all(r["errors"] == (2 if r["run_id"] == next(iter(out)) else 0) for r in tabled)
    assert all(abs(r["contradiction_ratio"] - out[r["run_id"]]["contradiction_ratio"]) < 1e-9 for r in tabled)


def test_ledger_resumes(spark, sf):
    """A run scored for another set is scored for the rest; a second call adds
    nothing; rows that two writers appended count once."""
    from precis.operators import entailment
    from precis.plans import evaluate as EV
    from precis.session import scratch_path
    runs, inp, path = views.runs(spark, sf), EV.Inputs(nli_scorer=entailment.length_scorer), scratch_path(spark, "t-ledger")
    n = runs.count()
    EV.reevaluate(runs.limit(5), path, ["errors"], inp)
    full = EV.reevaluate(runs, path, ["format", "errors", "entailment"], inp)
    assert full.count() == 3 * n
    written = spark.read.schema(EV.LEDGER).parquet(path)
    assert written.count() == 3 * n
    assert EV.reevaluate(runs, path, ["errors", "entailment"], inp).count() == 2 * n
    assert spark.read.schema(EV.LEDGER).parquet(path).count() == 3 * n
    written.limit(1).write.mode("append").partitionBy("metric").parquet(path)
    assert EV.read_ledger(spark, path).count() == 3 * n


def test_unknown_family_and_metric_are_errors(spark):
    import pytest
    from precis.plans import evaluate as EV
    runs = spark.createDataFrame([(1, "a", "b", "nope")], "run_id long, text string, prediction string, family string")
    with pytest.raises(ValueError):
        EV.evaluate(runs, ["bleu"])
    with pytest.raises(Exception, match="unknown modifier family: nope"):
        EV.evaluate_families(runs).collect()


def test_a_text_travels_once_for_each_cell_not_for_each_pair(spark):
    rng = np.random.default_rng(3)
    texts = {t: rng.normal(size=(20, 4)).round(1) for t in range(30)}
    rows = [(t, i, [float(x) for x in v]) for t, m in texts.items() for i, v in enumerate(m)]
    vecs = spark.createDataFrame(rows, "text_id int, vec_id int, embedding array<double>")
    pairs = spark.createDataFrame([(30 * c + r, c, r) for c in texts for r in texts], "pair_id int, cand_text int, ref_text int")
    blocks = embed.vector_blocks(vecs, block=200)
    cells = embed._cells(pairs, blocks, blocks, 200).cache()
    assert cells.count() == 900
    assert all(cells.select("bucket", "part", f"{s}_text").distinct().count() <= 30 * 5 for s in ("cand", "ref"))
    for r in embed.embedding_match(vecs, vecs, pairs, block=200).collect():
        assert np.allclose([r["p"], r["r"], r["f1"]], greedy(texts[r["pair_id"] // 30], texts[r["pair_id"] % 30]))


def _family_inputs(spark, sf):
    """Runs whose ids repeat within a family, between families and as null, with all inputs."""
    from precis.operators import entailment
    from precis.plans import evaluate as EV
    words = ["One two three.", "Two birds, 7 cats.\nThe cat sat", "the  cat ,sat. A b c", "", None]
    runs = spark.createDataFrame(
        [(i, words[i % 5], words[(i * 3 + 1) % 5], "abcd"[i % 4]) for i in range(12)]
        + [(2, "x 7", "Two cats sat.", "c"), (2, "x", "The birds", "c"), (2, "x", "a cat sat", "a"), (None, "x", "y", "a")],
        "run_id long, text string, prediction string, family string")
    refs = spark.createDataFrame([(i, k, f"The cat sat {i}. Two birds {k}.") for i in (0, 1, 2, 2, 3, 4, 6, 8, 40) for k in range(2)],
                                 "run_id int, ref_no int, reference string")
    replies = spark.createDataFrame([(i, m, k, str(1 + (i + k) % 5)) for i in range(11) for m in ("fluency", "relevance") for k in range(3)],
                                    "run_id long, metric string, choice_idx int, reply string")
    findings = spark.createDataFrame([(i, 0, "GRAMMAR") for i in (0, 1, 1, 2, 5)], "run_id long, line_no int, category string")
    inp = EV.Inputs(refs=refs, vectors=metric_queries.encoder(spark, sf), baseline=0.25, nli_scorer=entailment.length_scorer,
                    corpus=refs.select(F.col("reference").alias("text")), judge_replies=replies, judge_n=3, stem=False)
    nli = spark.createDataFrame([(i, k, 0.5, 0.3 * k, 0.2) for i in (0, 2, 3, 9) for k in range(3)],
                                "run_id long, line_no int, p_c double, p_n double, p_e double")
    return runs, inp, {"findings": findings, "nli": nli}


def test_families_equal_their_own_evaluations(spark, sf):
    """E19 by family: one plan for all families against a plan for each metric set."""
    from dataclasses import replace
    from precis.plans import evaluate as EV
    runs, inp, tables = _family_inputs(spark, sf)
    asked = {"a": ["rouge", "bert_score", "errors", "geval_fluency", "number_hallucination"], "c": ["geval_fluency", "rouge", "slor"],
             "b": ["format"], "d": ["entailment", "geval_relevance", "errors", "rouge", "bert_score"]}
    for given, table in ((inp, asked), (replace(inp, **tables), asked | {"b": asked["a"]}), (EV.Inputs(), asked)):
        got = EV.evaluate_families(runs, inputs=given, table=table)
        want = {}
        for metrics in {tuple(m) for m in table.values()}:
            mine = runs.filter(F.col("family").isin([f for f in table if tuple(table[f]) == metrics]))
            for r in EV.evaluate(mine, list(metrics), given).join(mine.select("run_id", "family"), "run_id").collect():
                want.setdefault((r["run_id"], r["family"]), []).append(r.asDict())
        assert [c for c in got.columns[2:]] == [*EV.FORMAT_COLUMNS, "prediction", *[c for m in EV.ALL_METRICS for c in EV.COLUMNS[m]
                                                if m in sum(table.values(), [])]]
        found = {}
        for r in got.collect():
            found.setdefault((r["run_id"], r["family"]), []).append(r.asDict())
        assert found.keys() == want.keys() and None not in {k[0] for k in found}
        for k, rows in want.items():
            plain = lambda r: str([(round(v, 9) if isinstance(v, float) else [round(x, 9) for x in v] if isinstance(v, list) else v)
                                   for v in (r.get(c) for c in got.columns)])
            assert sorted(map(plain, rows)) == sorted(map(plain, found[k])), k


def test_plan_does_not_grow_with_families(spark, sf):
    from precis.plans import evaluate as EV
    runs, inp, _ = _family_inputs(spark, sf)

    def exchanges(*dropped):  # families with a metric set each, all of which ask for what costs most
        table = {f: ["rouge", "bert_score", "geval_fluency", *(m for m in ("errors", "entailment", "geval_relevance") if m not in d)]
                 for f, d in zip("abcd", dropped, strict=True)}
        return EV.evaluate_families(runs, inputs=inp, table=table)._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    assert exchanges((), ("errors",), ("entailment",), ("geval_relevance",)) == exchanges((), (), (), ())

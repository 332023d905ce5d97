"""Analytics hand vectors, ordinals and partition invariance."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from precis.operators import analytics as A
from precis.plans import views
from precis.plans.ordinal import row_index


def test_success_rate_half_even(spark):
    rows = [("p", 1)] * 17 + [("p", 0)] * 13 + [("q", 1)] + [("q", 0)] * 7
    df = spark.createDataFrame(rows, "approach string, three_by_three int")
    got = {r["approach"]: r["success_rate"] for r in A.success_rate(df).collect()}
    assert got == {"p": 57.0, "q": 12.0}


def test_positional_pattern(spark):
    df = spark.createDataFrame([(0,), (53,), (54,)], "row_idx long")
    got = {r["row_idx"]: r["pattern"] for r in A.positional_pattern(df).collect()}
    assert got == {0: "base_prompt", 53: "init_topic", 54: ""}


def test_part_stats_modes(spark):
    text = " ".join(f"S{i}." for i in range(12))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    subs = A.part_stats(df, part="subheadings").first()
    assert subs["sent_count"] == 3
    fixed = A.part_stats(df, part="bullets").first()
    compat = A.part_stats(df, part="bullets", compat=True).first()
    assert fixed["sent_count"] == 9 and compat["sent_count"] == 9
    assert fixed["sent_lengths"] != compat["sent_lengths"]


def test_top1_ties_and_nan(spark):
    rows = [("a", "t", 1, 0.5), ("a", "t", 2, 0.5), ("a", "t", 3, float("nan")), ("a", "u", 4, None)]
    df = spark.createDataFrame(rows, "approach string, title string, run_id long, metric double")
    got = A.top1_per_group(df, ["approach", "title"], "metric").collect()
    assert [(r["title"], r["run_id"]) for r in got] == [("t", 1)]


def test_row_index_matches_window(spark, sf):
    s = views.scores(spark, sf).select("approach", "run_id", "metric")
    want = {(r["approach"], r["run_id"]): r["rn"] for r in s.withColumn(
        "rn", F.row_number().over(Window.partitionBy("approach").orderBy("run_id")) - 1).collect()}
    for parts in (1, 4, 13):
        got = {(r["approach"], r["run_id"]): r["idx"]
               for r in row_index(s, ["run_id"], ["approach"], partitions=parts).collect()}
        assert got == want


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "approach string, metric double")
    stats, outl = A.box_stats(df, "approach", "metric")
    r = stats.first()
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert r["upper_whisker"] == 4.0 and r["lower_whisker"] == 1.0
    assert [x["metric"] for x in outl.collect()] == [100.0]


def test_histogram_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "metric double")
    h = {r["bin"]: r["count"] for r in A.histogram(df, "metric").collect()}
    assert sum(h.values()) == 11 and h[9] == 2 and len(h) == 10


def test_quantiles_against_numpy(spark, sf):
    import numpy as np

    from precis.plans.quantiles import quantiles
    s = views.scores(spark, sf)
    values = {}
    for r in s.select("approach", "metric").collect():
        if r["metric"] is not None and r["metric"] == r["metric"]:
            values.setdefault(r["approach"], []).append(r["metric"])
    got = {r["approach"]: r["q"] for r in quantiles(s, "metric", ["approach"], [0.25, 0.5, 0.75]).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert np.allclose(got[k], np.quantile(v, [0.25, 0.5, 0.75]))
    every = [x for v in values.values() for x in v]
    assert abs(quantiles(s, "metric", [], [0.5]).first()["q"][0] - np.median(every)) < 1e-9


def test_verdict_vectors(spark):
    """Hand vectors: numbering from 1, one row per distinct prediction, unknown
    codes fail, scores are clipped by lo and hi only."""
    import pytest

    from precis.operators import analytics as A
    from precis.operators import judge
    df = spark.createDataFrame([("b", 2, 0.5), ("a", 1, 0.9), ("b", 3, 0.7)], "title string, run_id long, metric double")
    rows = [tuple(r) for r in A.title_difficulty(df, "metric").collect()]
    assert rows == [("2: b", 0.6), ("1: a", 0.9)]
    df = spark.createDataFrame([("x", "1\n2\n3\n4"), ("x", "1\n2\n3\n5"), ("x", "1\n2\n3\n5")], "g string, prediction string")
    assert [r["head"] for r in A.distinct_predictions(df, "g").collect()] == ["1\n2\n3"] * 2
    with pytest.raises(Exception, match="unknown metric"):
        A.metric_labels(spark.createDataFrame([("no such metric",)], "metric string")).collect()
    got = judge.with_scores(spark.createDataFrame([("50",), ("500",), ("-3",)], "reply string"), lo=1, hi=100)
    assert [r["score"] for r in got.collect()] == [50, 100, 1]


def test_sample_and_success_rate_partition_invariant(spark, sf):
    s = views.scores(spark, sf).select("run_id", "approach", "metric", "three_by_three")
    base = [r["run_id"] for r in A.sample_rows(s, k=5).collect()]
    rate = sorted(tuple(r) for r in A.success_rate(s).collect())
    for n in (1, 13):
        again = s.repartition(n)
        assert [r["run_id"] for r in A.sample_rows(again, k=5).collect()] == base
        assert sorted(tuple(r) for r in A.success_rate(again).collect()) == rate


def test_quantiles_of_a_hot_group_equal_numpy(spark):
    """Continuous values, a group with most rows, outliers, ties, infinities, a
    null group and groups of one."""
    import numpy as np
    from precis.plans import quantiles as Q
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=9000).tolist(), "far": [*rng.random(50).tolist(), 1e300, -1e300], "ties": [1.0] * 40 + [2.0] * 3,
              "one": [7.5], None: [3.0, 1.0, 2.0, 2.0], "inf": [1.0, 2.0, float("inf"), 4.0, float("-inf")], "tight": [1 + k * 2.0 ** -50 for k in range(9)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["g"]: (r["q"], r["n"]) for r in Q.quantiles(df, "v", ["g"], qs).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g][1] == len(vs)
        with np.errstate(invalid="ignore"):
            want = np.quantile(vs, qs)
        for a, b in zip(got[g][0], want, strict=True):
            assert a == b or abs(a - b) <= 1e-12 * max(1, abs(b)) or (np.isnan(b)), (g, a, b)


def test_building_a_report_starts_no_job(spark, sf):
    from precis.plans import analysis_queries  # noqa: F401
    from precis.plans.registry import QUERIES
    tracker = spark.sparkContext.statusTracker()
    for name in ("metric_series", "title_difficulty", "row_range", "distinct_titles", "box_stats", "control_vs_modifiers"):
        QUERIES[name](spark, sf)  # file listings and footers are cached
        group = f"build-{name}"
        spark.sparkContext.setJobGroup(group, "building")
        try:
            QUERIES[name](spark, sf)
            jobs = tracker.getJobIdsForGroup(group)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(jobs) <= 1, name  # the schema of the table


def test_distinct_predictions_query_covers_all_runs(spark, sf):
    from precis.plans import analysis_queries
    rows = analysis_queries.q_distinct_predictions(spark, sf).collect()
    assert {r["num_examples"] for r in rows} == {1, 2, 4, 8, 14}
    assert len(rows) == views.runs(spark, sf).selectExpr("cast(title as long) % 5 k", "prediction").distinct().count()


def test_doc_stats_tokenises_a_text_once(spark):
    from precis.functions.tokens import SENT_MARK
    texts = ["a b. c d! e_1 f", f"a{SENT_MARK}b c. a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = A.doc_stats(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(t") == 1  # the text with a mark only
    got = {r["doc_id"]: (r["word_count"], r["unique_words"], r["words_in_sents"]) for r in out.collect()}
    assert got[0] == (8, 8, [3, 3, 2]) and got[1] == (6, 5, [1, 3, 1]) and got[2] == (0, 0, [])

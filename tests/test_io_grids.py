"""Sources/sinks round trips, grids and the metric planner."""


from pyspark.sql import functions as F

from precis import schemas
from precis.operators import prompts as P
from precis.operators import responses as R
from precis.plans import evaluate as EV
from precis.plans import views
from precis.session import scratch_path
from precis.sources import files as IO


def test_gold_csv_round_trip_multiline(spark):
    rows = [("T1", "a,b", "d", "line one\nline two", "S1\r\nx", "s2", "s3", 'quote "q"')]
    df = spark.createDataFrame(rows, schemas.GOLD)
    path = scratch_path(spark, "t-gold")
    IO.write_gold(df, path)
    back = IO.read_gold(spark, path, clean=False).first()
    assert back["transcript"] == "line one\nline two" and back["summary4"] == 'quote "q"'
    assert back["references"] == ["S1\r\nx", "s2", "s3", 'quote "q"']


def test_append_corpus_dedups(spark):
    df = spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, title string")
    path = scratch_path(spark, "t-corpus")
    assert IO.append_corpus(df, path).count() == 2
    assert IO.append_corpus(df, path).count() == 0
    assert spark.read.parquet(path).count() == 2


def test_runs_csv_approach_from_path(spark, sf):
    r = views.runs(spark, sf).select("run_id", "approach")
    path = scratch_path(spark, "t-runs")
    r.write.option("header", True).partitionBy("approach").csv(path)
    back = IO.read_runs_csv(spark, path, schema=None)
    assert sorted(back.select("approach").distinct().toPandas()["approach"]) == \
        sorted(r.select("approach").distinct().toPandas()["approach"])


def test_conform_fills_defaults_and_drops_unknown(spark):
    df = spark.createDataFrame([(1, "p", 7)], "run_id long, prediction string, junk int")
    out = R.conform(df)
    assert out.columns == [f.name for f in schemas.RUN.fields]
    row = out.first()
    assert row["num_examples"] == 0 and row["rouge_1"] == [] and row["slor"] == 0.0


def test_export_markdown(spark):
    df = spark.createDataFrame([("T", "H1 \nb1\nb2\nb3\n H2")], "title string, prediction string")
    md = df.select(IO.export_markdown(df).alias("m")).first()["m"]
    assert md == "## T\n\n**H1**\n\n- b1\n- b2\n- b3\n\n**H2**\n"


def test_grids(spark):
    texts = spark.createDataFrame([(1, "x")], "run_id long, text string")
    g = P.modifier_grid(texts, "length", runs=3)
    assert g.count() == len(P.MODIFIERS["length"]) * 3
    a = P.approach_grid(texts, runs=2)
    assert a.count() == len(P.APPROACH_PLAN) * 2


def test_evaluate_truncates_before_metrics(spark):
    pred = "\n".join(f"line {i} has 3 cats" for i in range(14))
    runs = spark.createDataFrame([(1, "no numbers here", pred)], "run_id long, text string, prediction string")
    out = EV.evaluate(runs, ["number_hallucination", "errors"]).first()
    assert out["three_by_three"] == 0
    assert out["prediction"].count("\n") == 11
    # 12 kept lines, each with one unsupported digit "3" and line numbers
    assert out["number_hallucinations"] == 12 + 12


def test_attach_and_pending(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, prompt string")
    replies = spark.createDataFrame([(1, "r")], "run_id long, reply string")
    answered, pending = R.attach_responses(prompts, replies)
    assert answered.count() == 2 and [r["run_id"] for r in pending.collect()] == [2]


def test_fill_responses_bounded_retries(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, prompt string")

    def echo(ps):
        return [p.upper() for p in ps]

    def broken(ps):
        raise RuntimeError("down")

    got = {r["run_id"]: r["reply"] for r in R.fill_responses(prompts, echo).collect()}
    assert got == {1: "A", 2: "B"}
    lost = R.fill_responses(prompts, broken, max_retries=1).collect()
    assert all(r["reply"] is None and r["error"] == "RuntimeError: down" for r in lost)

    def picky(ps):
        if "b" in ps:
            raise ValueError("no b")
        return echo(ps)

    got = {r["run_id"]: (r["reply"], r["error"]) for r in R.fill_responses(prompts.coalesce(1), picky, max_retries=0).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no b")}


def test_evaluate_all_branches(spark, sf):
    from precis.operators import entailment
    from precis.session import table
    r = views.runs(spark, sf)
    refs = views.refs(spark, sf, r)
    tv = views.token_vecs(spark, sf)
    run_ids = [x["run_id"] for x in r.select("run_id").orderBy("run_id").limit(3).collect()]
    pairs = spark.createDataFrame([(i, rid, k, 0, 1) for i, rid in enumerate(run_ids) for k in range(2)],
                                  "pair_id long, run_id long, ref_no int, cand_text long, ref_text long")
    pairs = pairs.withColumn("pair_id", F.col("pair_id") * 2 + F.col("ref_no"))
    inp = EV.Inputs(refs=refs, ref_key="item_id", cand_vecs=tv, ref_vecs=tv, vec_pairs=pairs,
                    nli_scorer=entailment.length_scorer, corpus=table(spark, sf, "documents").select("text"))
    out = EV.evaluate(r, ["rouge", "bert_score", "number_hallucination", "entailment", "slor", "errors"], inp)
    row = out.filter(F.col("run_id") == run_ids[0]).first()
    assert len(row["rouge_1"]) == 4 and len(row["rouge_L"]) == 4 and len(row["bert_score"]) == 2
    assert row["slor"] is not None and row["errors"] is not None
    assert out.count() == r.count()


def test_run_csv_reads_only_the_asked_approaches(spark, sf):
    """A2: folders and flat files; arrays and structs come back; files of other
    approaches are not read."""
    from precis.plans.io_queries import _stored_runs
    runs = _stored_runs(spark, sf).withColumn("config", R.config_struct("m", stop=["x"]))
    path = scratch_path(spark, "t-runs-all")
    IO.write_runs_csv(runs, path)
    back = IO.read_runs_csv(spark, path)
    assert back.select(*runs.columns).dtypes == runs.dtypes
    key = lambda r: r["run_id"]
    empty = lambda r: {k: None if v == "" else v for k, v in r.asDict(True).items()}
    assert [empty(r) for r in sorted(back.select(*runs.columns).collect(), key=key)] == [empty(r) for r in sorted(runs.collect(), key=key)]
    one = back.filter(F.col("approach") == "a1")
    assert "approach" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    flat = scratch_path(spark, "t-runs-flat")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("a1", "a2"):
        found = [s.getPath() for s in fs.listStatus(jvm.Path(f"{path}/approach={name}")) if s.getPath().getName().startswith("part-")]
        fs.mkdirs(jvm.Path(f"{flat}/x"))
        for i, p in enumerate(found[:1]):
            fs.rename(p, jvm.Path(f"{flat}/x/{name}.csv"))
    got = IO.read_runs_csv(spark, flat, flat=True)
    assert {r["approach"] for r in got.select("approach").distinct().collect()} == {"a1", "a2"}
    assert got.filter(F.col("approach") == "a1").count() > 0
    for text, want in (("[0.5, 1]", [0.5, 1.0]), ("[]", []), ("", None), ("nope", None), (None, None)):
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(IO.parse_array_text(F.col("t")).alias("a")).first()["a"] == want
    df = spark.createDataFrame([("['a', 'b']",)], "t string")
    assert df.select(IO.parse_array_text(F.col("t"), "string").alias("a")).first()["a"] == ["a", "b"]


def test_gold_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    from precis import schemas
    from precis.sources import files as IO
    df = spark.range(2 * IO.GOLD_ROWS + 5).coalesce(1).select(*[F.concat(F.lit("a\nb "), F.col("id")).alias(f.name) for f in schemas.GOLD.fields])
    IO.write_gold(df, str(tmp_path / "gold"))
    assert len(list((tmp_path / "gold").glob("*.csv"))) == 3
    assert IO.read_gold(spark, str(tmp_path / "gold"), clean=False).count() == 2 * IO.GOLD_ROWS + 5

"""Stream = batch for the streaming operators; driver contract smoke."""


import __spark_entry__ as entry
from precis.plans import views
from precis.session import scratch_path
from precis.streaming import score as ST


def test_stream_score_equals_batch(spark, sf):
    runs = views.runs(spark, sf).select("run_id", "text", "prediction")
    src = scratch_path(spark, "t-stream")
    runs.repartition(3).write.parquet(src)
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    ST.stream_score(spark, src, sink, ckpt, runs.schema).awaitTermination()
    cols = ["run_id", "three_by_three", "long_bullets", "number_hallucinations", "errors"]
    streamed = sorted(tuple(r) for r in spark.read.parquet(sink).select(*cols).collect())
    batch = sorted(tuple(r) for r in ST.score_stateless(runs).select(*cols).collect())
    assert streamed == batch and len(batch) > 0


def test_leaderboard_batch_and_stream_agree(spark, sf):
    s = views.scores(spark, sf).select("run_id", "approach", "metric", "ts")
    batch = sorted((str(r["window"]["start"]), r["approach"], r["n"]) for r in
                   ST.leaderboard(s, watermark="365 days").collect())
    src = scratch_path(spark, "t-board-src")
    s.repartition(3).write.parquet(src)
    sink, ckpt = scratch_path(spark, "t-board"), scratch_path(spark, "t-board-ckpt")
    ST.stream_leaderboard(spark, src, sink, ckpt, s.schema, watermark="365 days").awaitTermination()
    streamed = sorted((str(r["window"]["start"]), r["approach"], r["n"]) for r in spark.read.parquet(sink).collect())
    assert streamed == batch


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "success_rate" in df.columns
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 100


def test_session_and_sliding_windows_stream_equals_batch(spark, sf):
    s = views.scores(spark, sf).select("run_id", "approach", "metric", "ts")
    for kw in ({"session_gap": "30 minutes"}, {"window": "1 day", "slide": "12 hours"}):
        batch = sorted((str(r["window"]["start"]), r["approach"], r["n"]) for r in
                       ST.leaderboard(s, watermark="365 days", **kw).collect())
        src = scratch_path(spark, "t-win-src")
        s.repartition(3).write.parquet(src)
        sink, ckpt = scratch_path(spark, "t-win"), scratch_path(spark, "t-win-ckpt")
        ST.stream_leaderboard(spark, src, sink, ckpt, s.schema, watermark="365 days", **kw).awaitTermination()
        streamed = sorted((str(r["window"]["start"]), r["approach"], r["n"])
                          for r in spark.read.parquet(sink).collect())
        assert streamed == batch and len(batch) > 0


def test_windows_leave_once_late_rows_are_counted_and_restarts_go_on(spark):
    """H2 in append mode, by hand: 10:00 and 10:20 are in; 11:30 closes the first
    windows; 10:05 comes too late; the stream restarts before every file."""
    schema = spark.createDataFrame([], "run_id long, approach string, metric double, ts timestamp").schema
    src, sink, ckpt = (scratch_path(spark, f"t-append-{x}") for x in ("in", "out", "ckpt"))
    spark.createDataFrame([], schema).write.parquet(src)
    got, late = [], 0
    steps = [[(1, "a", 1.0, "10:00"), (2, "a", 3.0, "10:20")], [(3, "b", 5.0, "11:30"), (4, "a", 7.0, "10:59")],
             [(5, "a", 9.0, "10:05"), (6, "b", 7.0, "11:45")], [(7, "z", 0.0, "23:00")]]
    for rows in steps:
        spark.createDataFrame([(i, a, m, f"2024-01-01 {t}:00") for i, a, m, t in rows], "run_id long, approach string, metric double, ts string") \
            .selectExpr("run_id", "approach", "metric", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(src)
        q = ST.stream_windows(spark, src, sink, ckpt, schema, window="30 minutes", watermark="10 minutes")
        q.awaitTermination()
        late += ST.late_rows(q)
        got.append(sorted((str(r["window"]["start"])[11:16], r["approach"], r["n"], r["mean"]) for r in spark.read.schema(
            "window struct<start:timestamp,end:timestamp>, approach string, n long, mean double").parquet(sink).collect()))
    assert got[0] == []
    # 10:59 came with 11:30, before the watermark moved
    assert got[1] == [("10:00", "a", 2, 2.0), ("10:30", "a", 1, 7.0)]
    assert got[2] == got[1] and late == 1
    assert got[3] == sorted([*got[1], ("11:30", "b", 2, 6.0)])

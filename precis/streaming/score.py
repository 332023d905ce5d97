"""Incremental scoring and leaderboards with Structured Streaming (H1-H3).

* H1 ``stream_score``: runs appended to a folder are scored as they
  arrive.  Only per-row (stateless) metrics run here: the format check,
  numeric hallucinations and the rule-based error score are all array
  expressions on the row, so the stream keeps no state; the sink is an
  append-only Parquet folder with a checkpoint (exactly-once).
* H2 ``stream_windows``: approach x window means in append mode.  A window
  leaves once, when the watermark has passed its end, and its state goes; rows
  later than the watermark are dropped and counted.  Tumbling, sliding or session
  windows.  ``stream_leaderboard`` keeps a whole board up to date instead, and
  with it the state of all its windows.
* H3 ``stream_dedup``: re-appended runs are dropped within the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.functions.tokens import word_tokens
from precis.operators import fmt, hallucination
from precis.operators.grammar import rule_errors


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def line_error_score(prediction: Column, rules=None) -> tuple[Column, Column]:
    """E14/E15 per row without a shuffle: mean over non-empty lines of
    1 - errors/tokens, and the total error count."""
    lines = F.split(prediction, "\n", -1)
    scored = F.transform(lines, lambda ln: F.struct(rule_errors(ln, rules).alias("e"),
                                                    F.size(word_tokens(ln)).alias("n")))
    valid = F.filter(scored, lambda s: s["n"] > 0)
    total = F.aggregate(valid, F.lit(0.0), lambda acc, s: acc + (F.lit(1.0) - s["e"] / s["n"]))
    avg = F.when(F.size(valid) > 0, total / F.size(valid))
    errors = F.aggregate(scored, F.lit(0), lambda acc, s: acc + s["e"])
    return avg, errors


def score_stateless(runs: DataFrame) -> DataFrame:
    """The per-row metrics shared by the batch and the streaming path."""
    checked = fmt.format_check(runs)
    scored = hallucination.number_hallucinations(checked, "text", "prediction")
    avg, errors = line_error_score(F.col("prediction"))
    return scored.withColumn("avg_error_count_score", avg).withColumn("errors", errors.cast("int"))


def stream_score(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType,
                 available_now: bool = True, max_files_per_trigger: int | None = None):
    """H1: start the scoring stream; returns the StreamingQuery."""
    out = score_stateless(read_stream(spark, source, schema, max_files_per_trigger))
    writer = out.writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(sink)


def leaderboard(events: DataFrame, ts: str = "ts", by: str = "approach", metric: str = "metric",
                window: str = "1 day", slide: str | None = None, session_gap: str | None = None,
                watermark: str = "1 hour") -> DataFrame:
    """H2 (works on batch and streaming frames): per window and group, the
    run count, mean and success rate of the metric."""
    t = F.col(ts).cast("timestamp")
    df = events.withColumn(ts, t).withWatermark(ts, watermark)
    if session_gap:
        w = F.session_window(ts, session_gap)
    else:
        w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return df.groupBy(w.alias("window"), by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"))


def stream_leaderboard(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType,
                       max_files_per_trigger: int | None = None, **kw):
    """H2 as a stream in complete mode; every micro-batch rewrites the
    (small: windows x groups) result table through foreachBatch."""
    board = leaderboard(read_stream(spark, source, schema, max_files_per_trigger), **kw)

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    return board.writeStream.outputMode("complete").option("checkpointLocation", checkpoint) \
        .foreachBatch(write).trigger(availableNow=True).start()


def stream_windows(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType,
                   max_files_per_trigger: int | None = None, available_now: bool = True, **kw):
    """H2 in append mode: every window is written once, when the watermark has
    passed its end, and then forgotten, so the state is bounded by the watermark
    and not by the history.  Started again with the same ``checkpoint``, it goes on
    where it stopped.  Sessions are merged inside each task before the shuffle, so
    that a hot group sends its sessions and not its rows."""
    merge = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(merge, "false")
    spark.conf.set(merge, "true")  # the query takes a copy of the settings when it starts
    try:
        board = leaderboard(read_stream(spark, source, schema, max_files_per_trigger), **kw)
        writer = board.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
        return writer.start(sink)
    finally:
        spark.conf.set(merge, before)


def late_rows(query) -> int:
    """Rows that the query's stateful operators dropped as later than the
    watermark, over the progress that the session keeps."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def dedup(events: DataFrame, key: str = "run_id", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """H3: drop re-appended rows (same key) within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark) \
        .dropDuplicatesWithinWatermark([key])


def stream_dedup(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType,
                 key: str = "run_id", ts: str = "ts", watermark: str = "1 hour",
                 max_files_per_trigger: int | None = None):
    out = dedup(read_stream(spark, source, schema, max_files_per_trigger), key, ts, watermark)
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start(sink)

"""Registered streaming queries (H1-H3).

Each query copies its derived input into a fresh folder under the shared
checkpoint location, runs the stream over it with ``availableNow``, waits for it
and returns the sink read back as a batch DataFrame.  Event-time queries get
their input in slices of time: after each one the stream is started again from
its checkpoint, so that state, watermark and restarts are all in play.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from precis.plans import views
from precis.plans.registry import register, rounded
from precis.session import scratch_path
from precis.streaming import score as ST


def _stage(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.schema


SLICES = 2


def _feed(df, name, start, again=lambda part: None):
    """Writes ``df`` in SLICES slices of its time ``ts``, then a row far in the
    future that closes every window; runs ``start(path)`` after each.  ``again``
    gives rows of a slice to append a second time."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    df.limit(0).write.parquet(path)
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / SLICES if first else None
    for k in range(SLICES if first else 0):
        lo, hi = first + k * step, first + (k + 1) * step
        part = df.filter((F.col("ts") >= F.lit(lo)) & ((F.col("ts") < F.lit(hi)) if k < SLICES - 1 else F.lit(True)))
        part.write.mode("append").parquet(path)
        start(path).awaitTermination()
        if (rows := again(part)) is not None:
            rows.write.mode("append").parquet(path)
            start(path).awaitTermination()
    end = spark.range(1).select(*[(F.lit("2999-01-01").cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name)
                                  for f in df.schema.fields])
    end.write.mode("append").parquet(path)
    start(path).awaitTermination()


def _stream_score_sql() -> str:
    from precis.functions.tokens import WORD_TOKEN
    from precis.operators import hallucination
    from precis.plans.io_queries import TRUNCATED_CTES
    from precis.plans.metric_queries import _sql_rule_errors
    return views.with_ctes(views.RUNS_SQL, body=TRUNCATED_CTES + f"""
, le AS (SELECT run_id, {_sql_rule_errors('line')} AS e,
                len(regexp_extract_all(line, '{WORD_TOKEN}')) AS n
         FROM (SELECT run_id, unnest(string_split(prediction, chr(10))) AS line FROM tr))
, agg AS (SELECT run_id, avg(CASE WHEN n > 0 THEN 1.0 - e / n END) AS s, CAST(sum(e) AS INTEGER) AS errors
          FROM le GROUP BY run_id)
SELECT tr.run_id, three_by_three, long_subheadings, long_bullets,
       {hallucination.sql_count('text', 'prediction')} AS number_hallucinations,
       round(agg.s, 6) AS avg_error_count_score, agg.errors
FROM tr JOIN agg USING (run_id)""")


@register("stream_score", sql=_stream_score_sql())
def q_stream_score(spark, sf):
    """H1: runs scored as they arrive (format, numeric hallucinations,
    error score); compared with the batch path in the tests."""
    src, schema = _stage(views.runs(spark, sf).select("run_id", "text", "prediction"), "stream-runs")
    sink, ckpt = scratch_path(spark, "scored"), scratch_path(spark, "scored-ckpt")
    q = ST.stream_score(spark, src, sink, ckpt, schema)
    q.awaitTermination()
    return rounded(spark.read.parquet(sink).select(
        "run_id", "three_by_three", "long_subheadings", "long_bullets", "number_hallucinations",
        "avg_error_count_score", "errors"))


def _windows(spark, sf, name, fmt="yyyy-MM-dd HH:mm:ss", **kw):
    scores = views.scores(spark, sf).select("run_id", "approach", "metric", "ts")
    sink, ckpt = scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")
    schema = scores.withColumn("ts", F.col("ts").cast("timestamp")).schema
    _feed(scores, f"{name}-in", lambda path: ST.stream_windows(spark, path, sink, ckpt, schema, **kw))
    return rounded(spark.read.parquet(sink).select(F.date_format("window.start", fmt).alias("window_start"), "approach", "n", "mean"))


@register("stream_leaderboard", sql=views.with_ctes(views.SCORES_SQL, body="""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, approach, count(*) AS n,
       round(avg(metric), 6) AS mean
FROM scores GROUP BY 1, 2"""))
def q_stream_leaderboard(spark, sf):
    """H2: daily approach means over the event stream, append mode."""
    return _windows(spark, sf, "board", window="1 day", watermark="1 hour")


@register("stream_sliding", sql=views.with_ctes(views.SCORES_SQL, body="""
, w AS (SELECT approach, metric, time_bucket(INTERVAL 12 HOURS, ts) - k.k * INTERVAL 12 HOURS AS start
        FROM scores, (SELECT unnest([0, 1]) AS k) k)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, approach, count(*) AS n, round(avg(metric), 6) AS mean
FROM w GROUP BY 1, 2"""))
def q_stream_sliding(spark, sf):
    """H2: daily means every 12 hours, append mode."""
    return _windows(spark, sf, "sliding", window="1 day", slide="12 hours", watermark="1 hour")


@register("stream_dedup", sql="SELECT event_id AS run_id FROM events")
def q_stream_dedup(spark, sf):
    """H3: after each slice of time its rows are appended again (a re-run);
    copies inside the watermark of an hour meet the state, older ones are late."""
    ev = views.scores(spark, sf).select("run_id", "ts")
    sink, ckpt = scratch_path(spark, "dedup"), scratch_path(spark, "dedup-ckpt")
    schema = ev.withColumn("ts", F.col("ts").cast("timestamp")).schema
    _feed(ev, "stream-dup", lambda path: ST.stream_dedup(spark, path, sink, ckpt, schema, watermark="1 hour"), again=lambda part: part)
    return spark.read.parquet(sink).filter("run_id is not null").select("run_id")


@register("stream_sessions", sql=views.with_ctes(views.SCORES_SQL, body="""
, o AS (SELECT approach, ts, metric,
               CASE WHEN lag(ts) OVER (PARTITION BY approach ORDER BY ts) IS NULL
                         OR ts >= lag(ts) OVER (PARTITION BY approach ORDER BY ts) + INTERVAL 30 MINUTE
                    THEN 1 ELSE 0 END AS brk
        FROM scores)
, g AS (SELECT *, sum(brk) OVER (PARTITION BY approach ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, approach, count(*) AS n,
       round(avg(metric), 6) AS mean
FROM g GROUP BY approach, sid"""))
def q_stream_sessions(spark, sf):
    """H2 with session windows (30-minute gap) over the event stream."""
    return _windows(spark, sf, "sessions", "yyyy-MM-dd HH:mm:ss.SSSSSS", session_gap="30 minutes", watermark="1 hour")

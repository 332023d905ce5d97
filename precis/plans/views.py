"""Derived views over the driver tables (FIXTURES.md "Derived views").

Each view is defined twice, once as a Spark DataFrame and once as a SQL
common-table expression for the DuckDB oracle; both must stay identical.
Views only add keys and relabel columns; they never subset rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.session import table

# The judge replies of the `responses` view, by (event_id*7+k) % 9.
FIXTURE_REPLIES = ["1", "2", "3.9", "4 good", "Score: 5", "10", "0", "bad", ""]
# Judge metric of a scores row, by event_id % 4.
FIXTURE_JUDGE_METRICS = ["fluency", "coherence", "consistency", "relevance"]
JUDGE_SAMPLES = 20
REFS_PER_RUN = 4
VECS_PER_TEXT = 16


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turn joined to the user turn before it; one run per reply."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role").isin("assistant", "user"))
    asked = F.col("role") == "user"
    # a reply and the turn before it meet under the reply's (conv_id, turn): one
    # aggregation instead of a self-join (the key is unique per role)
    met = conv.groupBy("conv_id", (F.col("turn") + asked.cast("int")).alias("turn")).agg(
        F.max(F.when(~asked, F.struct("text"))).alias("reply"), F.max(F.when(asked, F.struct("text"))).alias("ask"))
    return met.filter("reply is not null and ask is not null").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"),
        F.concat(F.lit("a"), (F.col("conv_id") % 5).cast("string")).alias("approach"),
        F.col("conv_id").cast("string").alias("title"),
        F.col("ask.text").alias("text"),
        F.col("reply.text").alias("prediction"),
    )


RUNS_SQL = """runs AS (
  SELECT a.conv_id * 1000 + a.turn AS run_id,
         'a' || CAST(a.conv_id % 5 AS VARCHAR) AS approach,
         CAST(a.conv_id AS VARCHAR) AS title,
         u.text AS text,
         a.text AS prediction
  FROM conversations a
  JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant' AND u.role = 'user'
)"""


def ref_keys(spark: SparkSession, sf_dir: str, run_df: DataFrame) -> DataFrame:
    """(run_id, ref_no, item_id): benchmark items (run_id + k) mod n_items."""
    n_items = table(spark, sf_dir, "benchmark").select(F.count(F.lit(1))).scalar()
    return run_df.select(
        "run_id", F.posexplode(F.sequence(F.lit(0), F.lit(REFS_PER_RUN - 1))).alias("ref_no", "k")
    ).select("run_id", "ref_no", ((F.col("run_id") + F.col("k")) % n_items).alias("item_id"))


def ref_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, reference): the texts that ``ref_keys`` names."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"))


def refs(spark: SparkSession, sf_dir: str, run_df: DataFrame | None = None) -> DataFrame:
    """Four references per run."""
    run_df = run_df if run_df is not None else runs(spark, sf_dir)
    # every item is referenced by many runs (hot keys): AQE broadcasts the item
    # table if it is small and splits skewed partitions otherwise
    joined = ref_keys(spark, sf_dir, run_df).join(ref_texts(spark, sf_dir), "item_id")
    return joined.select("run_id", "ref_no", "item_id", "reference")


REFS_SQL = """refs AS (
  SELECT r.run_id, CAST(k.k AS INTEGER) AS ref_no, b.item_id, b.text AS reference
  FROM runs r
  CROSS JOIN (SELECT unnest(range(0, 4)) AS k) k
  JOIN benchmark b ON b.item_id = (r.run_id + k.k) % (SELECT count(*) FROM benchmark)
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows derived from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("approach"),
        F.col("user_id").cast("string").alias("title"),
        F.col("value").alias("metric"),
        (F.col("event_id") % 2).cast("int").alias("three_by_three"),
        (F.col("event_id") % 4).cast("int").alias("errors"),
        (F.col("event_id") % 9).cast("int").alias("long_bullets"),
        (F.col("event_id") % 4).cast("int").alias("long_subheadings"),
        F.col("ts"),
        F.when(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.lit("initial"))
         .otherwise(F.lit("modifiers")).alias("experiment"),
    )


SCORES_SQL = """scores AS (
  SELECT event_id AS run_id, event_type AS approach, CAST(user_id AS VARCHAR) AS title,
         value AS metric,
         CAST(event_id % 2 AS INTEGER) AS three_by_three,
         CAST(event_id % 4 AS INTEGER) AS errors,
         CAST(event_id % 9 AS INTEGER) AS long_bullets,
         CAST(event_id % 4 AS INTEGER) AS long_subheadings,
         ts,
         CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'initial' ELSE 'modifiers' END AS experiment
  FROM events
)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human-rating stand-in: labels joined to documents, pattern = source."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_idx"),
        F.col("source").alias("pattern"),
        F.col("lang").alias("rater"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
    )


RATINGS_SQL = """ratings AS (
  SELECT l.doc_id AS row_idx, d.source AS pattern, d.lang AS rater,
         CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies: 20 per scores row; metric chosen by event_id % 4."""
    ev = table(spark, sf_dir, "events").select("event_id")
    replies = F.array(*[F.lit(r) for r in FIXTURE_REPLIES])
    metrics = F.array(*[F.lit(m) for m in FIXTURE_JUDGE_METRICS])
    return ev.select(
        F.col("event_id").alias("run_id"),
        F.element_at(metrics, (F.col("event_id") % 4 + 1).cast("int")).alias("metric"),
        F.explode(F.sequence(F.lit(0), F.lit(JUDGE_SAMPLES - 1))).alias("choice_idx"),
    ).select(
        "run_id", "metric", "choice_idx",
        F.element_at(replies, ((F.col("run_id") * 7 + F.col("choice_idx")) % 9 + 1).cast("int")).alias("reply"),
    )


RESPONSES_SQL = """responses AS (
  SELECT e.event_id AS run_id,
         (['fluency','coherence','consistency','relevance'])[(e.event_id % 4) + 1] AS metric,
         k.k AS choice_idx,
         (['1','2','3.9','4 good','Score: 5','10','0','bad',''])[((e.event_id * 7 + k.k) % 9) + 1] AS reply
  FROM events e CROSS JOIN (SELECT unnest(range(0, 20)) AS k) k
)"""


def run_responses(run_df: DataFrame) -> DataFrame:
    """Judge replies of the runs: 20 per (run, metric)."""
    replies = F.array(*[F.lit(r) for r in FIXTURE_REPLIES])
    metrics = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(x).alias("metric")) for i, x in enumerate(FIXTURE_JUDGE_METRICS)])
    return run_df.select("run_id", F.inline(metrics)).select(
        "run_id", "m", "metric", F.explode(F.sequence(F.lit(0), F.lit(JUDGE_SAMPLES - 1))).alias("choice_idx")).select(
        "run_id", "metric", "choice_idx",
        F.element_at(replies, ((F.col("run_id") * 7 + F.col("choice_idx") + F.col("m")) % 9 + 1).cast("int")).alias("reply"))


RUN_RESPONSES_SQL = """responses AS (
  SELECT r.run_id, (['fluency','coherence','consistency','relevance'])[m.m + 1] AS metric, k.k AS choice_idx,
         (['1','2','3.9','4 good','Score: 5','10','0','bad',''])[((r.run_id * 7 + k.k + m.m) % 9) + 1] AS reply
  FROM runs r CROSS JOIN (SELECT unnest(range(0, 20)) AS k) k CROSS JOIN (SELECT unnest(range(0, 4)) AS m) m
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate document d with the document before it as its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    src = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("source_text"))
    return docs.join(src, "doc_id").select(
        F.col("doc_id").alias("run_id"), "source_text", F.col("text").alias("candidate"))


PAIRS_SQL = """pairs AS (
  SELECT d.doc_id AS run_id, s.text AS source_text, d.text AS candidate
  FROM documents d JOIN documents s ON s.doc_id = d.doc_id - 1
)"""


def token_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors grouped into texts of at most 16 vectors."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        (F.col("vec_id") / VECS_PER_TEXT).cast("bigint").alias("text_id"),
        "vec_id", "embedding")


TOKEN_VECS_SQL = """token_vecs AS (
  SELECT vec_id // 16 AS text_id, vec_id, embedding FROM embeddings
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body

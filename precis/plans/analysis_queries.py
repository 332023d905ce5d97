"""Registered queries for experiment analytics.

Inputs are the derived views: ``scores`` (metric rows from events),
``runs`` (conversations), ``ratings`` (labels x documents) and documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from precis.functions import sql_text as S
from precis.functions import text as T
from precis.functions.tokens import WORD_TOKEN, sql_sentences
from precis.operators import analytics as A
from precis.operators import fmt
from precis.operators import prompts as P
from precis.plans import views
from precis.plans.metric_queries import FORMAT_SQL
from precis.plans.registry import register, rounded
from precis.session import table

SC = views.SCORES_SQL


def _w(*ctes, body):
    return views.with_ctes(*ctes, body=body)


@register("success_rate", sql=FORMAT_SQL + """
SELECT source, count(*) AS n_runs, CAST(sum(three_by_three) AS BIGINT) AS n_success,
       round_even(sum(three_by_three) * 100.0 / count(*), 0) AS success_rate,
       row_number() OVER (ORDER BY round_even(sum(three_by_three) * 100.0 / count(*), 0) DESC, source) AS rank
FROM h GROUP BY source
""")
def q_success_rate(spark, sf):
    """M0 flagship (F9): documents -> format check -> success rate per source."""
    docs = table(spark, sf, "documents").select("source", F.col("text").alias("prediction"))
    checked = fmt.format_check(docs, truncate=False).select("source", "three_by_three")
    return A.success_rate(checked, by="source")


@register("union_labelled", sql=_w(views.RUNS_SQL, SC, body="""
SELECT run_id, title, 'conversations' AS experiment FROM runs
UNION ALL SELECT run_id, title, 'events' AS experiment FROM scores"""))
def q_union_labelled(spark, sf):
    return A.union_labelled({
        "conversations": views.runs(spark, sf).select("run_id", "title"),
        "events": views.scores(spark, sf).select("run_id", "title")}, label="experiment")


@register("metric_summary", sql=_w(SC, body="""
SELECT approach, round(avg(metric), 6) AS mean, round(median(metric), 6) AS median,
       round(max(metric), 6) AS max, round(min(metric), 6) AS min, round(stddev_samp(metric), 6) AS std
FROM scores GROUP BY approach"""))
def q_metric_summary(spark, sf):
    return rounded(A.metric_summary(views.scores(spark, sf), "approach", "metric"))


def _box_sql(keys: str, src: str, metric: str, ctes: tuple) -> tuple[str, str]:
    base = _w(*ctes, body=f"""
, d AS (SELECT {keys}, {metric} AS v FROM {src} WHERE {metric} IS NOT NULL AND NOT isnan({metric}))
, q AS (SELECT {keys}, count(*) AS n, quantile_cont(v, [0.25, 0.5, 0.75]) AS qs FROM d GROUP BY {keys})
, f AS (SELECT {keys}, n, qs[1] AS q1, qs[2] AS median, qs[3] AS q3, qs[3] - qs[1] AS iqr,
               qs[1] - 1.5 * (qs[3] - qs[1]) AS lo_fence, qs[3] + 1.5 * (qs[3] - qs[1]) AS hi_fence FROM q)
, t AS (SELECT d.*, f.lo_fence, f.hi_fence FROM d JOIN f USING ({keys}))""")
    stats = base + f"""
SELECT f.{keys.replace(', ', ', f.')}, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(iqr, 6) AS iqr, round(f.lo_fence, 6) AS lo_fence, round(f.hi_fence, 6) AS hi_fence,
       round(w.lower_whisker, 6) AS lower_whisker, round(w.upper_whisker, 6) AS upper_whisker, w.n_outliers
FROM f JOIN (SELECT {keys}, min(v) FILTER (WHERE v BETWEEN lo_fence AND hi_fence) AS lower_whisker,
                    max(v) FILTER (WHERE v BETWEEN lo_fence AND hi_fence) AS upper_whisker,
                    count(*) FILTER (WHERE NOT (v BETWEEN lo_fence AND hi_fence)) AS n_outliers
             FROM t GROUP BY {keys}) w USING ({keys})"""
    outl = base + f"""
SELECT {keys}, round(v, 6) AS {metric} FROM t WHERE NOT (v BETWEEN lo_fence AND hi_fence)"""
    return stats, outl


_BOX1 = _box_sql("approach", "scores", "metric", (SC,))
_BOX2 = _box_sql("approach, three_by_three", "scores", "metric", (SC,))
_BOX3 = _box_sql("pattern, toxic", "ratings", "quality", (views.RATINGS_SQL,))


@register("box_stats", sql=_BOX1[0])
def q_box_stats(spark, sf):
    return rounded(A.box_stats(views.scores(spark, sf), "approach", "metric")[0])


@register("box_outliers", sql=_BOX1[1])
def q_box_outliers(spark, sf):
    return rounded(A.box_stats(views.scores(spark, sf), "approach", "metric")[1])


@register("grouped_box_stats", sql=_BOX2[0])
def q_grouped_box_stats(spark, sf):
    """by (pattern, with_modifiers) -> here (approach, three_by_three)."""
    return rounded(A.box_stats(views.scores(spark, sf), ["approach", "three_by_three"], "metric")[0])


@register("human_init_vs_mod", sql=_BOX3[0])
def q_human_init_vs_mod(spark, sf):
    """rating box stats by pattern, split by a binary label."""
    return rounded(A.box_stats(views.ratings(spark, sf), ["pattern", "toxic"], "quality")[0])


@register("describe_numeric", sql=_w(SC, body="""
, l AS (SELECT unnest(['metric', 'errors', 'long_bullets']) AS "column",
               unnest([metric, CAST(errors AS DOUBLE), CAST(long_bullets AS DOUBLE)]) AS v FROM scores)
SELECT "column", count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max
FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY "column\""""))
def q_describe_numeric(spark, sf):
    return rounded(A.describe_numeric(views.scores(spark, sf), ["metric", "errors", "long_bullets"]))


@register("histogram", sql=_w(SC, body="""
, b0 AS (SELECT approach, min(metric) AS lo0, max(metric) AS hi0 FROM scores GROUP BY approach)
, b AS (SELECT approach, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
               CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM b0)
, c AS (SELECT s.approach, CAST(least(floor((metric - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin, count(*) AS cnt
        FROM scores s JOIN b USING (approach) GROUP BY 1, 2)
, g AS (SELECT approach, lo, hi, CAST(unnest(range(0, 10)) AS INTEGER) AS bin FROM b)
SELECT g.approach, g.bin, round(lo + g.bin * (hi - lo) / 10, 6) AS bin_lo,
       round(CASE WHEN g.bin = 9 THEN hi ELSE lo + (g.bin + 1) * (hi - lo) / 10 END, 6) AS bin_hi,
       coalesce(cnt, 0) AS count
FROM g LEFT JOIN c ON c.approach = g.approach AND c.bin = g.bin"""))
def q_histogram(spark, sf):
    return rounded(A.histogram(views.scores(spark, sf), "metric", by="approach"))


@register("scatter_pairs", sql=_w(SC, body="SELECT run_id, metric AS x, errors AS y FROM scores"))
def q_scatter_pairs(spark, sf):
    return A.scatter_pairs(views.scores(spark, sf), "metric", "errors")


@register("metric_series", sql=_w(SC, body="""
SELECT approach, row_number() OVER (PARTITION BY approach ORDER BY run_id) - 1 AS idx, metric FROM scores"""))
def q_metric_series(spark, sf):
    return A.metric_series(views.scores(spark, sf), "approach", "metric")


_FORMATS = P.MODIFIERS["format"]


@register("success_rate_fixed_n", sql=_w(SC, body=f"""
, cat AS (SELECT unnest(l) AS modifier, generate_subscripts(l, 1) AS ord FROM (SELECT [{', '.join(S.q(m) for m in _FORMATS)}] AS l))
, s AS (SELECT ([{', '.join(S.q(m) for m in _FORMATS)}])[run_id % {len(_FORMATS) - 2} + 1] AS modifier, sum(three_by_three) AS k
        FROM scores GROUP BY 1)
, r AS (SELECT modifier, ord, CAST(coalesce(k, 0) AS BIGINT) AS n_success, round_even(coalesce(k, 0) * 100.0 / 30, 0) AS success_rate
        FROM cat LEFT JOIN s USING (modifier))
SELECT modifier, n_success, success_rate, row_number() OVER (ORDER BY success_rate DESC, ord) AS rank FROM r"""))
def q_success_rate_fixed_n(spark, sf):
    """the fixed list of format modifiers, two of them without runs, with
    the fixed denominator 30."""
    names = F.array(*[F.lit(m) for m in _FORMATS])
    s = views.scores(spark, sf).withColumn("modifier", F.element_at(names, (F.col("run_id") % (len(_FORMATS) - 2) + 1).cast("int")))
    return A.success_rate_fixed_n(s, _FORMATS, "modifier", n=30)


@register("execution_accuracy", sql=_w(SC, body="""
SELECT approach, round(avg(CASE WHEN three_by_three = 1 AND errors < 2 AND long_bullets > 3
                                 AND long_subheadings > 2 THEN 1.0 ELSE 0.0 END), 6) AS execution_accuracy
FROM scores GROUP BY approach"""))
def q_execution_accuracy(spark, sf):
    return rounded(A.execution_accuracy(views.scores(spark, sf)))


@register("top1_per_group", sql=_w(SC, body="""
SELECT approach, title, run_id, metric FROM (
  SELECT approach, title, run_id, metric,
         row_number() OVER (PARTITION BY approach, title ORDER BY metric DESC, run_id) AS rn
  FROM scores WHERE metric IS NOT NULL AND NOT isnan(metric)) WHERE rn = 1"""))
def q_top1_per_group(spark, sf):
    return A.top1_per_group(views.scores(spark, sf), ["approach", "title"], "metric")


@register("title_difficulty", sql=_w(SC, body="""
, p AS (SELECT title, avg(metric) AS m, min(run_id) AS first FROM scores GROUP BY title)
SELECT CAST(row_number() OVER (ORDER BY first) AS VARCHAR) || ': ' || title AS talk,
       CAST(round_even(CAST(round(m, 9) AS DECIMAL(38,9)), 3) AS DOUBLE) AS score FROM p"""))
def q_title_difficulty(spark, sf):
    return A.title_difficulty(views.scores(spark, sf), "metric")


_PATTERNS_SQL = "[" + ", ".join(f"'{p}'" for p in A.RATING_PATTERNS) + "]"


@register("positional_pattern", sql=_w(views.RATINGS_SQL, body=f"""
SELECT row_idx, CASE WHEN row_idx // 3 < {len(A.RATING_PATTERNS)} THEN {_PATTERNS_SQL}[row_idx // 3 + 1]
                     ELSE '' END AS pattern
FROM ratings"""))
def q_positional_pattern(spark, sf):
    return A.positional_pattern(views.ratings(spark, sf).select("row_idx")).select("row_idx", "pattern")


@register("filter_by_pattern", sql=_w(views.RATINGS_SQL, body="""
SELECT row_idx, pattern, quality FROM ratings
WHERE pattern IN (SELECT source FROM documents WHERE lang = 'en')"""))
def q_filter_by_pattern(spark, sf):
    """one semi join with the catalogue (sources of English documents)."""
    cat = table(spark, sf, "documents").filter(F.col("lang") == "en").select(F.col("source").alias("pattern"))
    return A.filter_by_catalogue(views.ratings(spark, sf), cat, "pattern").select("row_idx", "pattern", "quality")


@register("well_formed_filter", sql=_w(SC, body="""
SELECT run_id, approach, metric FROM scores WHERE three_by_three = 1"""))
def q_well_formed_filter(spark, sf):
    return A.well_formed(views.scores(spark, sf)).select("run_id", "approach", "metric")


@register("control_vs_modifiers", sql=_w(SC, body="""
, s AS (SELECT approach, avg(metric) AS mean, median(metric) AS median, max(metric) AS max,
               min(metric) AS min, stddev_samp(metric) AS std FROM scores GROUP BY approach)
SELECT approach, round(mean, 6) AS mean, round(median, 6) AS median, round(max, 6) AS max, round(min, 6) AS min,
       round(std, 6) AS std, approach = 'view' AS is_control,
       round(mean - (SELECT mean FROM s WHERE approach = 'view'), 6) AS delta_mean FROM s"""))
def q_control_vs_modifiers(spark, sf):
    """F17 with 'view' as the control group."""
    return rounded(A.control_vs_modifiers(views.scores(spark, sf), "approach", "metric", "view"))


@register("before_after", sql=_w(SC, body="""
, a AS (SELECT approach,
               avg(metric) FILTER (WHERE experiment = 'initial') AS metric_before,
               avg(metric) FILTER (WHERE experiment = 'modifiers') AS metric_after,
               avg(errors) FILTER (WHERE experiment = 'initial') AS errors_before,
               avg(errors) FILTER (WHERE experiment = 'modifiers') AS errors_after
        FROM scores GROUP BY approach)
SELECT approach, round(metric_before, 6) AS metric_before, round(metric_after, 6) AS metric_after,
       round(errors_before, 6) AS errors_before, round(errors_after, 6) AS errors_after,
       round(metric_after - metric_before, 6) AS metric_delta, round(errors_after - errors_before, 6) AS errors_delta
FROM a"""))
def q_before_after(spark, sf):
    return rounded(A.before_after(views.scores(spark, sf), "approach", "experiment", "initial", "modifiers",
                                  ["metric", "errors"]))


@register("distinct_predictions", sql=_w(views.RUNS_SQL, body="""
, n AS (SELECT ([1, 4, 8, 14, 2])[CAST(title AS BIGINT) % 5 + 1] AS num_examples, prediction FROM runs)
SELECT num_examples, array_to_string((string_split(prediction, chr(10)))[1:3], chr(10)) AS head
FROM (SELECT DISTINCT num_examples, prediction FROM n)"""))
def q_distinct_predictions(spark, sf):
    """F20 by number of examples, over all runs."""
    counts = F.array(*[F.lit(k) for k in (1, 4, 8, 14, 2)])
    runs = views.runs(spark, sf).withColumn("num_examples", F.element_at(counts, (F.col("title").cast("long") % 5 + 1).cast("int")))
    return A.distinct_predictions(runs, "num_examples")


@register("melt_summaries", sql="""
SELECT doc_id, 'lang' AS variable, lang AS value FROM documents
UNION ALL SELECT doc_id, 'source', source FROM documents
UNION ALL SELECT doc_id, 'text', text FROM documents""")
def q_melt_summaries(spark, sf):
    docs = table(spark, sf, "documents")
    return A.melt(docs, ["doc_id"], ["lang", "source", "text"])


def _sql_doc_stats(expr: str, key: str, src: str) -> str:
    toks = f"regexp_extract_all(t, '{WORD_TOKEN}')"
    sents = sql_sentences("t")
    return f"""
SELECT {key}, CAST(length(replace(t, ' ', '')) AS INTEGER) AS char_count,
       CAST(len({toks}) AS INTEGER) AS word_count, CAST(len({sents}) AS INTEGER) AS sent_count,
       CAST(len(list_distinct({toks})) AS INTEGER) AS unique_words,
       list_transform({sents}, lambda s: CAST(length(s) AS INTEGER)) AS sent_lengths,
       list_transform({sents}, lambda s: CAST(len(regexp_extract_all(s, '{WORD_TOKEN}')) AS INTEGER))
         AS words_in_sents
FROM (SELECT {key}, {expr} AS t FROM {src})"""


@register("doc_stats", sql=_sql_doc_stats(S.clean_transcript("text"), "doc_id", "documents"))
def q_doc_stats(spark, sf):
    """F22 on cleaned transcripts (C1 without NFKD)."""
    docs = table(spark, sf, "documents").select(
        "doc_id", T.clean_transcript(F.col("text"), normalize=False).alias("text"))
    return A.doc_stats(docs)


@register("part_stats", sql=_sql_doc_stats(
    f"array_to_string(list_filter({sql_sentences('text')}, lambda x, i: i <= 12 AND (i - 1) % 4 = 0), ' ')",
    "doc_id", "documents"))
def q_part_stats(spark, sf):
    """F23, subheadings mode (sentences 0, 4, 8)."""
    return A.part_stats(table(spark, sf, "documents").select("doc_id", "text"))


@register("part_stats_bullets", sql="SELECT *, false AS compat FROM (" + _sql_doc_stats(
    f"array_to_string(list_filter({sql_sentences('text')}, lambda x, i: i NOT IN (1, 5, 9)), ' ')", "doc_id", "documents")
    + ") UNION ALL SELECT *, true FROM (" + _sql_doc_stats(
    f"array_to_string(list_filter({sql_sentences('text')}, lambda x, i: i NOT IN (1, 6, 11)), ' ')", "doc_id", "documents") + ")")
def q_part_stats_bullets(spark, sf):
    """F23, bullet mode: without sentences 0, 4, 8, and in compat mode without
    0, 5, 10."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    fixed, compat = (A.part_stats(docs, part="bullets", compat=c).withColumn("compat", F.lit(c)) for c in (False, True))
    return fixed.unionByName(compat)


@register("corpus_vocabulary", sql=f"""
SELECT count(DISTINCT w) AS vocabulary FROM (SELECT unnest(regexp_extract_all(text, '{WORD_TOKEN}')) AS w
FROM documents)""")
def q_corpus_vocabulary(spark, sf):
    return A.corpus_vocabulary(table(spark, sf, "documents"))


@register("upload_timeline", sql="""
SELECT strftime(date_trunc('day', strptime(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ')), '%Y-%m-%d')
       AS day, count(*) AS count
FROM events GROUP BY 1""")
def q_upload_timeline(spark, sf):
    """ISO upload dates parsed and counted per day."""
    ev = table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("upload_date"))
    out = A.upload_timeline(ev, "upload_date")
    return out.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), "count")


@register("sample_rows", sql=_w(SC, body="""
SELECT run_id, approach, metric FROM scores
ORDER BY ((((run_id % 4294967296) + 4294967296) % 4294967296) * 40503 + 42) % 4294967296, run_id
LIMIT 5"""))
def q_sample_rows(spark, sf):
    """5 runs in seeded hash order (the limit is the feature)."""
    return A.sample_rows(views.scores(spark, sf).select("run_id", "approach", "metric"), k=5)


_LABELS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in A.METRIC_LABELS.items()) + "}"


@register("metric_labels", sql=_w(SC, body=f"""
, l AS (SELECT run_id, unnest(['three_by_three', 'errors', 'long_bullets', 'long_subheadings']) AS metric,
               unnest([three_by_three, errors, long_bullets, long_subheadings]) AS value FROM scores)
SELECT run_id, metric, value, element_at({_LABELS_SQL}, metric)[1] AS label FROM l"""))
def q_metric_labels(spark, sf):
    long = A.melt(views.scores(spark, sf), ["run_id"],
                  ["three_by_three", "errors", "long_bullets", "long_subheadings"], "metric", "value")
    return A.metric_labels(long)


@register("row_range", sql=_w(SC, body="""
SELECT approach, run_id, metric, idx FROM (
  SELECT approach, run_id, metric, row_number() OVER (PARTITION BY approach ORDER BY run_id) - 1 AS idx FROM scores)
WHERE idx BETWEEN 0 AND 4"""))
def q_row_range(spark, sf):
    """loc[0:4] (inclusive) per approach."""
    s = views.scores(spark, sf).select("approach", "run_id", "metric")
    return A.row_range(s, 0, 4, by="approach", inclusive=True)


@register("distinct_titles", sql=_w(SC, body="""
SELECT title, row_number() OVER (ORDER BY min(run_id)) - 1 AS idx FROM scores GROUP BY title"""))
def q_distinct_titles(spark, sf):
    return A.distinct_titles(views.scores(spark, sf))


@register("mean_metric", sql=_w(SC, body="SELECT round(avg(metric), 6) AS mean FROM scores"))
def q_mean_metric(spark, sf):
    return rounded(A.mean_metric(views.scores(spark, sf), "metric"))


@register("group_count", sql=_w(SC, body="SELECT experiment, count(*) AS n FROM scores GROUP BY experiment"))
def q_group_count(spark, sf):
    return A.group_count(views.scores(spark, sf), "experiment")

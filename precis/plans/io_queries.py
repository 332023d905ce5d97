"""Registered queries for sources/sinks (A1-A9), model outputs
and the metric planner (E19, E20).

Sink queries write a table derived from the driver tables into a fresh
folder under the shared checkpoint location and read it back, so the check
sees what a later job would read.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis import schemas
from precis.functions import sql_text as S
from precis.functions.tokens import WORD_TOKEN
from precis.operators import responses as R
from precis.operators import entailment, hallucination
from precis.plans import evaluate as EV
from precis.plans import views
from precis.plans.registry import register, rounded
from precis.plans.web_queries import SCRAPE_SQL, talk_pages
from precis.session import scratch_path, table
from precis.sources import files as IO
from precis.sources import web as W


@register("load_gold", sql=f"""
SELECT CAST(doc_id AS VARCHAR) AS title, source AS topic, {S.clean_summary('text')} AS transcript,
       {S.clean_summary('text')} AS summary, {S.clean_summary('lang')} AS summary2
FROM documents""")
def q_load_gold(spark, sf):
    """A1: documents written as a ";" gold CSV with quoted multi-line texts,
    read back with the gold loader (which cleans transcript and summaries)."""
    docs = table(spark, sf, "documents")
    gold = docs.select(F.col("doc_id").cast("string").alias("title"), F.col("source").alias("topic"),
                       F.col("lang").alias("description"), F.col("text").alias("transcript"),
                       F.col("text").alias("summary"), F.col("lang").alias("summary2"),
                       F.col("source").alias("summary3"), F.col("text").alias("summary4"))
    path = scratch_path(spark, "gold")
    IO.write_gold(gold, path)
    return IO.read_gold(spark, path).select("title", "topic", "transcript", "summary", "summary2")


_RUN_FIELDS = [f.name for f in schemas.RUN.fields if f.name != "config"]


def _stored_runs(spark, sf):
    """Run rows with every kind of column filled."""
    r = views.runs(spark, sf)
    tenth = lambda k: ((F.col("run_id") + k) % 10 / 10.0)
    return R.conform(r.withColumns({
        "experiment": F.lit("initial"), "rouge_1": F.array(*[tenth(k) for k in range(4)]), "bert_score": F.array(tenth(1)),
        "examples": F.array(F.array(F.lit('a "b", c'), F.col("title")), F.array(F.lit("d'e"))), "num_examples": F.lit(14),
        "prompt": F.concat(F.lit("Text: "), F.col("text")), "errors": (F.col("run_id") % 4).cast("int"), "slor": tenth(0)}))


_RUN_VALUES = {"experiment": "'initial'", "rouge_1": "[" + ", ".join(f"(run_id + {k}) % 10 / 10.0" for k in range(4)) + "]::DOUBLE[]",
               "bert_score": "[(run_id + 1) % 10 / 10.0]::DOUBLE[]", "examples": "[['a \"b\", c', title], ['d''e']]",
               "num_examples": "14", "prompt": "'Text: ' || text", "errors": "CAST(run_id % 4 AS INTEGER)",
               "slor": "(run_id % 10 / 10.0)::DOUBLE"}


def _sql_run_field(f) -> str:
    if f.name in ("run_id", "approach", "text", "title", "prediction"):
        return f.name
    if f.name in _RUN_VALUES:
        return f"{_RUN_VALUES[f.name]} AS {f.name}"
    default = schemas.RUN_DEFAULTS.get(f.name)
    # an empty string field of a CSV comes back as NULL
    value = {str: "NULL::VARCHAR", list: "[]::DOUBLE[]", int: str(default), float: f"{default}::DOUBLE"}.get(type(default), "NULL::VARCHAR")
    return f"{value} AS {f.name}"


@register("load_runs", sql=views.with_ctes(views.RUNS_SQL, body=f"""
SELECT {', '.join(_sql_run_field(f) for f in schemas.RUN.fields if f.name != 'config')} FROM runs WHERE approach IN ('a1', 'a3')"""))
def q_load_runs(spark, sf):
    """A2: run CSVs laid out per approach, every column of two approaches read
    back; the other approaches' files are not opened."""
    path = scratch_path(spark, "runs-csv")
    IO.write_runs_csv(_stored_runs(spark, sf), path)
    return IO.read_runs_csv(spark, path).filter(F.col("approach").isin("a1", "a3")).select(*_RUN_FIELDS)


@register("append_runs", sql=views.with_ctes(views.SCORES_SQL, body="""
SELECT approach, count(*) AS n FROM scores WHERE experiment = 'initial' GROUP BY approach"""))
def q_append_runs(spark, sf):
    """A3: append partitioned by (experiment, approach); the read prunes to
    one experiment by folder."""
    path = scratch_path(spark, "runs")
    IO.append_runs(views.scores(spark, sf).select("run_id", "approach", "experiment", "metric"), path)
    back = IO.read_runs(spark, path).filter(F.col("experiment") == "initial")
    return back.groupBy("approach").agg(F.count(F.lit(1)).alias("n"))


@register("append_corpus", sql=SCRAPE_SQL)
def q_append_corpus(spark, sf):
    """A4: corpus rows of all talk pages appended twice, the second time with
    a third of the pages first; nothing is stored twice."""
    corpus = W.extract_corpus(talk_pages(spark, sf).filter("html is not null"), unescape=W.html_unescape_basic)
    path = scratch_path(spark, "corpus")
    IO.append_corpus(corpus.filter("page_id % 3 = 0"), path, key="transcript_url")
    IO.append_corpus(corpus, path, key="transcript_url")
    return spark.read.parquet(path)


@register("append_url_list", sql=f"""
WITH l AS (SELECT regexp_extract_all(html, '(?s)<li[^>]*>\\s*<a[^>]*href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT replace(CASE WHEN starts_with(h, '/') THEN '{W.SITE}' || h ELSE h END, '?language=en', '')
       || '/transcript' AS value
FROM (SELECT unnest(hrefs) AS h FROM l)""")
def q_append_url_list(spark, sf):
    """A5: wanted transcript URLs appended as text lines and read back."""
    links = W.page_links(table(spark, sf, "pages"), "li", None).select(W.transcript_url(F.col("href")).alias("url"))
    path = scratch_path(spark, "urls")
    IO.append_url_list(links, path)
    return spark.read.text(path)


@register("run_row", sql=views.with_ctes(views.RUNS_SQL, body=f"""
SELECT run_id, CASE WHEN approach = 'a0' THEN 'text_completion' ELSE 'chat_completion' END AS kind,
       CASE WHEN approach = 'a0' THEN prediction ELSE {S.clean_prediction('prediction')} END AS prediction,
       'stop' AS finish_reason, 'gpt-3.5-turbo-16k' AS model, CAST(0.3 AS DOUBLE) AS temperature
FROM runs"""))
def q_run_row(spark, sf):
    """Responses -> run rows; chat replies cleaned, completions kept."""
    r = views.runs(spark, sf)
    resp = r.select("run_id", F.lit(0).alias("choice_idx"),
                    F.when(F.col("approach") == "a0", "text_completion").otherwise("chat_completion").alias("kind"),
                    F.col("prediction").alias("content"), F.lit("stop").alias("finish_reason"))
    rows = R.run_rows(r.select("run_id"), resp, R.config_struct("gpt-3.5-turbo-16k"))
    return rows.select("run_id", "kind", "prediction", "finish_reason",
                       F.col("config.model").alias("model"), F.col("config.temperature").alias("temperature"))


@register("conform_schema", sql=views.with_ctes(views.RUNS_SQL, body="""
SELECT run_id, approach, title, prediction, CAST(0 AS INTEGER) AS num_examples, CAST(0.0 AS DOUBLE) AS slor,
       CAST(0 AS INTEGER) AS errors, '' AS finish_reason, CAST(NULL AS VARCHAR) AS experiment FROM runs"""))
def q_conform_schema(spark, sf):
    """Runs conformed to the run-row schema (defaults filled, unknown
    columns dropped)."""
    c = R.conform(views.runs(spark, sf).withColumn("unknown_col", F.lit(1)))
    return c.select("run_id", "approach", "title", "prediction", "num_examples", "slor", "errors",
                    "finish_reason", "experiment")


@register("export_markdown", sql=views.with_ctes(views.RUNS_SQL, body=f"""
SELECT run_id, '## ' || title || array_to_string(list_transform(string_split(prediction, chr(10)),
       lambda line, i: CASE WHEN i IN (1, 5, 9) THEN chr(10) || chr(10) || '**' || {S.py_strip('line')} || '**' || chr(10)
                            ELSE chr(10) || '- ' || line END), '') AS markdown
FROM runs"""))
def q_export_markdown(spark, sf):
    """The markdown page of every run's summary."""
    r = views.runs(spark, sf)
    return r.select("run_id", IO.export_markdown(r).alias("markdown"))


@register("human_ratings_load", sql=views.with_ctes(views.RATINGS_SQL, body="""
SELECT row_idx AS "row", rater, quality AS oq, toxic AS gr FROM ratings"""))
def q_human_ratings_load(spark, sf):
    """One ";" file set per rater, concatenated, rater from the path."""
    rt = views.ratings(spark, sf).select(F.col("row_idx").alias("row"), "rater",
                                         F.col("quality").alias("oq"), F.col("toxic").alias("gr"))
    path = scratch_path(spark, "ratings")
    rt.write.option("sep", ";").option("header", True).partitionBy("rater").csv(path)
    return IO.read_ratings(spark, [path]).select("row", "rater", "oq", "gr")


_PROMPTS_SQL = """
WITH p AS (SELECT conv_id * 1000 + turn + 1 AS run_id, text FROM conversations WHERE role = 'user')
, r AS (SELECT conv_id * 1000 + turn AS run_id, text AS reply FROM conversations WHERE role = 'assistant')
"""


def _prompts_replies(spark, sf):
    conv = table(spark, sf, "conversations")
    prompts = conv.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("run_id"), "text")
    replies = conv.filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"), F.col("text").alias("reply"))
    return prompts, replies


@register("attach_responses", sql=_PROMPTS_SQL + """
SELECT p.run_id, r.reply IS NOT NULL AS answered, r.reply FROM p LEFT JOIN r USING (run_id)""")
def q_attach_responses(spark, sf):
    """G1: user turns as prompts, assistant turns as their responses."""
    prompts, replies = _prompts_replies(spark, sf)
    answered, _ = R.attach_responses(prompts, replies)
    return answered.select("run_id", F.col("reply").isNotNull().alias("answered"), "reply")


@register("pending_prompts", sql=_PROMPTS_SQL + """
SELECT run_id FROM p WHERE run_id NOT IN (SELECT run_id FROM r)""")
def q_pending_prompts(spark, sf):
    """G1: prompts still without a response (left anti)."""
    prompts, replies = _prompts_replies(spark, sf)
    return R.attach_responses(prompts, replies)[1].select("run_id")


@register("first_choice", sql=views.with_ctes(views.RESPONSES_SQL, body="""
SELECT run_id, metric, reply FROM responses WHERE choice_idx = 0"""))
def q_first_choice(spark, sf):
    """G2 (generation keeps choice 0)."""
    return R.first_choice(views.responses(spark, sf)).select("run_id", "metric", "reply")


@register("all_choices", sql=views.with_ctes(views.RESPONSES_SQL, body="""
SELECT run_id, metric, list(reply ORDER BY choice_idx) AS choices FROM responses GROUP BY run_id, metric"""))
def q_all_choices(spark, sf):
    """G2 (judging keeps all n choices, in order)."""
    return R.all_choices(views.responses(spark, sf), ("run_id", "metric"), col="reply")


TRUNCATED_CTES = """
, seg AS (SELECT run_id, text, prediction,
                 CASE WHEN len(string_split(prediction, '.')) = 12 THEN string_split(prediction, '.')
                      ELSE string_split(prediction, chr(10)) END AS s FROM runs)
, k AS (SELECT run_id, text, prediction, CAST(len(s) = 12 AS INTEGER) AS three_by_three, s[1:12] AS kept FROM seg)
, h AS (SELECT *, list_filter(kept, lambda x, i: (i - 1) % 4 = 0) AS subs FROM k)
, tr AS (SELECT run_id, text, three_by_three,
                CAST(len(list_filter(subs, lambda x: length(x) > 40)) AS INTEGER) AS long_subheadings,
                CAST(len(list_filter(kept, lambda x: NOT list_contains(subs, x) AND length(x) > 60)) AS INTEGER)
                  AS long_bullets,
                CASE WHEN three_by_three = 1 THEN prediction ELSE array_to_string(kept, chr(10)) END AS prediction
         FROM h)"""

def grammar_sql(line: str) -> str:
    from precis.plans.metric_queries import _sql_rule_errors
    return _sql_rule_errors(line)


_EVAL_SQL = views.with_ctes(views.RUNS_SQL, body=TRUNCATED_CTES + f"""
, lines AS (SELECT run_id, unnest(string_split(prediction, chr(10))) AS line FROM tr)
, ent AS (SELECT run_id,
            avg(CAST(pc >= pn AND pc >= pe AS DOUBLE)) AS contradiction_ratio,
            avg(CAST(pn > pc AND pn >= pe AND pc > pe AS DOUBLE)) AS neutral_contradiction_ratio
          FROM (SELECT run_id, (length(line) % 7) / ((length(line) % 7) + (length(line) % 5) + (length(line) % 3) + 1.0) AS pc,
                       (length(line) % 5) / ((length(line) % 7) + (length(line) % 5) + (length(line) % 3) + 1.0) AS pn,
                       ((length(line) % 3) + 1.0) / ((length(line) % 7) + (length(line) % 5) + (length(line) % 3) + 1.0) AS pe
                FROM lines) GROUP BY run_id)
SELECT tr.run_id, three_by_three, long_subheadings, long_bullets, prediction,
       {hallucination.sql_count('text', 'prediction')} AS number_hallucinations,
       round(contradiction_ratio, 6) AS contradiction_ratio,
       round(neutral_contradiction_ratio, 6) AS neutral_contradiction_ratio
FROM tr LEFT JOIN ent USING (run_id)""")


@register("metric_subset", sql=_EVAL_SQL)
def q_metric_subset(spark, sf):
    """Format check + truncation, then only the requested metrics
    (numeric hallucinations, entailment ratios) on the truncated text."""
    inp = EV.Inputs(nli_scorer=entailment.length_scorer)
    out = EV.evaluate(views.runs(spark, sf), ["format", "number_hallucination", "entailment"], inp)
    return rounded(out)


def _all_inputs(spark, sf, runs):
    from precis.plans.metric_queries import encoder
    return EV.Inputs(refs=views.ref_keys(spark, sf, runs), ref_key="item_id", ref_texts=views.ref_texts(spark, sf),
                     vectors=encoder(spark, sf), baseline=0.25, nli_scorer=entailment.length_scorer,
                     corpus=table(spark, sf, "documents").select("text"), judge_replies=views.run_responses(runs), stem=False)


def _rounded_all(df):
    return rounded(df.withColumns({c: F.transform(c, lambda x: F.round(x, 6)) for c in df.columns if c in EV.ARRAYS}))


@register("metric_all")
def q_metric_all(spark, sf):
    """All ten metrics of every run in one plan.  Every metric has its own
    checked query; the tests hold this one against them."""
    runs = views.runs(spark, sf)
    return _rounded_all(EV.evaluate(runs, None, _all_inputs(spark, sf, runs)))


_FAMILIES = list(EV.FAMILY_METRICS)


def _family_runs(spark, sf):
    names = F.array(*[F.lit(f) for f in _FAMILIES])
    return views.runs(spark, sf).withColumn("family", F.element_at(names, (F.col("run_id") % len(_FAMILIES) + 1).cast("int")))


def _sql_family(column: str) -> str:
    asks = [f for f, m in EV.FAMILY_METRICS.items() if any(column in EV.COLUMNS[x] for x in EV.checked(m))]
    listed = ", ".join(f"'{f}'" for f in asks)
    return f"count(*) FILTER (WHERE family IN ({listed or 'NULL'})) AS n_{column.lower()}"


_FAMILY_COLUMNS = [c for m in EV.ALL_METRICS for c in EV.COLUMNS[m] if c not in ("slor", "number_hallucinations")]


@register("family_metrics", sql=views.with_ctes(views.RUNS_SQL, body=f"""
, f AS (SELECT ([{', '.join(f"'{f}'" for f in _FAMILIES)}])[run_id % {len(_FAMILIES)} + 1] AS family FROM runs)
SELECT family, count(*) AS n_runs, {', '.join(map(_sql_family, _FAMILY_COLUMNS))} FROM f GROUP BY family"""))
def q_family_metrics(spark, sf):
    """E19 by modifier family: how many runs of each got each metric."""
    runs = _family_runs(spark, sf)
    out = EV.evaluate_families(runs, inputs=_all_inputs(spark, sf, runs))
    return out.groupBy("family").agg(F.count(F.lit(1)).alias("n_runs"), *[
        F.count(c).alias(f"n_{c.lower()}") for c in _FAMILY_COLUMNS])


@register("reevaluate", sql=_EVAL_SQL.replace("SELECT tr.run_id, three_by_three", ", ev AS (SELECT tr.run_id, three_by_three") + f""")
, er AS (SELECT run_id, {grammar_sql('line')} AS e, CAST(len(regexp_extract_all(line, '{WORD_TOKEN}')) AS INTEGER) AS n FROM lines)
, errs AS (SELECT run_id, round(avg(1.0 - e / (CASE WHEN n > 0 THEN n END)), 6) AS score, CAST(sum(e) AS DOUBLE) AS errors
           FROM er GROUP BY run_id)
SELECT run_id, 'number_hallucination' AS metric, 1::BIGINT AS times, CAST(number_hallucinations AS DOUBLE) AS first_score,
       CAST(NULL AS DOUBLE) AS second_score FROM ev
UNION ALL SELECT run_id, 'entailment', 1, contradiction_ratio, neutral_contradiction_ratio FROM ev
UNION ALL SELECT run_id, 'errors', 1, score, errors FROM errs""")
def q_reevaluate(spark, sf):
    """Half of the runs are scored for one metric, then all runs for three;
    the ledger has every (run, metric) once."""
    runs = views.runs(spark, sf)
    path = scratch_path(spark, "ledger")
    inp = EV.Inputs(nli_scorer=entailment.length_scorer)
    EV.reevaluate(runs.filter("run_id % 2 = 0"), path, ["number_hallucination"], inp)
    EV.reevaluate(runs, path, ["number_hallucination", "entailment", "errors"], inp)
    stored = spark.read.schema(EV.LEDGER).parquet(path)
    at = lambda c: F.max(F.col("scores")[c][0])
    return rounded(stored.groupBy("run_id", "metric").agg(
        F.count(F.lit(1)).alias("times"),
        F.coalesce(at("number_hallucinations"), at("contradiction_ratio"), at("avg_error_count_score")).alias("first_score"),
        F.coalesce(at("neutral_contradiction_ratio"), at("errors")).alias("second_score")))

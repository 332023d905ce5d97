"""Metric planning: evaluate a requested subset of metrics (E19) and
re-evaluate stored runs (E20).

The plan builds only what was asked for.  The format check (E1) always runs
first and truncates non-conforming predictions (E2), so every later metric sees
the truncated text.  Metrics that a row decides alone are columns of one
projection over it.  The others yield narrow rows (run_id, name, scores), whose
union goes through one aggregation and meets the base row in one join, however
many of them there are; texts never travel through that shuffle.

By modifier family (``evaluate_families``) every metric is built once too, over the
runs that ask for it, however many families there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.operators import embed, entailment, fmt, grammar, hallucination, judge, lm, rouge
from precis.session import stored

ALL_METRICS = ["rouge", "bert_score", "number_hallucination", "entailment", "slor", "errors",
               "geval_fluency", "geval_coherence", "geval_consistency", "geval_relevance"]

# Metrics of a modifier family's first run.
FAMILY_METRICS = {
    "format": ["format"],
    "denseness": ["format", "rouge", "bert_score", "errors", "entailment", "geval_fluency",
                  "geval_relevance", "geval_coherence", "geval_consistency"],
    "quality": ["entailment", "errors", "geval_fluency", "geval_coherence"],
    "structure": ["entailment", "errors", "geval_fluency", "geval_coherence"],
    "length": ["format", "errors"],
    "relevance": ["rouge", "bert_score", "entailment", "geval_relevance", "geval_consistency"],
}

# Metrics of a modifier family's re-evaluation.
FAMILY_REEVALUATION = {
    "format": [],
    "denseness": ["rouge", "bert_score", "errors", "entailment", "geval_fluency",
                  "geval_relevance", "geval_coherence", "geval_consistency"],
    "quality": ["geval_fluency"],
    "structure": ["geval_coherence"],
    "length": ["errors"],
    "relevance": ["geval_relevance"],
}

#: columns of each metric; the format check's are there for every run
COLUMNS = {
    "rouge": ["rouge_1", "rouge_2", "rouge_L"], "bert_score": ["bert_score"],
    "number_hallucination": ["number_hallucinations"],
    "entailment": ["contradiction_ratio", "neutral_contradiction_ratio"], "slor": ["slor"],
    "errors": ["avg_error_count_score", "errors"],
    **{f"geval_{m}": [f"geval_{m}"] for m in ("fluency", "coherence", "consistency", "relevance")},
}
FORMAT_COLUMNS = ["three_by_three", "long_subheadings", "long_bullets"]
ARRAYS = {"rouge_1", "rouge_2", "rouge_L", "bert_score"}
COUNTS = {"number_hallucinations", "errors", *FORMAT_COLUMNS}


@dataclass
class Inputs:
    """Side inputs of the metrics (each optional); a metric without its input
    has null columns."""
    refs: DataFrame | None = None            # (run_id, ref_no, reference or ref_key)
    ref_key: str | None = None                # refs column naming a shared reference (tokenised once)
    ref_texts: DataFrame | None = None        # (ref_key, reference)
    vectors: Callable[[DataFrame], DataFrame] | None = None  # encoder: (text_id, sentence) -> token vectors
    baseline: float | None = None             # of the rescaled embedding match
    ref_vecs: DataFrame | None = None         # or token vectors of references (text_id, vec_id, embedding),
    cand_vecs: DataFrame | None = None        # of candidates,
    vec_pairs: DataFrame | None = None        # and (pair_id, run_id, ref_no, cand_text, ref_text)
    nli_scorer: object = None                # Column fn (source, line) -> struct<p_c,p_n,p_e>
    nli: DataFrame | None = None              # (run_id, line_no, p_c, p_n, p_e)
    findings: DataFrame | None = None         # (run_id, line_no, category)
    rules: list | None = None
    corpus: DataFrame | None = None           # LM training texts (column text)
    judge_replies: DataFrame | None = None    # (run_id, metric, choice_idx, reply)
    judge_n: int = 20
    stem: bool = True


def _narrow(df: DataFrame, name: str | Column, scores: Column) -> DataFrame:
    named = F.lit(name) if isinstance(name, str) else name
    return df.select("run_id", named.alias("name"), scores.alias("scores"))


def _branches(cand: DataFrame, metrics: list[str], inp: Inputs) -> list[DataFrame]:
    """(run_id, name, scores) of the metrics that need more than a run's row."""
    out: list[DataFrame] = []
    if "rouge" in metrics and inp.refs is not None:
        rows = rouge.token_rows(cand, inp.refs, inp.stem, ref_key=inp.ref_key, ref_texts=inp.ref_texts)
        sc = rouge.rouge_score_arrays(rows, (1, 2))
        out.append(_narrow(sc, F.concat(F.lit("rouge_"), F.col("n").cast("string")), F.col("scores")))
        ls = rouge.multi_ref_scores(rouge.rouge_lsum(cand, inp.refs, inp.stem, ref_key=inp.ref_key, ref_texts=inp.ref_texts))
        out.append(_narrow(ls, "rouge_L", F.col("scores")))
    if "bert_score" in metrics:
        scored = None
        if inp.vectors is not None and inp.refs is not None:
            refs = inp.refs.join(inp.ref_texts, inp.ref_key) if inp.ref_texts is not None else inp.refs
            scored = embed.bert_scores(refs, cand, inp.vectors, inp.baseline)
        elif inp.vec_pairs is not None:
            m = embed.embedding_match(inp.cand_vecs, inp.ref_vecs, inp.vec_pairs, inp.baseline)
            scored = m.join(inp.vec_pairs.select("pair_id", "run_id", "ref_no"), "pair_id") \
                .groupBy("run_id", "ref_no").agg(F.avg("f1").alias("bert_score"))
        if scored is not None:
            out.append(_narrow(rouge.multi_ref_scores(scored, "bert_score"), "bert_score", F.col("scores")))
    if "entailment" in metrics and inp.nli is not None:
        both = entailment.entail_ratios(inp.nli)
        out += [_narrow(both, c, F.array(c)) for c in COLUMNS["entailment"]]
    if "errors" in metrics and inp.findings is not None:
        both = grammar.error_scores(grammar.line_scores(grammar.lines(cand), inp.rules, findings=inp.findings))
        out += [_narrow(both, c, F.array(F.col(c).cast("double"))) for c in COLUMNS["errors"]]
    if "slor" in metrics and inp.corpus is not None:
        out.append(_narrow(lm.slor(cand, inp.corpus), "slor", F.array("slor")))
    judged = [m for m in metrics if m.startswith("geval_")]
    if judged and inp.judge_replies is not None:
        js = judge.judge_score(inp.judge_replies.filter(F.col("metric").isin([m.split("_", 1)[1] for m in judged])), inp.judge_n)
        out.append(_narrow(js, F.concat(F.lit("geval_"), F.col("metric")), F.array(F.col("score").cast("double"))))
    return out


def checked(metrics: list[str] | None) -> list[str]:
    """The metrics besides the format check, in a fixed order; unknown names are
    an error before any job runs."""
    asked = ALL_METRICS if metrics is None else metrics
    unknown = [m for m in asked if m not in ALL_METRICS and m != "format"]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    return [m for m in ALL_METRICS if m in asked]


def _in_row(base: DataFrame, metrics: list[str], inp: Inputs,
            asks: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """``base`` with the metrics that a row decides alone, and their columns; with
    ``asks`` only in the rows that ask for the metric."""
    row: dict[str, Column] = {}
    only = lambda m, c: c if asks is None else F.when(asks[m], c)
    if "number_hallucination" in metrics:
        sides = {f"__{c}": only("number_hallucination", F.col(c)) for c in ("text", "prediction")}
        base = hallucination.number_hallucinations(base.withColumns(sides), *sides)
        row["number_hallucinations"] = only("number_hallucination", F.col("number_hallucinations"))
    if "entailment" in metrics and inp.nli is None and inp.nli_scorer is not None:
        base = base.withColumn("__nli", only("entailment", entailment.row_ratios(F.col("text"), F.col("prediction"), inp.nli_scorer)))
        row |= {c: F.col(f"__nli.{c}") for c in COLUMNS["entailment"]}
    if "errors" in metrics and inp.findings is None:
        base = base.withColumn("__err", only("errors", grammar.row_error_scores(F.col("prediction"), inp.rules)))
        row |= {c: F.col(f"__err.{c}") for c in COLUMNS["errors"]}
    return base, row


def evaluate(runs: DataFrame, metrics: list[str] | None = None, inputs: Inputs | None = None,
             with_runs: bool = False) -> DataFrame:
    """E19 -> (run_id, three_by_three, long_subheadings, long_bullets,
    prediction (truncated), + the columns of the requested metrics)."""
    metrics = checked(metrics)
    inp = inputs or Inputs()
    base, row = _in_row(fmt.format_check(runs.select("run_id", "text", "prediction")), metrics, inp)
    cand = base.select("run_id", "prediction")
    wanted = [c for m in metrics for c in COLUMNS[m]]
    out = base.select("run_id", *FORMAT_COLUMNS, "prediction", *[c.alias(n) for n, c in row.items()])
    branches = _branches(cand, metrics, inp)
    if branches:
        every = reduce(DataFrame.unionByName, branches)
        met = every.groupBy("run_id").agg(*[
            F.max(F.when(F.col("name") == c, F.col("scores"))).alias(c) for c in wanted if c not in row])
        out = out.join(met, "run_id", "left")
    missing = [c for c in wanted if c not in out.columns]
    out = out.withColumns({c: F.lit(None).cast("array<double>") for c in missing})
    out = out.select("run_id", *FORMAT_COLUMNS, "prediction", *[_typed(c, c in row) for c in wanted])
    if with_runs:
        out = runs.drop("prediction").join(out, "run_id")
    return out


def _typed(name: str, in_row: bool) -> Column:
    if in_row or name in ARRAYS:
        return F.col(name)
    one = F.col(name)[0]
    return (one.cast("int") if name in COUNTS else one).alias(name)


def _keyed(side: DataFrame | None, cand: DataFrame) -> DataFrame | None:
    """The rows of a side input (run_id, ...) of the runs of ``cand``, under its keys."""
    if side is None:
        return None
    keys = cand.select("run_id.run_id", F.col("run_id").alias("key")).groupBy("run_id").agg(F.collect_set("key").alias("keys"))
    return side.join(keys, "run_id").select(F.explode("keys").alias("run_id"), *[c for c in side.columns if c != "run_id"])


def _family_branches(base: DataFrame, asks: dict[str, list[int]], inp: Inputs) -> list[DataFrame]:
    """(run_id, asked, name, scores) of the metrics that need more than a run's row.
    Each is built once, over the runs of all metric sets that ask for it."""
    # scores of a run that its text does not change are found once for all sets
    tabled = [m for m in asks if m.startswith("geval_") or m == "entailment"
              or m == "bert_score" and (inp.vectors is None or inp.refs is None)]
    sets = {c: F.array(*map(F.lit, asks[m])) for m in tabled for c in COLUMNS[m]}
    which = F.coalesce(*[F.when(F.col("name") == c, s) for c, s in sets.items()]) if sets else None
    out = [b.select("run_id", F.explode(which).alias("asked"), "name", "scores") for b in _branches(base, tabled, inp)]
    for m in (m for m in asks if m not in tabled):
        cand = base.filter(F.col("asked").isin(asks[m])).select(F.struct("run_id", "asked").alias("run_id"), "prediction")
        keyed = replace(inp, refs=_keyed(inp.refs, cand), findings=_keyed(inp.findings, cand))
        out += [b.select("run_id.*", "name", "scores") for b in _branches(cand, [m], keyed)]
    return out


def evaluate_families(runs: DataFrame, family_col: str = "family", inputs: Inputs | None = None,
                      table: dict[str, list[str]] | None = None) -> DataFrame:
    """E19 by modifier family: every run gets the metrics of its family in
    ``table`` -> (run_id, family, format columns, prediction, all metric columns,
    null where the family does not ask for one).  Runs of a family without an entry
    are an error.

    A metric is built once for all families, so the plan does not grow with them.
    Families with the same metrics are one set; a run is scored by itself in each
    set it is in."""
    table = FAMILY_METRICS if table is None else table
    inp = inputs or Inputs()
    of = {family: tuple(checked(metrics)) for family, metrics in table.items()}
    sets = list(dict.fromkeys(of.values()))
    asks = {m: [i for i, s in enumerate(sets) if m in s] for m in ALL_METRICS if any(m in s for s in sets)}
    known = F.when(F.col(family_col).isin(*table), F.col(family_col)).otherwise(
        F.raise_error(F.concat(F.lit("unknown modifier family: "), F.coalesce(F.col(family_col), F.lit("null")))))
    number = F.coalesce(*[F.when(F.col("family").isin([f for f in of if of[f] == s]), F.lit(i)) for i, s in enumerate(sets)])
    # a run without an id meets no scores
    named = runs.filter(F.col("run_id").isNotNull()).withColumn("family", known).select(
        "run_id", "family", number.alias("asked"), "text", "prediction")
    base, row = _in_row(fmt.format_check(named), list(asks), inp, {m: F.col("asked").isin(s) for m, s in asks.items()})
    wanted = [c for m in asks for c in COLUMNS[m]]
    base = base.select("run_id", "family", "asked", *FORMAT_COLUMNS, "prediction", *[c.alias(n) for n, c in row.items()])
    if len(row) < len(wanted):
        base = stored(base, "runs")
    # runs of one id in one set share their families, as they do their scores
    mine = base.select("run_id", "asked", F.lit("family").alias("name"), "family")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [mine, *_family_branches(base, asks, inp)])
    scores = F.col("scores") if "scores" in every.columns else F.lit(None).cast("array<double>")
    met = every.groupBy("run_id", "asked").agg(F.collect_list("family").alias("families"), *[
        F.max(F.when(F.col("name") == c, scores)).alias(c) for c in wanted if c not in row])
    out = base.drop("family").join(met, ["run_id", "asked"])
    return out.select("run_id", F.explode("families").alias("family"), *FORMAT_COLUMNS, "prediction",
                      *[_typed(c, c in row) for c in wanted])


# ------------------------------------------------------------------ E20

LEDGER = "run_id long, metric string, scores map<string,array<double>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Scores by (run_id, metric), an empty table where nothing was written yet.
    A row is both the scores and the mark that they are there, so a write that
    was cut off leaves no mark without scores.  Rows that two writers appended for
    one key count once."""
    empty = spark.createDataFrame([], LEDGER)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return empty
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["run_id", "metric"])


def pending(runs: DataFrame, ledger: DataFrame, metric: str) -> DataFrame:
    """Runs that have no scores of ``metric`` in the ledger."""
    return runs.join(ledger.filter(F.col("metric") == metric).select("run_id"), "run_id", "left_anti")


def reevaluate(runs: DataFrame, path: str, metrics: list[str], inputs: Inputs | None = None) -> DataFrame:
    """Scores every run for those of ``metrics`` that the ledger at ``path``
    lacks, appends them, and returns the ledger's rows for these runs and metrics
    (run_id, metric, scores).

    A run scored for other metrics is scored for the missing ones only; one that
    is complete is not read again.  Metrics that lack the same runs are not told
    apart beforehand: each is anti-joined by itself and all are appended in one
    job, which can be repeated after a failure.  ``format`` is a metric here."""
    spark = runs.sparkSession
    ledger = read_ledger(spark, path)
    asked = (["format"] if "format" in metrics else []) + checked(metrics)

    def rows(metric: str) -> DataFrame:
        todo = pending(runs, ledger, metric)
        scored = evaluate(todo, [metric], inputs)
        names = FORMAT_COLUMNS if metric == "format" else COLUMNS[metric]
        scores = F.create_map(*[x for c in names for x in (
            F.lit(c), F.col(c) if c in ARRAYS else F.array(F.col(c).cast("double")))])
        return scored.select("run_id", F.lit(metric).alias("metric"), scores.alias("scores"))

    if asked:
        reduce(DataFrame.unionByName, map(rows, asked)).write.mode("append").partitionBy("metric").parquet(path)
    return read_ledger(spark, path).filter(F.col("metric").isin(asked)).join(runs.select("run_id"), "run_id", "left_semi")

"""Model outputs as tables: run rows (A6), schema conformance (A7),
attaching responses to prompts (G1) and choice selection (G2).

The model is not called here.  A caller who wants to fill responses from
inside Spark passes a function to ``fill_responses``: it runs per partition
through ``mapInPandas`` (client set up once per partition) with a bounded
number of retries, instead of the reference's endless retry loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis import schemas
from precis.functions.text import clean_prediction


def config_struct(model: str, temperature: float = 0.3, top_p: float = 1.0, n: int = 1,
                  suffix: str | None = None, stop: list[str] | None = None) -> Column:
    return F.struct(F.lit(model).alias("model"), F.lit(suffix).cast("string").alias("suffix"),
                    F.lit(float(temperature)).alias("temperature"), F.lit(float(top_p)).alias("top_p"),
                    F.lit(n).alias("n"),
                    (F.array(*[F.lit(s) for s in stop]) if stop else F.lit(None).cast("array<string>"))
                    .alias("stop"))


def run_rows(prompts: DataFrame, responses: DataFrame, config: Column | None = None,
             template_col: str = "prompt_template") -> DataFrame:
    """Prompt rows + their first choice -> run rows.  Chat predictions
    are cleaned (C8); text completions are kept as returned."""
    first = responses.filter(F.col("choice_idx") == 0).select(
        "run_id", "kind", F.col("content").alias("__raw"), "finish_reason")
    j = prompts.join(first, "run_id")
    pred = F.when(F.col("kind") == "text_completion", F.col("__raw")).otherwise(clean_prediction(F.col("__raw")))
    out = j.withColumn("prediction", pred).drop("__raw")
    if config is not None:
        out = out.withColumn("config", config)
    return out


def conform(df: DataFrame, schema: T.StructType = schemas.RUN, defaults: dict | None = None) -> DataFrame:
    """Keep the schema's fields in its order, fill missing ones with
    their default (else NULL), drop unknown columns, cast to the field type."""
    defaults = schemas.RUN_DEFAULTS if defaults is None else defaults
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f.name)
        elif f.name in defaults:
            d = defaults[f.name]
            c = F.array().cast(f.dataType) if isinstance(d, list) and not d else F.lit(d)
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def attach_responses(prompts: DataFrame, responses: DataFrame, key: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """G1: (prompts with their responses, prompts still unanswered)."""
    answered = prompts.join(responses, key, "left")
    pending = prompts.join(responses.select(key).distinct(), key, "left_anti")
    return answered, pending


def first_choice(responses: DataFrame) -> DataFrame:
    """G2 for generation: choice 0 only."""
    return responses.filter(F.col("choice_idx") == 0)


def all_choices(responses: DataFrame, keys: tuple[str, ...] = ("run_id",), col: str = "content") -> DataFrame:
    """G2 for judging: every choice of a request in choice order (bounded by
    the request's n)."""
    return responses.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("choice_idx", col))), lambda s: s[col]).alias("choices"))


def fill_responses(prompts: DataFrame, call: Callable[[list[str]], list[str]], prompt_col: str = "prompt",
                   max_retries: int = 3, setup: Callable[[], object] | None = None) -> DataFrame:
    """G1 with a caller-supplied model function ``call(prompts) -> replies``
    (batched).  Runs per partition; failures are retried ``max_retries``
    times, then the batch's prompts are sent one by one.  A prompt that still
    fails gets a NULL reply (listed as pending by ``attach_responses``) and its
    last error's text in ``error``, which is NULL otherwise."""
    schema = T.StructType(prompts.schema.fields + [T.StructField("reply", T.StringType()),
                                                   T.StructField("error", T.StringType())])

    def attempt(texts: list[str]) -> tuple[list[str] | None, str | None]:
        error = None
        for _ in range(max_retries + 1):
            try:
                replies = list(call(texts))
                if len(replies) != len(texts):
                    raise ValueError(f"{len(replies)} replies to {len(texts)} prompts")
                return replies, None
            except Exception as e:  # noqa: BLE001 - caller's client errors
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if setup is not None:
            setup()
        for pdf in batches:
            texts = pdf[prompt_col].tolist()
            replies, _ = attempt(texts)
            errors: list[str | None] = [None] * len(texts)
            if replies is None:
                single = [attempt([t]) for t in texts]
                replies = [r[0] if r is not None else None for r, _ in single]
                errors = [e for _, e in single]
            pdf = pdf.copy()
            pdf["reply"], pdf["error"] = replies, errors
            yield pdf

    return prompts.mapInPandas(run, schema)



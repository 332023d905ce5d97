"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, L = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType()

CONFIG = T.StructType([
    T.StructField("model", S), T.StructField("suffix", S), T.StructField("temperature", D),
    T.StructField("top_p", D), T.StructField("n", I), T.StructField("stop", T.ArrayType(S)),
])

# The run / metric row, in CSV column order, plus explicit keys.
RUN = T.StructType([
    T.StructField("run_id", L), T.StructField("approach", S), T.StructField("experiment", S),
    T.StructField("prompt_template", S), T.StructField("examples", T.ArrayType(T.ArrayType(S))),
    T.StructField("num_examples", I), T.StructField("text", S), T.StructField("title", S),
    T.StructField("prompt", S), T.StructField("prediction", S), T.StructField("finish_reason", S),
    T.StructField("bert_score", T.ArrayType(D)), T.StructField("rouge_1", T.ArrayType(D)),
    T.StructField("rouge_2", T.ArrayType(D)), T.StructField("rouge_L", T.ArrayType(D)),
    T.StructField("slor", D), T.StructField("avg_error_count_score", D), T.StructField("errors", I),
    T.StructField("contradiction_ratio", D), T.StructField("neutral_contradiction_ratio", D),
    T.StructField("number_hallucinations", I), T.StructField("three_by_three", I),
    T.StructField("long_subheadings", I), T.StructField("long_bullets", I),
    T.StructField("geval_fluency", D), T.StructField("geval_relevance", D),
    T.StructField("geval_coherence", D), T.StructField("geval_consistency", D),
    T.StructField("config", CONFIG),
])

# Defaults of the run row (fields not listed default to NULL).
RUN_DEFAULTS = {
    "examples": [], "num_examples": 0, "text": "", "title": "", "finish_reason": "",
    "bert_score": [], "rouge_1": [], "rouge_2": [], "rouge_L": [], "slor": 0.0,
    "avg_error_count_score": 0.0, "errors": 0, "contradiction_ratio": 0.0,
    "neutral_contradiction_ratio": 0.0, "number_hallucinations": 0, "three_by_three": 0,
    "long_subheadings": 0, "long_bullets": 0, "geval_fluency": 0.0, "geval_relevance": 0.0,
    "geval_coherence": 0.0, "geval_consistency": 0.0,
}

GOLD = T.StructType([T.StructField(n, S) for n in (
    "title", "topic", "description", "transcript", "summary", "summary2", "summary3", "summary4")])

CORPUS = T.StructType([T.StructField(n, S) for n in (
    "title", "topics", "speaker", "description", "transcript", "duration", "upload_date")])

RATING_METRICS = ["oq", "gr", "nr", "rc", "fo", "sc", "su", "si"]
RATINGS = T.StructType([T.StructField(m, D) for m in RATING_METRICS])

"""Registered queries for text normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from precis.functions import sql_text as S
from precis.functions import text as T
from precis.functions import tokens as K
from precis.plans import views
from precis.plans.registry import register
from precis.session import table


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _per_line(col, fn):
    return F.array_join(F.transform(F.split(col, "\n", -1), fn), "\n")


@register("clean_transcript",
          sql=f"SELECT doc_id, {S.clean_transcript('text')} AS transcript FROM documents")
def q_clean_transcript(spark, sf):
    """C1 without NFKD (DuckDB has no NFKD); the NFKD variant is below."""
    return _docs(spark, sf).select("doc_id", T.clean_transcript(F.col("text"), normalize=False)
                                   .alias("transcript"))


@register("clean_transcript_nfkd")
def q_clean_transcript_nfkd(spark, sf):
    """C1 with Unicode NFKD through an Arrow-batched function."""
    return _docs(spark, sf).select("doc_id", T.clean_transcript(F.col("text")).alias("transcript"))


@register("clean_summary", sql=f"SELECT doc_id, {S.clean_summary('text')} AS summary FROM documents")
def q_clean_summary(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_summary(F.col("text")).alias("summary"))


@register("remove_empty_lines",
          sql=f"SELECT doc_id, {S.remove_empty_lines('text')} AS text FROM documents")
def q_remove_empty_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", T.remove_empty_lines(F.col("text")).alias("text"))


@register("note_line", sql=f"""
SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: {S.is_note_line('x')})) AS INTEGER)
       AS note_lines
FROM documents""")
def q_note_line(spark, sf):
    return _docs(spark, sf).select(
        "doc_id",
        F.size(F.filter(F.split("text", "\n", -1), T.is_note_line)).cast("int").alias("note_lines"))


@register("strip_prefix_words",
          sql=f"SELECT doc_id, {S.per_line('text', S.strip_prefix_words)} AS text FROM documents")
def q_strip_prefix_words(spark, sf):
    lines = F.split("text", "\n", -1)
    return _docs(spark, sf).select("doc_id", F.array_join(T.prefix_stripped_lines(lines), "\n").alias("text"))


@register("strip_line", sql=f"SELECT doc_id, {S.per_line('text', S.strip_line)} AS text FROM documents")
def q_strip_line(spark, sf):
    lines = F.split("text", "\n", -1)
    return _docs(spark, sf).select("doc_id", F.array_join(T.stripped_lines(lines, suffix=False), "\n")
                                   .alias("text"))


@register("strip_suffix", sql=f"SELECT doc_id, {S.per_line('text', S.strip_suffix)} AS text FROM documents")
def q_strip_suffix(spark, sf):
    return _docs(spark, sf).select("doc_id", _per_line("text", T.strip_suffix).alias("text"))


@register("clean_prediction", sql=views.with_ctes(views.RUNS_SQL, body=f"""
SELECT run_id, {S.clean_prediction('prediction')} AS prediction FROM runs"""))
def q_clean_prediction(spark, sf):
    return views.runs(spark, sf).select("run_id", T.clean_prediction(F.col("prediction")).alias("prediction"))


@register("rouge_preprocess", sql=views.with_ctes(views.RUNS_SQL, body=f"""
SELECT run_id, {K.sql_rouge_preprocess('prediction')} AS processed FROM runs"""))
def q_rouge_preprocess(spark, sf):
    return views.runs(spark, sf).select("run_id", K.rouge_preprocess(F.col("prediction")).alias("processed"))


@register("short_label", sql=f"""
SELECT conv_id, turn, {S.short_label('text')} AS label FROM conversations""")
def q_short_label(spark, sf):
    conv = table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", T.short_label(F.col("text")).alias("label"))


@register("dialogue_text", sql="""
SELECT conv_id, string_agg(role || ':' || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS dialogue
FROM conversations GROUP BY conv_id""")
def q_dialogue_text(spark, sf):
    """C13 from turn rows: one ordered aggregation per conversation (the
    output row is the whole dialogue, so the group is the result itself)."""
    conv = table(spark, sf, "conversations")
    msgs = conv.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.col("role"), F.col("text").alias("content"))))
        .alias("msgs"))
    return msgs.select("conv_id", T.dialogue_text(F.col("msgs")).alias("dialogue"))


@register("induction_cleanup", sql=views.with_ctes(views.RUNS_SQL, body="""
SELECT run_id, replace(replace(prediction, 'assistant: ', ''), chr(10) || '----------' || chr(10), '')
       AS prediction FROM runs"""))
def q_induction_cleanup(spark, sf):
    return views.runs(spark, sf).select("run_id", T.induction_cleanup(F.col("prediction")).alias("prediction"))


@register("sentence_pairs", sql=views.with_ctes(views.RUNS_SQL, views.REFS_SQL, body=f"""
, s AS (
  SELECT f.run_id, f.ref_no, {S.reference_sentences('f.reference')} AS rs,
         string_split(r.prediction, chr(10)) AS cs, f.reference, r.prediction
  FROM refs f JOIN runs r ON r.run_id = f.run_id
)
SELECT run_id, ref_no, CAST(i - 1 AS INTEGER) AS pos,
       CASE WHEN len(rs) = len(cs) THEN rs[i] ELSE reference END AS ref_sentence,
       CASE WHEN len(rs) = len(cs) THEN cs[i] ELSE prediction END AS cand_sentence
FROM s, LATERAL (SELECT unnest(range(1, CASE WHEN len(rs) = len(cs) THEN len(rs) + 1 ELSE 2 END)) AS i)
"""))
def q_sentence_pairs(spark, sf):
    from precis.operators.embed import sentence_pairs
    r = views.runs(spark, sf)
    return sentence_pairs(views.refs(spark, sf, r), r.select("run_id", "prediction"))

"""Registered queries for summary metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from precis.functions import tokens as K
from precis.operators import embed, entailment, fmt, grammar, hallucination, judge, lm, rouge
from precis.plans import views
from precis.plans.registry import register, rounded
from precis.session import table

FORMAT_SQL = """
WITH seg AS (
  SELECT doc_id, source, text,
         CASE WHEN len(string_split(text, '.')) = 12 THEN string_split(text, '.')
              ELSE string_split(text, chr(10)) END AS s
  FROM documents
), k AS (
  SELECT doc_id, source, text, CAST(len(s) = 12 AS INTEGER) AS three_by_three, s[1:12] AS kept
  FROM seg
), h AS (
  SELECT *, list_filter(kept, lambda x, i: (i - 1) % 4 = 0) AS subs FROM k
)
"""


@register("format_check", sql=FORMAT_SQL + """
SELECT doc_id, source, three_by_three,
       CAST(len(list_filter(subs, lambda x: length(x) > 40)) AS INTEGER) AS long_subheadings,
       CAST(len(list_filter(kept, lambda x: NOT list_contains(subs, x) AND length(x) > 60)) AS INTEGER)
         AS long_bullets
FROM h
""")
def q_format_check(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("prediction"))
    return fmt.format_check(docs, truncate=False).drop("prediction")


@register("truncate_prediction", sql=FORMAT_SQL + """
SELECT doc_id, three_by_three,
       CASE WHEN three_by_three = 1 THEN text ELSE array_to_string(kept, chr(10)) END AS prediction
FROM h
""")
def q_truncate_prediction(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prediction"))
    return fmt.format_check(docs).select("doc_id", "three_by_three", "prediction")


# ------------------------------------------------------------------ ROUGE


def _sql_tokens(e: str) -> str:
    return K.sql_scorer_tokens(K.sql_rouge_preprocess(e))


def _sql_grams(t: str, n: int) -> str:
    if n == 1:
        return t
    parts = " || ' ' || ".join(f"{t}[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: {parts})"


def _sql_rouge(n: int) -> str:
    return views.with_ctes(views.RUNS_SQL, views.REFS_SQL, body=f"""
, ct AS (SELECT run_id, {_sql_tokens('prediction')} AS t FROM runs)
, rt AS (SELECT run_id, ref_no, {_sql_tokens('reference')} AS t FROM refs)
, cg AS (SELECT run_id, g, count(*) AS c FROM (SELECT run_id, unnest({_sql_grams('t', n)}) AS g FROM ct) GROUP BY 1, 2)
, rg AS (SELECT run_id, ref_no, g, count(*) AS r FROM
           (SELECT run_id, ref_no, unnest({_sql_grams('t', n)}) AS g FROM rt) GROUP BY 1, 2, 3)
, ov AS (SELECT rg.run_id, rg.ref_no, sum(least(rg.r, cg.c)) AS o FROM rg JOIN cg USING (run_id, g) GROUP BY 1, 2)
, tot AS (SELECT rt.run_id, rt.ref_no, greatest(len(rt.t) - {n - 1}, 0) AS nr, greatest(len(ct.t) - {n - 1}, 0) AS nc
          FROM rt JOIN ct USING (run_id))
, pr AS (SELECT tot.run_id, tot.ref_no, coalesce(o, 0) / greatest(nc, 1) AS p, coalesce(o, 0) / greatest(nr, 1) AS r
         FROM tot LEFT JOIN ov USING (run_id, ref_no))
SELECT run_id, ref_no, round(p, 6) AS p, round(r, 6) AS r,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
FROM pr""")


def _token_rows(spark, sf, stem=False):
    """Token arrays of candidates (ref_no null) and references.  One pass over
    the runs makes the rows of both; a reference text is tokenised once."""
    runs = views.runs(spark, sf)
    n_items = table(spark, sf, "benchmark").select(F.count(F.lit(1))).scalar()
    item = lambda k: ((F.col("run_id") + k) % n_items).alias("item_id")
    none = F.lit(None).cast("long").alias("item_id")
    no = lambda k: F.lit(k).cast("int").alias("ref_no")
    rows = runs.select("run_id", F.inline(F.array(
        F.struct(no(None), none, F.col("prediction")),
        *[F.struct(no(k), item(k), F.lit(None).cast("string").alias("prediction")) for k in range(views.REFS_PER_RUN)])))
    texts = views.ref_texts(spark, sf).select("item_id", rouge.metric_tokens(F.col("reference"), stem).alias("rt"))
    return rows.join(texts, "item_id", "left").filter("ref_no is null or rt is not null").select(
        "run_id", "ref_no", F.when(F.col("ref_no").isNull(), rouge.metric_tokens(F.col("prediction"), stem))
        .otherwise(F.col("rt")).alias("t"))


def _rouge_n(spark, sf, n, stem=False):
    each = rouge.rouge_arrays(_token_rows(spark, sf, stem), (n,)).select("run_id", "nc", F.explode("refs").alias("ref"))
    p, r, f1 = rouge._scores(F.col("nc"), F.col("ref"))
    return rounded(each.select("run_id", "ref.ref_no", p.alias("p"), r.alias("r"), f1.alias("f1")))


@register("rouge_1", sql=_sql_rouge(1))
def q_rouge_1(spark, sf):
    """E3 (tokens unstemmed so the SQL oracle can follow; see rouge_1_stemmed)."""
    return _rouge_n(spark, sf, 1)


@register("rouge_2", sql=_sql_rouge(2))
def q_rouge_2(spark, sf):
    return _rouge_n(spark, sf, 2)


@register("rouge_1_stemmed")
def q_rouge_1_stemmed(spark, sf):
    """E3 + E6 as the reference scores: Porter stems of tokens over 3 chars."""
    return _rouge_n(spark, sf, 1, stem=True)


@register("rouge_lsum")
def q_rouge_lsum(spark, sf):
    """E5: summary-level LCS (Arrow DP per pair); hand vectors in tests."""
    r = views.runs(spark, sf)
    return rounded(rouge.rouge_lsum(r.select("run_id", "prediction"), views.ref_keys(spark, sf, r), stem=True,
                                    ref_key="item_id", ref_texts=views.ref_texts(spark, sf)))


@register("stem_vocab")
def q_stem_vocab(spark, sf):
    """Distinct vocabulary of all predictions, each token stemmed once."""
    r = views.runs(spark, sf)
    toks = r.select(rouge.metric_tokens(F.col("prediction")).alias("t"))
    return rouge.stem_vocab(toks, "t")


_MULTI_SQL_TAIL = """
SELECT run_id, list_transform(list(f1 ORDER BY ref_no), lambda x: round(x, 6)) AS scores FROM pr2 GROUP BY run_id"""


def _pr2(n):
    body = _sql_rouge(n)
    head, tail = body.rsplit("SELECT run_id, ref_no, round(p, 6)", 1)
    return head + ", pr2 AS (SELECT run_id, ref_no, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"


@register("multi_ref_scores", sql=_pr2(1) + _MULTI_SQL_TAIL)
def q_multi_ref_scores(spark, sf):
    """ROUGE-1 F1 of every reference, in reference order."""
    out = rouge.rouge_score_arrays(_token_rows(spark, sf), (1,))
    return out.select("run_id", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


@register("multi_ref_mean", sql=_pr2(1) + """
SELECT run_id, round(avg(f1), 6) AS mean_f1 FROM pr2 GROUP BY run_id""")
def q_multi_ref_mean(spark, sf):
    """Mean over the per-reference array (computed at analysis time)."""
    arr = rouge.rouge_score_arrays(_token_rows(spark, sf), (1,))
    return rounded(arr.select("run_id", rouge.array_mean(F.col("scores")).alias("mean_f1")))


# ------------------------------------------------------------- embeddings

@register("embedding_match", sql=views.with_ctes(views.TOKEN_VECS_SQL, body="""
, sims AS (
  SELECT c.text_id AS ct, c.vec_id AS cv, r.text_id AS rt, r.vec_id AS rv,
         list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))
         / (sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))
            * sqrt(list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))) AS s
  FROM token_vecs c JOIN token_vecs r ON r.text_id = c.text_id + 1
)
, p AS (SELECT ct, avg(m) AS p FROM (SELECT ct, cv, max(s) AS m FROM sims GROUP BY ct, cv) GROUP BY ct)
, r AS (SELECT ct, avg(m) AS r FROM (SELECT ct, rv, max(s) AS m FROM sims GROUP BY ct, rv) GROUP BY ct)
SELECT ct AS pair_id, round(p, 6) AS p, round(r, 6) AS r,
       round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
FROM p JOIN r USING (ct)"""))
def q_embedding_match(spark, sf):
    """Texts of 16 token vectors, candidate t against reference t+1."""
    tv = views.token_vecs(spark, sf)
    texts = tv.select("text_id").distinct()
    pairs = texts.select(F.col("text_id").alias("pair_id"), F.col("text_id").alias("cand_text"),
                         (F.col("text_id") + 1).alias("ref_text"))
    return rounded(embed.embedding_match(tv, tv, pairs))


_LABEL_BASELINE = 0.25


@register("embedding_match_rescaled", sql=f"""
WITH sims AS (
  SELECT c.label AS ct, c.vec_id AS cv, r.vec_id AS rv,
         list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))
         / (sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))
            * sqrt(list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))) AS s
  FROM embeddings c JOIN embeddings r ON r.label = c.label + 1)
, p AS (SELECT ct, avg(m) AS p FROM (SELECT ct, cv, max(s) AS m FROM sims GROUP BY ct, cv) GROUP BY ct)
, r AS (SELECT ct, avg(m) AS r FROM (SELECT ct, rv, max(s) AS m FROM sims GROUP BY ct, rv) GROUP BY ct)
SELECT ct AS pair_id, round((p - {_LABEL_BASELINE}) / (1 - {_LABEL_BASELINE}), 6) AS p,
       round((r - {_LABEL_BASELINE}) / (1 - {_LABEL_BASELINE}), 6) AS r,
       round((2 * p * r / (p + r) - {_LABEL_BASELINE}) / (1 - {_LABEL_BASELINE}), 6) AS f1
FROM p JOIN r USING (ct)""")
def q_embedding_match_rescaled(spark, sf):
    """E9 with a baseline over long texts: all vectors of a label against those
    of the next one, in blocks."""
    tv = table(spark, sf, "embeddings").select(F.col("label").alias("text_id"), "vec_id", "embedding")
    pairs = tv.select("text_id").distinct().select(
        F.col("text_id").alias("pair_id"), F.col("text_id").alias("cand_text"), (F.col("text_id") + 1).alias("ref_text"))
    return rounded(embed.embedding_match(tv, tv, pairs, baseline=_LABEL_BASELINE))


def encoder(spark, sf):
    """Stand-in for the contextual encoder: a token's vector is the row of
    ``embeddings`` that its letters name."""
    emb = table(spark, sf, "embeddings")
    n = emb.select(F.count(F.lit(1))).scalar()

    def vectors(sentences):
        toks = sentences.select("text_id", F.posexplode(K.word_tokens(F.lower("sentence"))).alias("pos", "w"))
        named = toks.select("text_id", "pos", ((F.length("w") * 37 + F.ascii("w") * 11 + F.ascii(F.right("w", F.lit(1)))) % n).alias("e"))
        return named.join(emb.select(F.col("vec_id").alias("e"), "embedding"), "e").select(
            "text_id", F.col("pos").alias("vec_id"), "embedding")

    return vectors


@register("bert_score")
def q_bert_score(spark, sf):
    """E9 as the evaluation uses it: sentence pairs (C15), rescaled, mean F1 per
    reference.  Held against brute force in the tests; the all-pairs SQL is too
    slow over whole tables."""
    runs = views.runs(spark, sf)
    return rounded(embed.bert_scores(views.refs(spark, sf, runs), runs.select("run_id", "prediction"), encoder(spark, sf),
                                     baseline=_LABEL_BASELINE))


# ------------------------------------------------------ numbers, entailment

@register("number_hallucinations", sql=views.with_ctes(views.PAIRS_SQL, body=f"""
SELECT run_id, {hallucination.sql_count('source_text', 'candidate')} AS number_hallucinations FROM pairs"""))
def q_number_hallucinations(spark, sf):
    """E10 over consecutive documents (candidate d, source d-1)."""
    p = views.pairs(spark, sf)
    return hallucination.number_hallucinations(p, "source_text", "candidate").select(
        "run_id", "number_hallucinations")


_LEN_SCORER_SQL = """
, lines AS (SELECT run_id, CAST(generate_subscripts(string_split(prediction, chr(10)), 1) - 1 AS INTEGER) AS line_no,
                   unnest(string_split(prediction, chr(10))) AS line FROM runs)
, probs AS (SELECT run_id, line_no,
                   (length(line) % 7) / ((length(line) % 7) + (length(line) % 5) + (length(line) % 3) + 1.0) AS p_c,
                   (length(line) % 5) / ((length(line) % 7) + (length(line) % 5) + (length(line) % 3) + 1.0) AS p_n,
                   ((length(line) % 3) + 1.0) / ((length(line) % 7) + (length(line) % 5) + (length(line) % 3) + 1.0) AS p_e
            FROM lines)"""


@register("entail_lines", sql=views.with_ctes(views.RUNS_SQL, body=_LEN_SCORER_SQL + """
SELECT run_id, line_no, line FROM lines"""))
def q_entail_lines(spark, sf):
    """Candidate lines paired with the source (source column kept out
    of the checked output)."""
    return entailment.entail_lines(views.runs(spark, sf), keep_source=False)


def _probs(spark, sf):
    lines = entailment.entail_lines(views.runs(spark, sf))
    return entailment.score_lines(lines, entailment.length_scorer)


@register("contradiction_ratio", sql=views.with_ctes(views.RUNS_SQL, body=_LEN_SCORER_SQL + """
SELECT run_id, round(avg(CAST(p_c >= p_n AND p_c >= p_e AS DOUBLE)), 6) AS contradiction_ratio
FROM probs GROUP BY run_id"""))
def q_contradiction_ratio(spark, sf):
    """E12 with the deterministic stand-in scorer (model outputs are inputs)."""
    return rounded(entailment.entail_ratios(_probs(spark, sf)).select("run_id", "contradiction_ratio"))


@register("neutral_contradiction_ratio", sql=views.with_ctes(views.RUNS_SQL, body=_LEN_SCORER_SQL + """
SELECT run_id, round(avg(CAST(p_n > p_c AND p_n >= p_e AND p_c > p_e AS DOUBLE)), 6) AS neutral_contradiction_ratio
FROM probs GROUP BY run_id"""))
def q_neutral_contradiction_ratio(spark, sf):
    return rounded(entailment.entail_ratios(_probs(spark, sf))
                   .select("run_id", "neutral_contradiction_ratio"))


# ------------------------------------------------------------ error scores

def _sql_rule_errors(e: str) -> str:
    cats = set(grammar.ERROR_CATEGORIES)
    parts = [f"len(regexp_extract_all({e}, '{pat}'))" for cat, pat in grammar.DEFAULT_RULES if cat in cats]
    return "CAST(" + " + ".join(parts) + " AS INTEGER)"


_ERR_SQL = f"""
, lines AS (SELECT run_id, CAST(generate_subscripts(string_split(prediction, chr(10)), 1) - 1 AS INTEGER) AS line_no,
                   unnest(string_split(prediction, chr(10))) AS line FROM runs)
, ls AS (SELECT run_id, line_no, {_sql_rule_errors('line')} AS errors,
                CAST(len(regexp_extract_all(line, '{K.WORD_TOKEN}')) AS INTEGER) AS n_tokens FROM lines)
, sc AS (SELECT *, 1.0 - errors / (CASE WHEN n_tokens > 0 THEN n_tokens END) AS score FROM ls)"""


@register("error_count_score", sql=views.with_ctes(views.RUNS_SQL, body=_ERR_SQL + """
SELECT run_id, line_no, errors, n_tokens, round(score, 6) AS score FROM sc"""))
def q_error_count_score(spark, sf):
    """E14 with the built-in rule set."""
    return rounded(grammar.line_scores(grammar.lines(views.runs(spark, sf))))


@register("avg_error_count_score", sql=views.with_ctes(views.RUNS_SQL, body=_ERR_SQL + """
SELECT run_id, round(avg(score), 6) AS avg_error_count_score, CAST(sum(errors) AS INTEGER) AS errors,
       CAST(sum(CAST(n_tokens = 0 AS INTEGER)) AS INTEGER) AS empty_lines
FROM sc GROUP BY run_id"""))
def q_avg_error_count_score(spark, sf):
    return rounded(grammar.error_scores(grammar.line_scores(grammar.lines(views.runs(spark, sf)))))


# ------------------------------------------------------------------- SLOR

def _sql_line_tokens(e: str) -> str:
    return f"list_concat(['<s>'], regexp_extract_all(lower({e}), '{K.WORD_TOKEN}'))"


@register("slor", sql=views.with_ctes(views.RUNS_SQL, body=f"""
, cl AS (SELECT {_sql_line_tokens('line')} AS t FROM
           (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0)
, uni AS (SELECT token, count(*) AS cu FROM (SELECT unnest(t) AS token FROM cl) GROUP BY token)
, bi AS (SELECT t[i - 1] AS prev, t[i] AS token, count(*) AS cb
         FROM (SELECT t, unnest(range(2, len(t) + 1)) AS i FROM cl) GROUP BY 1, 2)
, st AS (SELECT sum(cu) AS n, count(*) AS v FROM uni WHERE token <> '<s>')
, lines AS (SELECT run_id, generate_subscripts(string_split(prediction, chr(10)), 1) AS line_no,
                   unnest(string_split(prediction, chr(10))) AS line FROM runs)
, lt AS (SELECT run_id, line_no, {_sql_line_tokens('line')} AS t FROM lines)
, tp AS (SELECT run_id, line_no, t[i - 1] AS prev, t[i] AS token
         FROM (SELECT run_id, line_no, t, unnest(range(2, len(t) + 1)) AS i FROM lt))
, lp AS (
  SELECT tp.run_id, tp.line_no,
         ln((coalesce(b.cb, 0) + 1.0) / (coalesce(up.cu, 0) + 1.0 * st.v)) AS lbi,
         ln((coalesce(u.cu, 0) + 1.0) / (st.n + 1.0 * st.v)) AS luni
  FROM tp CROSS JOIN st
  LEFT JOIN uni u ON u.token = tp.token
  LEFT JOIN uni up ON up.token = tp.prev
  LEFT JOIN bi b ON b.prev = tp.prev AND b.token = tp.token
)
SELECT run_id, round(avg(ls), 6) AS slor FROM
  (SELECT run_id, line_no, (sum(lbi) - sum(luni)) / count(*) AS ls FROM lp GROUP BY run_id, line_no)
GROUP BY run_id"""))
def q_slor(spark, sf):
    """Bigram LM (add-1) trained in Spark on all documents."""
    corpus = table(spark, sf, "documents").select("text")
    return rounded(lm.slor(views.runs(spark, sf), corpus))


# ------------------------------------------------------------------ judge

_JUDGE_SQL = f"""
, sc AS (SELECT run_id, metric, {judge.sql_parse_score('reply')} AS score FROM responses)
, d AS (SELECT run_id, metric,
               count(*) FILTER (WHERE score = 1) AS s1, count(*) FILTER (WHERE score = 2) AS s2,
               count(*) FILTER (WHERE score = 3) AS s3, count(*) FILTER (WHERE score = 4) AS s4,
               count(*) FILTER (WHERE score = 5) AS s5, count(*) AS n_received,
               count(*) FILTER (WHERE score IS NULL) AS n_discarded
        FROM sc GROUP BY run_id, metric)"""


@register("judge_score", sql=views.with_ctes(views.RESPONSES_SQL, body=_JUDGE_SQL + """
SELECT run_id, metric,
       CASE WHEN 20 - n_discarded > 0 THEN round_even(
         0.0 + 1.0 * (s1 / (20 - n_discarded)) + 2.0 * (s2 / (20 - n_discarded)) + 3.0 * (s3 / (20 - n_discarded))
         + 4.0 * (s4 / (20 - n_discarded)) + 5.0 * (s5 / (20 - n_discarded)), 2) END AS score,
       CAST(20 - n_discarded AS INTEGER) AS n
FROM d"""))
def q_judge_score(spark, sf):
    """E17 over 20 replies per (run, metric)."""
    return judge.judge_score(views.responses(spark, sf), n_requested=views.JUDGE_SAMPLES)


@register("judge_distribution", sql=views.with_ctes(views.RESPONSES_SQL, body=_JUDGE_SQL + """
SELECT * FROM d"""))
def q_judge_distribution(spark, sf):
    """Counts per score 1..5."""
    return judge.judge_distribution(views.responses(spark, sf))

"""Registered queries for prompt rendering.

Inputs: the ``runs`` view (text = user turn, prediction = assistant turn,
title) crossed with approach plans / modifier catalogues by exploding
literal arrays.  The SQL oracle renders the same catalogue with string
concatenation, generated from the same fixed templates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis.functions import text as T
from precis.functions.sql_text import q
from precis.functions.tokens import WORD_TOKEN
from precis.operators import prompts as P
from precis.plans import views
from precis.plans.registry import register

_SLOT = re.compile(r"\$\{(\w+)\}")
PLAN_APPROACHES = [p[0] for p in P.APPROACH_PLAN]


def _sql_render(tpl: str, slots: dict[str, str]) -> str:
    parts, pos = [], 0
    for m in _SLOT.finditer(tpl):
        if m.start() > pos:
            parts.append(q(tpl[pos:m.start()]))
        parts.append(f"coalesce({slots[m.group(1)]}, '')")
        pos = m.end()
    if pos < len(tpl):
        parts.append(q(tpl[pos:]))
    return "(" + " || ".join(parts or ["''"]) + ")"


def _sql_messages(name: str, slots: dict[str, str]) -> list[tuple[str, str]]:
    msgs = P.CHAT_MESSAGES[name]
    out = []
    for i, (role, tpl) in enumerate(msgs):
        c = _sql_render(tpl, slots)
        if i == len(msgs) - 1 and name not in P.NO_SUFFIX + P.PLAIN:
            c = f"({c} || {q(P.MODIFIER_SUFFIX)})"
        out.append((role, c))
    return out + ([("user", q(P.INDUCE_QUESTION))] if name == "induce" else [])


def _sql_dialogue(msgs: list[tuple[str, str]]) -> str:
    return " || ".join(f"{q(r + ':' + chr(10))} || {c} || {q(chr(10) * 2)}" for r, c in msgs)


def _sql_case(approach: str, names: list[str], fn) -> str:
    whens = " ".join(f"WHEN {approach} = {q(n)} THEN {fn(n)}" for n in names)
    return f"(CASE {whens} END)"


_N_EX = P.NUM_EXAMPLES


def _sql_loo(n: int = 4) -> str:
    def drop_first(lst, val):
        return (f"(CASE WHEN list_position({lst}, {val}) IS NOT NULL AND list_position({lst}, {val}) > 0 "
                f"THEN list_concat(({lst})[1:list_position({lst}, {val}) - 1], "
                f"({lst})[list_position({lst}, {val}) + 1:]) ELSE {lst} END)")
    return views.with_ctes(views.RUNS_SQL, body=f"""
, head AS (SELECT list(text ORDER BY run_id) AS ins, list(prediction ORDER BY run_id) AS outs
           FROM (SELECT * FROM runs ORDER BY run_id LIMIT {n + 1}))
, loo AS (SELECT r.run_id, r.title, r.text, r.prediction,
                 ({drop_first('h.ins', 'r.text')})[1:{n}] AS ex_inputs,
                 ({drop_first('h.outs', 'r.prediction')})[1:{n}] AS ex_outputs
          FROM runs r CROSS JOIN head h)""")


def _sql_zip_join(ins, outs, left, right, only_outputs=False):
    i_expr = "'[Text]'" if only_outputs else f"({ins})[i]"
    return (f"array_to_string(list_transform(range(1, len({ins}) + 1), lambda i: {q(left)} || {i_expr} || "
            f"{q(right)} || ({outs})[i] || {q(P.PRIMING_SEPARATOR)}), '')")


_SQL_PRIMING = (f"""{q("Summarize the text. " + P.BEST_FORMAT_MODIFIER + ". " + P.LITERARY_MODIFIERS_STRING + chr(10)
                       + "Following are some good summary examples." + chr(10) + P.PRIMING_SEPARATOR)} || """
                + _sql_zip_join('ex_inputs', 'ex_outputs', 'Text: ', chr(10) + 'Summary: ', only_outputs=True) + " || 'Text: '")


def _spark_prompt_arg() -> Column:
    a = F.col("approach")
    return (F.when(a == "topic", T.topic_string(F.col("title")))
             .when(a == "persona", T.persona_context(F.col("title")))
             .when(a == "description", F.col("title"))
             .when(a == "template", F.lit(P.SUMMARY_SKELETON))
             .when(a == "in_context", P.priming_head(F.col("ex_inputs"), F.col("ex_outputs"), only_outputs=P.ONLY_OUTPUTS))
             .otherwise(F.lit("")))


_SQL_PROMPT_ARG = ("(CASE WHEN approach = 'topic' THEN replace(title, ',', ', ') || '.' "
                   "WHEN approach = 'persona' THEN 'You are an expert on the following topic(s): ' || "
                   "replace(title, ',', ', ') || '.' WHEN approach = 'description' THEN title "
                   f"WHEN approach = 'template' THEN {q(P.SUMMARY_SKELETON)} "
                   f"WHEN approach = 'in_context' THEN {_SQL_PRIMING} ELSE '' END)")
_SLOTS = {"text": "text", "prompt": "prompt", "ref_text": "''", "ref_summary": "''"}

_GRID_SQL = _sql_loo(_N_EX) + f"""
, plan AS (SELECT unnest([{', '.join(q(a) for a in PLAN_APPROACHES)}]) AS approach)
, g AS (SELECT r.run_id, r.title, r.text, r.prediction, r.ex_inputs, r.ex_outputs, p.approach FROM loo r CROSS JOIN plan p)
, gp AS (SELECT *, {_SQL_PROMPT_ARG} AS prompt FROM g)"""


def _grid(spark, sf):
    r = views.runs(spark, sf).select("run_id", "title", "text", "prediction")
    g = P.approach_grid(P.leave_one_out(r, _N_EX), runs=1)
    return g.withColumn("prompt", _spark_prompt_arg())


def _entry(name: str) -> str:
    return P.MESSAGES_OF.get(name, name)


@register("render_chat", sql=_GRID_SQL + f"""
SELECT run_id, approach, {_sql_case('approach', PLAN_APPROACHES,
                                    lambda n: _sql_dialogue(_sql_messages(_entry(n), _SLOTS)))} AS dialogue
FROM gp""")
def q_render_chat(spark, sf):
    """D1 (+D2): every run x the 13 approaches of the main plan, rendered as
    dialogue text; the in-context prompt shows 14 outputs."""
    g = P.render_prompts(_grid(spark, sf), prompt_col="prompt", names=PLAN_APPROACHES)
    return g.select("run_id", "approach", T.dialogue_text(F.col("messages")).alias("dialogue"))


_MOD_FAMILIES = list(P.MODIFIERS)


@register("modifier_suffix", sql=views.with_ctes(views.RUNS_SQL, body=f"""
, m AS (SELECT fam, unnest(mods) AS modifier, CAST(generate_subscripts(mods, 1) - 1 AS INTEGER) AS modifier_no
        FROM (SELECT unnest([{', '.join(q(f) for f in _MOD_FAMILIES)}]) AS fam,
                     unnest([{', '.join('[' + ', '.join(q(x) for x in P.MODIFIERS[f]) + ']' for f in _MOD_FAMILIES)}])
                     AS mods))
SELECT r.run_id, m.fam AS approach, m.modifier_no,
       {_sql_case('m.fam', _MOD_FAMILIES, lambda f: _sql_messages(f, {'text': 'r.text', 'prompt': 'm.modifier', 'ref_text': "''", 'ref_summary': "''"})[-1][1])}
         AS last_message
FROM runs r CROSS JOIN m"""))
def q_modifier_suffix(spark, sf):
    """D2 on the modifier grid: last message carries the modifier and the
    literary/format suffix."""
    r = views.runs(spark, sf).select("run_id", "text")
    grids = None
    for fam in _MOD_FAMILIES:
        g = P.modifier_grid(r, fam, runs=1)
        grids = g if grids is None else grids.unionByName(g)
    msgs = P.chat_messages(F.col("approach"), F.col("text"), F.col("modifier"), names=_MOD_FAMILIES)
    return grids.select("run_id", "approach", F.col("modifier_no").cast("int").alias("modifier_no"),
                        F.element_at(msgs, -1)["content"].alias("last_message"))


_COMPLETION_KINDS = ["topic", "persona", "improve", "improve_second", "important_parts",
                     "important_parts_improve", "important_parts_summary", "template", "paraphrase",
                     "translate:German"]


def _sql_completion(kind: str) -> str:
    name, _, language = kind.partition(":")
    return _sql_render(P.COMPLETIONS[name], {"text": "text", "prompt": "prompt", "ref_text": "title", "ref_summary": "prompt",
                                             "language": q(language)})


@register("render_completion", sql=views.with_ctes(views.RUNS_SQL, body="""
, k AS (SELECT run_id, title, text, prediction AS prompt FROM runs)
SELECT run_id, kind, prompt_text FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT run_id, {q(k)} AS kind, "
    f"{_sql_completion(k)} AS prompt_text FROM k"
    for k in _COMPLETION_KINDS) + ")"))
def q_render_completion(spark, sf):
    """D3: single-string prompts for non-chat models (the second-step kinds
    take the reply as the prompt argument)."""
    r = views.runs(spark, sf)
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), P.completion_prompt(
        k, F.col("text"), F.col("prediction"), F.col("title"), F.col("prediction")).alias("prompt_text"))
        for k in _COMPLETION_KINDS])
    return r.select("run_id", F.inline(arr))


# The dialogues after k replies, as message lists: U is the first user message,
# R1..R3 are the replies.
_SUMMARIZE, _PARTS = "Summarize the text. Text: ###\n${text}\n###", "Find all important parts of the following text. Text: ###\n${text}\n###"
_ASKED = [("user", _SUMMARIZE), ("assistant", "Before summarizing, I will ask two questions about the text.")]
_ENDING = P.LITERARY_MODIFIERS_STRING + " " + P.BEST_FORMAT_MODIFIER + "."
_IMPROVE = [("user", _SUMMARIZE + P.MODIFIER_SUFFIX), ("assistant", "${r1}"),
            ("user", "I am not satisfied with the summary. Write an improved version. " + _ENDING), ("assistant", "${r2}")]
_FOLLOW = [*_ASKED, ("assistant", "${r1}"), ("user", "${r2}"), ("user", "Now summarize the text. " + _ENDING), ("assistant", "${r3}")]
_IMPORTANT = [("user", _PARTS), ("assistant", "${r1}"),
              ("user", "Here is a text and its important parts. Summarize the text. Text: ###\n${text}\n###"
               "\nImportant parts: ###\n${r1}\n###" + P.MODIFIER_SUFFIX), ("assistant", "${r2}")]
_STEPWISE = [("user", "Identify and analyze the text's structure and meaning. Text: ###\n${text}\n###Let's think step by step."),
             ("assistant", "${r1}"), ("user", "Summarize the text. " + _ENDING), ("assistant", "${r2}")]
_HEADINGS = [("user", "Summarize the following text into three subheadings. Text: ###\n${text}\n###"), ("assistant", "${r1}"),
             ("user", "Add three bullet points to each subheading. " + P.LITERARY_MODIFIERS_STRING), ("assistant", "${r2}")]
_BASE = [("user", _SUMMARIZE + P.MODIFIER_SUFFIX), ("assistant", "${r1}")]
#: (approach, replies) -> messages shown
_DIALOGUES = {
    ("follow_up_questions", 0): _FOLLOW[:2], ("follow_up_questions", 1): _FOLLOW[:3], ("follow_up_questions", 2): _FOLLOW[:5],
    ("follow_up_questions", 3): _FOLLOW, ("improve", 0): _IMPROVE[:1], ("improve", 1): _IMPROVE[:3], ("improve", 2): _IMPROVE,
    ("important_parts", 0): _IMPORTANT[:1], ("important_parts", 1): _IMPORTANT[:3], ("important_parts", 2): _IMPORTANT,
    ("step_by_step", 0): _STEPWISE[:1], ("step_by_step", 1): _STEPWISE[:3], ("step_by_step", 2): _STEPWISE,
    ("headings_first", 0): _HEADINGS[:1], ("headings_first", 1): _HEADINGS[:3], ("headings_first", 2): _HEADINGS,
    ("base_prompt", 0): _BASE[:1], ("base_prompt", 1): _BASE,
}
_LAST = {a: max(k for b, k in _DIALOGUES if a == b) for a, _ in _DIALOGUES}
_REPLY_SLOTS = {"text": "text", "r1": "prediction", "r2": "('second ' || title)", "r3": "('third ' || title)"}


@register("multi_turn_step", sql=views.with_ctes(views.RUNS_SQL, body="\nUNION ALL\n".join(
    f"SELECT run_id, {q(a)} AS approach, {k} AS step, {str(_LAST[a] == k).lower()} AS finished, "
    f"{_sql_dialogue([(r, _sql_render(c, _REPLY_SLOTS)) for r, c in msgs])} AS dialogue FROM runs"
    for (a, k), msgs in _DIALOGUES.items())))
def q_multi_turn_step(spark, sf):
    """Every step of every approach with several calls, and a single call:
    each (run, approach) after no reply, the first, the first two, ..."""
    r = views.runs(spark, sf)
    steps = F.array(*[F.struct(F.lit(a).alias("approach"), F.lit(k).alias("k")) for a, k in _DIALOGUES])
    each = r.select("run_id", "title", "text", "prediction", F.inline(steps))
    key = F.concat_ws("|", F.col("run_id").cast("string"), "approach", F.col("k").cast("string")).alias("dialogue_id")
    hist = each.select(key, "run_id", "approach", "text", P.chat_messages(
        F.col("approach"), F.col("text"), names=list(_LAST)).alias("messages"))
    said = F.array(F.col("prediction"), F.concat(F.lit("second "), F.col("title")), F.concat(F.lit("third "), F.col("title")))
    replies = each.select(key, F.posexplode(F.slice(said, 1, F.col("k"))).alias("step", "content")) \
        .withColumn("step", F.col("step") + 1)
    out = P.multi_turn(hist, replies, key="dialogue_id")
    return out.select("run_id", "approach", "step", "finished",
                      T.dialogue_text(F.concat("past", "messages")).alias("dialogue"))


@register("leave_one_out", sql=_sql_loo() + """
SELECT run_id, ex_inputs, ex_outputs FROM loo""")
def q_leave_one_out(spark, sf):
    """D7 with 4 examples per run."""
    r = views.runs(spark, sf).select("run_id", "text", "prediction")
    return P.leave_one_out(r, 4).select("run_id", "ex_inputs", "ex_outputs")


@register("priming_examples", sql=_sql_loo() + f"""
SELECT run_id, {q("Summarize the text. " + P.BEST_FORMAT_MODIFIER + ". " + P.LITERARY_MODIFIERS_STRING
                  + chr(10) + "Following are some good summary examples." + chr(10) + P.PRIMING_SEPARATOR)}
       || {_sql_zip_join('ex_inputs', 'ex_outputs', 'Text: ', chr(10) + 'Summary: ')}
       || 'Text: ' || text || chr(10) || 'Summary:' AS prompt
FROM loo""")
def q_priming_examples(spark, sf):
    """In-context prompt from the leave-one-out examples."""
    r = views.runs(spark, sf).select("run_id", "text", "prediction")
    loo = P.leave_one_out(r, 4)
    return loo.select("run_id", P.priming_prompt(F.col("text"), F.col("ex_inputs"), F.col("ex_outputs"))
                      .alias("prompt"))


@register("priming_outputs", sql=_sql_loo() + f"""
SELECT run_id, {_SQL_PRIMING} || text || chr(10) || 'Summary:' AS prompt FROM loo""")
def q_priming_outputs(spark, sf):
    """D5 as the default experiment uses it: outputs only."""
    loo = P.leave_one_out(views.runs(spark, sf).select("run_id", "text", "prediction"), 4)
    return loo.select("run_id", P.priming_prompt(F.col("text"), F.col("ex_inputs"), F.col("ex_outputs"), only_outputs=True)
                      .alias("prompt"))


@register("induction_chat", sql="\nUNION ALL\n".join(
    (_sql_loo() if not only else "") + f"""
SELECT run_id, {str(only).lower()} AS only_outputs, {_sql_dialogue([
        ('user', q(P.INDUCE_CONTEXT_OUTPUTS if only else P.INDUCE_CONTEXT) + ' || ' + q(P.PRIMING_SEPARATOR) + ' || '
         + _sql_zip_join('ex_inputs', 'ex_outputs', 'Input: ', chr(10) + 'Output: ', only_outputs=only)),
        ('user', "'The instruction was:'")])} AS dialogue FROM loo""" for only in (False, True)))
def q_induction_chat(spark, sf):
    """D6 (chat form), with inputs and with outputs only."""
    loo = P.leave_one_out(views.runs(spark, sf).select("run_id", "text", "prediction"), 4)
    both = F.array(*[F.struct(F.lit(only).alias("only_outputs"), T.dialogue_text(P.induction_messages(
        F.col("ex_inputs"), F.col("ex_outputs"), only)).alias("dialogue")) for only in (False, True)])
    return loo.select("run_id", F.inline(both))


@register("induction_prompt", sql=_sql_loo() + f"""
SELECT run_id, {q(P.INDUCE_CONTEXT_OUTPUTS)} || {q(P.PRIMING_SEPARATOR)}
       || {_sql_zip_join('ex_inputs', 'ex_outputs', 'Input: ', chr(10) + 'Output: ', only_outputs=True)}
       || 'The instruction was:' AS prompt
FROM loo""")
def q_induction_prompt(spark, sf):
    """D6 (only-outputs variant)."""
    r = views.runs(spark, sf).select("run_id", "text", "prediction")
    loo = P.leave_one_out(r, 4)
    return loo.select("run_id", P.induction_prompt(F.col("ex_inputs"), F.col("ex_outputs"), only_outputs=True)
                      .alias("prompt"))


@register("example_tokens", sql=_sql_loo() + f"""
SELECT run_id, CAST(coalesce(list_sum(list_transform(list_concat(ex_inputs, ex_outputs),
       lambda e: len(regexp_extract_all(e, '{WORD_TOKEN}')) + 4)), 0) AS INTEGER) AS example_tokens
FROM loo""")
def q_example_tokens(spark, sf):
    """Sum over the run's examples of tokens + 4."""
    r = views.runs(spark, sf).select("run_id", "text", "prediction")
    loo = P.leave_one_out(r, 4)
    return loo.select("run_id", P.example_tokens(F.array("ex_inputs", "ex_outputs")).alias("example_tokens"))


@register("modifier_grid", sql=views.with_ctes(views.RUNS_SQL, body=f"""
SELECT r.run_id, CAST(m.i - 1 AS INTEGER) AS modifier_no, m.modifier, CAST(k.run_no AS INTEGER) AS run_no
FROM runs r
CROSS JOIN (SELECT unnest(l) AS modifier, generate_subscripts(l, 1) AS i
            FROM (SELECT [{', '.join(q(m) for m in P.MODIFIERS['format'])}] AS l)) m
CROSS JOIN (SELECT unnest(range(1, 3)) AS run_no) k"""))
def q_modifier_grid(spark, sf):
    """Runs x 29 format modifiers x 2 runs."""
    r = views.runs(spark, sf).select("run_id")
    g = P.modifier_grid(r, "format", runs=2)
    return g.select("run_id", F.col("modifier_no").cast("int").alias("modifier_no"), "modifier",
                    F.col("run_no").cast("int").alias("run_no"))


@register("approach_grid", sql=views.with_ctes(views.RUNS_SQL, body="""
, plan(approach, uses_topic, uses_description, num_examples, only_outputs) AS (VALUES
  ('base_prompt', false, false, 0, false), ('follow_up', false, false, 0, false), ('topic', true, false, 0, false),
  ('persona', true, false, 0, false), ('improve', false, false, 0, false), ('repeat', false, false, 0, false),
  ('headings_first', false, false, 0, false), ('template', false, false, 0, false), ('description', false, true, 0, false),
  ('step_by_step', false, false, 0, false), ('analyze_main_themes', false, false, 0, false),
  ('main_points', false, false, 0, false), ('in_context', false, false, 14, true))
SELECT r.run_id, p.* FROM runs r CROSS JOIN plan p"""))
def q_approach_grid(spark, sf):
    """Runs x the 13 approaches of the default experiment."""
    r = views.runs(spark, sf).select("run_id")
    return P.approach_grid(r, runs=1).drop("run_no")


@register("paraphrase_prompts", sql=views.with_ctes(views.RUNS_SQL, body="""
SELECT run_id, 'Paraphrase the following text: ' || text || '. Paraphrased text:' AS paraphrase,
       'Translate the following text into German: ' || text || chr(10) || 'Translation:' AS to_german,
       'Translate the following text into English: ' || prediction || chr(10) || 'Translation:' AS back
FROM runs"""))
def q_paraphrase_prompts(spark, sf):
    """Paraphrase, and the two-step translation round trip (the second
    prompt takes the first reply, here the run's assistant turn)."""
    r = views.runs(spark, sf)
    return r.select("run_id",
                    P.completion_prompt("paraphrase", F.col("text")).alias("paraphrase"),
                    P.completion_prompt("translate:German", F.col("text")).alias("to_german"),
                    P.completion_prompt("translate:English", F.col("prediction")).alias("back"))


def _sql_judge(compat: bool) -> str:
    swap = {"coherence": "consistency", "consistency": "coherence"} if compat else {}
    return views.with_ctes(views.RUNS_SQL, body="\nUNION ALL\n".join(
        f"SELECT run_id, {q(m)} AS metric, "
        f"{_sql_render(P.JUDGE_TEMPLATES[swap.get(m, m)], {'text': 'text', 'summary': 'prediction'})} AS judge_prompt FROM runs"
        for m in P.JUDGE_METRICS))


@register("judge_prompts", sql=_sql_judge(False))
def q_judge_prompts(spark, sf):
    """One judge prompt per (run, metric) from the four templates."""
    return P.judge_prompts(views.runs(spark, sf))


@register("judge_prompts_compat", sql=_sql_judge(True))
def q_judge_prompts_compat(spark, sf):
    """D11 with coherence and consistency swapped."""
    return P.judge_prompts(views.runs(spark, sf), compat=True)


@register("template_substitute", sql=views.with_ctes(views.RUNS_SQL, body="""
SELECT run_id, 'Summary of ' || approach || ': ' || prediction || ' ${missing}' AS filled FROM runs"""))
def q_template_substitute(spark, sf):
    """Slots filled from columns; unknown slots stay as written."""
    r = views.runs(spark, sf)
    body = F.lit("Summary of ${title}: ${text} ${missing}")
    return r.select("run_id", P.template_substitute(body, {"title": F.col("approach"),
                                                           "text": F.col("prediction")}).alias("filled"))


def _sql_budget(name: str) -> str:
    msgs = _sql_messages(_entry(name), _SLOTS)

    def tok(e):
        return f"len(regexp_extract_all({e}, '{WORD_TOKEN}'))"
    parts = [f"(4 + {tok(q(r))} + {tok(c)})" for r, c in msgs]
    return "(" + " + ".join(parts) + " + 3)"


@register("token_budget", sql=_GRID_SQL + f"""
, b AS (SELECT run_id, approach, CAST({_sql_case('approach', PLAN_APPROACHES, _sql_budget)} AS INTEGER) AS n_tokens
        FROM gp)
SELECT run_id, approach, n_tokens, CAST(16384 - n_tokens - 3 AS INTEGER) AS max_completion,
       n_tokens <= 16384 AS within_budget FROM b""")
def q_token_budget(spark, sf):
    """D13 on the rendered chat prompts (4 tokens per message)."""
    g = P.render_prompts(_grid(spark, sf), prompt_col="prompt", names=PLAN_APPROACHES)
    return P.token_budget(g).select("run_id", "approach", F.col("n_tokens").cast("int").alias("n_tokens"),
                                    F.col("max_completion").cast("int").alias("max_completion"),
                                    "within_budget")

"""Prompt-dataset rendering.

Texts x approaches/modifiers -> prompt rows.  The model call is not part of
it: responses come back as a table and are attached with a join (D4, G1).

Rendering is map-only: the message catalogue is compiled into one CASE
expression over ``approach`` that builds ``array<struct<role,content>>``
from literal pieces and columns.  Placeholders are resolved when the
catalogue is compiled, so a value inserted into a prompt is never scanned
for further placeholders.  Grids (D8, D9) explode literal arrays instead of
joining, so the text column is never shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions.tokens import word_tokens
from precis.operators.judge_templates import JUDGE_TEMPLATES

# Prompt building blocks.
BASE_PROMPT = "Summarize the text."
BEGIN_SEPARATOR = "###\n"
END_SEPARATOR = "\n###"
PRIMING_SEPARATOR = "\n###\n"
BEST_FORMAT_MODIFIER = "Three subtitles, each with three bullet points"
LITERARY_MODIFIERS_STRING = (
    "The subheadings and bullet points must be skillfully and effectively written, telegraphic, "
    "put together well, and cover all key points. The bullets must be less than 60 characters "
    "long and subheadings less than 40 characters long.")
MAX_TOKENS_COMPLETION = 4096
MAX_TOKENS_CHAT = 16384

# Chat message templates per approach.  ${text}, ${prompt},
# ${ref_text} and ${ref_summary} are the slots.
_T = "Text: ###\n${text}\n###"
CHAT_MESSAGES: dict[str, list[tuple[str, str]]] = {
    "base_prompt": [("user", "Summarize the text. " + _T)],
    "in_context": [("user", "${prompt}${text}\nSummary:")],
    "follow_up_questions": [
        ("user", "Summarize the text. " + _T),
        ("assistant", "Before summarizing, I will ask two questions about the text.")],
    "persona": [("system", "${prompt}"), ("user", "Summarize the text. " + _T)],
    "improve": [("user", "Summarize the text. " + _T)],
    "topic": [("user", "Summarize the text. The text is on the following topic(s): ${prompt}\n" + _T)],
    "important_parts": [("user", "Find all important parts of the following text. " + _T)],
    "summarize_important_parts": [(
        "user", "Here is a text and its important parts. Summarize the text. " + _T
        + "\nImportant parts: ###\n${prompt}\n###")],
    "induce": [("user", "${prompt}${text}")],
    "template": [(
        "user", "I am going to provide you a summary template. Everything in all caps is a "
        "placeholder. Please preserve the format, and number of subheadings and bullet points. "
        "Template: ${prompt}\nSummarize the following text. " + _T)],
    "template_with_examples": [
        ("user", "I am going to provide you a template for your output. Everything in all caps is a "
         "placeholder. The prompts must result in output summaries that adhere to the template "
         "format. Template: ${prompt}Here is a sample interaction after the prompt was provided: "
         "###\n\nSummarize the text. Text: ${ref_text}\nChatGPT: ${ref_summary}\n###"),
        ("user", "Summarize the text. " + _T)],
    "headings_first": [("user", "Summarize the following text into three subheadings. " + _T)],
    "repeat": [("user", "Summarize the text. " + LITERARY_MODIFIERS_STRING + BEST_FORMAT_MODIFIER
                + ". " + _T + "\nSummarize the text.")],
    "description": [("user", "Here is a text and its description. Summarize the text. " + _T
                     + "\nDescription: ###\n${prompt}\n###")],
    "step_by_step": [("user", "Identify and analyze the text's structure and meaning. " + _T
                      + "Let's think step by step.")],
    "analyze_main_themes": [(
        "user", "Analyze the text and identify three main themes or topics discussed in the text. "
        "For each theme, provide three supporting points from the text. " + _T)],
    "main_points": [("user", "Write an output summarizing the main points of the text. " + _T)],
    "format": [("user", BASE_PROMPT + "\n" + _T + "\n${prompt}.")],
    "shorten_as_possible": [("user", "Summarize the text. " + _T + "\nShorten the answer as possible. ")],
    "baseline": [("user", "suggest three insightful, concise subheadings which summarize this text, "
                  "suggest three bullet points for each subheading:\n${text}")],
}
for _fam in ("length", "quality", "structure", "denseness", "relevance"):
    CHAT_MESSAGES[_fam] = [("user", "Summarize the text. " + _T
                            + "\nThe bullet points and subheadings must be ${prompt}.")]

# Approaches whose last message gets no modifier suffix.
NO_SUFFIX = ["follow_up_questions", "important_parts", "headings_first", "format", "step_by_step",
             "induce"]
# Approaches whose only message is written out by themselves.
PLAIN = ["baseline", "in_context"]
MODIFIER_SUFFIX = "\n" + LITERARY_MODIFIERS_STRING + "\n" + BEST_FORMAT_MODIFIER + "."

# The skeleton that the template approaches show.
SUMMARY_SKELETON = ("SUBHEADING\n- BULLET\n- BULLET\n- BULLET\nSUBHEADING\n- BULLET\n- BULLET\n- BULLET\n"
                    "SUBHEADING\n- BULLET\n- BULLET\n- BULLET")

# Single-string prompts of the non-chat models (D3).  ${prompt}
# is the topic, persona or former reply; ${language} a language name.
COMPLETIONS: dict[str, str] = {
    "topic": "Summarize the following text into three subheadings with three corresponding bullet points."
             "\n\nTopic: ###\n${prompt}\n###\n\nText: ###\n${text}\n###\n\nSummary:",
    "persona": "${prompt}Summarize the text.Text: ###\n${text}\n###Summary:",
    "improve": "Summarize the following text into three subheadings with three corresponding bullet points."
               "\nText: ###\n${text}\n###\nSummary:",
    "improve_second": "Here is a text and its summary. Please improve the summary."
                      "\nText: ###\n${text}\n###\nSummary: ###\n${prompt}\n###",
    "important_parts": "Find all important parts of the following text.\nText: ###\n${text}\n###",
    "important_parts_improve": "Here is a text and its important parts. Please improve the important parts."
                               "\nText: ###\n${text}\n###\nImportant parts:###\n${prompt}\n###",
    "important_parts_summary": "Here is a text and its important parts. Summarize the content into a three "
                               "subheadings with three corresponding bullet points."
                               "\nText: ###\n${text}\n###Important parts: ###\n${prompt}\n###",
    "template": "I am going to provide you a template for your output. Everything in all caps is a "
                "placeholder. The prompts must result in output summaries that follow the template "
                "format. Template: " + SUMMARY_SKELETON + "\nA sample interaction after the prompt was "
                "provided is shown below.\n###\nUser: Summarize the text into three subheadings with three "
                "corresponding bullet points.\nText: ${ref_text}\nChatGPT: ${ref_summary}\n###"
                "\nSummarize text. Text: ${text}",
    "paraphrase": "Paraphrase the following text: ${text}. Paraphrased text:",
    "translate": "Translate the following text into ${language}: ${text}\nTranslation:",
}

# Contexts of the instruction induction.
INDUCE_CONTEXT = (
    "I gave a friend an instruction and some inputs. The friend read the instruction and wrote an "
    "output for every one of the inputs. Here are the input-output pairs.\n")
INDUCE_CONTEXT_OUTPUTS = (
    "I gave a friend an instruction and some texts. The friend read the instruction and wrote an "
    "output for every one of the texts. Here are the outputs.\n")
INDUCE_QUESTION = "The instruction was:"

# What happens with the model's k-th reply of an approach with
# several calls (D4): role it is kept under, approach whose messages start a new
# history with the reply as their prompt (or None), messages that follow.
_CLOSE = LITERARY_MODIFIERS_STRING + " " + BEST_FORMAT_MODIFIER + "."
STEPS: dict[str, list[tuple[str, str | None, list[tuple[str, str]]]]] = {
    "follow_up_questions": [
        ("assistant", None, []),
        ("user", None, [("user", "Now summarize the text. " + _CLOSE)]),
        ("assistant", None, [])],
    "improve": [
        ("assistant", None, [("user", "I am not satisfied with the summary. Write an improved version. " + _CLOSE)]),
        ("assistant", None, [])],
    "important_parts": [
        ("assistant", "summarize_important_parts", []),
        ("assistant", None, [])],
    "step_by_step": [
        ("assistant", None, [("user", "Summarize the text. " + _CLOSE)]),
        ("assistant", None, [])],
    "headings_first": [
        ("assistant", None, [("user", "Add three bullet points to each subheading. " + LITERARY_MODIFIERS_STRING)]),
        ("assistant", None, [])],
    "induce": [("assistant", None, [])],
}

# Modifier catalogues (family -> ordered modifiers).
MODIFIERS: dict[str, list[str]] = {
    "quality": [
        "articulate", "eloquent", "well-written", "well-put", "well-expressed", "well-stated",
        "well-worded", "well-formulated", "well-presented", "a pleasure to read", "a joy to read",
        "a delight to read", "delightful", "meaningful, persuasive, and delightful",
        "masterfully written", "masterpieces of the English language",
        "understandable and enjoyable for everyone", "well-crafted",
        "skillfully and effectively written", "accurately articulated", "a joy to peruse",
        "enjoyable to read", "an absolute pleasure to read", "an enjoyable reading experience",
        "expertly crafted", "expertly written", "outstanding works of English literature",
        "literary works of great importance in the English language",
        "easily comprehensible and enjoyable for individuals of all backgrounds",
        "adorable, delightful, enchanting, charming"],
    "structure": [
        "well-constructed", "well-organized", "well-arranged", "well-ordered", "well-structured",
        "well-phrased", "well-composed", "coherent", "flowing", "put together well",
        "well put together", "put together so that it flows well",
        "put together so that they are connected well", "put together so that there is a good flow",
        "compiled so that it flows well", "assembled so that they are well connected to each other",
        "organized in a neat and systematic manner", "neatly organized",
        "arranged in a way that allows for a smooth and cohesive progression",
        "arranged in a manner that ensures a strong connection between the different components"],
    "format": [
        "3 subheadings with 3 bullet points", "3 subheadings, each with 3 bullet points",
        "3 x 3 subheadings and bullet points", "3 by 3 subheadings with bullet points",
        "3 subtitles with 3 bullet points", "3 times 3 subtitles with bullet points",
        "Three subheadings with three corresponding bullet points",
        "Output must be three subheadings, each with three bullet points",
        "Output format: three subheadings, each with three bullet points",
        "Output format: three subtitles, each with three bullet points",
        "Output format: three sub-points, each with three bullet points",
        "Three subheadings, each with three bullet points",
        "Three subsections containing three bullet points each",
        "Three subheadings each accompanied by three bullet points",
        "Three subtitles, each with three bullet points",
        "Three main headings consisting of three bullet points rewritten as follows",
        "Three main sections, each containing three key points",
        "Three categories with three points each",
        "Three sections headers, with each containing three bullet points",
        "Three sections, each containing three points that are listed using bullet points",
        "Three divisions with a set of three items",
        "Three sections, each containing a list of three points",
        "Organize the summary into three subheadings with bullet points",
        "Three sets of three headings with bullet points",
        "Three titles, each containing three bullet points",
        "Output style: three subheadings, each containing three bullet points",
        "Format for output: three headings, each containing three bullet points",
        "Format of output: three headings with three points listed under each heading",
        "Format of output: three headings with three items listed under each heading"],
    "length": ["brief", "short", "shortened", "abbreviated", "abridged", "curtailed",
               "less than 60 characters long", "shortened as possible"],
    "denseness": ["compendious", "comprehensive", "concise", "compressed", "succinct", "pithy",
                  "terse", "epigrammatic", "telegraphic", "condensed", "aphoristic", "compact",
                  "laconic", "apothegmatic"],
    "relevance": ["relevant", "pertinent", "important", "meaningful", "significant", "insightful",
                  "substantial", "to the point", "cover all main points", "cover all key points",
                  "address all main subjects", "include all essential elements",
                  "include all main points", "include all key points"],
}

_SLOT = re.compile(r"\$\{(\w+)\}")


def _render(template: str, slots: dict[str, Column]) -> Column:
    """Literal pieces + slot columns, resolved once (no rescanning)."""
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(slots[m.group(1)], F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else (parts[0] if parts else F.lit(""))


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _messages(name: str, slots: dict[str, Column], modifier_suffix: bool = True) -> Column:
    msgs = CHAT_MESSAGES[name]
    rendered = []
    for i, (role, tpl) in enumerate(msgs):
        content = _render(tpl, slots)
        if modifier_suffix and i == len(msgs) - 1 and name not in NO_SUFFIX + PLAIN:
            content = F.concat(content, F.lit(MODIFIER_SUFFIX))
        rendered.append(_msg(role, content))
    if name == "induce":
        rendered.append(_msg("user", F.lit(INDUCE_QUESTION)))
    return F.array(*rendered)


def chat_messages(approach: Column, text: Column, prompt: Column | None = None,
                  ref_text: Column | None = None, ref_summary: Column | None = None,
                  modifier_suffix: bool = True, names: list[str] | None = None) -> Column:
    """D1 + D2: array<struct<role,content>> for the row's approach.

    ``prompt`` fills the approach's own slot: topic line, persona, description,
    modifier, summary skeleton, or for ``in_context`` everything before the text
    (``priming_head``).  An unknown approach is an error when the row is
    rendered; ``names`` limits the compiled catalogue to some approaches."""
    empty = F.lit("")
    slots = {"text": text, "prompt": prompt if prompt is not None else empty,
             "ref_text": ref_text if ref_text is not None else empty,
             "ref_summary": ref_summary if ref_summary is not None else empty}
    expr = F
    for name in names or CHAT_MESSAGES:
        expr = expr.when(approach == name, _messages(name, slots, modifier_suffix))
    return expr.otherwise(F.raise_error(F.concat(F.lit("unknown approach: "), F.coalesce(approach, F.lit("null")))))


#: approaches whose catalogue entry has another name than their runs
MESSAGES_OF = {"follow_up": "follow_up_questions"}


def render_prompts(texts: DataFrame, approach_col: str = "approach", text_col: str = "text",
                   prompt_col: str | None = None, names: list[str] | None = None) -> DataFrame:
    """D1/D2 as a DataFrame operator: adds ``messages``."""
    prompt = F.col(prompt_col) if prompt_col else None
    approach = F.col(approach_col)
    for run_name, entry in MESSAGES_OF.items():
        approach = F.when(F.col(approach_col) == run_name, F.lit(entry)).otherwise(approach)
    wanted = [MESSAGES_OF.get(n, n) for n in names] if names else None
    return texts.withColumn("messages", chat_messages(approach, F.col(text_col), prompt, names=wanted))


def validate_approaches(approaches: list[str]) -> None:
    unknown = [a for a in approaches if MESSAGES_OF.get(a, a) not in CHAT_MESSAGES]
    if unknown:
        raise ValueError(f"unknown approaches: {unknown}")


# ------------------------------------------------------------------ D3

def completion_prompt(kind: str, text: Column, prompt: Column | None = None,
                      reference_text: Column | None = None,
                      reference_summary: Column | None = None) -> Column:
    """D3: single-string prompts of the non-chat models; ``translate:German``
    names the language of a translation."""
    name, _, language = kind.partition(":")
    if name not in COMPLETIONS or (name == "translate") != bool(language):
        raise ValueError(f"unknown completion prompt {kind}")
    empty = F.lit("")
    return _render(COMPLETIONS[name], {
        "text": text, "prompt": prompt if prompt is not None else empty, "language": F.lit(language),
        "ref_text": reference_text if reference_text is not None else empty,
        "ref_summary": reference_summary if reference_summary is not None else empty})


# ------------------------------------------------------------------ D4

def multi_turn(history: DataFrame, responses: DataFrame, key: str = "run_id",
               approach_col: str = "approach", text_col: str = "text") -> DataFrame:
    """Every dialogue after all replies that it got so far.

    ``history`` (key, approach, text, messages) are first prompts, ``responses``
    (key, step, content) the model's replies, steps from 1.  -> history's columns
    with ``past`` (messages of an abandoned history), ``messages`` (the live one:
    the next prompt, or the finished dialogue), ``step`` (replies taken) and
    ``finished``.

    The step table becomes one expression, folded over the steps of a row: a
    reply is kept under its role, then messages follow or a new history starts.
    Replies after a missing one wait; replies beyond the last step are ignored;
    of two replies to one step the smallest counts.  One join for all steps."""
    got = responses.groupBy(key, "step").agg(F.min("content").alias("content")) \
        .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("step").cast("int"), "content"))).alias("__replies"))
    joined = history.join(got, key, "left")
    approach, text, replies = F.col(approach_col), F.col(text_col), F.col("__replies")
    none = F.array().cast("array<struct<role:string,content:string>>")

    def advance(state: Column, step: Column) -> Column:
        reply = F.try_element_at(replies, step)
        plain = F.concat(state["messages"], F.array(_msg("assistant", reply)))
        past, live = F, F
        for name, table in STEPS.items():
            for k, (role, restart, follow) in enumerate(table, 1):
                here = (approach == name) & (step == k)
                kept = F.concat(state["messages"], F.array(_msg(role, reply), *[_msg(r, F.lit(c)) for r, c in follow]))
                if restart:
                    fresh = _messages(restart, {"text": text, "prompt": reply, "ref_text": F.lit(""), "ref_summary": F.lit("")})
                    past, live = past.when(here, F.concat(state["past"], kept)), live.when(here, fresh)
                elif follow or role != "assistant":
                    live = live.when(here, kept)
        taken = reply.isNotNull() & (state["step"] == step - 1) & (step <= last)
        return F.struct(F.when(taken, past.otherwise(state["past"])).otherwise(state["past"]).alias("past"),
                        F.when(taken, live.otherwise(plain)).otherwise(state["messages"]).alias("messages"),
                        F.when(taken, step).otherwise(state["step"]).alias("step"))

    last = F
    for name, table in STEPS.items():
        last = last.when(approach == name, F.lit(len(table)))
    last = last.otherwise(F.lit(1))
    most = max(map(len, STEPS.values()))
    start = F.struct(none.alias("past"), F.col("messages").cast(none_type()).alias("messages"), F.lit(0).alias("step"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, advance)
    kept = [c for c in history.columns if c != "messages"]
    return joined.select(*kept, state.alias("__s"), last.alias("__last")).select(
        *kept, "__s.past", "__s.messages", "__s.step", (F.col("__s.step") == F.col("__last")).alias("finished"))


def none_type() -> str:
    return "array<struct<role:string,content:string>>"


# --------------------------------------------------------------- D5, D6, D7

# Head of the in-context prompt.
PRIMING_HEAD = ("Summarize the text. " + BEST_FORMAT_MODIFIER + ". " + LITERARY_MODIFIERS_STRING
                + "\nFollowing are some good summary examples.\n" + PRIMING_SEPARATOR)


def priming_head(inputs: Column, outputs: Column, only_outputs: bool = False) -> Column:
    """Everything of the in-context prompt before the text."""
    pairs = F.arrays_zip(inputs.alias("i"), outputs.alias("o"))
    ex = F.transform(pairs, lambda p: F.concat(
        F.lit("Text: "), F.lit("[Text]") if only_outputs else p["i"], F.lit("\nSummary: "), p["o"],
        F.lit(PRIMING_SEPARATOR)))
    return F.concat(F.lit(PRIMING_HEAD), F.array_join(ex, ""), F.lit("Text: "))


def priming_prompt(text: Column, inputs: Column, outputs: Column, only_outputs: bool = False) -> Column:
    """In-context prompt with (input, output) examples."""
    return F.concat(priming_head(inputs, outputs, only_outputs), text, F.lit("\nSummary:"))


def induction_examples(inputs: Column, outputs: Column, only_outputs: bool = False) -> Column:
    pairs = F.arrays_zip(inputs.alias("i"), outputs.alias("o"))
    ex = F.transform(pairs, lambda p: F.concat(
        F.lit("Input: "), F.lit("[Text]") if only_outputs else p["i"], F.lit("\nOutput: "), p["o"],
        F.lit(PRIMING_SEPARATOR)))
    return F.concat(F.lit(PRIMING_SEPARATOR), F.array_join(ex, ""))


def induction_prompt(inputs: Column, outputs: Column, only_outputs: bool = False) -> Column:
    """D6 (completion form): context + examples + the question."""
    ctx = INDUCE_CONTEXT_OUTPUTS if only_outputs else INDUCE_CONTEXT
    return F.concat(F.lit(ctx), induction_examples(inputs, outputs, only_outputs), F.lit(INDUCE_QUESTION))


def induction_messages(inputs: Column, outputs: Column, only_outputs: bool = False) -> Column:
    """D6 (chat form): context and examples as one message, the question as the
    next."""
    ctx = INDUCE_CONTEXT_OUTPUTS if only_outputs else INDUCE_CONTEXT
    return _messages("induce", {"prompt": F.lit(ctx), "text": induction_examples(inputs, outputs, only_outputs)})


def _drop_first_equal(arr: Column, value: Column) -> Column:
    pos = F.array_position(arr, value)
    return F.when(pos > 0, F.concat(F.slice(arr, 1, pos - 1), F.slice(arr, pos + 1, F.size(arr))))\
        .otherwise(arr)


def leave_one_out(corpus: DataFrame, n: int, key: str = "run_id", input_col: str = "text",
                  output_col: str = "prediction") -> DataFrame:
    """Per row, the first ``n`` other examples in corpus order; the
    row's own input and output are removed by value (first equal element)
    from the input and output lists separately.  Only the first n+1
    examples can ever be chosen, so just those are gathered (a proven
    bound of n+1 rows) and read as a scalar; no row-by-row self join."""
    head = corpus.orderBy(key).limit(n + 1)  # top-k: one partial sort per task
    ordered = F.sort_array(F.collect_list(F.struct(key, input_col, output_col)))
    pool = head.agg(F.transform(ordered, lambda s: s[input_col]).alias("__inputs"),
                    F.transform(ordered, lambda s: s[output_col]).alias("__outputs"))
    # one-row pool read through scalar subqueries: computed once, shipped to
    # every task as a value, no join (a constant-key join would plan as a
    # nested-loop cross join)
    inputs, outputs = pool.select("__inputs").scalar(), pool.select("__outputs").scalar()
    return corpus.select(
        *corpus.columns,
        F.slice(_drop_first_equal(inputs, F.col(input_col)), 1, n).alias("ex_inputs"),
        F.slice(_drop_first_equal(outputs, F.col(output_col)), 1, n).alias("ex_outputs"))


# ------------------------------------------------------------ D8, D9

def modifier_grid(texts: DataFrame, family: str, runs: int = 1,
                  modifiers: list[str] | None = None) -> DataFrame:
    """Texts x modifiers x runs by exploding literal arrays (map-only)."""
    mods = modifiers if modifiers is not None else MODIFIERS[family]
    arr = F.array(*[F.struct(F.lit(i).alias("modifier_no"), F.lit(m).alias("modifier"))
                    for i, m in enumerate(mods)])
    return texts.select("*", F.inline(arr), F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_no")) \
        .withColumn("approach", F.lit(family))


# Approaches of the default experiment, in their order, each with
# 14 examples of outputs only for the approaches that show examples.
APPROACHES = ["base_prompt", "follow_up", "topic", "persona", "improve", "repeat", "headings_first",
              "template", "description", "step_by_step", "analyze_main_themes", "main_points",
              "in_context"]
NUM_EXAMPLES = 14
ONLY_OUTPUTS = True


def plan_row(approach: str, num_examples: int = NUM_EXAMPLES, only_outputs: bool = ONLY_OUTPUTS) -> tuple:
    """(approach, uses_topic, uses_description, num_examples, only_outputs)."""
    shows = approach in ("in_context", "induce")
    return (approach, approach in ("topic", "persona"), approach == "description",
            num_examples if shows else 0, only_outputs and shows)


#: (approach, uses_topic, uses_description, num_examples, only_outputs)
APPROACH_PLAN = [plan_row(a) for a in APPROACHES]


def approach_grid(texts: DataFrame, runs: int = 1, plan=None) -> DataFrame:
    """Texts x approaches x runs with per-approach arguments."""
    plan = plan or APPROACH_PLAN
    validate_approaches([p[0] for p in plan])
    arr = F.array(*[F.struct(F.lit(a).alias("approach"), F.lit(t).alias("uses_topic"),
                             F.lit(d).alias("uses_description"), F.lit(n).alias("num_examples"),
                             F.lit(o).alias("only_outputs")) for a, t, d, n, o in plan])
    return texts.select("*", F.inline(arr), F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_no"))


# ------------------------------------------------------------- D11, D12

JUDGE_METRICS = ["fluency", "coherence", "consistency", "relevance"]


def judge_prompts(runs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text",
                  summary_col: str = "prediction", compat: bool = False) -> DataFrame:
    """One judge prompt per (run, metric).  ``templates`` (metric -> body
    with ${text}/${summary}) default to the four of the judge; ``compat`` swaps
    coherence and consistency as the reference did."""
    templates = JUDGE_TEMPLATES if templates is None else templates
    pick = dict(templates)
    if compat and "coherence" in pick and "consistency" in pick:
        pick["coherence"], pick["consistency"] = templates["consistency"], templates["coherence"]
    slots = {"text": F.col(text_col), "summary": F.col(summary_col)}
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), _render(pick[m], slots).alias("judge_prompt"))
                    for m in pick])
    return runs.select("run_id", F.inline(arr))


def template_substitute(body: Column, values: dict[str, Column]) -> Column:
    """``${name}`` substitution on a template column.  The body is split
    on "${" first, so inserted values are never rescanned."""
    pieces = F.split(body, r"\$\{", -1)
    items = []
    for k, v in values.items():
        items += [F.lit(k), v]
    lookup = F.create_map(*items)

    def piece(p: Column, i: Column) -> Column:
        name = F.substring_index(p, "}", 1)
        rest = F.substring(p, F.length(name) + 2, 1 << 30)
        known = (F.instr(p, "}") > 0) & F.map_contains_key(lookup, name)
        return F.when(i == 0, p).when(known, F.concat(F.try_element_at(lookup, name), rest)) \
            .otherwise(F.concat(F.lit("${"), p))

    return F.array_join(F.transform(pieces, piece), "")


# ------------------------------------------------------------- D13, D14

def count_tokens(s: Column) -> Column:
    """Default token count (pluggable): regex word/punctuation tokens."""
    return F.size(word_tokens(s))


# Tokens that a model adds to every message.
TOKENS_PER_MESSAGE = {"gpt-3.5-turbo-0301": 4, "gpt-4-0314": 3}
# Models counted like a dated one.
COUNTED_AS = {"gpt-3.5-turbo": "gpt-3.5-turbo-0301", "gpt-3.5-turbo-16k": "gpt-3.5-turbo-0301", "gpt-4": "gpt-4-0314"}


def tokens_per_message(model: str) -> int:
    dated = COUNTED_AS.get(model, model)
    if dated not in TOKENS_PER_MESSAGE:
        raise ValueError(f"no token rule for model {model}")
    return TOKENS_PER_MESSAGE[dated]


def token_budget(df: DataFrame, messages_col: str = "messages", per_message: int | None = None,
                 limit: int = MAX_TOKENS_CHAT, tokens=count_tokens, model: str = "gpt-3.5-turbo-16k") -> DataFrame:
    """n_tokens = sum over messages of (per_message + tokens(role) +
    tokens(content)) + 3; max_completion = limit - n_tokens - 3;
    within_budget replaces the reference's exception.  ``per_message`` follows
    from ``model`` unless it is given."""
    per_message = tokens_per_message(model) if per_message is None else per_message
    n = F.aggregate(F.col(messages_col), F.lit(0),
                    lambda acc, m: acc + F.lit(per_message) + tokens(m["role"]) + tokens(m["content"])) + 3
    return df.withColumn("n_tokens", n) \
        .withColumn("max_completion", F.lit(limit) - F.col("n_tokens") - 3) \
        .withColumn("within_budget", F.col("n_tokens") <= limit)


def completion_budget(df: DataFrame, prompt_col: str, limit: int = MAX_TOKENS_COMPLETION, tokens=count_tokens) -> DataFrame:
    """D13 for single-string prompts: n_tokens, max_completion, within_budget."""
    return df.withColumn("n_tokens", tokens(F.col(prompt_col))) \
        .withColumn("max_completion", F.lit(limit) - F.col("n_tokens") - 3) \
        .withColumn("within_budget", F.col("n_tokens") <= limit)


def example_tokens(examples: Column, tokens=count_tokens) -> Column:
    """Sum over all examples of (tokens + 4); examples is
    array<array<string>>."""
    return F.aggregate(F.flatten(examples), F.lit(0), lambda acc, e: acc + tokens(e) + 4)


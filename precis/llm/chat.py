"""Chat formatting (operator 12), relational.

The turns of a conversation are collected as structs and sorted; neighbours of
the same role become one block, whose texts are a slice of the sorted array; the
blocks are rendered and concatenated.  All of it are Spark expressions.

The rendered string can be read back: control strings inside a text get one
backslash after their first character, and reading takes it away again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import load
from precis.plans.registry import register


@dataclass(frozen=True)
class Template:
    """Marks around the blocks of a role, and between the texts of one block.

    Roles without marks of their own are written as ``any_open`` role
    ``any_name`` texts ``any_close``.  Every control string starts with ``<`` or
    ``[``, holds no other of these and is no prefix of another, so that none can
    begin in a text and end in a mark."""

    begin: str = "<s>"
    roles: dict = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")})
    any_open: str = "[ROLE]"
    any_name: str = "[SAYS]"
    any_close: str = "[/ROLE]"
    between: str = "[TURN]"
    learnt: tuple = ("assistant",)

    @property
    def controls(self) -> list[str]:
        marks = [self.begin, self.any_open, self.any_name, self.any_close, self.between]
        return list(dict.fromkeys(marks + [m for pair in self.roles.values() for m in pair]))

    @property
    def closes(self) -> list[str]:
        return list(dict.fromkeys([self.any_close] + [pair[1] for pair in self.roles.values()]))

    def __post_init__(self):
        for a in self.controls:
            if not re.fullmatch(r"[<\[][^<\[\\]+", a) or any(a != b and b.startswith(a) for b in self.controls):
                raise ValueError(f"not a usable control string: {a!r}")


MISTRAL_LIKE = Template()


def _pattern(template: Template, slashes: str) -> str:
    tails = "|".join(re.escape(c[1:]).replace("/", "\\/") for c in template.controls)
    return rf"([<\[])({slashes})({tails})"


def escape(text: Column, template: Template = MISTRAL_LIKE) -> Column:
    """``text`` without control strings; ``unescape`` gives it back."""
    marked = F.regexp_replace(text, _pattern(template, r"\\*"), r"$1\\$2$3")
    return F.when(text.contains("<") | text.contains("["), marked).otherwise(text)


def unescape(text: Column, template: Template = MISTRAL_LIKE) -> Column:
    plain = F.regexp_replace(text, _pattern(template, r"\\+").replace(r"(\\+)", r"\\(\\*)"), "$1$2$3")
    return F.when(text.contains("\\"), plain).otherwise(text)


def _by_role(role: Column, template: Template, side: int, other: Column) -> Column:
    out = F
    for name, marks in template.roles.items():
        out = out.when(role == name, F.lit(marks[side]))
    return out.otherwise(other)


def format_conversations(turns: DataFrame, template: Template = MISTRAL_LIKE, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_blocks, segments, formatted) per conversation.

    ``formatted`` is the string to train on; ``segments`` are its consecutive
    parts (text, loss), loss being true for the texts of the learnt roles alone:
    marks, and what separates two texts of one block, are not learnt.

    Turns are ordered by turn (null first), then role and text, so repeated rows
    and equal turn numbers are turns of their own in a fixed order.  Null roles
    and texts count as empty, malformed UTF-8 as U+FFFD.  A null conv_id is one
    conversation.  Other columns are ignored.  Empty table: empty result.  One
    conversation is one row and has to fit into one, as its result is one
    string."""
    clean = [F.coalesce(F.make_valid_utf8(F.col(c)), F.lit("")) for c in (role_col, text_col)]
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), clean[0].alias("role"), clean[1].alias("text")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    at = F.sequence(F.lit(1), F.size("turns"))
    # 1-based places at which the role changes, and one past the end
    first = F.filter(at, lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]))
    cut = whole.withColumn("cuts", F.concat(first, F.array(F.size("turns") + 1)))
    merged = F.transform(
        F.filter("cuts", lambda i: i <= F.size("turns")),
        lambda i, k: F.struct(
            F.get("turns", i - 1)["role"].alias("role"),
            F.transform(F.slice("turns", i, F.get("cuts", k + 1) - i),
                        lambda t: escape(t["text"], template)).alias("texts")))
    blocks = cut.select("conv_id", F.size("turns").cast("long").alias("n_turns"), merged.alias("blocks"))

    def mark(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def render(block: Column) -> Column:
        role = block["role"]
        named = F.concat(F.lit(template.any_open), escape(role, template), F.lit(template.any_name))
        learnt = role.isin(*template.learnt)
        texts = F.flatten(F.transform(block["texts"], lambda t, k: F.when(
            k == 0, F.array(F.struct(t.alias("text"), learnt.alias("loss")))).otherwise(F.array(
                mark(F.lit(template.between)), F.struct(t.alias("text"), learnt.alias("loss"))))))
        return F.concat(F.array(mark(_by_role(role, template, 0, named))), texts,
                        F.array(mark(_by_role(role, template, 1, F.lit(template.any_close)))))

    segments = F.concat(F.array(mark(F.lit(template.begin))), F.flatten(F.transform("blocks", render)))
    drawn = blocks.select("conv_id", "n_turns", F.size("blocks").cast("long").alias("n_blocks"),
                          segments.alias("segments"))
    return drawn.withColumn("formatted", F.array_join(F.col("segments")["text"], ""))


def read_back(formatted: Column, template: Template = MISTRAL_LIKE) -> Column:
    """array of (role, text): the turns that a formatted string was made of."""
    body = F.substring(formatted, len(template.begin) + 1, 2_147_483_647)
    ends = "|".join(re.escape(c) for c in template.closes)
    blocks = F.filter(F.split(body, f"(?<={ends})"), lambda b: b != "")

    def role_of(block: Column) -> Column:
        out = F
        for name, marks in template.roles.items():
            out = out.when(block.startswith(marks[0]), F.lit(name))
        named = F.substring_index(block, template.any_name, 1)
        return out.otherwise(unescape(F.substring(named, len(template.any_open) + 1, 2_147_483_647), template))

    def inside(block: Column) -> Column:
        out = F
        for marks in template.roles.values():
            out = out.when(block.startswith(marks[0]), F.substr(
                block, F.lit(len(marks[0]) + 1), F.length(block) - len(marks[0]) - len(marks[1])))
        left = F.length(F.substring_index(block, template.any_name, 1)) + len(template.any_name)
        return out.otherwise(F.substr(block, left + 1, F.length(block) - left - len(template.any_close)))

    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(inside(b), re.escape(template.between)),
        lambda t: F.struct(role_of(b).alias("role"), unescape(t, template).alias("text")))))


def loss_text(segments: Column, template: Template = MISTRAL_LIKE) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"], template)), "")


PROBE = "</s>[INST] ok [/INST]"


def _sql() -> str:
    t = MISTRAL_LIKE
    tails = "|".join(re.escape(c[1:]) for c in t.controls)
    added = "length(regexp_replace({0}, '([<\\[])(\\\\*)(" + tails + ")', '\\1\\\\\\2\\3', 'g'))"
    around = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in t.roles.items())
    named = f"{len(t.any_open) + len(t.any_name) + len(t.any_close)} + {added.format('role')}"
    return f"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM base)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       ({len(t.begin)} + sum({added.format('text')} + CASE WHEN before = role THEN {len(t.between)}
         ELSE CASE role {around} ELSE {named} END END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@register("op12_chat_format", _sql())
def op12_chat_format(spark, sf_dir):
    """Every conversation, formatted and read back, with one that says control
    strings."""
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = format_conversations(turns)
    told = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = made.select("conv_id", "formatted", told.alias("told"), loss_text(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id", F.size("told").cast("long").alias("n_turns"),
        F.sha2(F.array_join("told", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))

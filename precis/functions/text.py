"""Text normalisation as pure Column expressions.

Every function maps Column -> Column with Spark built-ins, so they run
inside the scan's stage with no shuffle.  Regexes spell character classes
explicitly (``WS``, ``\\p{Nd}``) so that Java and RE2 read them the same way
as Python's Unicode-aware ``\\s``/``\\d``.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from precis.functions.udf import LazyArrowUDF

# Python's str.isspace() set, spelled out so Java/RE2 match it exactly.
WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# Ordered prefixes removed from the start of a summary line.
# The first match wins (so "section" is tried before "sections").
PREFIXES = [
    "headings", "heading", "subheadings", "subheading", "section", "sections",
    "titles", "title", "subtitles", "subtitle", "sub-titles", "sub-title",
    "sub-heading", "sub-headings", "bullet-points", "bullet-point", "bullets",
    "bullet", "summary", "summaries", "theme", "themes", "topic", "topics",
    "themes/topics", "theme/topic", "i.", "i:", "ii.", "ii:", "iii.", "iii:",
]

# Line starts that mark a trailing note line.
NOTE_PREFIXES = ["note:", "notes:", "overall summary:", "summary:", "overall:"]

# Characters trimmed from both ends of a summary line.
LINE_TRIM = " -.*:"


#: texts that a worker holds as Python strings at once
NFKD_TEXTS = 64


def _nfkd(texts: pa.Array) -> pa.Array:
    """NFKD of an Arrow array, a few texts at a time; pieces of ASCII, which NFKD
    leaves alone, are handed on as they are."""
    out = [texts.slice(0, 0)]
    for k in range(0, len(texts), NFKD_TEXTS):
        part = texts.slice(k, NFKD_TEXTS)
        if not pc.all(pc.string_is_ascii(part)).as_py():
            part = pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in part.to_pylist()], texts.type)
        out.append(part)
    return pa.concat_arrays(out)


nfkd = LazyArrowUDF(_nfkd, "string")


def clean_transcript(text: Column, normalize: bool = True) -> Column:
    """NFKD, then four literal single-pass replacements."""
    t = nfkd(text) if normalize else text
    t = F.replace(t, F.lit("\n\n"), F.lit("\n"))
    t = F.replace(t, F.lit("  "), F.lit(" "))
    t = F.replace(t, F.lit('"""'), F.lit('"'))
    return F.replace(t, F.lit('""'), F.lit('"'))


def clean_summary(text: Column) -> Column:
    """Lines by CRLF when that gives 12, else by LF; drop a leading "- ",
    add "." to every line not ending in "?", join with a space."""
    by_crlf = F.split(text, "\r\n", -1)
    lines = F.when(F.size(by_crlf) == 12, by_crlf).otherwise(F.split(text, "\n", -1))

    def fix(line: Column) -> Column:
        body = F.when(line.startswith("- "),
                      line.substr(F.lit(3), F.length(line))).otherwise(line)
        return F.when(body.endswith("?"), body).otherwise(F.concat(body, F.lit(".")))

    return F.array_join(F.transform(lines, fix), " ")


def remove_empty_lines(text: Column) -> Column:
    """Collapse blank-line runs (with surrounding whitespace) into one LF."""
    return F.regexp_replace(text, f"{WS}*\n{WS}*\n{WS}*", "\n")


def is_note_line(line: Column) -> Column:
    """C4: line starts, case-insensitively, with a note marker."""
    low = F.lower(line)
    cond = None
    for p in NOTE_PREFIXES:
        c = low.startswith(p)
        cond = c if cond is None else (cond | c)
    return cond


def strip_prefix_words(line: Column, low: Column | None = None) -> Column:
    """Remove the first matching prefix (ordered, case-insensitive, once).
    ``low`` may pass a precomputed lower-case form of ``line``."""
    low = F.lower(line) if low is None else low
    expr = None
    for p in PREFIXES:
        cut = line.substr(F.lit(len(p) + 1), F.greatest(F.length(line), F.lit(1)))
        expr = (F.when(low.startswith(p), cut) if expr is None
                else expr.when(low.startswith(p), cut))
    return expr.otherwise(line)


def _cut_numbered(s: Column) -> Column:
    cut = F.btrim(s.substr(F.instr(s, ".") + 2, F.greatest(F.length(s), F.lit(1))), F.lit(LINE_TRIM))
    return F.when(s.rlike(r"^\p{Nd}[.:]"), cut).otherwise(s)


def strip_line(line: Column) -> Column:
    """Prefix words off, LF removed, trim " -.*:"; a "<digit>." or
    "<digit>:" start is cut after the first "." plus one character."""
    s = F.btrim(F.replace(strip_prefix_words(line), F.lit("\n"), F.lit("")), F.lit(LINE_TRIM))
    return _cut_numbered(s)


def strip_suffix(line: Column) -> Column:
    """Drop a trailing ": " or ":"."""
    n = F.length(line)
    return (F.when(line.endswith(": "), line.substr(F.lit(1), n - 2))
             .when(line.endswith(":"), line.substr(F.lit(1), n - 1))
             .otherwise(line))


def prefix_stripped_lines(lines: Column) -> Column:
    """C5 over an array of lines.  Lambda bodies are interpreted and do not
    share subexpressions, so the work is staged: each stage computes its
    value once and the next stage reads it through the lambda variable."""
    with_low = F.transform(lines, lambda x: F.struct(x.alias("x"), F.lower(x).alias("l")))
    return F.transform(with_low, lambda p: strip_prefix_words(p["x"], p["l"]))


def stripped_lines(lines: Column, suffix: bool = True) -> Column:
    """C6 (+ C7) over an array of lines, staged (see prefix_stripped_lines)."""
    s = F.transform(prefix_stripped_lines(lines),
                    lambda x: F.btrim(F.replace(x, F.lit("\n"), F.lit("")), F.lit(LINE_TRIM)))
    s = F.transform(s, _cut_numbered)
    return F.transform(s, strip_suffix) if suffix else s


def clean_prediction(text: Column) -> Column:
    """Normalise a model's summary into clean lines."""
    lines = F.split(remove_empty_lines(text), "\n", -1)
    kept = F.when(is_note_line(F.element_at(lines, -1)),
                  F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return remove_empty_lines(F.array_join(F.filter(stripped_lines(kept), lambda x: F.length(x) > 2), "\n"))


def topic_string(topics: Column) -> Column:
    """C10: "a,b" -> "a, b." (topic approach)."""
    return F.concat(F.replace(topics, F.lit(","), F.lit(", ")), F.lit("."))


def persona_context(topics: Column) -> Column:
    """C10 persona variant: the expert sentence around the topic list."""
    return F.concat(F.lit("You are an expert on the following topic(s): "),
                    F.replace(topics, F.lit(","), F.lit(", ")), F.lit("."))


def py_strip(s: Column) -> Column:
    """Python str.strip(): remove Unicode whitespace at both ends."""
    return F.regexp_replace(s, f"^{WS}+|{WS}+\\z", "")


def topic_token(topic: Column) -> Column:
    """C11: lower, strip, spaces -> underscores."""
    return F.replace(py_strip(F.lower(topic)), F.lit(" "), F.lit("_"))


def short_label(label: Column, width: int = 20) -> Column:
    """Labels longer than ``width`` become their first ``width`` chars + "..."."""
    return F.when(F.length(label) > width,
                  F.concat(F.substring(label, 1, width), F.lit("..."))).otherwise(label)


def dialogue_text(messages: Column) -> Column:
    """array<struct<role,content>> -> "role:\\ncontent\\n\\n" per message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(
        m["role"], F.lit(":\n"), m["content"], F.lit("\n\n"))), "")


def induction_cleanup(text: Column) -> Column:
    """C14: drop chat-role residue from induced instructions."""
    return F.replace(F.replace(text, F.lit("assistant: "), F.lit("")),
                     F.lit("\n----------\n"), F.lit(""))


def reference_sentences(reference: Column) -> Column:
    """Split a reference on ". " / "? "; the last piece loses end "." and "?"."""
    parts = F.split(reference, f"\\.{WS}|\\?{WS}", -1)
    last = F.btrim(F.element_at(parts, -1), F.lit(".?"))
    return F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(last))


def candidate_sentences(candidate: Column) -> Column:
    """A candidate's sentences are its lines."""
    return F.split(candidate, "\n", -1)

"""DuckDB SQL mirrors of the text expressions, used only to build the
oracle strings of the correctness check.  Each helper takes a SQL
expression and returns a SQL expression."""

from __future__ import annotations

from precis.functions.text import LINE_TRIM, NOTE_PREFIXES, PREFIXES, WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def remove_empty_lines(e: str) -> str:
    return f"regexp_replace({e}, '{WS}*\\n{WS}*\\n{WS}*', chr(10), 'g')"


def is_note_line(e: str) -> str:
    return "(" + " OR ".join(f"starts_with(lower({e}), {q(p)})" for p in NOTE_PREFIXES) + ")"


def strip_prefix_words(e: str) -> str:
    whens = " ".join(f"WHEN starts_with(lower({e}), {q(p)}) THEN substr({e}, {len(p) + 1})"
                     for p in PREFIXES)
    return f"(CASE {whens} ELSE {e} END)"


def strip_line(e: str) -> str:
    s = f"trim(replace({strip_prefix_words(e)}, chr(10), ''), {q(LINE_TRIM)})"
    return (f"(CASE WHEN regexp_matches({s}, '^\\p{{Nd}}[.:]') "
            f"THEN trim(substr({s}, instr({s}, '.') + 2), {q(LINE_TRIM)}) ELSE {s} END)")


def strip_suffix(e: str) -> str:
    return (f"(CASE WHEN ends_with({e}, ': ') THEN left({e}, length({e}) - 2) "
            f"WHEN ends_with({e}, ':') THEN left({e}, length({e}) - 1) ELSE {e} END)")


def clean_prediction(e: str) -> str:
    lines = f"string_split({remove_empty_lines(e)}, chr(10))"
    kept = (f"(CASE WHEN {is_note_line(f'({lines})[len({lines})]')} "
            f"THEN ({lines})[1:len({lines}) - 1] ELSE {lines} END)")
    cleaned = f"list_transform({kept}, lambda x: {strip_suffix(strip_line('x'))})"
    return remove_empty_lines(f"array_to_string(list_filter({cleaned}, lambda x: length(x) > 2), chr(10))")


def clean_summary(e: str) -> str:
    crlf = f"string_split({e}, chr(13) || chr(10))"
    lines = f"(CASE WHEN len({crlf}) = 12 THEN {crlf} ELSE string_split({e}, chr(10)) END)"
    body = f"list_transform({lines}, lambda l: CASE WHEN starts_with(l, '- ') THEN substr(l, 3) ELSE l END)"
    return (f"array_to_string(list_transform({body}, lambda l: CASE WHEN ends_with(l, '?') "
            f"THEN l ELSE l || '.' END), ' ')")


def clean_transcript(e: str) -> str:
    t = f"replace({e}, chr(10) || chr(10), chr(10))"
    t = f"replace({t}, '  ', ' ')"
    t = f"replace({t}, '\"\"\"', '\"')"
    return f"replace({t}, '\"\"', '\"')"


def py_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+\\z', '', 'g')"


def short_label(e: str, width: int = 20) -> str:
    return f"(CASE WHEN length({e}) > {width} THEN left({e}, {width}) || '...' ELSE {e} END)"


def reference_sentences(e: str) -> str:
    parts = f"regexp_split_to_array({e}, '\\.{WS}|\\?{WS}')"
    return f"list_concat(({parts})[1:len({parts}) - 1], [trim(({parts})[len({parts})], '.?')])"


def per_line(e: str, fn) -> str:
    return f"array_to_string(list_transform(string_split({e}, chr(10)), lambda x: {fn('x')}), chr(10))"

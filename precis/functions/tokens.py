"""Sentence/word tokenisation used by the ROUGE preprocessing (C9) and the
ROUGE scorer's own tokeniser.

The reference used library tokenisers (Punkt sentences, Treebank words)
that are not available here; this module fixes one documented regex
tokeniser that reads the same in Spark (Java regex) and DuckDB (RE2):

* sentence ends: one of ``.!?`` followed by whitespace;
* word tokens: runs of letters/digits/underscore, or any single other
  non-space character (punctuation becomes its own token).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis.functions.text import WS, py_strip

WS_CHARS = WS[1:-1]
SENT_MARK = "\u0001"
SENTENCE_END = f"([.!?]){WS}+"
WORD_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^{WS_CHARS}\p{{L}}\p{{N}}_]"

# English stop-word list (the 179-word NLTK English list).
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s",
    "t", "can", "will", "just", "don", "don't", "should", "should've", "now", "d",
    "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]


def sentences(text: Column) -> Column:
    """Split into sentences after ``.!?`` + whitespace; empty pieces dropped."""
    marked = F.regexp_replace(py_strip(text), SENTENCE_END, "$1" + SENT_MARK)
    return F.filter(F.split(marked, SENT_MARK, -1), lambda s: F.length(s) > 0)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0))


def rouge_preprocess(text: Column, stops: list[str] | None = None) -> Column:
    """Lower, sentence split, commas dropped, word tokens, the last token
    of every sentence popped, stop words dropped; tokens joined by a space and
    sentences by a newline."""
    stops = STOP_WORDS if stops is None else stops

    def one(sent: Column) -> Column:
        toks = word_tokens(F.replace(sent, F.lit(","), F.lit("")))
        popped = F.when(F.size(toks) > 0, F.slice(toks, 1, F.size(toks) - 1)) \
                  .otherwise(F.array().cast("array<string>"))
        return F.array_join(F.filter(popped, lambda t: ~t.isin(stops)), " ")

    return F.array_join(F.transform(sentences(F.lower(text)), one), "\n")


def scorer_tokens(text: Column) -> Column:
    """The ROUGE scorer's tokeniser: lower, non-[a-z0-9] runs to spaces,
    whitespace split, empty tokens dropped."""
    cleaned = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(cleaned), " ", -1), lambda t: F.length(t) > 0)


def sql_sentences(expr: str) -> str:
    return (f"list_filter(string_split(regexp_replace({sql_py_strip(expr)}, '{SENTENCE_END}', "
            f"'\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0)")


def sql_py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+\\z', '', 'g')"


def sql_rouge_preprocess(expr: str) -> str:
    stop_list = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    toks = f"regexp_extract_all(replace(s, ',', ''), '{WORD_TOKEN}')"
    popped = f"(CASE WHEN len({toks}) > 0 THEN ({toks})[1:len({toks}) - 1] ELSE [] END)"
    one = f"array_to_string(list_filter({popped}, lambda t: NOT list_contains([{stop_list}], t)), ' ')"
    return f"array_to_string(list_transform({sql_sentences(f'lower({expr})')}, lambda s: {one}), chr(10))"


def sql_scorer_tokens(expr: str) -> str:
    return (f"list_filter(string_split(trim(regexp_replace(lower({expr}), '[^a-z0-9]+', ' ', 'g')), ' '),"
            f" lambda t: length(t) > 0)")

"""Number-word dimension for numeric-hallucination checks.

Matching is against single whitespace tokens, so only numbers that spell
as one token matter: 0-99 (with hyphenated 21-99) and their ordinals; the
scale words map to their values.  The table is generated by rule.
"""

from __future__ import annotations

# English number words.
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
         "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
         "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
UNIT_ORDINALS = ["zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh",
                 "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth",
                 "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth"]
TENS_ORDINALS = ["", "", "twentieth", "thirtieth", "fortieth", "fiftieth", "sixtieth",
                 "seventieth", "eightieth", "ninetieth"]
SCALES = {"hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000}


def cardinal(n: int) -> str:
    if n < 20:
        return UNITS[n]
    t, u = divmod(n, 10)
    return TENS[t] if u == 0 else f"{TENS[t]}-{UNITS[u]}"


def ordinal(n: int) -> str:
    if n < 20:
        return UNIT_ORDINALS[n]
    t, u = divmod(n, 10)
    return TENS_ORDINALS[t] if u == 0 else f"{TENS[t]}-{UNIT_ORDINALS[u]}"


def digit_words() -> dict[str, tuple[str, str]]:
    """Canonical digit string -> (cardinal word, ordinal word), 0-99."""
    return {str(n): (cardinal(n), ordinal(n)) for n in range(100)}


def word_values() -> dict[str, int]:
    """Single-token number words -> value, read the way a word-to-number
    parser reads a token: hyphens split it, and only number words count
    (so "forty-first" reads as 40)."""
    out: dict[str, int] = {}
    for n in range(100):
        out[cardinal(n)] = n
    for t in range(2, 10):
        for u in range(1, 10):
            out[f"{TENS[t]}-{UNIT_ORDINALS[u]}"] = t * 10
    for w, v in SCALES.items():
        out[w] = v
    return out

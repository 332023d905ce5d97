"""Toxicity by a misspelling-tolerant lexicon (operator 6).

The lexicon is learnt from labelled rows.  Levenshtein automata of its terms find
exact and misspelt ones; a word runs through those of the terms that it shares its
first letters with, all but a few.  The words around a hit and quotation marks
separate quoting from abuse.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm import textvec
from precis.llm.common import id_bucket, lean, load, materialize
from precis.plans.registry import register

#: states of one automaton, about; a term is in LEAST toxic documents
STATES = 1 << 15
LEAST = 3
SPAN = 6
#: characters often written for a letter, and quotation marks
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
APOSTROPHES = "'’"
QUOTES = "\"'`‘’‚“”„«»‹›"
#: first letters of a word and a term that are compared by hashes, and how many
#: hashes a part of a lexicon has, about
HEAD = 10
KEYS = 1 << 20
#: bytes of texts whose distinct words are looked up together, and pairs of a word
#: and a term that are run together: both bound a task's memory, some 100 MB
SLICE = 1 << 20
PAIRS = 1 << 17
PLACE = np.array([pow(textvec.BASE, k, 1 << 64) for k in range(HEAD)], np.uint64)
BACK = np.uint64(pow(textvec.BASE, -1, 1 << 64))
WORD = r"[^\p{L}\p{N}]+"


def allowed_edits(term: str) -> int:
    """Edits within which a word still counts as ``term``."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """Deterministic automaton of all words within ``allowed_edits`` of a term.

    A state is a set of (trie node, edits); the trie is kept apart for each
    number of allowed edits.  Symbols are the letters of the lexicon, each with
    its capital and look-alikes, and one symbol for every other character.  Only
    the first ``fuzzy`` terms, if given, may have edits; ``full`` tells that more
    than ``most`` states were needed, and nothing else is built then.
    ``letters``, if given, are those of a lexicon that the terms are a part of."""

    def __init__(self, terms: list[str], fuzzy: int | None = None, most: int | None = None,
                 letters: list[str] | None = None):
        self.terms, self.full = terms, False
        self.letters = sorted(set("".join(terms))) if letters is None else letters
        edits_of = [allowed_edits(t) if fuzzy is None or k < fuzzy else 0 for k, t in enumerate(terms)]
        self.longest = max((len(t) + k for t, k in zip(terms, edits_of, strict=True)), default=0)
        children: list[dict[str, int]] = []
        ends: dict[int, int] = {}
        roots: dict[int, int] = {}
        for number, term in enumerate(terms):
            edits = edits_of[number]
            if edits not in roots:
                roots[edits] = len(children)
                children.append({})
            node = roots[edits]
            for char in term:
                if char not in children[node]:
                    children[node][char] = len(children)
                    children.append({})
                node = children[node][char]
            ends.setdefault(node, number)
        limit = {}
        for edits, root in roots.items():
            stack = [root]
            while stack:
                node = stack.pop()
                limit[node] = edits
                stack.extend(children[node].values())

        def closed(items: dict[int, int]) -> frozenset:
            todo = list(items.items())
            while todo:
                node, edits = todo.pop()
                if edits < limit[node]:
                    for child in children[node].values():  # a letter left out
                        if items.get(child, 99) > edits + 1:
                            items[child] = edits + 1
                            todo.append((child, edits + 1))
            return frozenset(items.items())

        def step(state: frozenset, char: str) -> frozenset:
            out: dict[int, int] = {}
            for node, edits in state:
                if edits < limit[node]:
                    out[node] = min(out.get(node, 99), edits + 1)  # a letter too many
                for own, child in children[node].items():
                    cost = edits + (own != char)
                    if cost <= limit[node]:
                        out[child] = min(out.get(child, 99), cost)
            return closed(out)

        start = closed({root: 0 for root in roots.values()})
        number = {frozenset(): 0, start: 1}
        order, rows = [frozenset(), start], []
        for state in order:
            if most is not None and len(order) > most:
                self.full = True
                return
            row = []
            for char in ["", *self.letters]:
                to = step(state, char)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        self.moves = np.array(rows, np.int32)
        best = [min(((e, ends[n]) for n, e in state if n in ends), default=(-1, -1)) for state in order]
        self.edits = np.array([b[0] for b in best], np.int32)
        self.term = np.array([b[1] for b in best], np.int32)

    @classmethod
    def within(cls, terms: list[str], most: int = STATES) -> Automaton:
        """The automaton with edits for as many of the first terms as ``most``
        states allow; it finds all terms exactly in any case."""
        fuzzy = len(terms)
        while fuzzy:
            machine = cls(terms, fuzzy, most)
            if not machine.full:
                return machine
            fuzzy //= 2
        return cls(terms, 0)

    def symbols(self) -> np.ndarray:
        """Code point -> symbol."""
        return _symbols(self.letters)

    def match(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the matching words and their final states."""
        which = np.flatnonzero((ends - starts <= self.longest) & (ends > starts))
        state = np.ones(len(which), np.int32)
        found, finals = [], []
        for k in range(self.longest + 1):
            over = ends[which] - starts[which] == k
            hit = over & (self.term[state] >= 0)
            found.append(which[hit])
            finals.append(state[hit])
            which, state = which[~over], state[~over]
            state = self.moves[state, symbols[starts[which] + k]]
            which, state = which[state > 0], state[state > 0]
        found = np.concatenate(found) if found else which
        order = np.argsort(found, kind="stable")
        return found[order], np.concatenate(finals)[order] if finals else state


def _symbols(letters: list[str]) -> np.ndarray:
    """Code point -> symbol: 1 and on for the letters, their capitals and look-alikes."""
    table = np.zeros(0x110000, np.int32)
    for k, char in enumerate(letters, 1):
        for same in {char, char.upper(), *(a for a, b in LOOKALIKES.items() if b == char)}:
            if len(same) == 1:
                table[ord(same)] = k
    return table


class Near:
    """Terms with the same number of allowed ``edits``, for many words at once.

    A word within so many edits of a term and the term are equal once up to that
    many letters are left out of the first HEAD letters of each.  Hashes of what is
    left lead a word to the terms whose Levenshtein automata it runs through; no
    automaton is built, as its state is the least edits on each diagonal."""

    def __init__(self, terms: list[str], edits: int, number: dict[str, int]):
        self.terms, self.edits = terms, edits
        self.sizes = np.array([len(t) for t in terms])
        self.values = textvec.mix(np.arange(1, len(number) + 2, dtype=np.uint64))
        # letters of the terms, with room on both sides for the outer diagonals
        self.rows = np.full((len(terms), int(self.sizes.max()) + 2 * edits + 1), -1, np.int32)
        for row, term in zip(self.rows, terms, strict=True):
            row[edits:edits + len(term)] = [number[c] for c in term]
        keys, owners = [], []
        heads = np.minimum(self.sizes, HEAD)
        for size in np.unique(heads):
            which = np.flatnonzero(heads == size)
            for key in self._left(self.rows[which, edits:edits + size]):
                keys.append(key)
                owners.append(which)
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.owners = owners[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        bits = min(24, max(16, (64 * len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        self.known[self.keys >> self.shift] = True

    def _left(self, heads: np.ndarray) -> Iterator[np.ndarray]:
        """Hashes of the rows of ``heads`` with none up to ``edits`` letters left out."""
        size = heads.shape[1]
        sums = np.zeros((size + 1, len(heads)), np.uint64)
        np.cumsum(self.values[heads.T] * PLACE[:size, None], axis=0, out=sums[1:])
        yield sums[size]
        if self.edits:
            once = sums * BACK  # as the letters after one gap count
            for i in range(size):
                yield sums[i] + (once[size] - once[i + 1])
        if self.edits > 1:
            twice = once * BACK
            before, after = sums[:-1] - once[1:], once[:-1] + (twice[size] - twice[1:])
            for i in range(size):
                for k in range(i + 1, size):
                    yield before[i] + after[k]

    def _met(self, heads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, keys) of rows of ``heads`` that leave a key of a term."""
        for left in self._left(heads):
            rows = np.flatnonzero(self.known[left >> self.shift])
            if len(rows):
                at = np.minimum(np.searchsorted(self.keys, left[rows]), len(self.keys) - 1)
                same = self.keys[at] == left[rows]
                yield rows[same], at[same]

    def candidates(self, heads: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, terms): the first letters of words of one ``size``, and the terms
        that such a word may be near."""
        met = [x for x in self._met(heads) if len(x[0])]
        if not met:
            return
        rows, keys = (np.concatenate(x) for x in zip(*met, strict=True))
        fits = np.abs(self.sizes - size) <= self.edits
        count = self.first[keys + 1] - self.first[keys]
        total = np.cumsum(count)
        for begin in range(0, int(total[-1]), PAIRS):  # pairs of a row and a term, some of them twice
            pair = np.arange(begin, min(begin + PAIRS, int(total[-1])))
            met = np.searchsorted(total, pair, "right")
            term = self.owners[self.first[keys[met]] + pair - (total[met] - count[met])]
            fit = fits[term]
            codes = np.unique(rows[met[fit]] * len(self.terms) + term[fit])
            yield codes // len(self.terms), codes % len(self.terms)

    def run(self, words: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs each word through the automaton of its term: the accepted pairs
        and their edits.  ``state[d]`` is the least edits after the letters read, if
        as many of the term less ``edits`` plus d are used."""
        pairs, edits, size = np.arange(len(terms)), self.edits, words.shape[1]
        state = np.full((2 * edits + 1, len(terms)), 99, np.int32)
        state[edits:] = np.arange(edits + 1)[:, None]
        for k in range(size):
            letter, new = words[pairs, k], np.full_like(state, 99)
            for d in range(2 * edits + 1):
                if k + 1 + d < edits:
                    continue  # more letters left out than read
                # column of the letter in a row: its place plus ``edits``
                new[d] = state[d] + (self.rows[terms[pairs], np.minimum(k + d, self.rows.shape[1] - 1)] != letter)
                if d < 2 * edits:
                    np.minimum(new[d], state[d + 1] + 1, out=new[d])  # a letter too many
                if d:
                    np.minimum(new[d], new[d - 1] + 1, out=new[d])  # a letter left out
            alive = new.min(axis=0) <= edits
            pairs, state = (pairs[alive], new[:, alive]) if not alive.all() else (pairs, new)
        final = state[self.sizes[terms[pairs]] - size + edits, np.arange(len(pairs))]
        return pairs[final <= edits], final[final <= edits]


class Lexicon:
    """All ``terms``, each with its edits, in parts of the same number of edits
    and at most about ``most`` keys."""

    def __init__(self, terms: list[str], most: int = KEYS):
        self.letters = sorted(set("".join(terms)))
        number = {c: k for k, c in enumerate(self.letters, 1)}
        self.parts: list[Near] = []
        for edits in (0, 1, 2):
            some, keys = [], 0
            for term in (t for t in terms if allowed_edits(t) == edits):
                own = sum(math.comb(min(len(term), HEAD), k) for k in range(edits + 1))
                if some and keys + own > most:
                    self.parts.append(Near(some, edits, number))
                    some, keys = [], 0
                some.append(term)
                keys += own
            if some:
                self.parts.append(Near(some, edits, number))

    def symbols(self) -> np.ndarray:
        """Code point -> symbol, the same in all parts."""
        return _symbols(self.letters)

    def match(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the matching words and their least edits."""
        least, sizes = np.full(len(starts), 99, np.int32), ends - starts
        by_size = np.argsort(sizes, kind="stable")
        for size in np.unique(sizes).tolist():
            parts = [p for p in self.parts if size and np.abs(p.sizes - size).min() <= p.edits]
            if not parts:
                continue
            which = by_size[slice(*np.searchsorted(sizes, [size, size + 1], sorter=by_size))]
            heads = symbols[starts[which][:, None] + np.arange(min(size, HEAD))]
            for part in parts:
                for rows, terms in part.candidates(heads, size):
                    kept, edits = part.run(symbols[starts[which[rows]][:, None] + np.arange(size)], terms)
                    np.minimum.at(least, which[rows[kept]], edits)
        found = np.flatnonzero(least < 99)
        return found, least[found]


class _Chars:
    """Which code points are letters or digits."""

    alnum: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.alnum is None:
            cls.alnum = np.array([chr(p).isalnum() for p in range(0x110000)])
        return cls.alnum


def _decoded(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, its code points, and the offsets of the texts in it."""
    text = data.tobytes().decode("utf-8", "replace")
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if chars[-1] != len(text):  # malformed bytes were replaced: go text by text
        parts = [data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(offsets) - 1)]
        text, chars = "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), chars


def _distinct(points: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of code points that follow each other, and the place of
    each word in them."""
    wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.append(0, np.cumsum(wide))[np.append(0, np.cumsum(sizes))]
    data = points.tobytes().decode("utf-32-le").encode("utf-8")
    coded = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]) \
        .dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


@dataclass
class Model:
    """Lexicon, context weights and logistic weights: no more than the words of
    labelled texts that pass the tests."""

    terms: list[str] = field(default_factory=list)
    context: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-2.0])
    _machine: Lexicon | None = None
    _symbols: np.ndarray | None = None

    def __getstate__(self):
        # a task derives the rest from the terms, which are far smaller
        return {"terms": self.terms, "context": self.context, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state, _machine=None, _symbols=None)

    def hits(self, texts: pa.Array, words: bool = False):
        """Per text a list of (exact, quoted, context words, context score); the
        words are listed only if ``words`` asks for them.

        Words are runs of letters and digits, as in learning; what stands between
        blanks is tried as a whole too, for look-alikes such as @."""
        if self._machine is None:
            self._machine = Lexicon(self.terms)
        if self._symbols is None:
            self._symbols = self._machine.symbols()
        alnum, quotes = _Chars.get(), set(QUOTES)
        marks = [ord(c) for c in QUOTES]
        for first, end, data, offsets in textvec.slices(texts, SLICE):
            out: list[list] = [[] for _ in range(end - first)]
            text, points, chars = _decoded(data, offsets)
            if len(points) and self.terms:
                starts, ends, _ = textvec.words(np.minimum(points, 255).astype(np.uint8), chars)
                letter = alnum[points]
                s, e, at = textvec.words(np.where(letter, 0x61, 0x20).astype(np.uint8), chars)
                home = np.searchsorted(starts, s, "right") - 1  # of a run: what stands between blanks
                kinds, kind = _distinct(points[letter], e - s)
                spans = self._spans(self._symbols[points], s, e, home, kinds, kind)
                if len(spans):
                    a, b, edits = spans.T
                    i = np.searchsorted(at, a, "right") - 1
                    steps = np.arange(SPAN)
                    near = np.concatenate([a[:, None] - SPAN + steps, b[:, None] + 1 + steps], axis=1)
                    inside = (near >= at[i][:, None]) & (near < at[i + 1][:, None])
                    near = np.where(inside, near, 0)
                    used = np.unique(kind[near[inside]])
                    lower = dict(zip(used.tolist(), (w.lower() for w in kinds.take(pa.array(used)).to_pylist()), strict=True))
                    weight = np.zeros(len(kinds))
                    weight[used] = [self.context.get(w, 0.0) for w in lower.values()]
                    weights = np.where(inside, weight[kind[near]], 0.0)
                    scores = [0.0] * len(a)
                    for k in np.flatnonzero(weights.any(axis=1)).tolist():
                        scores[k] = sum(weights[k].tolist())
                    # what stands on both sides, up to the next run or blank
                    left, right = np.maximum(a - 1, 0), np.minimum(b + 1, len(s) - 1)
                    inner = (a > 0) & (home[left] == home[a]), (b + 1 < len(s)) & (home[right] == home[b])
                    rims = ((np.where(inner[0], e[left], starts[home[a]]), s[a]),
                            (e[b], np.where(inner[1], s[right], ends[home[b]])))
                    quoted = np.zeros(len(a), bool)
                    seen = np.append(0, np.cumsum(np.isin(points, marks)))
                    for within, (x, y) in zip(inner, rims, strict=True):
                        for k in np.flatnonzero(seen[y] > seen[x]).tolist():
                            rim = text[x[k]:y[k]]
                            quoted[k] |= not quotes.isdisjoint(rim) and not (within[k] and rim in APOSTROPHES)
                    listed = [[lower[c] for c, ok in zip(row, there, strict=True) if ok] for row, there in
                              zip(kind[near].tolist(), inside.tolist(), strict=True)] if words else [[]] * len(a)
                    for home_text, *hit in zip(i.tolist(), (edits == 0).tolist(), quoted.tolist(), listed, scores, strict=True):
                        out[home_text].append(tuple(hit))
            yield first, end, out

    def _spans(self, symbols: np.ndarray, s: np.ndarray, e: np.ndarray, home: np.ndarray, kinds: pa.Array,
               kind: np.ndarray) -> np.ndarray:
        """Rows (first run, last run, edits) of all hits.  Several runs with no blank
        between them are a hit together if none of them is one as near.  ``kind``
        is the place of each run in the distinct words ``kinds``."""
        points = np.frombuffer("".join(kinds.to_pylist()).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(pc.utf8_length(kinds).to_numpy())
        least = np.full(len(kinds), 99, np.int32)
        which, edits = self._machine.match(self._symbols[points], np.append(0, ends)[:-1], ends)
        least[which] = edits
        least = least[kind]
        first = np.flatnonzero(np.diff(home, prepend=-1))
        last = np.append(first[1:], len(home)) - 1
        several = np.flatnonzero(last > first)
        which, near = self._machine.match(symbols, s[first[several]], e[last[several]])
        whole = []
        for k, edits in zip(several[which].tolist(), near.tolist(), strict=True):
            inside = least[first[k]:last[k] + 1]
            if inside.min() > edits:
                inside[:] = 99
                whole.append((first[k], last[k], edits))
        runs = np.flatnonzero(least < 99)
        spans = np.concatenate([np.array(whole, np.int64).reshape(-1, 3), np.column_stack([runs, runs, least[runs]])])
        return spans[np.argsort(spans[:, 0])]

    def features(self, hits: list) -> tuple[int, int, int, int]:
        """(plain exact, plain misspelt, quoted) hits up to 3, 2, 2, and the sign
        of the context's score: -1, 0, 1."""
        plain = [h for h in hits if not h[1]]
        exact = sum(1 for h in plain if h[0])
        score = sum(h[3] for h in hits)
        return (min(exact, 3), min(len(plain) - exact, 2), min(len(hits) - len(plain), 2),
                int(score > 1) - int(score < -1))

    @staticmethod
    def row(cell: tuple[int, int, int, int]) -> list[float]:
        exact, fuzzy, quoted, context = cell
        return [1.0, exact >= 1, exact >= 2, exact >= 3, fuzzy >= 1, fuzzy >= 2, quoted >= 1, quoted >= 2, context]

    def score(self, cell: tuple[int, int, int, int]) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.row(cell), strict=False))
        return float(1 / (1 + np.exp(-z)))


#: weights before any row is seen, and how many rows they are worth
PRIOR = [-2.5, 2.0, 0.5, 0.5, 1.0, 0.5, 0.5, 0.0, 0.5]
PRIOR_STRENGTH = 1.0


def fit_logistic(cells: list[tuple[tuple, float, float]]) -> list[float]:
    """Newton steps on (cell, toxic rows, all rows), pulled towards PRIOR; rows
    may be weighted."""
    prior = np.array(PRIOR)
    if not cells:
        return prior.tolist()
    x = np.array([Model.row(c) for c, _, _ in cells], float)
    y, n = np.array([t for _, t, _ in cells], float), np.array([m for _, _, m in cells], float)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - n * p) - PRIOR_STRENGTH * (w - prior)
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + PRIOR_STRENGTH * np.eye(len(w)), grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _salient(counts: DataFrame, toxic: int, clean: int, least: int, lift: float, sure: float,
             weight: float = 1.0):
    """Words of (word, t, n) that toxic rows have far above their share, a clean
    row standing for ``weight`` rows."""
    share = toxic / max(toxic + weight * clean, 1)
    expected = (F.col("t") + weight * (F.col("n") - F.col("t"))) * share
    ratio = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    z = (F.col("t") - expected) / F.sqrt(expected)
    return (counts.filter(F.col("t") >= least).withColumns({"ratio": ratio, "z": z})
            .filter((F.col("ratio") >= lift) & (F.col("z") >= sure)).orderBy(F.desc("z"), "word").collect())


def fit(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> Model:
    """Lexicon, context and weights from labelled rows.

    ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1; a document that
    any row marks is toxic).  All of them are used; a caller who asks for a sample
    gets ``per_class`` documents of each class, the first by id hash.  Each class
    then counts by its share of all labelled documents, so that a sample does not
    move the odds."""
    marked = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    if per_class is not None:
        order = F.xxhash64("doc_id")
        marked = materialize(marked, "marked")
        chosen = (marked.filter("toxic = 1").orderBy(order, "doc_id").limit(per_class)
                  .unionByName(marked.filter("toxic <> 1").orderBy(order, "doc_id").limit(per_class)))
        ids = materialize(chosen, "labelled")
    else:
        ids = marked = materialize(marked, "labelled")
    labelled, taken = ({r["c"]: r["n"] for r in t.groupBy((F.col("toxic") == 1).alias("c")).agg(F.count(F.lit(1)).alias("n"))
                        .collect()} for t in (marked, ids))
    # dealt out by id whatever the size of either side, as the labels grow with the texts
    sample = materialize(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id")
                         .select("text", (F.col("toxic") == 1).cast("int").alias("toxic")), "sample")
    toxic, total = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = toxic or 0, total - (toxic or 0)
    model = Model()
    if not toxic or not clean:
        model.weights = [float(np.log((toxic + 0.5) / (clean + 5.0)))]
        return model
    # rows that a clean row of the sample stands for, a toxic one being one
    weight = labelled[False] / taken[False] / (labelled[True] / taken[True])
    words = F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), WORD))).alias("word")
    counts = (sample.select("toxic", words).filter("word <> ''")
              .groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")))
    model.terms = [r["word"] for r in _salient(counts, toxic, clean, LEAST, 8.0, 5.0, weight)]
    model.context = _context(sample, model)
    cells = sample.mapInArrow(lean(_cells(model)), "e int, f int, q int, c int, toxic int")
    grouped = cells.groupBy("e", "f", "q", "c").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    model.weights = fit_logistic([((r["e"], r["f"], r["q"], r["c"]), r["t"], r["t"] + weight * (r["n"] - r["t"]))
                                  for r in grouped.orderBy("e", "f", "q", "c").collect()])
    return model


def _context(sample: DataFrame, model: Model) -> dict[str, float]:
    """Log-odds weights of words near hits, toxic against other documents."""

    def near(batches):
        for batch in batches:
            label = batch.column("toxic").to_pylist()
            for first, end, found in model.hits(batch.column("text"), words=True):
                rows = [(w, label[first + i]) for i in range(end - first)
                        for w in {w for h in found[i] for w in h[2] if w}]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                                  pa.array([r[1] for r in rows], pa.int32())], names=["word", "toxic"])

    if not model.terms:
        return {}
    counts = materialize(sample.mapInArrow(lean(near), "word string, toxic int").groupBy("word")
                         .agg(F.sum("toxic").alias("t"), (F.count(F.lit(1)) - F.sum("toxic")).alias("c")), "near")
    total = counts.agg(F.sum("t"), F.sum("c")).first()
    if not total[0] or not total[1]:
        return {}
    odds = F.log((F.col("t") + 1) / (total[0] + 1)) - F.log((F.col("c") + 1) / (total[1] + 1))
    spread = F.sqrt(1 / (F.col("t") + 1) + 1 / (F.col("c") + 1))
    top = (counts.withColumns({"odds": odds, "z": F.abs(odds / spread)}).filter("z > 3")
           .orderBy(F.desc("z"), "word").collect())
    return {r["word"]: r["odds"] for r in top}


def _cells(model: Model):
    def count(batches):
        for batch in batches:
            rows = [model.features(h) for _, _, found in model.hits(batch.column("text")) for h in found]
            grid = np.array(rows, np.int32).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*[pa.array(grid[:, k]) for k in range(4)], batch.column("toxic")],
                                             names=["e", "f", "q", "c", "toxic"])

    return count


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with score (0 to 1) and predicted (0/1).
    Null and empty texts score like any text without a hit."""
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for batch in batches:
            value = np.array([model.score(model.features(h)) for _, _, found in model.hits(batch.column("_text"))
                              for h in found], float)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(value, pa.float64()),
                 pa.array((value >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(lean(run), schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""

    def run(batches):
        for batch in batches:
            clean = [model.score(model.features(h)) < 0.5 for _, _, found in model.hits(batch.column(text_col))
                     for h in found]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def fit_on_folds(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows whose crc32(doc_id) mod 5 is not 0."""
    learn = F.coalesce(id_bucket(F.col("doc_id"), 5) != 0, F.lit(False))
    return fit(docs.filter(learn), labels.select("doc_id", "toxic").filter(learn))


@register("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    docs = load(spark, sf_dir, "documents")
    model = fit_on_folds(docs, load(spark, sf_dir, "labels"))
    held = F.coalesce(id_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])

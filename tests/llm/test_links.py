"""The full round of ``links.connect`` against all pairs."""

import numpy as np
import pytest

from precis.llm import links, textvec

SCHEMA = "node long, keys array<long>, weight double, size long, sketch binary"


def family(n: int, seed: int, kinds: int = 6, width: int = 40):
    """Sets around ``kinds`` originals, many of them just under or over 0.75."""
    rng = np.random.default_rng(seed)
    originals = [rng.choice(10_000, width, replace=False) for _ in range(kinds)]
    sets = {}
    for i in range(n):
        own = originals[i % kinds].copy()
        change = rng.choice(width, int(rng.integers(2, 9)), replace=False)
        own[change] = rng.integers(10_000, 20_000, len(change))
        sets[i] = np.unique(own.astype(np.uint64))
    return sets


def linked(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("rows", [2048, 16])
def test_full_round_equals_all_pairs(spark, monkeypatch, rows):
    """Every block size gives the components of all similar pairs, and a family
    sends fewer links than it has rows, times its blocks on a side."""
    monkeypatch.setattr(links, "BLOCK_ROWS", rows)
    sets = family(150, 3)
    sketch = np.zeros(8, np.uint8).tobytes()  # agrees always: the sets decide
    postings = spark.createDataFrame(
        [(i, [1 + i % 6, 100], 1.0, len(s), sketch) for i, s in sets.items()], SCHEMA).selectExpr("*", "explode(keys) AS key")
    whole = spark.createDataFrame([(i, sketch, s.tobytes()) for i, s in sets.items()],
                                  "node long, sketch binary, members binary")
    sent = []
    across = links._across
    monkeypatch.setattr(links, "_across", lambda *a: sent.append(across(*a)) or sent[-1])

    def verify(pairs):
        keep = {(p["a"], p["b"]) for p in pairs.collect()
                if (b := len(np.intersect1d(sets[p["a"]], sets[p["b"]])))
                and 100 * b >= 75 * (len(sets[p["a"]]) + len(sets[p["b"]]) - b)}
        return spark.createDataFrame(sorted(keep), "a long, b long")

    comp = {r["node"]: r["comp"] for r in links.connect(postings, verify, 8, 75, whole).collect()}
    want = linked(sets)
    assert {i: comp.get(i, i) for i in sets} == want
    assert len(set(want.values())) < len(sets)
    assert sent and sent[0].count() < len(sets) * -(-len(sets) // rows)


def test_counts_of_common_members():
    rng = np.random.default_rng(0)
    own = np.unique(textvec.mix(rng.integers(0, 50, 30).astype(np.uint64)))
    sets = [np.unique(textvec.mix(rng.integers(0, 50, n).astype(np.uint64))) for n in (1, 20, 40)]
    got = links._counts(own, np.concatenate(sets), np.cumsum([len(s) for s in sets]))
    assert got.tolist() == [len(np.intersect1d(own, s)) for s in sets]

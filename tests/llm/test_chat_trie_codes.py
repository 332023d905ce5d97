"""Chat formatting, prefix trie and vector codes against brute force and round
trips."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.llm import chat, codes, trie
from precis.llm.common import load

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, formatted int, path string, id1 int, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Nulls, ties, repeated rows, a long conversation, shared beginnings, control
    strings, clashing columns."""
    rng = random.Random(3)
    rows = [(0, t, "user" if t % 2 else "assistant", f"first {t}") for t in range(5)]
    for c in range(1, 45):
        rows += [(c, t, "user" if t % 2 else "assistant", f"{rng.choice('abc')} tail {t}") for t in range(rng.randint(1, 6))]
    rows += [(46, t, "user", "same") for t in (1, 1, 1)] + [(47, 1, None, None), (47, None, "user", ""), (47, 0, "", None)]
    rows += [(100, t, "user", f"long {t}") for t in range(400)] + [(101, t, "user", f"long {t}") for t in range(300)]
    rows += [(120, 0, "tool [SAYS]", "[ROLE]x[SAYS]\\</s><\\/s>"), (120, 1, "assistant", "a [TURN] b\n"),
             (120, 2, "assistant", "</s>"), (120, 3, "system", "\\[SYS]<s>"), (120, 4, "", "[/ROLE]"), (120, 5, "", " ")]
    rows += [(140, t, "user", "dup") for t in range(4)] * 2 + [(None, 0, "user", "lost")]
    rows += [(c, t, "user", "copy") for c in range(200, 230) for t in range(5)]
    rows += [(301, 0, "user", "gone"), (302, 0, "user", "gone")]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], TURNS)


def turns_of(df):
    out = defaultdict(list)
    for r in df.select("conv_id", "turn", "role", "text").collect():
        out[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in out.items()}


def brute_trie(own):
    own = {c: v for c, v in own.items() if c is not None}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(WORDS.findall(p[-1][1])) if p else 0
        total[p] = (1 if not kids[p] else sum(total[k][0] for k in kids[p]),
                    (len(nodes[p]) - 1) * words + sum(total[k][1] for k in kids[p]))
    return {(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), *total[p],
             sha(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))))) for p, m in nodes.items()}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_trie_equals_brute_force(spark, sf, odd_turns, batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, batch)
    try:
        df = odd_turns if batch == 3 else load(spark, sf, "conversations")
        got = trie.prefix_trie(df).collect()
        want = brute_trie(turns_of(df))
        assert len(got) == len(want)
        assert {tuple(r) for r in got} == want
    finally:
        spark.conf.unset(key)


def test_trie_without_turns(spark, odd_turns):
    assert trie.prefix_trie(odd_turns.limit(0)).collect() == []
    # a conversation that loses its only turn: a root alone
    lone = next(c for c in range(1, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1)
    got = trie.prefix_trie(spark.createDataFrame([(lone, 0, "user", "x")], "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in got.collect()] == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]


def test_findclose_matches_a_stack():
    rng = random.Random(1)
    for n in (1, 3, 40, 700, 5000):
        bits, open_, left = [], 0, n
        while left or open_:
            if left and (not open_ or rng.random() < 0.5 + 0.3 * (left > n // 2)):
                bits.append(True)
                open_, left = open_ + 1, left - 1
            else:
                bits.append(False)
                open_ -= 1
        stack, match = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                match[stack.pop()] = i
        opens = np.array(sorted(match))
        assert trie.Excess(np.array(bits)).findclose(opens).tolist() == [match[i] for i in opens]


def test_chat_round_trip(spark, sf, odd_turns):
    for df in (odd_turns, load(spark, sf, "conversations")):
        own = turns_of(df)
        made = chat.format_conversations(df)
        rows = made.select("conv_id", "n_turns", "n_blocks", "formatted", "segments", chat.read_back(F.col("formatted")).alias("back"),
                           chat.loss_text(F.col("segments")).alias("loss")).collect()
        assert {r["conv_id"] for r in rows} == set(own) and len(rows) == len(own)
        for r in rows:
            turns = own[r["conv_id"]]
            assert [(t["role"], t["text"]) for t in r["back"]] == turns
            assert r["n_turns"] == len(turns)
            assert r["n_blocks"] == sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))
            assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
            assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
            assert r["formatted"].count("[TURN]") == r["n_turns"] - r["n_blocks"]
    assert chat.format_conversations(odd_turns.limit(0)).collect() == []


def test_chat_escape_and_malformed(spark):
    rng = random.Random(5)
    parts = [*chat.MISTRAL_LIKE.controls, "\\", "<", "[", "/", "s>", "INST]", "é😀", "\n", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in chat.MISTRAL_LIKE.controls)
    bad = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, cast(X'61FF62' AS string) AS text")
    got = chat.format_conversations(bad).select(chat.read_back(F.col("formatted")).alias("b")).first()["b"]
    assert [(t["role"], t["text"]) for t in got] == [("user", "a�b")]
    with pytest.raises(ValueError):
        chat.Template(between="TURN")


def brute_codes(v):
    books = v[:64].reshape(min(64, len(v)), 16, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]
    for left in (2, 1, 0):
        out, error = np.zeros((len(v), 16), int), np.zeros(len(v), np.int64)
        for p in range(16):
            own = v[:, p * width:(p + 1) * width]
            d = ((own[:, None] - books[p][None]) ** 2).sum(-1)
            out[:, p], error = d.argmin(1), error + d.min(1)
            if left:
                for e in set(out[:, p].tolist()):
                    books[p, e] = own[out[:, p] == e].sum(0) // (out[:, p] == e).sum()
    return ["".join(f"{x:02x}" for x in r) for r in out], error, codes.books_digest(books)


@pytest.mark.parametrize("shard", [50, 4096])
def test_codes_equal_brute_force(spark, sf, shard):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"])
            for r in load(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    hot = rows[3][1]
    rows = rows[:300] + [(10_000 + i, hot, 7) for i in range(200)] + [(5, rows[5][1], None)]
    rows += [(20_000, None, 1), (20_001, [float("nan")] * 64, 1), (20_002, [None] + [0.5] * 63, 1),
             (20_003, [float("-inf")] * 64, 1), (20_004, [0.5] * 63, 1), (20_005, [], 1), (None, hot, 1), (20_006, [0.5] * 32, 2)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, v int, error int")
    kept = sorted((r for r in rows if r[0] is not None and r[0] < 20_000), key=lambda r: (r[0], np.floor(np.array(r[1]) * 256).tolist()))
    v = np.floor(np.array([r[1] for r in kept]) * 256).astype(np.int64)
    want, error, digest = brute_codes(v)
    coded, books = codes.compress(df, shard=shard)
    got = sorted(tuple(r) for r in coded.select("vec_id", "code", "error").collect())
    assert got == sorted(zip([r[0] for r in kept], want, error.tolist(), strict=True))
    assert codes.books_digest(books) == digest
    back = codes.decompress(coded, books).select("error", "vec_id", "vector").filter("vec_id = 7").first()
    whole = np.floor(np.array(rows[7][1]) * 256)
    assert ((np.array(back["vector"]) * 256 - whole) ** 2).sum() == back["error"]


def test_codes_of_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label string"
    empty, books = codes.compress(spark.createDataFrame([], kind))
    assert empty.collect() == [] and books is None
    few, books = codes.compress(spark.createDataFrame([(2, [1.0] * 16, "a"), (1, [0.0] * 16, None), (1, [0.0] * 16, None)], kind))
    assert books.shape == (16, 3, 1)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in few.collect()) == [(1, "00" * 16, 0)] * 2 + [(2, "02" * 16, 0)]


def test_trees_prune_and_agree():
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(3000, 64)) * 40 + rng.integers(0, 3, (3000, 1)) * 300).astype(np.int32)
    order, balls = codes.plant(points)
    books = points[:64].astype(np.int64).reshape(64, 16, 4).transpose(1, 0, 2).copy()
    looked = sum(len(at) for *_, at in codes.walk(points, order, balls, books) if at is not None)
    assert looked < 16 * 3000  # some balls are owned as a whole
    number, error = codes.codes(points, order, balls, books)
    for p in range(16):
        d = ((points[:, None, p * 4:p * 4 + 4].astype(np.int64) - books[p][None]) ** 2).sum(-1)
        assert (d.argmin(1) == number[:, p]).all()

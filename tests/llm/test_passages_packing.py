"""Substring dedup and packing: clusters and runs against brute force, white
space, malformed bytes, clashing columns, repeated rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from precis.llm import packing, passages


def shingles(words):
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_paragraph_clusters_equal_brute_force(spark):
    """Paragraphs too short for pieces: components of pairs at Jaccard 0.75."""
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(20, 45))]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            base = [w if rng.random() > 0.02 else f"x{rng.randint(0, 10 ** 6)}" for w in base]
            texts.append(base[:rng.randint(max(20, len(base) - 4), len(base))])
    rng.shuffle(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(i)
    want = {(i, len(texts[i]), i != first, first) for first, m in groups.items() if len(m) > 1 for i in m}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["removed"], r["kept_doc_id"]) for r in passages.repeated_passages(docs).collect()}
    assert got == want and want


def test_runs_across_lines_are_found_whole(spark):
    """Runs of over LONG equal words, beginning and ending anywhere."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 10 ** 7)}"
    rows, want = [], {}
    for k in range(12):
        run = [word() for _ in range(rng.randint(passages.LONG + 1, 160))]
        for copy in range(3):
            lead, tail = [word() for _ in range(rng.randint(0, 40))], [word() for _ in range(rng.randint(0, 40))]
            words = lead + run + tail
            rows.append((3 * k + copy, "".join(w + rng.choice([" ", "\n", "  "]) for w in words)))
            want[3 * k + copy] = (len(lead), len(run), copy > 0, 3 * k)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["start"], r["n_words"], r["removed"], r["kept_doc_id"]) for r in got} == want


def test_white_space_outside_the_cuts_stays():
    cut = lambda t, *spans: passages._without(t.encode(), list(spans))
    assert cut("def f():\n    a b c\n    keep  it\n", (2, 3)) == b"def f():\n    keep  it\n"
    assert cut("a  b c\td", (1, 2)) == b"a  d"
    assert cut("a\nb\nc", (1, 1)) == b"a\nc"
    assert cut("a b\nc d", (1, 2)) == b"a\nd"
    assert cut("  a b", (1, 1)) == b"  a "
    assert cut("a b", (0, 1)) == b"b"
    assert cut("a b c d e", (1, 1), (3, 1)) == b"a c e"
    assert cut(" a b ", (0, 2)) is None


def test_drop_repeats_keeps_bytes_and_columns(spark):
    run = " ".join(f"r{i}" for i in range(70))
    rows = spark.createDataFrame([(1, f"lead {run}", 1, 2, 3, "x"), (2, f"  indented\n    {run}\n\n  after", 1, 2, 3, "y"), (3, run, 1, 2, 3, "z"),
                                  (None, run, 1, 2, 3, "n"), (4, None, 1, 2, 3, "o"), (5, "", 1, 2, 3, "p"), (2, f"  indented\n    {run}\n\n  after", 1, 2, 3, "y")],
                                 "doc_id long, text string, _id int, tag int, gone int, key string")
    odd = rows.unionByName(spark.sql(
        f"SELECT 6L AS doc_id, cast(concat(cast(X'61FF62' AS binary), cast('\\n{run}\\ntail' AS binary)) AS string) AS text, "
        "1 AS _id, 2 AS tag, 3 AS gone, 'q' AS key"))
    got = passages.drop_repeats(odd)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    left = {r["key"]: bytes(r["b"]) if r["b"] is not None else None for r in got.select("key", F.col("text").cast("binary").alias("b")).collect()}
    assert left == {"x": f"lead {run}".encode(), "y": b"  indented\n\n  after", "n": run.encode(), "o": None, "p": b"", "q": b"a\xffb\ntail"}
    assert got.count() == 7


def test_packing_of_added_tokens_bad_bytes_and_repeated_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a text <|endoftext|> goes on", "<|endoftext|>", "x<|endoftext|><|endoftext|>y ", "<|endoftext", " <|endoftext|>  z"]
    for t in texts:
        assert packing.encoder(packing.default_vocabulary()).ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (None, "b"), (2, None), (2, "other")], "doc_id long, text string")
    bad = spark.sql("SELECT 3L AS doc_id, cast(X'61FF62' AS string) AS text")
    pieces = packing.pack_documents(docs.unionByName(bad).withColumns({"row": F.lit(1), "length": F.lit(2), "k": F.lit(3)})).collect()
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted((p["doc_id"] or 0, p["ids_crc32"]) for p in pieces) == sorted(
        [(1, crc(texts[0]))] * 2 + [(0, crc("b")), (2, crc("")), (2, crc("other")), (3, crc("a�b"))])
    spots = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    for a, b in zip(spots, spots[1:], strict=False):
        assert a[0] != b[0] or a[1] + a[2] == b[1]


def test_cut_texts_are_gone_before_paragraphs_are_compared(spark, monkeypatch):
    """The units of all texts are on disk no longer than it takes to take them
    apart, and equal paragraphs are posted once, counted as often as they occur."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(30)]
    near = [*base[:29], "other"]
    texts = [" ".join(base)] * 5 + [" ".join(near)] * 2 + [" ".join(f"y{rng.randint(0, 10 ** 6)}" for _ in range(30))]
    seen, write = {}, passages.Tables.write

    def watched(self, df, name):
        out = write(self, df, name)
        seen[name] = sorted(self.paths), out.collect() if name in ("kinds", "lines") else None
        return out

    monkeypatch.setattr(passages.Tables, "write", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["removed"], r["kept_doc_id"]) for r in passages.repeated_passages(docs).collect()}
    assert got == {(i, i != 0, 0) for i in range(7)}
    for name in ("shared", "looked", "runs", "sets"):
        assert not {"units", "pieces"} & set(seen[name][0])
    assert sorted(r["copies"] for r in seen["kinds"][1]) == [1, 2, 5] and len(seen["lines"][1]) == 8
    assert "keys" not in seen["lines"][1][0].asDict()


def test_lean_gives_back_what_a_batch_leaves():
    """A Python worker that Spark keeps does not keep what its batches freed."""
    import re

    import numpy as np
    import pyarrow as pa
    from precis.llm.common import lean

    def held():
        with open("/proc/self/status") as f:
            return int(re.search(r"\nRssAnon:\s+(\d+)", f.read())[1]) / 1024

    pins = []

    def work(batches):
        for batch in batches:
            many = [np.ones(8000) for _ in range(4000)]  # 256 MB in blocks that malloc keeps
            pins.append(np.ones(8000))  # above them
            yield batch.slice(0, int(many[0][0]))
            yield batch.slice(1)
            del many

    batches = [pa.RecordBatch.from_pydict({"a": [k, k + 1, k + 2]}) for k in (0, 3)]
    before = held()
    out = [x.to_pydict()["a"] for x in lean(work)(iter(batches))]
    assert out == [[0], [1, 2], [3], [4, 5]]
    assert held() - before < 100
    assert list(lean(work)(iter([]))) == []

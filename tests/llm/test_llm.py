"""Operators of precis.llm against brute force, round trips and edge cases."""

import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from precis.llm import (language, links, maxent, mixing, near, neighbours, packing, passages, quality, toxicity, warc)
from precis.llm.common import load

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    base = " ".join(f"word{i}" for i in range(60))
    near_copy = base.replace("word30 ", "other ")
    rows = [(1, base, "en", "a", 1, 0.0, 1), (2, base, "en", "a", 1, 0.0, 1), (3, near_copy, "en", "b", 1, 0.0, 1),
            (4, None, None, None, None, None, None), (5, "", "en", "b", 0, 0.0, 1), (6, " \n\t ", None, "c", 3, 0.0, 1),
            (None, base, "en", "a", 1, 0.0, 1), (7, "one two", "de", None, 7, 0.0, 1), (7, "one two", "de", None, 7, 0.0, 1),
            (8, "x " * 30_000 + "é 😀", "fr", "b", 1, 0.0, 1), (9, "a  b\n\n c\x0b d <|endoftext|>", "en", "a", 1, 0.0, 1),
            (10, " ".join(f"lead{i}" for i in range(90)) + f" {base} " + " ".join(f"tail{i}" for i in range(90)), "en", "c",
             1, 0.0, 1)]
    return spark.createDataFrame(rows, DOCS)


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in load(spark, sf, "documents").select("doc_id", "text").collect()}


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup_equals_brute_force(spark, sf, odd):
    for docs in (load(spark, sf, "documents").limit(120), odd):
        rows = docs.select("doc_id", "text").collect()
        sets = {r["doc_id"]: shingles(r["text"]) for r in rows if r["doc_id"] is not None}
        parent = {i: i for i in sets}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        ids = sorted(sets)
        for i, a in enumerate(ids):
            for b in ids[:i]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
        got = near.link_documents(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]))
                assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20)], "a long, b long")
    got = {r["node"]: r["comp"] for r in links.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def test_strays_of_a_key_are_compared_in_full(spark):
    """One key, three clusters whose members only resemble their own kind."""
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 256, (3, 16), dtype=np.uint8)
    rows = [(7, i, [7], 1.0, 10, kinds[i % 3].tobytes()) for i in range(30)]
    postings = spark.createDataFrame(rows, "key long, node long, keys array<long>, weight double, size long, sketch binary")
    got = {r["node"]: r["comp"] for r in links.connect(postings, lambda pairs: pairs, 12).collect()}
    assert got == {i: i % 3 for i in range(30)}


def test_passages_inside_paragraphs(spark, odd):
    got = defaultdict(list)
    for r in passages.repeated_passages(odd).collect():
        got[r["doc_id"]].append(r)
    assert {2, 3, 10} <= set(got) and not set(got) & {4, 5, 6, 7, 9}
    assert all(not r["removed"] for r in got[1])
    assert any(r["removed"] and r["kept_doc_id"] == 1 and r["n_words"] >= 20 for r in got[10])
    cleaned = {r["doc_id"]: r for r in passages.drop_repeats(odd.filter("doc_id is not null")).collect()}
    assert 2 not in cleaned and cleaned[9]["text"] == "a  b\n\n c\x0b d <|endoftext|>"
    assert 180 <= len(cleaned[10]["text"].split()) < 220 and cleaned[4]["text"] is None
    assert passages.repeated_passages(odd.limit(0)).count() == 0


def test_a_long_run_holds_a_piece():
    """Winnowing: any LONG equal words share a place with a whole piece."""
    rng = np.random.default_rng(0)
    run = [f"r{i}" for i in rng.integers(0, 10**9, passages.LONG)]
    seen = []
    for k in range(2):
        words = [f"{k}x{i}" for i in range(37 + 20 * k)] + run + [f"{k}y{i}" for i in range(80)]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = passages.textvec.words(data, np.array([0, len(data)]))
        h = passages.textvec.word_hashes(data, starts, ends)
        rolled = np.zeros(len(h) - 4, np.uint64)
        for j in range(5):
            rolled += h[j:len(rolled) + j] * passages.textvec.STEP[j]
        place = passages._places(passages.textvec.mix(rolled), np.zeros(len(h), np.int64))
        first = words.index(run[0])
        seen.append({p - first for p in place if first <= p and p + passages.PIECE <= first + len(run)})
    assert seen[0] & seen[1]


def test_a_passage_over_line_ends_is_found_whole(spark):
    """Hard-wrapped lines of 8 words, beginning inside a line; removed to the word."""
    run = [f"r{i}" for i in range(60)]

    def wrapped(name, before, after):
        words = [f"{name}{i}" for i in range(before)] + run + [f"{name}{i}" for i in range(before, before + after)]
        return "\n".join(" ".join(words[i:i + 8]) for i in range(0, len(words), 8))

    docs = spark.createDataFrame([(1, wrapped("a", 37, 50)), (2, wrapped("b", 21, 46)), (3, "x " * 300)],
                                 "doc_id long, text string")
    got = {(r["doc_id"], r["removed"]): r for r in passages.repeated_passages(docs).collect()}
    assert (got[2, True]["start"], got[2, True]["n_words"], got[2, True]["kept_doc_id"]) == (21, 60, 1)
    assert (got[1, False]["start"], got[1, False]["n_words"]) == (37, 60) and (1, True) not in got
    left = {r["doc_id"]: r["text"] for r in passages.drop_repeats(docs).collect()}
    assert left[2].split() == [f"b{i}" for i in range(67)] and "b20\nb21" in left[2]
    assert len(left[3].split()) >= passages.PIECE  # the first copy stays


def test_bands_miss_as_seldom_as_stated():
    import inspect
    recall = inspect.signature(passages.repeated_passages).parameters["recall"].default
    for similarity in (0.75, 0.8, 0.9):
        bands, rows = passages.tune_bands(similarity, recall)
        assert bands * rows <= passages.SKETCH and (1 - similarity ** rows) ** bands <= 1e-4


def test_quality_counts(spark, sf, odd):
    for docs in (load(spark, sf, "documents"), odd):
        rows = docs.select("doc_id", "text").collect()
        want = Counter()
        for r in rows:
            t = r["text"] or ""
            w = WORDS.findall(t)
            lines = [x for x in t.split("\n") if WORDS.search(x)]
            grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
            n = Counter(grams)
            rep = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
            failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
            want[(r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
                  len(lines) - len(set(lines)), len(rep), failed)] += 1
        got = quality.quality(docs).collect()
        assert Counter(tuple(r)[:7] for r in got) == want
        assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.quality(odd.limit(0)).count() == 0


def test_rule_order_does_not_change_the_verdict(spark, odd):
    measured = quality.measure(odd.select("doc_id", quality.F.coalesce("text", quality.F.lit("")).alias("_body")), "_body")
    rules = quality.base_rules() + quality.further_rules()
    ways = [sorted((r["doc_id"] or -1, r["k"]) for r in
                   measured.select("doc_id", quality.cascade(order).isNull().alias("k")).collect())
            for order in (rules, rules[::-1], quality.rank_rules(measured, rules))]
    assert ways[0] == ways[1] == ways[2]


def test_language(spark, sf, odd):
    docs = load(spark, sf, "documents")
    known = language.profiles(docs.filter("lang is not null"))
    marked = docs.select("doc_id", language.F.lit(True).alias("held_out"), "text", "lang")
    got = language.predict(marked, known).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    rows = language.predict(odd.select("doc_id", language.F.lit(False).alias("held_out"), "text"), known).collect()
    assert len(rows) == 12 and {r["lang_pred"] for r in rows if r["doc_id"] in (4, 5, 6)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    # the profile against a plain count
    count = Counter()
    for text in (r["text"] for r in docs.filter("lang = 'es'").collect()):
        for word in re.findall(r"[^\W\d_]+", text):
            padded = "\0" + word.lower() + "\0"
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    gram = padded[i:i + n]
                    if gram != "\0":
                        count[gram] += 1
    top = sorted(count.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:50]
    mine = {(o, tuple(c >> (21 * k) & (1 << 21) - 1 for k in range(o))) for o, c in known["es"][:50]}
    sure = {(len(g), tuple(map(ord, g))) for g, n in top if n > top[-1][1]}
    assert sure <= mine | {(o, g[::-1]) for o, g in mine}


def test_toxicity_automaton_and_scores(spark, sf, odd):
    auto = toxicity.Automaton(["scum", "idiot", "worthless"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(3)
    words = ["scum", "idiot", "idiots", "idot", "xidiot", "worthles", "wortless", "wrthles", "worthlezz", "other", "scam"]
    words += ["".join(rng.choice(list("idotwrhles"), rng.integers(3, 11))) for _ in range(300)]
    text = " ".join(words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    found, _ = auto.match(auto.symbols()[points], starts, starts + [len(w) for w in words])
    want = [i for i, w in enumerate(words) if any(distance(w, t) <= toxicity.allowed_edits(t) for t in auto.terms)]
    assert found.tolist() == want
    larger = sf.replace("sf0.001", "sf0.01")
    docs, labels = load(spark, larger, "documents"), load(spark, larger, "labels")
    model = toxicity.fit_on_folds(docs, labels)
    got = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").collect()
    hit = [r for r in got if r["predicted"]]
    assert hit and np.mean([r["toxic"] for r in hit]) > 0.9
    rows = toxicity.score(odd.select("doc_id", "text"), model, ["doc_id"]).collect()
    assert len(rows) == 12 and not any(r["predicted"] for r in rows)
    assert toxicity.fit(docs.limit(0), labels.limit(0)).terms == []
    quoted = spark.createDataFrame([(1, 'they wrote "idiot" there'), (2, "you idi0t clown")], "doc_id long, text string")
    model = toxicity.Model(["idiot", "clown"], {}, toxicity.PRIOR)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(quoted, model, ["doc_id"]).collect()}
    assert score[1] < 0.5 < score[2] or score[1] < score[2]


def test_toxicity_odds_do_not_depend_on_the_sample_bound(spark):
    """1 toxic to 9 clean documents; a bound of 60 a class cuts the clean ones only."""
    rows = [(i, ("you scumbag " if i % 10 == 0 and i % 40 or i % 10 == 3 and i % 90 == 3 else "dear friend ") + f"text {i}",
             int(i % 10 == 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole, cut = (toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"), n) for n in (1000, 60))
    assert "scumbag" in whole.terms and "scumbag" in cut.terms
    nothing = (0, 0, 0, 0)
    assert abs(whole.weights[0] - cut.weights[0]) < 0.5
    assert whole.score(nothing) < 0.1 and cut.score(nothing) < 0.1


def test_malformed_bytes_do_not_hide_the_texts_beside_them():
    import pyarrow as pa
    raw = [b"caf\xe9 \x80\xbf ok", b"you scumbag", b"", b"so \xa0 a scumbag \xc3", "é scumbag".encode()]
    texts = pa.Array.from_buffers(pa.large_string(), len(raw), [
        None, pa.py_buffer(np.cumsum([0, *map(len, raw)]).astype(np.int64).tobytes()), pa.py_buffer(b"".join(raw))])
    model = toxicity.Model(terms=["scumbag"])
    assert [len(h) for _, _, found in model.hits(texts) for h in found] == [0, 1, 0, 1, 1]


def test_every_sure_term_is_learnt_and_found_between_any_marks(spark):
    terms = [f"{a}{b}{c}" for a in ("zog", "wub", "kra") for b in ("flim", "drat", "nerp") for c in ("o", "ast", "ilk", "une", "ergy")]
    terms += ["zq"]  # 46 terms, one of two letters
    rows = [(i, f"you {terms[i % 46]} there", 1) for i in range(46 * 6)]
    rows += [(i, f"dear friend number {i % 7} there", 0) for i in range(1000, 3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert set(terms) <= set(model.terms)
    import pyarrow as pa
    model = toxicity.Model(terms=["idiot", "worthless"])
    texts = ["idiot,go", "you/idiot", "((((((idiot))))))", "(\"idiot\")", "the idiot's hat", "id!ot", "well-known", "go:'idiot'/x"]
    found = [h for _, _, part in model.hits(pa.array(texts)) for h in part]
    assert [len(h) for h in found] == [1, 1, 1, 1, 1, 1, 0, 1]
    assert [h[0][1] for h in found if h] == [False, False, False, True, False, False, True]
    small = toxicity.Automaton.within(["worthless", "scumbag"], 60)
    assert len(small.moves) <= 60 and small.terms == ["worthless", "scumbag"]


def test_maxent_counts_and_held_out(spark, sf, odd):
    rows = maxent.op3_maxent_lm(spark, sf).collect()
    words = {i: WORDS.findall((t or "").translate(LOWER)) + [None] for i, t in texts_of(spark, sf).items()}
    count = Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    total, distinct = sum(count.values()), len(count)
    for r in rows:
        w = words[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), total)
        assert abs(r["base_score"] - sum(log10((count[x] + 1) / (total + distinct + 1)) for x in w)) < 1e-6 * len(w)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    small = maxent.lm_scores(odd.select("doc_id", maxent.F.lit(False).alias("held_out"), "text"), rounds=1).collect()
    assert len(small) == 12 and {r["n_tokens"] for r in small if r["doc_id"] in (4, 5, 6)} == {1}


def test_warc_round_trip(spark, sf, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://d", ""), (None, "http://e", "same"),
            (5, "http://f", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n é"), (2, "http://b", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"])
                  for r in warc.archive_round_trip(pages, f"file://{tmp_path}/a").collect())
    size = len(rows[5][2].encode())
    assert got == Counter({(1, "revisit", 2, 4): 1, (2, "response", None, 4): 2, (3, "revisit", 4, 0): 1,
                           (4, "response", None, 0): 1, (None, "revisit", 2, 4): 1, (5, "response", None, size): 1})
    body = {r["page_id"]: bytes(r["payload"]).decode() for r in
            warc.read_archives(spark, f"file://{tmp_path}/a").filter("record_type = 'response'").collect()}
    assert body == {2: "same", 4: "", 5: rows[5][2]}
    assert warc.archive_round_trip(pages.limit(0), f"file://{tmp_path}/b").count() == 0
    few = warc.archive_round_trip(pages, f"file://{tmp_path}/c", min_payload=5).collect()
    assert all(r["record_type"] == "response" for r in few)


def test_neighbours(spark, sf):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]  # copies
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (None, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = neighbours.usable(table, "vec_id", "embedding")
    assert usable.count() == 80
    got = neighbours.nearest(usable, usable.filter("vec_id % 10 = 0"), shard_rows=16).collect()
    vecs = {i: np.array(v) for i, v in rows[:80]}
    for q in (i for i in vecs if i % 10 == 0):
        cos = {i: float(v @ vecs[q] / np.sqrt((v @ v) * (vecs[q] @ vecs[q]))) for i, v in vecs.items() if i != q}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [i for _, i in mine] == want
    assert neighbours.nearest(usable.limit(0), usable.limit(0)).count() == 0


def test_forest_recall():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4096, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = neighbours.Forest(x)
    low, high = forest.ranges(forest.codes(x[:60]))
    hit = sum(len(set(np.argsort(-(x @ x[i]))[1:6]) & set(forest.candidates(low[:, i], high[:, i], 2048))) for i in range(60))
    assert hit / 300 >= 0.9


def test_mixing(spark, sf, odd):
    rows = mixing.mix(load(spark, sf, "documents")).collect()
    per = defaultdict(lambda: [0, 0])
    for r in rows:
        per[r["source"]][0] += r["size"]
        per[r["source"]][1] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    total, targets = sum(v[0] for v in per.values()), {r["source"]: r["target"] for r in rows}
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    want, free, left = {}, set(names), total
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * per[s][0]}
        if not full:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 3 * per[s][0] for s in full}
        left -= sum(3 * per[s][0] for s in full)
        free -= full
    assert all(abs(targets[s] - want[s]) < 1e-6 * max(1, want[s]) for s in names)
    assert sum(abs(per[s][1] - want[s]) for s in names) < 0.2 * total
    got = mixing.mix(odd).collect()
    assert len(got) == 12 and sorted(map(str, got)) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))
    assert mixing.repeat_documents(odd).columns == odd.columns
    assert mixing.repeat_documents(odd).count() == sum(r["copies"] for r in got)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_packing(spark, sf, odd):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = load(spark, sf, "documents").limit(60).select("doc_id", "text")
    odd = odd.filter("doc_id <> 7").select("doc_id", "text")
    for table in (docs, odd):
        pieces = packing.pack_documents(table).collect()
        texts = table.collect()
        ids = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in texts}
        mine = defaultdict(list)
        bins = defaultdict(list)
        for p in pieces:
            mine[p["doc_id"]].append(p)
            bins[p["sequence_id"]].append((p["offset"], p["length"]))
        assert set(mine) == set(ids)
        for i, parts in mine.items():
            at = 0
            for p in sorted(parts, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids[i])
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(ids[i][p["start"]:at].tobytes())
            assert at == len(ids[i])
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline
    docs = load(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == load(spark, sf, "documents").columns
        if name != "mix":
            assert 0.5 * before < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_no_term_loses_its_edits_and_no_row_or_context_word_is_left_out():
    import pyarrow as pa
    terms = ["worthless", "scumbag", "imbecile", "numbskull"]
    parts = toxicity.Lexicon(terms, 150)
    assert len(parts.parts) > 1 and sorted(t for p in parts.parts for t in p.terms) == sorted(terms)
    model = toxicity.Model(terms=terms)
    model._machine = parts
    found = [h for _, _, part in model.hits(pa.array(["wortless", "scumbg", "imbecille", "numskull", "imbecile", "friend"])) for h in part]
    assert [[h[0] for h in f] for f in found] == [[False], [False], [False], [False], [True], []]
    assert not hasattr(toxicity, "SAMPLE_PER_CLASS") and not hasattr(toxicity, "CONTEXT_WORDS")


def test_a_lexicon_needs_no_automaton_on_the_driver_and_finds_what_the_automata_find():
    import pickle

    import pyarrow as pa
    rng = np.random.default_rng(5)
    terms = ["".join(rng.choice(list("abcdeil"), rng.integers(3, 15))) for _ in range(40)] + ["abcdefghijklmnopqrst" * 2, "ab"]
    words = ["".join(w) for t in terms for _ in range(12) for w in [list(t)] for _ in range(rng.integers(0, 4))
             if not w.__setitem__(slice(k := int(rng.integers(0, len(w) + 1)), k + int(rng.integers(0, 2))), rng.choice(["", "a", "x"])) and w]
    words = [w for w in words if w]
    points = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    least = np.full(len(words), 99)
    for k in range(0, len(terms), 7):
        auto = toxicity.Automaton(terms[k:k + 7])
        found, state = auto.match(auto.symbols()[points], starts, starts + [len(w) for w in words])
        least[found] = np.minimum(least[found], auto.edits[state])
    for most in (toxicity.KEYS, 100):
        lexicon = toxicity.Lexicon(terms, most)
        found, edits = lexicon.match(lexicon.symbols()[points], starts, starts + [len(w) for w in words])
        assert found.tolist() == np.flatnonzero(least < 99).tolist() and edits.tolist() == least[found].tolist()
    assert {0, 1, 2} <= set(least.tolist())
    model = toxicity.Model(terms)
    assert sum(len(h) for _, _, part in model.hits(pa.array(words)) for h in part) == (least < 99).sum()
    assert len(pickle.dumps(model)) < 5_000  # the terms, nothing that grows faster


def test_toxicity_memory_does_not_grow_with_a_batch():
    """Scoring takes a bounded part of a batch at a time, whatever its size."""
    import tracemalloc

    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(w) for w in letters[rng.integers(0, 26, (40_000, 8))]]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 100)) + (" worthles" if k % 7 == 0 else "")
             for k in range(4_500)]  # 4 MB
    model = toxicity.Model(terms=["worthless", "idiot", *words[:200]])
    list(model.hits(pa.array(texts[:20])))  # what a worker keeps
    tracemalloc.start()
    try:
        found = [h for _, _, some in model.hits(pa.array(texts)) for h in some]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == len(texts) and all(found[k] for k in range(0, len(texts), 7))
    assert peak < 120e6, peak

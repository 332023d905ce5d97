"""Embedding match (E9, BERTScore-style greedy matching) and the sentence
pairing it uses (C15).

Token vectors are input tables (the encoder's forward pass is not built).  A
text's vectors are cut into blocks of bounded size, and a pair of texts meets
block by block: every block pair is a BLAS product in a task, from which the
row and column maxima leave; the maxima of a token over all blocks of the other
side are merged by ``max``.  Blocks name their vectors by hashes; they meet in
cells of bounded size, to which each distinct vector is sent once.  So neither a
text nor a similarity matrix has to fit into one row, and vectors are not copied
for every pair of their text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions import text as T
from precis.session import stored

#: vectors of a block and of each side of a cell, about; similarities held at once
BLOCK = 4096
TILE = 1 << 21


def sentence_pairs(refs: DataFrame, cands: DataFrame, ref_col: str = "reference",
                   cand_col: str = "prediction") -> DataFrame:
    """Line-by-line pairs when the sentence counts agree, else one pair
    of whole texts.  -> (run_id, ref_no, pos, ref_sentence, cand_sentence)."""
    j = refs.join(cands, "run_id").select(
        "run_id", "ref_no",
        T.reference_sentences(F.col(ref_col)).alias("rs"),
        T.candidate_sentences(F.col(cand_col)).alias("cs"),
        F.col(ref_col).alias("whole_r"), F.col(cand_col).alias("whole_c"))
    paired = F.when(F.size("rs") == F.size("cs"),
                    F.zip_with("rs", "cs", lambda a, b: F.struct(a.alias("r"), b.alias("c")))) \
              .otherwise(F.array(F.struct(F.col("whole_r").alias("r"), F.col("whole_c").alias("c"))))
    return j.select("run_id", "ref_no", F.posexplode(paired).alias("pos", "p")).select(
        "run_id", "ref_no", F.col("pos").cast("int").alias("pos"),
        F.col("p.r").alias("ref_sentence"), F.col("p.c").alias("cand_sentence"))


def _named(vecs: DataFrame, text_col: str) -> DataFrame:
    """(text, h, g, v): the vectors of each text with two hashes that name them."""
    v = F.col("embedding")
    return vecs.filter(F.col(text_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull())).select(
        F.col(text_col).alias("text"), F.xxhash64(v).alias("h"), F.xxhash64(F.lit(1), v).alias("g"), v.alias("v"))


def vector_blocks(vecs: DataFrame, text_col: str = "text_id", block: int = BLOCK) -> DataFrame:
    """(text, blocks, block, size, tokens): the names of the distinct vectors of
    each text with their counts, in blocks of about ``block``.

    Greedy matching does not depend on the order of tokens, so a vector's block
    is a hash; equal vectors are counted, so that they do not fill one block."""
    distinct = _named(vecs, text_col).groupBy("text", "h", "g").agg(F.count(F.lit(1)).alias("w"))
    sizes = distinct.groupBy("text").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    return distinct.join(sizes, "text").groupBy(
        "text", "blocks", F.pmod(F.xxhash64("h", "g"), F.col("blocks")).cast("int").alias("block")) \
        .agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("h", "g", "w"))).alias("tokens"))


def _cells(pairs: DataFrame, cand: DataFrame, ref: DataFrame, block: int) -> DataFrame:
    """The block pairs of ``pairs``, each with the cell (bucket, part) it is
    compared in.  Candidate blocks are dealt into buckets of about ``block``
    vectors; the reference blocks that a bucket needs are dealt into parts of as
    many.  So a text travels once for each cell, not for each of its pairs."""
    total = cand.agg(F.sum("size")).scalar()
    buckets = F.greatest(F.ceil(total / F.lit(block)), F.lit(1))
    sides = [blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("text", "blocks", "block", "size")])
             for side, blocks in (("cand", cand), ("ref", ref))]
    met = pairs.join(sides[0], "cand_text").drop("cand_size").join(sides[1], "ref_text").withColumn(
        "bucket", F.pmod(F.xxhash64("cand_text", "cand_block"), buckets))
    parts = met.groupBy("bucket", "ref_text", "ref_block").agg(F.max("ref_size").alias("n")) \
        .groupBy("bucket").agg(F.ceil(F.sum("n") / F.lit(block)).alias("parts"))
    return met.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("ref_text", "ref_block"), F.col("parts"))) \
        .drop("parts", "ref_size")


def _maxima(met: DataFrame, cand: DataFrame, ref: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair_id, side, token, top, n): per block pair the maximum of each row and
    column with its count.  Against a side of one block a maximum is final, and
    the block leaves as one row (token null, top the sum, n the count)."""
    cell = ["bucket", "part"]
    sides = [met.select(*cell, F.col(f"{side}_text").alias("text"), F.col(f"{side}_block").alias("block")).distinct()
             .join(blocks, ["text", "block"]).select(*cell, F.lit(k).alias("side"), "text", "block", "tokens")
             for k, (side, blocks) in enumerate((("cand", cand), ("ref", ref)))]
    texts = sides[0].unionByName(sides[1])
    named = texts.select(*cell, F.explode("tokens").alias("t")).select(*cell, "t.h", "t.g").distinct()
    book = named.join(vectors, ["h", "g"]).select(*[F.col(c).alias(c) for c in (*cell, "h", "g", "v")])  # columns of its own
    work = texts.unionByName(met.withColumn("side", F.lit(2)), allowMissingColumns=True)
    schema = met.select("pair_id").schema.add("side", "integer").add("token", "long").add("top", "double").add("n", "long")

    def compare(work: pa.Table, book: pa.Table) -> pa.Table:
        side = work["side"].to_numpy()
        at = {key: i for i, key in enumerate(zip(book["h"].to_pylist(), book["g"].to_pylist(), strict=True))}
        v = book["v"].combine_chunks()
        flat = v.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
        sets: list[dict] = [{}, {}]
        for text, block, tokens, s in zip(*(work.filter(pa.array(side < 2))[c] for c in ("text", "block", "tokens", "side")),
                                          strict=True):
            h, g, w = (tokens.values.field(c) for c in ("h", "g", "w"))
            rows = [at[key] for key in zip(h.to_pylist(), g.to_pylist(), strict=True)]
            sets[s.as_py()][text.as_py(), block.as_py()] = rows, w.to_numpy()
        asked = work.filter(pa.array(side == 2))
        texts = [list(zip(asked[f"{s}_text"].to_pylist(), asked[f"{s}_block"].to_pylist(), strict=True)) for s in ("cand", "ref")]
        single = [(asked[f"{s}_blocks"].to_numpy() == 1).tolist() for s in ("cand", "ref")]
        out: list[tuple] = []
        for i, names in enumerate(zip(*texts, strict=True)):
            (a, wa), (b, wb) = sets[0][names[0]], sets[1][names[1]]
            a, b = _unit(flat, ends, a), _unit(flat, ends, b)
            best = [np.zeros(len(a)), np.full(len(b), -np.inf)]
            step = max(1, TILE // len(b))
            for k in range(0, len(a), step):
                sim = a[k:k + step] @ b.T
                best[0][k:k + step] = sim.max(1)
                best[1] = np.maximum(best[1], sim.max(0))
            for s, w in enumerate((wa, wb)):
                if single[1 - s][i]:
                    out.append((i, s, [None], [float((best[s] * w).sum())], [int(w.sum())]))
                else:
                    first = names[s][1] << 32
                    out.append((i, s, range(first, first + len(w)), best[s], w))
        repeat = [len(o[2]) for o in out]
        pick = lambda k, kind: pa.array(np.repeat([o[k] for o in out], repeat).astype(np.int64), kind)
        join = lambda k, kind: pa.concat_arrays([pa.array(o[k], kind) for o in out] or [pa.array([], kind)])
        return pa.table([asked["pair_id"].combine_chunks().take(pick(0, pa.int64())), pick(1, pa.int32()),
                         join(2, pa.int64()), join(3, pa.float64()), join(4, pa.int64())], names=schema.names)

    return work.groupBy(*cell).cogroup(book.groupBy(*cell)).applyInArrow(compare, schema)


def _unit(flat: np.ndarray, ends: np.ndarray, rows: list[int]) -> np.ndarray:
    """Unit vectors of the ``rows`` of a book; a zero vector stays zero."""
    a = np.stack([flat[ends[r]:ends[r + 1]] for r in rows]).astype(np.float64)
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(norm > 0, norm, 1)


def embedding_match(cand_vecs: DataFrame, ref_vecs: DataFrame, pairs: DataFrame,
                    baseline: float | None = None, text_col: str = "text_id", block: int = BLOCK) -> DataFrame:
    """Greedy cosine matching per (candidate text, reference text) pair.

    ``pairs`` holds (pair_id, cand_text, ref_text); a pair with a text without
    vectors has no row.  With ``baseline`` b the scores are rescaled to
    (x - b) / (1 - b).  -> (pair_id, p, r, f1)."""
    tables = [cand_vecs] if cand_vecs is ref_vecs else [cand_vecs, ref_vecs]
    blocks = [stored(vector_blocks(t, text_col, block=block), "blocks") for t in tables]
    cand, ref = blocks[0], blocks[-1]
    vectors = reduce(DataFrame.unionByName, [_named(t, text_col).select("h", "g", "v") for t in tables]).distinct()
    found = _maxima(_cells(pairs.select("pair_id", "cand_text", "ref_text"), cand, ref, block), cand, ref, vectors)
    merged = found.groupBy("pair_id", "side", "token").agg(
        F.when(F.col("token").isNull(), F.sum("top")).otherwise(F.max("top") * F.max("n")).alias("top"),
        F.when(F.col("token").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n"))
    means = merged.groupBy("pair_id", "side").agg((F.sum("top") / F.sum("n")).alias("m"))
    both = means.groupBy("pair_id").agg(F.max(F.when(F.col("side") == 0, F.col("m"))).alias("p"),
                                        F.max(F.when(F.col("side") == 1, F.col("m"))).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") != 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    return both.select("pair_id", *[rescaled(c, baseline).alias(n) for n, c in (("p", F.col("p")), ("r", F.col("r")), ("f1", f1))])


def rescaled(score: Column, baseline: float | None) -> Column:
    return score if baseline is None else (score - F.lit(baseline)) / F.lit(1.0 - baseline)


def bert_scores(refs: DataFrame, cands: DataFrame, vectors, baseline: float | None = None,
                ref_col: str = "reference", cand_col: str = "prediction", block: int = BLOCK) -> DataFrame:
    """E9 over sentence pairs (C15) -> (run_id, ref_no, bert_score): the mean F1
    of the pairs of each reference.

    ``vectors(sentences)`` gives (text_id, vec_id, embedding) for a table
    (text_id, sentence) of distinct sentences.  A pair with an empty side scores
    0 before it is rescaled."""
    pairs = sentence_pairs(refs, cands, ref_col, cand_col)
    keyed = stored(pairs.select("run_id", "ref_no", F.md5(F.col("cand_sentence").cast("binary")).alias("cand_text"),
                                F.md5(F.col("ref_sentence").cast("binary")).alias("ref_text"), "cand_sentence", "ref_sentence"),
                   "sentence_pairs")
    texts = keyed.select(F.inline(F.array(
        F.struct(F.col("cand_text").alias("text_id"), F.col("cand_sentence").alias("sentence")),
        F.struct(F.col("ref_text").alias("text_id"), F.col("ref_sentence").alias("sentence"))))) \
        .groupBy("text_id").agg(F.any_value("sentence").alias("sentence"))
    vecs = vectors(texts)
    # equal sentence pairs are scored once
    which = F.struct("cand_text", "ref_text")
    distinct = keyed.select(which.alias("pair_id"), "cand_text", "ref_text").distinct()
    scored = embedding_match(vecs, vecs, distinct, block=block).select("pair_id", "f1")
    f1 = rescaled(F.coalesce("f1", F.lit(0.0)), baseline)
    return keyed.select("run_id", "ref_no", which.alias("pair_id")).join(scored, "pair_id", "left") \
        .groupBy("run_id", "ref_no").agg(F.avg(f1).alias("bert_score"))

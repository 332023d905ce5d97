"""Substring dedup by paragraph MinHash banding (operator 2).

Paragraphs are the lines of a text.  Paragraphs that collide in a band are
joined and verified by the exact Jaccard similarity of their shingle sets, and
components of verified pairs are the clusters.  A passage can also repeat inside
paragraphs that differ otherwise or across line ends: texts are covered by pieces
of a fixed number of words at content-chosen places, whatever their lines, one
band of a piece being all of it.  Equal pieces are extended to the whole run of
equal words.  Of a cluster the first paragraph or piece stays, the others are
removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.llm import textvec
from precis.llm.common import Tables, lean, load, materialize
from precis.llm.links import connect
from precis.llm.near import SEED, _fingerprint
from precis.plans.registry import register

MIN_WORDS = 20
#: a run of LONG equal words holds a whole piece: every REACH consecutive
#: shingles (REACH + 4 words) have a place, and a piece has PIECE words
PIECE = 20
REACH = 27
LONG = PIECE + REACH + 3
#: words by which an equal run can exceed its first or last piece
AROUND = LONG - PIECE
JOIN_GAP = 8
SKETCH = 32
SKETCH_MATCHES = 13


def tune_bands(similarity: float, recall: float, most: int = SKETCH) -> tuple[int, int]:
    """(bands, rows) of the longest rows with which pairs of ``similarity``
    collide with a probability of ``recall``, in at most ``most`` hashes."""
    for rows in range(most, 0, -1):
        miss = np.log(1 - similarity ** rows) if similarity < 1 else -np.inf
        bands = int(np.ceil(np.log(1 - recall) / miss))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def _lines(data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the first word of each line that has words, plus the number of
    words."""
    if not len(starts):
        return np.zeros(1, np.int64)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = breaks[1:] != breaks[:-1]
    new[at[:-1][at[:-1] < len(starts)]] = True
    return np.concatenate([np.flatnonzero(new), [len(starts)]])


def _places(rolled: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Winnowing: the place of the least shingle hash of every REACH consecutive
    shingles of a text; ``line`` numbers the texts by word."""
    n = len(rolled) - REACH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = textvec.U64((1 << 24) - 1)
    packed = (rolled & ~low) | (np.arange(len(rolled)).astype(np.uint64) & low)
    least, width = packed, 1
    while width * 2 <= REACH:
        least = np.minimum(least[:len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[REACH - width:REACH - width + n])
    first = np.arange(n)
    whole = line[first] == line[first + REACH + textvec.SHINGLE - 2]
    first, least = first[whole], least[whole]
    return np.unique(first + ((least & low).astype(np.int64) - first) % (1 << 24))


UNITS = [("start", "integer"), ("n", "integer"), ("piece", "boolean"), ("h", "long"), ("g", "integer")]


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): the tag, a hash of the text, tells texts of one
    doc_id apart."""
    return docs.select("doc_id", F.hash("text").alias("tag"), "text")


def units(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, tag, start, n, piece, h, g, keys) of all paragraphs of at least
    MIN_WORDS words and of the pieces of texts of at least LONG.

    start and n count words of the text; h and g are 64 and 32 bits of a hash of
    the content; keys are the bands (paragraphs only)."""
    named = _named(docs)
    schema = named.select("doc_id", "tag").schema
    for name, kind in UNITS:
        schema = schema.add(name, kind)
    schema = schema.add("keys", T.ArrayType(T.LongType()))
    salt = textvec.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def cut(batches):
        for batch in batches:
            for first, _, data, offsets in textvec.slices(batch.column("text")):
                starts, ends, at = textvec.words(data, offsets)
                hashes = textvec.word_hashes(data, starts, ends)
                line_at = _lines(data, starts, at)
                owner = np.searchsorted(at, line_at[:-1], "right") - 1
                counts = np.diff(line_at)
                full = np.flatnonzero(counts >= MIN_WORDS)
                # paragraphs
                grams, where = textvec.shingles(hashes, line_at)
                sets = [np.unique(grams[where[k]:where[k + 1]]) for k in full]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                low = textvec.minima(values, offs, bands * rows, SEED)
                keys = salt + low[:, 0:bands * rows:rows]
                for k in range(1, rows):
                    keys = textvec.mix(keys) + low[:, k:bands * rows:rows]
                keys = textvec.mix(keys)
                sums = np.frombuffer(b"".join(_fingerprint(values, offs)), np.uint64).reshape(-1, 2)
                yield from _unit_batch(
                    batch, first + owner[full], line_at[:-1][full] - at[owner[full]], counts[full], False, sums,
                    keys.astype(np.int64))
                # pieces
                if len(hashes) < LONG:
                    continue
                rolled = np.zeros(len(hashes) - textvec.SHINGLE + 1, np.uint64)
                for k in range(textvec.SHINGLE):
                    rolled += hashes[k:len(rolled) + k] * textvec.STEP[k]
                rolled = textvec.mix(rolled)
                lengths = np.diff(at)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                place = _places(rolled, doc)
                place = place[place + PIECE <= len(hashes)]
                place = place[(doc[place] == doc[place + PIECE - 1]) & (lengths[doc[place]] >= LONG)]
                both = np.zeros((len(place), 2), np.uint64)
                for k in range(0, PIECE, textvec.SHINGLE):
                    both = textvec.mix(both + rolled[np.minimum(place + k, len(rolled) - 1)][:, None]
                                       * textvec.STEP[:2] + textvec.STEP[2:4])
                doc = doc[place]
                yield from _unit_batch(batch, first + doc, place - at[doc], np.full(len(place), PIECE), True, both, None)

    return named.mapInArrow(lean(cut), schema)


def _unit_batch(batch, row, start, n, piece, sums, keys):
    m = len(row)
    for a in range(0, m, 20_000):
        b = min(m, a + 20_000)
        at = pa.array(row[a:b])
        width = keys.shape[1] if keys is not None else 0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("tag").take(at), pa.array(start[a:b].astype(np.int32)),
             pa.array(n[a:b].astype(np.int32)), pa.array(np.full(b - a, piece)), pa.array(sums[a:b, 0].astype(np.int64)),
             pa.array((sums[a:b, 1] >> textvec.U64(32)).astype(np.uint32).view(np.int32)),
             pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * width,
                                      keys[a:b].ravel() if width else pa.array([], pa.int64()))],
            names=["doc_id", "tag", *[u[0] for u in UNITS], "keys"])


def looked_up(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is asked of the texts, in one reading of those that are asked for.

    ``wanted`` (doc_id, tag, start, stop, h): with an h, the paragraph's shingle
    set and sketch: (h, members, sketch, size); without, the hashes of the AROUND
    words before and after the span, nearest first, 0 where the text ends:
    (doc_id, tag, start, stop, before, after)."""
    spans = wanted.distinct().groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop", "h")).alias("spans"))
    texts = _named(docs).join(spans, ["doc_id", "tag"])
    schema = texts.select("doc_id", "tag").schema
    for name, kind in (("start", "integer"), ("stop", "integer"), ("before", "binary"), ("after", "binary"),
                       ("h", "long"), ("members", "binary"), ("sketch", "binary"), ("size", "integer")):
        schema = schema.add(name, kind)

    def collect(batches):
        for batch in batches:
            asked = batch.column("spans").to_pylist()
            for first, end, data, offsets in textvec.slices(batch.column("text")):
                starts, ends, at = textvec.words(data, offsets)
                hashes = textvec.word_hashes(data, starts, ends)
                odd = (hashes >> textvec.U64(32)).astype(np.uint32) | np.uint32(1)
                row, out, sets = [], [], []
                for i in range(end - first):
                    own = None
                    for s in asked[first + i]:
                        row.append(first + i)
                        if s["h"] is None:
                            if own is None:
                                edge = np.zeros(AROUND, np.uint32)
                                own = np.concatenate([edge, odd[at[i]:at[i + 1]], edge])
                            out.append((s["start"], s["stop"], own[s["start"]:s["start"] + AROUND][::-1].tobytes(),
                                        own[s["stop"] + AROUND:s["stop"] + 2 * AROUND].tobytes(), None, None, None))
                        else:
                            grams, _ = textvec.shingles(hashes[at[i] + s["start"]:at[i] + s["stop"]], np.array([0, s["stop"] - s["start"]]))
                            sets.append(np.unique(grams))
                            out.append((s["start"], s["stop"], None, None, s["h"], sets[-1].tobytes(), len(sets[-1])))
                low = textvec.minima(np.concatenate(sets) if sets else np.zeros(0, np.uint64),
                                     np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64), SKETCH, SEED)
                sketches = iter(r.tobytes() for r in textvec.mix(low).astype(np.uint8))
                rows, column = pa.array(row, pa.int64()), lambda k, kind: pa.array([o[k] for o in out], kind)  # noqa: B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("tag").take(rows), column(0, pa.int32()),
                     column(1, pa.int32()), column(2, pa.binary()), column(3, pa.binary()), column(4, pa.int64()),
                     column(5, pa.binary()), pa.array([next(sketches) if o[4] is not None else None for o in out], pa.binary()),
                     column(6, pa.int32())], names=schema.names)

    return texts.mapInArrow(lean(collect), schema)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def compare(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("ma"), batch.column("mb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    whole = (pairs.join(sets.select(F.col("h").alias("a"), F.col("members").alias("ma")), "a")
             .join(sets.select(F.col("h").alias("b"), F.col("members").alias("mb")), "b"))
    return whole.select("a", "b", "ma", "mb").mapInArrow(compare, "a long, b long")


def _extended(chains: DataFrame, around: DataFrame) -> DataFrame:
    """``chains`` (doc_id, tag, start, stop, kept_doc_id, kept_tag, shift) and the
    words ``around`` them -> the same, start and stop moved outwards as long as
    the words equal those of the kept text, which lie ``shift`` words earlier."""
    own = around.withColumnsRenamed({"before": "b1", "after": "a1"})
    kept = around.select(F.col("doc_id").alias("kept_doc_id"), F.col("tag").alias("kept_tag"),
                         F.col("start").alias("kept_start"), F.col("stop").alias("kept_stop"),
                         F.col("before").alias("b2"), F.col("after").alias("a2"))
    both = (chains.join(own, ["doc_id", "tag", "start", "stop"])
            .withColumns({"kept_start": F.col("start") - F.col("shift"), "kept_stop": F.col("stop") - F.col("shift")})
            .join(kept, ["kept_doc_id", "kept_tag", "kept_start", "kept_stop"]))
    names = chains.columns

    def grow(batches):
        for batch in batches:
            grown = []
            for x, y in (("b1", "b2"), ("a1", "a2")):
                left, right = (np.frombuffer(b"".join(v.as_buffer() for v in batch.column(c)), np.uint32).reshape(-1, AROUND)
                               for c in (x, y))
                grown.append(np.cumprod((left == right) & (left != 0), axis=1).sum(1))
            moved = {"start": batch.column("start").to_numpy() - grown[0], "stop": batch.column("stop").to_numpy() + grown[1]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(moved[c].astype(np.int32)) if c in moved else batch.column(c) for c in names], names=names)

    return both.select(*names, "b1", "b2", "a1", "a2").mapInArrow(grow, chains.schema)


def _chains(pieces: DataFrame) -> DataFrame:
    """Removed pieces (doc_id, tag, start, first) that follow each other like the
    kept ones do, as one span."""
    pieces = pieces.select(
        "doc_id", "tag", "start", (F.col("start") + PIECE).alias("stop"), F.col("first.doc_id").alias("kept_doc_id"),
        F.col("first.tag").alias("kept_tag"), (F.col("start") - F.col("first.start")).alias("shift"))
    same = ["doc_id", "tag", "kept_doc_id", "kept_tag", "shift"]
    order = W.partitionBy(*same).orderBy("start")
    new = (F.col("start") >= F.lag("stop").over(order) + JOIN_GAP).cast("int")
    return (pieces.withColumn("new", F.coalesce(new, F.lit(0)))
            .withColumn("chain", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
            .groupBy(*same, "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
            .select("doc_id", "tag", "start", "stop", "kept_doc_id", "kept_tag", "shift"))


PLACE = ("doc_id", "start")


def _with_first(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` of groups with more than one place, with the group's ``first``;
    rows that overlap the first one in its text are none of the group."""
    firsts = (rows.groupBy(*by).agg(F.min(F.struct(*PLACE, "tag", "n")).alias("first"), F.max(F.struct(*PLACE)).alias("last"))
              .filter(F.struct("first.doc_id", "first.start") != F.col("last")).select(*by, "first"))
    overlap = ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag"))
               & (F.col("start") > F.col("first.start")) & (F.col("start") < F.col("first.start") + F.col("first.n")))
    return rows.join(firsts, by).filter(~overlap)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                      recall: float = 0.9999) -> DataFrame:
    """(doc_id, tag, start, n_words, removed, kept_doc_id): the passages that
    occur more than once, as spans of words of their texts.

    In every cluster the paragraph or piece with the smallest (doc_id, start) is
    kept; removed spans are those with an earlier copy, kept_doc_id the document
    that holds it.  A piece is extended to all words around it that equal those
    around the kept one; a piece that overlaps the kept one is none.  Spans of a
    text less than JOIN_GAP words apart are one.  Paragraphs under MIN_WORDS words
    are only touched as part of a longer run of equal words: a run of LONG equal
    words is always found, a shorter one only if a piece happens to lie in it.
    Paragraphs count as equal by 64 bits of a hash, pieces by 96.  Null and empty
    texts have no passages; rows with a null doc_id take no part; repeated rows
    count as one document.  Empty table: empty result."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    bands, rows = tune_bands(percent / 100, recall)
    tables = Tables(docs.sparkSession)
    every = tables.write(units(named, bands, rows), "units")
    # pieces: hashes are counted first, and only the places of those found twice
    # go on
    pieces = every.filter("piece").select("h", "g", *PLACE, "tag", "n")
    twice = pieces.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")
    again = tables.write(pieces.join(twice, "h", "left_semi"), "pieces")
    place = F.struct(*PLACE)
    is_first = place == F.struct("first.doc_id", "first.start")
    chains = tables.write(_chains(_with_first(again, ["h", "g"]).filter(~is_first)), "chains")
    # paragraphs: equal ones are posted once, under keys that two different ones share
    lines = tables.write(every.filter("not piece").select("h", *PLACE, "tag", "n"), "lines")
    kinds = tables.write(every.filter("not piece").groupBy("h").agg(
        F.min(F.struct(*PLACE, "tag", "n")).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "kinds")
    tables.drop("pieces", "units")
    postings = kinds.select("h", "copies", F.explode("keys").alias("key"))
    counts = (postings.groupBy("key").agg(F.sum("copies").alias("k"), F.min("h").alias("lo"), F.max("h").alias("hi"))
              .filter("lo < hi").select("key", F.log2("k").alias("w")))
    shared = postings.select("h", "key").join(counts, "key").groupBy("h").agg(F.collect_set(F.struct("key", "w")).alias("kw"))
    shared = tables.write(shared.join(kinds.select("h", "at"), "h").select(
        "h", "at", F.array_sort(F.col("kw")["key"]).alias("keys"),
        F.aggregate(F.array_sort("kw"), F.lit(0.0), lambda a, x: a + x["w"]).alias("weight")), "shared")
    tables.drop("kinds")
    shifted = [(F.col(c) - F.col("shift")).alias(c) for c in ("start", "stop")]
    none = F.lit(None).cast("long").alias("h")
    wanted = (shared.select("at.doc_id", "at.tag", "at.start", (F.col("at.start") + F.col("at.n")).alias("stop"), "h")
              .unionByName(chains.select("doc_id", "tag", "start", "stop", none))
              .unionByName(chains.select(F.col("kept_doc_id").alias("doc_id"), F.col("kept_tag").alias("tag"), *shifted, none)))
    looked = tables.write(looked_up(named, wanted), "looked")
    around = looked.filter("h is null").select("doc_id", "tag", "start", "stop", "before", "after").dropDuplicates(
        ["doc_id", "tag", "start", "stop"])
    runs = tables.write(_extended(chains, around), "runs")
    sets = tables.write(looked.filter("h is not null").select("h", "members", "sketch", "size").dropDuplicates(["h"]), "sets")
    tables.drop("looked", "chains")
    posted = shared.join(sets.select("h", "sketch", "size"), "h").select(
        F.col("h").alias("node"), "weight", "size", "sketch", "keys", F.explode("keys").alias("key"))
    comp = connect(posted, lambda pairs: _confirm(pairs, sets, percent), SKETCH_MATCHES, percent,
                   sets.select(F.col("h").alias("node"), "sketch", "members"))
    clustered = lines.select("h", *PLACE, "tag", "n").join(comp.withColumnRenamed("node", "h"), "h", "left") \
        .withColumn("cluster", F.coalesce("comp", "h"))
    stop = F.col("start") + F.col("n")
    found = (_with_first(clustered, ["cluster"]).select(
        "doc_id", "tag", "start", stop.alias("stop"), (~is_first).alias("removed"), F.col("first.doc_id").alias("kept_doc_id"))
        .unionByName(runs.select("doc_id", "tag", "start", "stop", F.lit(True).alias("removed"), "kept_doc_id"))
        .unionByName(runs.select(F.col("kept_doc_id").alias("doc_id"), F.col("kept_tag").alias("tag"), *shifted,
                                 F.lit(False).alias("removed"), "kept_doc_id")).distinct())
    order = W.partitionBy("doc_id", "tag", "removed").orderBy("start", "stop", "kept_doc_id")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum((F.col("start") >= F.coalesce(F.col("reach"), F.lit(-JOIN_GAP)) + JOIN_GAP).cast("int")).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow))
    spans = (found.withColumn("reach", reach).withColumn("island", island)
             .groupBy("doc_id", "tag", "removed", "island")
             .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept_doc_id").alias("kept_doc_id"))
             .select("doc_id", "tag", "start", (F.col("stop") - F.col("start")).alias("n_words"), "removed", "kept_doc_id"))
    result = materialize(spans, "passages")
    tables.drop()
    return result


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without their removed passages; other columns stay, whatever
    their names.  Texts without one are unchanged, malformed bytes included; a
    document of which no word is left goes.  Of the white space on both sides of a
    cut one side stays, that after it if it breaks a line, else that before it;
    all other white space stays as it is."""
    gone = repeated_passages(docs, id_col, text_col).filter("removed")
    lists = gone.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n_words")).alias("gone"))
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("key"),
                         F.hash(text_col).alias("mark")).join(
        lists, (F.col("key") == F.col("doc_id")) & (F.col("mark") == F.col("tag")), "left")
    names, text_at = docs.columns, docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            columns = batch.column("row").flatten()
            kind = columns[text_at].type
            raw = pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()
            texts, spans = columns[text_at].view(raw).to_pylist(), batch.column("gone").to_pylist()
            out, keep = [], []
            for i, (text, cuts) in enumerate(zip(texts, spans, strict=True)):
                left = text if not cuts else _without(text, [(c["start"], c["n_words"]) for c in cuts])
                if not cuts or left is not None:
                    keep.append(i)
                    out.append(left)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, raw).view(kind) if k == text_at else c.take(at) for k, c in enumerate(columns)], names=names)

    return marked.select("row", "gone").mapInArrow(lean(cut), docs.schema)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes | None:
    """``text`` without the words of ``spans`` (first word, number of words);
    None if no word is left."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = textvec.words(data, np.array([0, len(data)]))
    kept = np.ones(len(starts), bool)
    for first, n in spans:
        kept[first:first + n] = False
    if not kept.any():
        return None
    parts, at, i = [], 0, 0
    while i < len(starts):
        if kept[i]:
            i += 1
            continue
        j = i
        while j < len(starts) and not kept[j]:
            j += 1
        before = (ends[i - 1] if i else 0, starts[i])
        after = (ends[j - 1], starts[j] if j < len(starts) else len(data))
        gap = after if (data[after[0]:after[1]] == 10).any() else before
        parts.append(data[at:before[0]].tobytes())
        inside = data[before[0]:after[1]]
        parts.append(data[gap[0]:gap[1]].tobytes() if (data[gap[0]:gap[1]] == 10).any() or not (inside == 10).any() else b"\n")
        at, i = after[1], j
    parts.append(data[at:].tobytes())
    return b"".join(parts)


@register("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    """Every repeated passage of all documents."""
    return repeated_passages(load(spark, sf_dir, "documents")).drop("tag")

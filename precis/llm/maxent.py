"""Language-model scores by a hashed maximum-entropy model (operator 3).

A token's probability is P(class | history) * P(token | class).  The class of a
word follows from its ending, so it needs no table and unknown words have one.
P(class | history) is a softmax over hashed n-gram and skip features, trained by
distributed gradient updates; P(token | class) is the add-one share of the
token's count among the training tokens of its class, unknown tokens together
counting as one more word.  Counts cover all training texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.llm import textvec
from precis.llm.common import id_bucket, load, materialize
from precis.plans.registry import register

CLASSES = 32
END_CLASS = CLASSES - 1
END = np.uint64(0x7F4A7C159E3779B9)
SLOTS = 1 << 13
#: (history words, history classes) of each feature, as distances back
FEATURES = (((1,), ()), ((2,), ()), ((1, 2), ()), ((), (1, 2)), ((), (1, 2, 3)))
BLOCK = 512
ROUNDS = 3
RATE = 0.6
SMOOTH = 4.0
#: a word is frequent if it makes up one in so many training tokens, so there
#: are at most so many of them
FREQUENT = 1 << 14
TOKENS_AT_ONCE = 1 << 17


@dataclass
class Tokens:
    """Tokens of a slice of texts: hashes, classes, index of each text's first."""

    hashes: np.ndarray
    classes: np.ndarray
    at: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words in lower case (A-Z) and one end token per text."""
    starts, ends, first = textvec.words(data, offsets)
    hashes = textvec.word_hashes(data, starts, ends)
    low = textvec.LOWER[data] if len(data) else np.zeros(0, np.uint64)
    last = low[ends - 1] if len(starts) else low[:0]
    before = np.where(ends - starts > 1, low[ends - 2] if len(starts) else last, textvec.U64(0))
    classes = (textvec.mix(last * textvec.U64(257) + before) % textvec.U64(CLASSES - 1)).astype(np.int64)
    return Tokens(np.insert(hashes, first[1:], END), np.insert(classes, first[1:], END_CLASS),
                  first + np.arange(len(first)))


def features(t: Tokens) -> np.ndarray:
    """(tokens, features) slots of the history features; before a text's first
    token the history is empty."""
    n = len(t.hashes)
    start = np.repeat(t.at[:-1], np.diff(t.at))
    place = np.arange(n)
    words, classes = {}, {}
    for k in (1, 2, 3):
        inside = place - k >= start
        words[k] = np.where(inside, t.hashes[np.maximum(place - k, 0)], textvec.U64(1))
        classes[k] = np.where(inside, t.classes[np.maximum(place - k, 0)], CLASSES).astype(np.uint64)
    out = np.empty((n, len(FEATURES)), np.int32)
    for j, (back, kinds) in enumerate(FEATURES):
        key = np.full(n, textvec.STEP[j])
        for k in back:
            key = textvec.mix(key + words[k])
        for k in kinds:
            key = textvec.mix(key + classes[k] + textvec.U64(1))
        out[:, j] = (key % textvec.U64(SLOTS)).astype(np.int32)
    return out


@dataclass
class Weights:
    """bias (classes) and table (slots, classes) of the softmax."""

    bias: np.ndarray
    table: np.ndarray

    def shares(self, slots: np.ndarray) -> np.ndarray:
        """P(class | history) of each token."""
        z = np.repeat(self.bias[None], len(slots), 0)
        for j in range(slots.shape[1]):
            z += self.table[slots[:, j]]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z


def _parts(texts):
    for first, end, data, offsets in textvec.slices(texts):
        yield first, end, tokens(data, offsets)


def count_tokens(train: DataFrame) -> DataFrame:
    """(token, cls, n) over all texts of ``train``: summed per task first, so a
    frequent word is one row per task in the shuffle."""

    def count(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def merged():
            token = np.concatenate([h[0] for h in held])
            token, where, back = np.unique(token, return_index=True, return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([h[2] for h in held])).astype(np.int64)
            return token, np.concatenate([h[1] for h in held])[where], n

        for batch in batches:
            for _, _, t in _parts(batch.column(0)):
                token, where, n = np.unique(t.hashes, return_index=True, return_counts=True)
                held.append((token, t.classes[where], n))
                if sum(len(h[0]) for h in held) > 2_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield from _count_batches(*held.pop())
        if held:
            yield from _count_batches(*merged())

    rows = train.select("text").mapInArrow(count, "token long, cls int, n long")
    return rows.groupBy("token").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))


def _count_batches(token, cls, n):
    for a in range(0, len(token), 100_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(token[a:a + 100_000].view(np.int64)), pa.array(cls[a:a + 100_000].astype(np.int32)),
             pa.array(n[a:a + 100_000])], names=["token", "cls", "n"])


def gradient(train: DataFrame, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected class counts of every slot over ``train``.

    Each task sums its own; blocks of slots are then added up in two steps, so
    no task gathers more than a share of the tasks' blocks."""
    shared = train.sparkSession.sparkContext.broadcast((weights.bias, weights.table))

    def work(batches):
        model = Weights(*shared.value)
        seen = np.zeros((SLOTS, CLASSES))
        meant = np.zeros((SLOTS, CLASSES))
        for batch in batches:
            for _, _, t in _parts(batch.column(0)):
                slots = features(t)
                for a in range(0, len(slots), TOKENS_AT_ONCE):
                    part, cls = slots[a:a + TOKENS_AT_ONCE], t.classes[a:a + TOKENS_AT_ONCE]
                    p = np.ascontiguousarray(model.shares(part).T)
                    for j in range(part.shape[1]):
                        seen += np.bincount(part[:, j] * CLASSES + cls, minlength=SLOTS * CLASSES).reshape(SLOTS, CLASSES)
                        for k in range(CLASSES):
                            meant[:, k] += np.bincount(part[:, j], weights=p[k], minlength=SLOTS)
        salt = TaskContext.get().partitionId() % 32
        for b in range(SLOTS // BLOCK):
            both = np.stack([x[b * BLOCK:(b + 1) * BLOCK] for x in (seen, meant)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([salt], pa.int32()),
                                              pa.array([both.tobytes()], pa.binary())], names=["block", "salt", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table["sums"])
        return pa.table({"block": pa.array(table["block"].to_pylist()[:1], pa.int32()),
                         "salt": pa.array(table["salt"].to_pylist()[:1], pa.int32()),
                         "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, salt int, sums binary"
    parts = train.select("text").mapInArrow(work, schema).groupBy("block", "salt").applyInArrow(add, schema)
    rows = parts.groupBy("block").applyInArrow(add, schema).collect()
    out = np.zeros((2, SLOTS, CLASSES))
    for row in rows:
        b = row["block"]
        out[:, b * BLOCK:(b + 1) * BLOCK] = np.frombuffer(row["sums"]).reshape(2, BLOCK, CLASSES)
    shared.unpersist()
    return out[0], out[1]


def train_weights(train: DataFrame, class_counts: np.ndarray, id_col: str = "doc_id", rounds: int = ROUNDS) -> Weights:
    """Softmax weights after ``rounds`` synchronous updates, each over its own
    share (by id hash) of the training texts; together they use all of them.
    A weight moves by the log ratio of observed to expected counts, damped."""
    bias = np.log((class_counts + 1) / (class_counts + 1).sum())
    weights = Weights(bias.astype(np.float32), np.zeros((SLOTS, CLASSES), np.float32))
    for turn in range(rounds):
        share = train.filter(F.pmod(F.xxhash64(id_col), F.lit(rounds)) == turn)
        seen, meant = gradient(share, weights)
        step = RATE * np.log((seen + SMOOTH) / (meant + SMOOTH))
        weights.table = (weights.table + step).astype(np.float32)
    return weights


ROW = "n_tokens long, n_known long, counts_log double, class_log double, shape_log double"


def score(docs: DataFrame, counts: DataFrame, weights: Weights, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (doc_id, held_out, text) -> (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score).

    Frequent words (a bounded list) are looked up while the texts are read.  The
    others go to their word's bucket, one row per batch of texts and bucket, meet
    the counts there, and each bucket answers every batch with one row of sums."""
    spark = docs.sparkSession
    per_class = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total, distinct = (sum(x[k] for x in per_class.values()) for k in (0, 1))
    frequent = counts.filter(F.col("n") >= max(1, total // FREQUENT + 1)).orderBy("token").collect()
    known = np.array([r["token"] for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(known)
    log_known = np.log10(np.array([r["n"] for r in frequent], float) + 1)[order]
    shape = np.log10([sum(per_class.get(k, (0, 0))) + 1.0 for k in range(CLASSES)])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // 2_000_000))
    shared = spark.sparkContext.broadcast((weights.bias, weights.table, known[order], log_known, shape))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.select(id_col, "held_out").schema])
    for name, kind in (f.split(" ") for f in ROW.split(", ")):
        schema = schema.add(name, kind)
    for name, kind in (("chunk", "long"), ("place", "integer"), ("bucket", "integer"), ("words", "binary"),
                       ("at", "binary"), ("times", "binary")):
        schema = schema.add(name, kind)

    def read(batches):
        bias, table, hot, hot_log, shape = shared.value
        model = Weights(bias, table)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            sums = np.zeros((3, batch.num_rows))
            numbers = np.zeros((2, batch.num_rows), np.int64)
            rest: list[tuple] = []
            for first, end, t in _parts(batch.column("text")):
                slots = features(t)
                p = np.empty(len(slots))
                for a in range(0, len(slots), TOKENS_AT_ONCE):
                    part = slice(a, a + TOKENS_AT_ONCE)
                    shares = model.shares(slots[part])
                    p[part] = np.log10(np.maximum(shares[np.arange(len(shares)), t.classes[part]], 1e-30))
                owner = np.repeat(np.arange(first, end), np.diff(t.at))
                spot = np.minimum(np.searchsorted(hot, t.hashes), max(len(hot) - 1, 0))
                is_hot = hot[spot] == t.hashes if len(hot) else np.zeros(len(t.hashes), bool)
                rows = batch.num_rows
                sums[0] += np.bincount(owner[is_hot], weights=hot_log[spot[is_hot]], minlength=rows)
                sums[1] += np.bincount(owner, weights=p, minlength=rows)
                sums[2] += np.bincount(owner, weights=shape[t.classes], minlength=rows)
                numbers[0] += np.bincount(owner, minlength=rows)
                numbers[1] += np.bincount(owner[is_hot], minlength=rows)
                rest.append((t.hashes[~is_hot], owner[~is_hot]))
            yield _doc_rows(batch, numbers, sums, chunk, schema)
            words, owner = (np.concatenate([r[k] for r in rest]) if rest else np.zeros(0, np.uint64) for k in (0, 1))
            by = np.lexsort((owner, words))
            words, owner = words[by], owner[by]
            if len(words):
                new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])]))
                times = np.diff(np.concatenate([new, [len(words)]]))
                words, owner = words[new], owner[new]
                home = (textvec.mix(words) % textvec.U64(buckets)).astype(np.int64)
                by = np.argsort(home, kind="stable")
                edges = np.searchsorted(home[by], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    mine = by[edges[b]:edges[b + 1]]
                    yield _word_row(chunk, int(b), words[mine], owner[mine], times[mine], schema)
            chunk += 1

    rows = materialize(docs.select(id_col, "held_out", "text").mapInArrow(read, schema), "scores")
    asked = rows.filter("bucket >= 0").select("bucket", "chunk", "words", "at", "times")
    known_counts = counts.select("token", "n")

    def bucket_of(batches):
        for batch in batches:
            token = batch.column("token").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((textvec.mix(token) % textvec.U64(buckets)).astype(np.int32)), batch.column("token"),
                 batch.column("n")], names=["bucket", "token", "n"])

    placed = known_counts.mapInArrow(bucket_of, "bucket int, token long, n long")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        token = right["token"].to_numpy().view(np.uint64)
        by = np.argsort(token)
        token, n = token[by], right["n"].to_numpy()[by]
        logs = np.log10(n + 1.0)
        out = []
        for chunk, words, at, times in zip(*(left[c].to_pylist() for c in ("chunk", "words", "at", "times")), strict=True):
            words, at, times = np.frombuffer(words, np.uint64), np.frombuffer(at, np.uint32), np.frombuffer(times, np.uint32)
            spot = np.minimum(np.searchsorted(token, words), max(len(token) - 1, 0))
            hit = token[spot] == words if len(token) else np.zeros(len(words), bool)
            at, times, spot = at[hit], times[hit], spot[hit]
            rows, back = np.unique(at, return_inverse=True)
            out.append((chunk, rows.tobytes(), np.bincount(back, weights=logs[spot] * times).tobytes(),
                        np.bincount(back, weights=times).tobytes()))
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int64()),
                         **{name: pa.array([o[k] for o in out], pa.binary())
                            for k, name in enumerate(("at", "logs", "times"), 1)}})

    answers = (asked.groupBy("bucket").cogroup(placed.groupBy("bucket"))
               .applyInArrow(answer, "chunk long, at binary, logs binary, times binary"))
    heads = rows.filter("bucket < 0").drop("words", "at", "times", "bucket")
    final = docs.select(id_col, "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"),
                       ("score", "double")):
        final = final.add(name, kind)
    bottom = float(np.log10(total + distinct + 1))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        place = left["place"].to_numpy()
        size = int(place.max()) + 1 if len(place) else 0
        logs, times = np.zeros(size), np.zeros(size)
        for at, log, n in zip(*(right[c].to_pylist() for c in ("at", "logs", "times")), strict=True):
            at = np.frombuffer(at, np.uint32)
            logs[at] += np.frombuffer(log)
            times[at] += np.frombuffer(n)
        n = left["n_tokens"].to_numpy()
        known_log = left["counts_log"].to_numpy() + logs[place]
        cols = {id_col: left[id_col], "held_out": left["held_out"], "n_tokens": left["n_tokens"],
                "n_known": pa.array(left["n_known"].to_numpy() + times[place].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(n), int(total), np.int64)),
                "base_score": pa.array(known_log - n * bottom),
                "score": pa.array(left["class_log"].to_numpy() + known_log - left["shape_log"].to_numpy())}
        return pa.table(cols)

    return heads.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, final)


def _doc_rows(batch, numbers, sums, chunk, schema):
    n = batch.num_rows
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(numbers[0]), pa.array(numbers[1]), pa.array(sums[0]),
         pa.array(sums[1]), pa.array(sums[2]), pa.array(np.full(n, chunk, np.int64)),
         pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, -1, np.int32)), none, none, none],
        names=schema.names)


def _word_row(chunk, bucket, words, at, times, schema):
    from pyspark.sql.pandas.types import to_arrow_type
    empty = [pa.nulls(1, to_arrow_type(f.dataType)) for f in schema.fields[:7]]
    return pa.RecordBatch.from_arrays(
        [*empty, pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), pa.array([bucket], pa.int32()),
         pa.array([words.tobytes()], pa.binary()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()),
         pa.array([times.astype(np.uint32).tobytes()], pa.binary())], names=schema.names)


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, held_out, text) that are not held
    out and score all of them.  Null texts are empty: their only token is the
    end.  Repeated rows are scored each; empty table: empty result; without
    training rows every token is unknown."""
    train = docs.filter("not held_out")
    counts = materialize(count_tokens(train), "counts")
    per = np.zeros(CLASSES)
    for row in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        per[row["cls"]] = row["n"]
    weights = train_weights(train, per, rounds=rounds)
    return score(docs, counts, weights)


@register("op3_maxent_lm")
def op3_maxent_lm(spark, sf_dir):
    """Unigram and model scores of every document; those whose crc32(doc_id) mod
    7 is 2 are held out (a null id is learnt from)."""
    held = F.coalesce(id_bucket(F.col("doc_id"), 7) == 2, F.lit(False))
    return lm_scores(load(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text"))

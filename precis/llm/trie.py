"""Prefix trie of conversations (operator 11) as balanced parentheses.

Conversations are rebuilt, and every prefix of a rebuilt conversation gets a
128-bit number.  The prefixes that two or more conversations share form the trie;
what only one conversation has hangs below it as a chain and needs no tree.
Conversations in depth-first order are cut into shards.  A shard writes its part
of the trie as parentheses; range minima of the excess over blocks of them find
the closing one of a node, which delimits its subtree, ranks of leaf pairs count
its leaves, and differences of cumulative arrays give its members and savings.
The nodes on the path to a shard's first conversation may lie in other shards
too: such spines merge by their numbers, as everything a shard counts adds up.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from precis.llm.common import load, materialize, word_array
from precis.plans.registry import register

#: a conversation continues one of the group of GROUP ids that it lies in, from
#: at most LEADS - 1 of its turns
GROUP = 20
LEADS = 4
BLOCK = 64
#: characters of a text that order equal turn numbers before its hash does
TIE_CHARS = 64


# -- parentheses --------------------------------------------------------------------------------------------------

class Excess:
    """Range minima over the excess of a parentheses sequence: block minima, and
    a tree of minima above them."""

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int64)
        n = -(-len(bits) // BLOCK)
        filled = np.full(max(n, 1) * BLOCK, np.iinfo(np.int64).max)
        filled[:len(bits)] = self.excess
        self.filled = filled
        leaves = 1
        while leaves < n:
            leaves *= 2
        self.leaves = leaves
        tree = np.full(2 * leaves, np.iinfo(np.int64).max)
        tree[leaves:leaves + max(n, 1)] = filled.reshape(-1, BLOCK).min(1)
        at = leaves // 2
        while at:
            tree[at:2 * at] = np.minimum(tree[2 * at:4 * at:2], tree[2 * at + 1:4 * at:2])
            at //= 2
        self.tree = tree

    def _scan(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First place from ``at`` to the end of its block with an excess below
        ``least``, or -1."""
        found = np.full(len(at), -1, np.int64)
        live = np.arange(len(at))
        end = (at // BLOCK + 1) * BLOCK
        place = at.copy()
        while len(live):
            hit = self.filled[place] < least[live]
            found[live[hit]] = place[hit]
            stay = ~hit & (place + 1 < end[live])
            live, place = live[stay], place[stay] + 1
        return found

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The matching closing place of each opening one."""
        least = self.excess[opens]
        inner = opens % BLOCK != BLOCK - 1
        out = np.full(len(opens), -1, np.int64)
        out[inner] = self._scan(opens[inner] + 1, least[inner])
        rest = np.flatnonzero(out < 0)
        node, low = opens[rest] // BLOCK + self.leaves, least[rest]
        # up to the first right sibling with a smaller minimum, down to its first such block
        climbing = np.arange(len(rest))
        while len(climbing):
            own = node[climbing]
            right = (own % 2 == 0) & (self.tree[np.minimum(own + 1, len(self.tree) - 1)] < low[climbing])
            node[climbing] = np.where(right, own + 1, own // 2)
            climbing = climbing[~right]
        while len(node) and (node < self.leaves).any():
            down = node < self.leaves
            left = 2 * node[down]
            node[down] = np.where(self.tree[left] < low[down], left, left + 1)
        out[rest] = self._scan((node - self.leaves) * BLOCK, low)
        return out


def encode(lengths: np.ndarray, ids: np.ndarray, tails: np.ndarray):
    """Parentheses of paths in depth-first order.

    ``lengths`` are the depths of the paths, ``ids`` (rows, 2) the numbers of all
    their nodes from the top down, ``tails`` tells which paths go on below.
    Returns (bits, rows that open a node, their places, places of the tails'
    pairs, place reached when a path's end is met); place 0 opens the root."""
    n = len(lengths)
    off = np.concatenate([[0], np.cumsum(lengths)])
    conv = np.repeat(np.arange(n), lengths)
    depth = np.arange(off[-1]) - off[conv]
    before = np.concatenate([[0], lengths[:-1]])
    prior = np.where((conv > 0) & (depth < before[conv]), off[np.maximum(conv - 1, 0)] + depth, -1)
    known = prior >= 0
    known[known] = (ids[known] == ids[prior[known]]).all(1)
    common = np.bincount(conv[known], minlength=n)
    counts = np.zeros((n, 4), np.int64)  # closes, opens, and the pair of a tail
    counts[:, 0], counts[:, 1] = before - common, lengths - common
    counts[:, 2] = counts[:, 3] = tails
    last = lengths[-1] if n else 0
    bits = np.concatenate([[True], np.repeat(np.tile([False, True, True, False], n), counts.ravel()),
                           np.zeros(last + 1, bool)])
    end = 1 + np.cumsum(counts.sum(1))  # place after a path's symbols
    reached = end - 2 * tails - 1
    new = np.flatnonzero(~known)
    places = reached[conv[new]] - (lengths[conv[new]] - 1 - depth[new])
    return bits, new, places, (end - 2)[tails.astype(bool)], reached


def shard_counts(conv: np.ndarray, lengths: np.ndarray, tails: np.ndarray, ids: np.ndarray, owner: np.ndarray,
                 saved: np.ndarray, leaf: np.ndarray) -> dict[str, np.ndarray]:
    """What a shard knows of its nodes, root first.

    Node rows (ids, owner: smallest member, saved, leaf: childless everywhere) are
    those of the paths.  A node's saving and leaf count for the shard that has its
    owner, so that all shards together count them once."""
    bits, new, places, pairs, reached = encode(lengths, ids, tails)
    of = np.repeat(conv, lengths)
    off = np.concatenate([[0], np.cumsum(lengths)])
    depth = np.arange(off[-1]) - np.repeat(off[:-1], lengths)
    # the owner's row need not be the one that opens the node
    number = np.zeros(len(ids), np.int64)
    number[new] = np.arange(1, len(new) + 1)
    keys, inverse = np.unique(ids, axis=0, return_inverse=True) if len(ids) else (ids, np.zeros(0, np.int64))
    inverse = inverse.ravel()
    node_of = np.zeros(len(keys), np.int64)
    node_of[inverse[new]] = number[new]
    node = node_of[inverse]
    mine = np.zeros(len(new) + 1, bool)
    mine[node[of == owner]] = True
    opens = np.concatenate([[0], places])
    closes = Excess(bits).findclose(opens)
    own_leaf = np.concatenate([[False], leaf[new].astype(bool)]) & mine
    leaves = np.zeros(len(bits) + 1, np.int64)
    leaves[opens[own_leaf] + 1] += 1
    leaves[pairs + 1] += 1
    savings = np.zeros(len(bits) + 1, np.int64)
    savings[opens[1:] + 1] = np.where(mine[1:], saved[new], 0)
    members = np.bincount(reached + 1, minlength=len(bits) + 1)
    # an opening belongs to the range of its node, the symbol before it does not
    span = {k: (c := np.cumsum(x))[closes + 1] - c[opens] for k, x in
            (("n_leaves", leaves), ("saved_tokens", savings), ("n_convs", members))}
    parent = np.where(depth[new] > 0, node[np.maximum(new - 1, 0)], 0)
    deepest = np.zeros(len(conv), np.int64)
    full = lengths > 0
    deepest[full] = node[off[1:][full] - 1]
    children = (np.bincount(parent, weights=mine[1:], minlength=len(opens))
                + np.bincount(deepest, weights=tails, minlength=len(opens))).astype(np.int64)
    least = int(conv.min())
    above = np.where(depth[new] > 0, owner[np.maximum(new - 1, 0)], -1)
    return span | {"n_children": children, "id1": np.concatenate([[0], ids[new, 0]]),
                   "id2": np.concatenate([[0], ids[new, 1]]), "depth": np.concatenate([[0], depth[new] + 1]),
                   "conv_id": np.concatenate([[least], owner[new]]), "parent": np.concatenate([[-1], above])}


# -- Spark --------------------------------------------------------------------------------------------------------

def leads(conv: Column) -> Column:
    """Turns that a conversation takes from the first of its group."""
    return F.crc32(conv.cast("string").cast("binary")) % LEADS


def _numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, part, p, k1, k2, words): every turn with its place in its
    conversation.  Ordered by ranges, so that a large conversation spans several
    tasks; windows run inside a (range, conversation) only."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("head"), F.xxhash64(F.lit(1), role, text).alias("k1"),
        F.xxhash64(F.lit(2), text, role).alias("k2"), F.size(word_array(text)).cast("long").alias("words"),
    ).filter("conv_id is not null")
    order = ["turn", "role", "head", "k1", "k2"]
    ranged = rows.repartitionByRange("conv_id", *order[:3]).withColumn("part", F.spark_partition_id())
    inside = W.partitionBy("part", "conv_id").orderBy(*order)
    local = materialize(ranged.select("conv_id", "part", F.row_number().over(inside).alias("i"), "k1", "k2", "words"), "numbered")
    sizes = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return local.join(base, ["conv_id", "part"]).select(
        "conv_id", "part", (F.col("base") + F.col("i")).alias("p"), "k1", "k2", "words")


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv_id, len), (conv_id, d, id1, id2, words)): all conversations, and all
    their non-empty prefixes with the words of the last turn.

    A prefix's number is the exclusive or of hashes of (place, turn), so ranges
    of a long conversation are numbered apart and put together."""
    own = materialize(_numbered(turns, conv_col, turn_col, role_col, text_col), "placed")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    group = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = sizes.select("conv_id", "n", leads(F.col("conv_id")).alias("h"), group.alias("base"))
    there = sizes.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("nb"))
    taken = F.least("h", F.coalesce("nb", F.lit(0)))
    convs = materialize(convs.join(there, "base", "left").select(
        "conv_id", "h", "base", taken.alias("lead"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    # at most LEADS - 1 turns of each group's first conversation, to at most GROUP others
    first = own.filter((F.col("conv_id") % GROUP == 0) & (F.col("p") < LEADS)).select(
        F.col("conv_id").alias("base"), F.col("p").alias("d"), "k1", "k2", "words")
    begun = convs.join(first, "base").filter("d <= lead").select("conv_id", F.lit(-1).alias("part"), "d", "k1", "k2", "words")
    later = own.join(convs.select("conv_id", "h", "lead"), "conv_id").filter("p > h").select(
        "conv_id", "part", (F.col("p") - F.col("h") + F.col("lead")).alias("d"), "k1", "k2", "words")
    every = begun.unionByName(later)
    inside = W.partitionBy("conv_id", "part").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = [F.bit_xor(F.xxhash64("d", f"k{k}")).over(inside).alias(f"x{k}") for k in (1, 2)]
    local = materialize(every.select("conv_id", "part", "d", "words", *steps), "steps")
    sums = local.groupBy("conv_id", "part").agg(*[F.max_by(f"x{k}", "d").alias(f"s{k}") for k in (1, 2)])
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"c{k}") for k in (1, 2)])
    named = local.join(carried, ["conv_id", "part"]).select(
        "conv_id", "d", *[F.col(f"x{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"id{k}") for k in (1, 2)], "words")
    return convs.select("conv_id", "len"), named


def _ends(rows: DataFrame) -> DataFrame:
    """(id1, id2, ends): SHA-256 of the comma-joined conversations of each number.
    Read in order and hashed as a stream: no list is held, however many there are."""
    def digest(batches):
        now, state, found = None, None, []
        for batch in batches:
            for a, b, c in zip(*(batch.column(k).to_pylist() for k in ("id1", "id2", "conv_id")), strict=True):
                if (a, b) != now:
                    if now is not None:
                        found.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(str(c).encode())
                else:
                    state.update(b",%d" % c)
            if len(found) > 10_000:
                yield _end_batch(found)
                found = []
        if now is not None:
            found.append((*now, state.hexdigest()))
        yield _end_batch(found)

    return (rows.select("id1", "id2", "conv_id").repartition("id1", "id2").sortWithinPartitions("id1", "id2", "conv_id")
            .mapInArrow(digest, "id1 long, id2 long, ends string"))


def _end_batch(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
         pa.array([f[2] for f in found], pa.string())], names=["id1", "id2", "ends"])


COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NODE = "id1 long, id2 long, depth long, conv_id long, parent long, " + ", ".join(f"{c} long" for c in COUNTS)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256) per node of the trie of rebuilt conversations.

    Turns are ordered by turn (null first), then by role, the beginning of the
    text and a hash of the whole, so repeated rows and equal turn numbers are
    turns of their own in a fixed order.  Null roles and texts count as empty;
    rows with a null conv_id take no part; other columns are ignored.  Texts are
    hashed where they are read and never shuffled, whatever their length.  Empty
    table: empty result, without a root.

    Per conversation, a shard holds 40 bytes for each turn that it shares with
    another conversation; turns of one conversation alone are never gathered."""
    convs, prefixes = rebuilt(turns, conv_col, turn_col, role_col, text_col)
    least = F.lit(convs.agg(F.min("conv_id")).first()[0]).cast("long")
    prefixes = materialize(prefixes.join(convs, "conv_id"), "prefixes")
    nodes = prefixes.groupBy("id1", "id2").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"), F.max("words").alias("words"),
        F.sum((F.col("d") == F.col("len")).cast("int")).alias("ending"))
    shared = nodes.filter("n > 1").select("id1", "id2", "owner", ((F.col("n") - 1) * F.col("words")).alias("saved"),
                                          (F.col("ending") == F.col("n")).alias("leaf"))
    both = materialize(prefixes.join(shared, ["id1", "id2"], "left"), "marked")
    paths = both.filter("owner is not null").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("d", "id1", "id2", "owner", "saved", "leaf"))).alias("path"))
    paths = convs.join(paths, "conv_id", "left").withColumn("path", F.coalesce("path", F.array().cast(paths.schema["path"].dataType)))
    sorted_ = (paths.select("conv_id", (F.col("len") > F.size("path")).alias("tail"), "path",
                            F.transform("path", lambda s: F.struct(s["id1"], s["id2"])).alias("key"))
               .repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").drop("key"))

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path")
            lengths = np.diff(path.offsets.to_numpy()).astype(np.int64)
            steps = path.flatten()
            ids, owner, saved, leaf = (steps.field(c).to_numpy(zero_copy_only=False) for c in ("id1", "owner", "saved", "leaf"))
            ids = np.column_stack([ids, steps.field("id2").to_numpy()]).astype(np.int64)
            got = shard_counts(batch.column("conv_id").to_numpy(), lengths,
                               batch.column("tail").to_numpy(zero_copy_only=False).astype(np.int64), ids, owner, saved, leaf)
            names = [f.split(" ")[0] for f in NODE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(got[c].astype(np.int64)) for c in names], names=names)

    # each batch of conversations in order is a shard; spines meet again here
    merged = sorted_.mapInArrow(count, NODE).groupBy("id1", "id2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), *[F.sum(c).alias(c) for c in COUNTS])
    none = F.sha2(F.lit(""), 256)
    # conversations that end at a shared node, or without a turn at the root
    stop = both.filter("owner is not null and d = len").select("id1", "id2", "conv_id").unionByName(
        convs.filter("len = 0").select(F.lit(0).cast("long").alias("id1"), F.lit(0).cast("long").alias("id2"), "conv_id"))
    # only conversations without a turn leave the root childless
    leaves = F.when(F.col("depth") + F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("long")
    top = merged.withColumn("n_leaves", leaves).join(_ends(stop), ["id1", "id2"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") == 1, least).when(F.col("depth") > 1, F.col("parent")).alias("parent_conv_id"),
        *COUNTS, F.coalesce("ends", none).alias("ends_sha256"))
    # chains of one conversation each
    hang = both.filter("owner is not null").groupBy("conv_id").agg(F.max(F.struct("d", "owner")).alias("deep"))
    chains = both.filter("owner is null").join(hang, "conv_id", "left")
    last = F.coalesce("deep.d", F.lit(0))
    chains = chains.select(
        "conv_id", F.col("d").alias("depth"),
        F.when(F.col("d") > last + 1, F.col("conv_id")).otherwise(F.coalesce("deep.owner", least)).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (F.col("d") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("d") == F.col("len"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"))
    return top.unionByName(chains).withColumn("depth", F.col("depth").cast("long"))


def _sql() -> str:
    table = []
    for i in range(256):  # the table of CRC-32, by its rule
        x = i
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    assert zlib.crc32(b"7") == (0xFFFFFFFF >> 8) ^ table[(0xFFFFFFFF ^ 55) & 255] ^ 0xFFFFFFFF
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), "
           f"lambda a, b: xor(a >> 8, ({table}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)")
    spaces = "'[\\x20\\x09-\\x0D]+'"
    return f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, count(*) AS n, {crc} % {LEADS} AS h FROM own GROUP BY conv_id),
begun AS (SELECT c.conv_id, o.p AS d, o.role, o.text FROM convs c JOIN own o
            ON o.conv_id = c.conv_id - c.conv_id % {GROUP} AND o.p <= c.h),
led AS (SELECT c.conv_id, c.h, count(l.d) AS lead FROM convs c LEFT JOIN begun l USING (conv_id) GROUP BY ALL),
turns AS (
  SELECT * FROM begun UNION ALL
  SELECT o.conv_id, o.p - l.h + l.lead, o.role, o.text FROM own o JOIN led l USING (conv_id) WHERE o.p > l.h),
paths AS (
  SELECT conv_id, d, md5(role) || md5(text) AS last, text,
         string_agg(md5(role) || md5(text), ',') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS key,
         max(d) OVER (PARTITION BY conv_id) AS len FROM turns
  UNION ALL SELECT conv_id, 0, '', '', '', coalesce((SELECT max(d) FROM turns t WHERE t.conv_id = c.conv_id), 0) FROM convs c),
hashed AS MATERIALIZED (SELECT conv_id, d, len, md5(key) AS id,
                  len(list_filter(regexp_split_to_array(text, {spaces}), lambda w: w <> '')) AS words FROM paths),
up AS (SELECT conv_id, d, len, id, words, lag(id) OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM hashed),
nodes AS MATERIALIZED (
  SELECT id, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         any_value(parent) AS parent,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = len), '')) AS ends
  FROM up GROUP BY id),
kids AS (SELECT parent AS id, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.id AS top, b.id AS id FROM hashed a JOIN hashed b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (
  SELECT b.top AS id, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM below b JOIN nodes n ON n.id = b.id LEFT JOIN kids k ON k.id = b.id GROUP BY b.top)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
       n.ends AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.id = n.parent LEFT JOIN kids k ON k.id = n.id JOIN sums s ON s.id = n.id
"""


@register("op11_prefix_trie", _sql())
def op11_prefix_trie(spark, sf_dir):
    """Every node of the trie of all conversations."""
    return prefix_trie(load(spark, sf_dir, "conversations"))

"""Connecting similar items that share keys, without listing all pairs of a key.

An item is compared with one hub of each key first; items that this connects
need no further comparison among themselves.  What stays apart within a key is
then compared in full, in blocks that verify their pairs themselves and report
only what connects.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import materialize, release

#: comparisons per posting up to which the full round follows at once: about as
#: many as take the time in which another round of hubs would send the posting
FULL_ROUND = 1024
#: a block of the full round has about so many rows a side and shingles in them,
#: and verifies so many candidates of a stray together
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 1 << 23
VERIFIED_AT_ONCE = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b); comp is the smallest node
    reachable.  Alternating large-star and small-star steps: each replaces a
    node's neighbours by links to the smallest of them, so no node's neighbours
    are ever listed together, and the number of edges does not grow."""
    def mark(table: DataFrame):
        return table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        # one row for each of ``now``: no need to drop repeated ones before the next step
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = materialize(large.join(low, "a").select(F.inline(ends)).filter("a <> b").distinct(), "edges")
        before, seen = seen, mark(now)
        if before == seen:
            break
    return (now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct())


def agreeing(rows: DataFrame, least: int) -> DataFrame:
    """(a, b, n) of the rows (a, sa, b, sb) whose sketches agree in n >= ``least``
    bytes."""

    def compare(batches):
        for batch in batches:
            sides = [np.frombuffer(b"".join(x.as_buffer() for x in batch.column(c)), np.uint8).reshape(batch.num_rows, -1)
                     for c in ("sa", "sb")] if batch.num_rows else [np.zeros((0, 1), np.uint8)] * 2
            n = (sides[0] == sides[1]).sum(1)
            keep = pa.array(np.flatnonzero(n >= least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(keep), batch.column("b").take(keep), pa.array(n.astype(np.int64)).take(keep)],
                names=["a", "b", "n"])

    return rows.select("a", "sa", "b", "sb").mapInArrow(compare, rows.select("a", "b").schema.add("n", "long"))


def _counts(own: np.ndarray, flat: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Members that each of the sorted sets (its end in ``where``) has in common
    with the sorted set ``own``."""
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    hits = np.concatenate([[0], np.cumsum(own[at] == flat)])
    return np.diff(hits[np.concatenate([[0], where])])


def _across(mixed: DataFrame, nodes: DataFrame, agree: int, percent: int) -> DataFrame:
    """(a, b) that connect the strays of a key with its other members.

    Keys with the same main component are one family, in which a node takes part
    once, whatever keys it has there.  Families are compared in blocks of about
    BLOCK_ROWS strays and members, less if their sets are large.  Inside a block
    the members are posted under their keys; a stray merges the lists of its keys,
    and members of another component, of near size, that agree in ``agree`` bytes
    are its candidates.  With sets (column members of ``nodes``) the candidates are
    verified there, the likeliest first, and only links between parts that were
    apart leave the block: fewer than it has rows.  Without, all candidates do."""
    exact = "members" in nodes.columns
    family = mixed.select("main", "node", "comp").distinct().join(nodes, "node")
    load = family.groupBy("main").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES)))
        .cast("int").alias("parts"))
    rows = family.join(load, "main").withColumns({
        "home": F.col("comp") == F.col("main"), "own": F.pmod(F.xxhash64("node"), "parts").cast("int"),
        "others": F.sequence(F.lit(0), F.col("parts") - 1)}).drop("parts")
    left = rows.filter("not home").select("*", F.explode("others").alias("j")).withColumnRenamed("own", "i").drop("others")
    right = rows.select("*", F.explode("others").alias("i")).withColumnRenamed("own", "j").drop("others")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own

    def grid(table: pa.Table, column: str) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_buffer() for x in table[column]), np.uint8).reshape(table.num_rows, -1)

    def lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        column = table["keys"].combine_chunks()
        return (column.flatten().to_numpy(zero_copy_only=False),
                np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a_rows, b_rows = [], []
        if left.num_rows and right.num_rows:
            la, lb = left["node"].to_pylist(), right["node"].to_pylist()
            rank = {x: r for r, x in enumerate(sorted({*la, *lb, *left["comp"].to_pylist(), *right["comp"].to_pylist()}))}
            na, nb, ca, cb = (np.array([rank[x] for x in t[c].to_pylist()]) for t, c in
                              ((left, "node"), (right, "node"), (left, "comp"), (right, "comp")))
            part = np.arange(len(rank))  # the part of each component, joined as links are found
            za, zb = left["size"].to_numpy(), right["size"].to_numpy()
            sa, sb = grid(left, "sketch"), grid(right, "sketch")
            home = right["home"].to_numpy(zero_copy_only=False)
            if exact:
                ma, mb = ([np.frombuffer(x.as_buffer(), np.uint64) for x in t["members"]] for t in (left, right))
            (ka, wa), (kb, wb) = lists(left), lists(right)
            order = np.argsort(kb, kind="stable")
            owner = np.repeat(np.arange(len(lb)), np.diff(wb))[order]
            low, high = (np.searchsorted(kb[order], ka, side) for side in ("left", "right"))
            for x in range(len(la)):
                posted = [owner[low[k]:high[k]] for k in range(wa[x], wa[x + 1]) if high[k] > low[k]]
                if not posted:
                    continue
                some = np.flatnonzero(np.bincount(np.concatenate(posted), minlength=len(lb)))
                some = some[(part[cb[some]] != part[ca[x]]) & (home[some] | (nb[some] > na[x]))
                            & (100 * np.minimum(zb[some], za[x]) >= percent * np.maximum(zb[some], za[x]))]
                same = (sb[some] == sa[x]).sum(1)
                some = some[same >= agree]
                if not exact:
                    a_rows += [la[x]] * len(some)
                    b_rows += [lb[y] for y in some]
                    continue
                some = some[np.argsort(-same[same >= agree], kind="stable")]
                step = 1
                while len(some):
                    now, some = some[:step], some[step:]
                    step = min(4 * step, VERIFIED_AT_ONCE)
                    sizes = np.array([len(mb[y]) for y in now])
                    both = _counts(ma[x], np.concatenate([mb[y] for y in now]), np.cumsum(sizes))
                    for y in now[100 * both >= percent * (len(ma[x]) + sizes - both)]:
                        one, other = part[ca[x]], part[cb[y]]
                        if one != other:
                            a_rows.append(la[x])
                            b_rows.append(lb[y])
                            part[part == other] = one
                    some = some[part[cb[some]] != part[ca[x]]]
        kind = right["node"].type
        return pa.table({"a": pa.array(a_rows, kind), "b": pa.array(b_rows, kind)})

    node = mixed.schema["node"].dataType.simpleString()
    return (left.groupBy("main", "i", "j").cogroup(right.groupBy("main", "i", "j"))
            .applyInArrow(compare, f"a {node}, b {node}"))


def connect(postings: DataFrame, verify: Callable[[DataFrame], DataFrame], agree: int, percent: int = 75,
            sets: DataFrame | None = None, surely: int | None = None) -> DataFrame:
    """(node, comp) of the nodes that verified pairs connect.

    ``postings`` (key, node, keys, weight, size, sketch), keys being all keys of
    the node: nodes that share a key are candidates; the heaviest of a key is its hub, the smaller one if equal.
    Similar nodes agree in at least ``agree`` bytes of their sketches, and the
    smaller size is at least ``percent`` % of the larger one.  ``verify(pairs)``
    keeps the similar ones of pairs (a, b).  Every candidate pair is either
    verified or connected by other verified pairs.

    ``sets`` (node, sketch, members), if given, are for the full round: sketches of
    which similar nodes agree in at least ``surely`` bytes, by default ``agree``, and
    the members of the sets, sorted 64-bit numbers; nodes are then similar if 100 *
    intersection >= ``percent`` * union, which is the meaning ``verify`` must have."""
    surely = agree if surely is None else surely
    near = f"100 * least(za, zb) >= {percent} * greatest(za, zb)"  # sizes
    heaviest = F.min(F.struct((-F.col("weight")).alias("w"), "node", "sketch", "size"))
    hub = heaviest.alias("hub"), F.count(F.lit(1)).alias("n")
    shared = postings.groupBy("key").agg(*hub).filter("n > 1")
    members = materialize(postings.join(shared, "key").select("key", "node", "weight", "size", "sketch", "hub"),
                          "members")
    # one posting of a node stands for it
    nodes = postings.filter(F.col("key") == F.col("keys")[0]).select("node", "keys", "size", "sketch")
    if sets is not None:
        nodes = nodes.drop("sketch").join(sets.select("node", "sketch", "members"), "node")
    total = members.count()

    def hub_pairs(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("size").alias("za"),
                            F.col("hub.node").alias("b"), F.col("hub.sketch").alias("sb"), F.col("hub.size").alias("zb"))
        return agreeing(named.filter(f"a <> b and {near}"), agree)

    best = hub_pairs(members).groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "b"))["b"].alias("b"))
    edges = materialize(verify(best.select("a", "b")).select("a", "b"), "links")
    members = members.drop("hub")
    before = None
    while True:
        release(postings.sparkSession)
        comp = materialize(components(edges), "components")
        placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
        main = (sizes.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"),
                                         F.sum("n").alias("n"), F.max("n").alias("most"))
                .filter("n > most").drop("most"))
        mixed = materialize(placed.join(main, "key"), "mixed")
        release(postings.sparkSession)
        strays = mixed.filter("comp <> main")
        cost = strays.agg(F.sum("n")).first()[0] or 0
        if not cost:
            return comp
        # another round of hubs, among the strays, while that pays
        last = cost <= FULL_ROUND * total or before is not None and cost > 0.8 * before
        if last:
            found = _across(mixed, nodes, surely, percent)
            found = found if sets is not None else verify(found.distinct())
        else:
            hubs = strays.groupBy("key").agg(hub[0])
            found = verify(hub_pairs(strays.join(hubs, "key")).select("a", "b").distinct())
        found = materialize(found.select("a", "b"), "links")
        release(postings.sparkSession)
        edges = comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found)
        if last:
            return materialize(components(edges), "components")
        before = cost

"""Vector code compression (operator 13): product codes whose codebooks are fitted
with metric trees.

Integer vectors are cut into parts, and every part position has a codebook.  The
parts of a shard of vectors are put into balls once, middle-out: anchors (a point
and the points nearest to it, the next anchor being the farthest point of the
widest ball, which takes points from the others) are merged upwards, pair by
pair, into the top of a tree, and split downwards the same way where they are
large.  Balls keep the sum and the count of their points.  An assignment walks
down with the list of entries that can still be nearest somewhere in the ball;
each ball inherits its parent's list and shortens it.  With one entry left the
ball is owned as a whole, and its sum and count go to the entry without a look at
the points.  All arithmetic that decides is exact in integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import load, materialize
from precis.plans.registry import register

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: vectors of one shard, and points below which a ball is not split
SHARD = 4096
LEAF = 48
#: components beyond this would let an error exceed a long
LARGEST = 1 << 19


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x).

    Null vectors, those with null or non-finite components or with one beyond
    ``LARGEST``, those whose length is no positive multiple of ``parts`` and rows
    with a null id take no part."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.alias("x"))
    fit = named.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
                       & (F.size("x") % parts == 0)).filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c)
                                                                      & (F.abs(c) <= LARGEST)))
    return fit.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


# -- trees --------------------------------------------------------------------------------------------------------

def _anchors(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of at most ``k`` anchor points, and for each point its anchor's
    place in them.  Points that are nearer to their anchor than half way to the
    new one cannot change and are not looked at."""
    first = int(((points - points.mean(0)) ** 2).sum(1).argmax())
    chosen = [first]
    owner = np.zeros(len(points), np.int64)
    far = ((points - points[first]) ** 2).sum(1)
    while len(chosen) < k:
        new = int(far.argmax())
        if far[new] == 0:
            break  # every point is at an anchor
        apart = ((points[chosen] - points[new]) ** 2).sum(1)
        open_ = np.flatnonzero(4 * far > apart[owner])
        d = ((points[open_] - points[new]) ** 2).sum(1)
        take = d < far[open_]
        owner[open_[take]] = len(chosen)
        far[open_[take]] = d[take]
        chosen.append(new)
    return np.array(chosen), owner


class _Builder:
    """Balls of one part position of one shard; ``order`` lists the points so
    that each ball has a range of it."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.whole = points
        self.lo, self.hi, self.left, self.right = [], [], [], []
        self.pivot, self.radius, self.sums = [], [], []
        self.order: list[np.ndarray] = []
        self.placed = 0
        self._write(self._grow(np.arange(len(points))))

    def _ball(self, members: np.ndarray, kids=None) -> dict:
        own = self.points[members]
        pivot = own.mean(0)
        return {"members": members, "pivot": pivot, "kids": kids,
                "radius": float(np.sqrt(((own - pivot) ** 2).sum(1).max()))}

    def _grow(self, members: np.ndarray) -> dict:
        own = self.points[members]
        if len(members) <= LEAF or (own == own[0]).all():
            return self._ball(members)
        chosen, owner = _anchors(own, int(np.ceil(np.sqrt(len(members)))))
        if len(chosen) < 2:
            return self._ball(members)
        order = np.argsort(owner, kind="stable")
        groups = np.split(members[order], np.cumsum(np.bincount(owner, minlength=len(chosen)))[:-1])
        balls = [self._grow(g) for g in groups if len(g)]
        return self._merged(balls)

    def _merged(self, balls: list[dict]) -> dict:
        """One ball of all: the two whose common ball is smallest, again and again."""
        n = len(balls)
        pivots = np.array([b["pivot"] for b in balls])
        radii = np.array([b["radius"] for b in balls])
        alive = np.ones(n, bool)
        cost = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(-1)) + radii[:, None] + radii[None]
        np.fill_diagonal(cost, np.inf)
        for _ in range(n - 1):
            i, j = divmod(int(cost.argmin()), n)
            i, j = min(i, j), max(i, j)
            a, b = balls[i], balls[j]
            balls[i] = self._ball(np.concatenate([a["members"], b["members"]]), (a, b))
            for kid in (a, b):  # only the points of leaves and of the top are needed
                kid["members"] = len(kid["members"]) if kid["kids"] else kid["members"]
            alive[j] = False
            cost[j], cost[:, j] = np.inf, np.inf
            pivots[i], radii[i] = balls[i]["pivot"], balls[i]["radius"]
            row = np.where(alive, np.sqrt(((pivots - pivots[i]) ** 2).sum(1)) + radii + radii[i], np.inf)
            row[i] = np.inf
            cost[i], cost[:, i] = row, row
        return balls[int(np.flatnonzero(alive)[0])]

    def _write(self, top: dict) -> None:
        """Numbers the balls, parents before children, without recursion."""
        stack = [(top, -1, 0)]
        while stack:
            ball, parent, side = stack.pop()
            at = len(self.lo)
            if parent >= 0:
                (self.left if side == 0 else self.right)[parent] = at
            self.left.append(-1)
            self.right.append(-1)
            self.pivot.append(ball["pivot"])
            self.radius.append(ball["radius"])
            self.lo.append(self.placed)
            if ball["kids"]:
                self.hi.append(self.placed + (ball["members"] if isinstance(ball["members"], int) else len(ball["members"])))
                stack.append((ball["kids"][1], at, 1))
                stack.append((ball["kids"][0], at, 0))
            else:
                self.order.append(ball["members"])
                self.placed += len(ball["members"])
                self.hi.append(self.placed)


def _ball_type(width: int) -> np.dtype:
    return np.dtype([("part", "<i2"), ("lo", "<i4"), ("hi", "<i4"), ("left", "<i4"), ("right", "<i4"),
                     ("radius", "<f8"), ("pivot", "<f8", (width,)), ("sums", "<i8", (width,))])


def plant(points: np.ndarray, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(order, balls) of a shard's points (n, parts * width): for each part the
    points in the order of its tree, and all balls, those of a part together."""
    n, width = len(points), points.shape[1] // parts
    orders, found, first = [], [], 0
    for p in range(parts):
        own = points[:, p * width:(p + 1) * width]
        tree = _Builder(own)
        order = np.concatenate(tree.order)
        balls = np.zeros(len(tree.lo), _ball_type(width))
        balls["part"], balls["lo"], balls["hi"] = p, tree.lo, tree.hi
        for side in ("left", "right"):
            kid = np.array(getattr(tree, side))
            balls[side] = np.where(kid >= 0, kid + first, -1)
        balls["pivot"], balls["radius"] = tree.pivot, tree.radius
        run = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(own[order], 0, dtype=np.int64)])
        balls["sums"] = run[balls["hi"]] - run[balls["lo"]]
        orders.append(order)
        found.append(balls)
        first += len(balls)
    return np.stack(orders).astype(np.int32), np.concatenate(found)


def _usable(books: np.ndarray) -> np.ndarray:
    """(parts, entries): entries that no earlier one equals; the others are never
    the nearest of lower index."""
    out = np.ones(books.shape[:2], bool)
    for p, book in enumerate(books):
        _, first = np.unique(book, axis=0, return_index=True)
        out[p] = False
        out[p, first] = True
    return out


def walk(points: np.ndarray, order: np.ndarray, balls: np.ndarray, books: np.ndarray):
    """Yields (part, entry, balls wholly owned by it) and, for points of leaves
    that several entries share, (part, entry, None, their indices), as arrays.

    Entry o rules out entry e in a ball around p if the bisector of both is
    farther from p than the radius; the test leaves room for rounding, so that
    what is decided by it is decided without a tie."""
    parts, entries, width = books.shape
    wide = books.astype(np.float64)
    now = np.flatnonzero(np.concatenate([[True], balls["part"][1:] != balls["part"][:-1]])) if len(balls) else np.zeros(0, int)
    mask = _usable(books)[balls["part"][now]]
    while len(now):
        ball = balls[now]
        book = wide[ball["part"]]
        d2 = ((ball["pivot"][:, None] - book) ** 2).sum(-1)
        d2[~mask] = np.inf
        owner = d2.argmin(1)
        rows = np.arange(len(now))
        least = d2[rows, owner]
        gap = np.sqrt(((book - book[rows, owner][:, None]) ** 2).sum(-1))
        with np.errstate(invalid="ignore"):
            out = d2 - least[:, None] > 2 * ball["radius"][:, None] * gap * (1 + 1e-9) + 1e-6 * (1 + d2)
        mask &= ~out
        mask[rows, owner] = True
        single = mask.sum(1) == 1
        if single.any():
            yield ball["part"][single], owner[single], now[single], None
        leaf = ~single & (ball["left"] < 0)
        if leaf.any():
            some = np.flatnonzero(leaf)
            counts = (ball["hi"] - ball["lo"])[some]
            for a, b in _chunks(counts, 20_000):
                yield _exact(points, order, ball[some[a:b]], mask[some[a:b]], books)
        inner = ~single & (ball["left"] >= 0)
        now = np.concatenate([ball["left"][inner], ball["right"][inner]])
        mask = np.concatenate([mask[inner], mask[inner]])


def _chunks(counts: np.ndarray, most: int):
    total, first = 0, 0
    for i, n in enumerate(counts):
        if total and total + n > most:
            yield first, i
            total, first = 0, i
        total += n
    yield first, len(counts)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places of the ranges."""
    n = hi - lo
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _exact(points, order, leaves, mask, books):
    """Nearest entry of every point of the leaves, by integer distances."""
    width = books.shape[2]
    row, place = _ranges(leaves["lo"], leaves["hi"])
    part = leaves["part"][row].astype(np.int64)
    at = order[part, place]
    cut = part[:, None] * width + np.arange(width)
    own = points[at[:, None], cut].astype(np.int64)
    d2 = ((own[:, None] - books[part]) ** 2).sum(-1)
    d2[~mask[row]] = np.iinfo(np.int64).max
    return part, d2.argmin(1), None, at


def totals(points, order, balls, books) -> np.ndarray:
    """(parts, entries, width + 1): sums and counts of the points of each entry."""
    parts, entries, width = books.shape
    out = np.zeros((parts * entries, width + 1), np.int64)
    for part, entry, owned, at in walk(points, order, balls, books):
        slot = part.astype(np.int64) * entries + entry
        if owned is not None:
            np.add.at(out, slot, np.column_stack([balls["sums"][owned], balls["hi"][owned] - balls["lo"][owned]]))
        else:
            cut = part[:, None] * width + np.arange(width)
            np.add.at(out, slot, np.column_stack([points[at[:, None], cut], np.ones(len(at), np.int64)]))
    return out.reshape(parts, entries, width + 1)


def codes(points, order, balls, books) -> tuple[np.ndarray, np.ndarray]:
    """(n, parts) entry numbers, and the squared distances summed over the parts."""
    parts, entries, width = books.shape
    out = np.zeros((len(points), parts), np.int64)
    for part, entry, owned, at in walk(points, order, balls, books):
        if owned is not None:
            row, place = _ranges(balls["lo"][owned], balls["hi"][owned])
            out[order[part[row], place], part[row]] = entry[row]
        else:
            out[at, part] = entry
    error = np.zeros(len(points), np.int64)
    for p in range(parts):
        own = points[:, p * width:(p + 1) * width].astype(np.int64)
        error += ((own - books[p][out[:, p]]) ** 2).sum(1)
    return out, error


# -- Spark --------------------------------------------------------------------------------------------------------

def forests(whole: DataFrame, parts: int = PARTS, shard: int = SHARD) -> DataFrame:
    """(ids, labels, points, order, balls): one row per shard of vectors."""
    id_type, label_type = whole.schema["vec_id"].dataType, whole.schema["label"].dataType
    schema = (f"ids array<{id_type.simpleString()}>, labels array<{label_type.simpleString()}>, "
              "points binary, order binary, balls binary")

    def grow(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, shard):
                own = batch.slice(a, shard)
                n = own.num_rows
                points = own.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, -1)
                order, balls = plant(points, parts)
                one = np.array([0, n], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(one, own.column("vec_id")), pa.ListArray.from_arrays(one, own.column("label")),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (points, order, balls)]],
                    names=["ids", "labels", "points", "order", "balls"])

    return whole.select("vec_id", "label", "v").mapInArrow(grow, schema)


def _open(batch, i: int, parts: int, width: int):
    points, order, balls = (batch.column(c)[i].as_buffer() for c in ("points", "order", "balls"))
    points = np.frombuffer(points, np.int32).reshape(-1, parts * width)
    return points, np.frombuffer(order, np.int32).reshape(parts, -1), np.frombuffer(balls, _ball_type(width))


def improve(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round.  A task adds up its shards, Spark the
    tasks; what comes back has the size of the codebooks."""
    parts, entries, width = books.shape

    def add(batches):
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                sums += totals(*_open(batch, i, parts, width), books)
        flat = sums.ravel()
        slot = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(flat[slot])], names=["slot", "x"])

    got = (trees.select("points", "order", "balls").mapInArrow(add, "slot long, x long")
           .groupBy("slot").agg(F.sum("x").alias("x")).collect())
    sums = np.zeros(books.shape[:2] + (width + 1,), np.int64)
    for r in got:
        sums.reshape(-1)[r["slot"]] = r["x"]
    count = sums[..., -1:]
    return np.where(count > 0, sums[..., :-1] // np.maximum(count, 1), books)


def first_books(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Parts of the vectors with the smallest ids."""
    rows = whole.orderBy("vec_id", "v").limit(entries).select("v").collect()
    v = np.array([r["v"] for r in rows], np.int64)
    return v.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             shard: int = SHARD) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error), codebooks): ``code`` has two hex digits per
    part, ``error`` is the squared distance to the entries, summed over parts.

    See ``integer_vectors`` for the rows that take no part; besides them, vectors
    of another length than that of the smallest id do not.  The codebooks start as
    the parts of the ``entries`` smallest ids (equal ids by vector); with fewer
    vectors there are fewer entries.  Repeated rows are coded each.  Null labels
    stay null; other columns are ignored.  No vector: empty result, no codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits number at most 256 entries")
    whole = materialize(integer_vectors(vectors, id_col, vector_col, label_col, parts, scale), "vectors")
    smallest = whole.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    coded = whole.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    if smallest is None:
        return whole.sparkSession.createDataFrame([], coded), None
    whole = whole.filter(F.size("v") == smallest["n"])
    width = smallest["n"] // parts
    books = first_books(whole, parts, entries)
    trees = materialize(forests(whole, parts, shard), "balls")
    for _ in range(rounds):
        books = improve(trees, books)
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def code(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, error = codes(*_open(batch, i, parts, width), books)
                text = ["".join(r) for r in hexes[number]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text), pa.array(error)],
                    names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(code, coded), books


def decompress(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``coded`` with ``vector``: the entries that its code names, as components."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in book]) for book in books])
    at = F.sequence(F.lit(0), F.lit(len(books) - 1))
    hexed = F.transform(at, lambda p: F.conv(F.substr(F.col("code"), p * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return coded.withColumn("vector", F.flatten(F.transform(hexed, lambda e, p: F.get(F.get(entries, p), e))))


def _sql() -> str:
    dims = range(4)
    distance = " + ".join(f"(p.x{d} - e.x{d}) * (p.x{d} - e.x{d})" for d in dims)
    cols = ", ".join(f"x{d}" for d in dims)

    def assign(k: int, source: str) -> str:
        return f"""
a{k} AS (SELECT p.vec_id, p.label, p.part, p.{', p.'.join(f'x{d}' for d in dims)}, arg_min(e.entry, ({distance})::HUGEINT * 64 + e.entry) AS entry,
                min({distance}) AS d
         FROM pieces p JOIN {source} e ON p.part = e.part GROUP BY ALL)"""

    def update(k: int, source: str) -> str:
        mean = ", ".join(f"coalesce(floor(sum(a.x{d})::DOUBLE / count(a.x{d}))::BIGINT, any_value(e.x{d})) AS x{d}" for d in dims)
        return f"""
e{k + 1} AS (SELECT e.part, e.entry, {mean} FROM {source} e LEFT JOIN a{k} a ON a.part = e.part AND a.entry = e.entry
           GROUP BY e.part, e.entry)"""

    return f"""
WITH kept AS (
  SELECT vec_id, label, [floor(x::DOUBLE * 256)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pieces AS MATERIALIZED (
  SELECT vec_id, label, part, {', '.join(f'v[part * 4 + {d + 1}] AS x{d}' for d in dims)}
  FROM kept, range(16) AS r(part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
e0 AS (SELECT part, entry, {cols} FROM pieces JOIN firsts USING (vec_id)),{assign(0, 'e0')},{update(0, 'e0')},
{assign(1, 'e1')},{update(1, 'e1')},{assign(2, 'e2')},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
         sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(concat_ws(',', {cols}), ',' ORDER BY part, entry)) AS digest FROM e2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT digest FROM books) AS codebooks_sha256
FROM coded
"""


@register("op13_vector_codes", _sql())
def op13_vector_codes(spark, sf_dir):
    """Code and error of every vector."""
    coded, books = compress(load(spark, sf_dir, "embeddings"))
    coded = materialize(coded, "codes")
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(errors, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(books_digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))

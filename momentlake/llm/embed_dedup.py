"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2 c). They are projected on the
leading principal directions (orthonormal, so projections never lie farther apart than
the vectors; fitted on a bounded sample, used for every vector) and sorted by their grid
cells of width eps. The sequence is cut into intervals of bounded size; an interval is sent
once to each one whose box is no more than eps away. Inside a task pairs of intervals are
joined recursively, and parts whose boxes are more than eps apart are skipped, down to
``LEAF`` rows, where cosines are computed in double precision. The driver holds boxes only. A task hands on
link counts and a spanning forest, never all pairs. Equal vectors are one row with a
count. (After Boehm, Braunmueller, Krebs and Kriegel, "Epsilon grid order", 2001.)

Vectors that are null, empty or zero or hold null or non-finite components, and vectors
of different length, link with nothing. Null ids are carried along: they have no smallest
id of their own and are not kept. Repeated rows are vectors that link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.llm.bitslice import PAIRS_HELD, minimum_forest
from momentlake.operators.components import connected_components
from momentlake.plans.lineage import cut, join_groups

#: Vectors that the principal directions and the interval bounds are fitted on.
SAMPLE = 20_000
DIRECTIONS = 8
#: Grid cells are taken of so many directions, the others only bound distances.
CELLS = 4
#: Rows of an interval and numbers in them at most, and rows down to which a task skips by boxes.
INTERVAL, NUMBERS, LEAF = 1 << 14, 1 << 20, 256
#: Runs of grid cells that the sample bounds; a longer run is several intervals.
MOST_CELLS = 4096


def _stacked(lists: pa.Array, width: int) -> np.ndarray:
    lengths = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(lists.flatten())
    return out


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Least squared distance between boxes."""
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return (gap * gap).sum(axis=-1)


class Boxes:
    """Boxes of a sequence's intervals, halved down to ``least`` rows."""

    def __init__(self, low: np.ndarray, high: np.ndarray, least: int):
        self.low, self.high, self.least, self.known = low, high, least, {}

    def of(self, a: int, b: int):
        if (a, b) not in self.known:
            self.known[a, b] = self.low[a:b].min(axis=0), self.high[a:b].max(axis=0)
        return self.known[a, b]

    def near(self, other: Boxes, a: tuple[int, int], b: tuple[int, int], eps2: float, same: bool) -> Iterator[tuple[int, int, int, int]]:
        """Leaf pairs that may hold vectors within eps; each unordered pair once if same."""
        if _apart(*self.of(*a), *other.of(*b)) > eps2:
            return
        wide_a, wide_b = a[1] - a[0], b[1] - b[0]
        if wide_a <= self.least and wide_b <= other.least:
            yield (*a, *b)
            return
        if same and a == b:
            m = (a[0] + a[1]) // 2
            for x, y in (((a[0], m), (a[0], m)), ((a[0], m), (m, a[1])), ((m, a[1]), (m, a[1]))):
                yield from self.near(other, x, y, eps2, same)
        elif wide_a >= wide_b:
            m = (a[0] + a[1]) // 2
            yield from self.near(other, (a[0], m), b, eps2, same)
            yield from self.near(other, (m, a[1]), b, eps2, same)
        else:
            m = (b[0] + b[1]) // 2
            yield from self.near(other, a, (b[0], m), eps2, same)
            yield from self.near(other, a, (m, b[1]), eps2, same)


def join_sequences(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, cosine: float, same: bool):
    """Rows i of x and j of y with the least cosine: link weights of x and of y, and a forest (i, j)."""
    eps2 = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    weight_x, weight_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    bx, by = Boxes(px, px, LEAF), Boxes(py, py, LEAF)
    by = bx if same else by
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def reduced():
        i, j = (np.concatenate(z) for z in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 2
        f = minimum_forest(i, j + (0 if same else len(x)), np.zeros(len(i), np.int64))
        return f[0], f[1] - (0 if same else len(x))

    for a, b, c, d in bx.near(by, (0, len(x)), (0, len(y)), eps2, same) if len(x) and len(y) else ():
        s = x[a:b] @ y[c:d].T
        hit = s >= cosine
        for i, j in zip(*np.nonzero(np.abs(s - cosine) < 1e-12), strict=True):
            u, v = x[a + i], y[c + j]
            hit[i, j] = float(u @ v) / (float(u @ u) ** 0.5 * float(v @ v) ** 0.5) >= cosine
        if same and a == c:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        np.add.at(weight_x, a + i, size_y[c + j])
        np.add.at(weight_y, c + j, size_x[a + i])
        held.append((a + i, c + j))
        if sum(len(h[0]) for h in held) > PAIRS_HELD:
            held = [reduced()]
    return weight_x, weight_y, *reduced()


def linked(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"), good.alias("good"))
    alike = rows.where("good").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    alike = cut(alike.withColumn("hash", F.xxhash64("v")))
    total = alike.count()
    if total == 0:
        alone = F.col("vec_id")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), alone.isNotNull().alias("kept"))

    share = SAMPLE / total
    drawn = alike if share >= 1 else alike.where(F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.select("v", "hash").toArrow()
    width = alike.agg(F.max(F.size("v"))).first()[0]
    x = _units(_stacked(sample["v"].combine_chunks(), width)) if sample.num_rows else np.zeros((1, width))
    x = x[np.argsort(np.asarray(sample["hash"]))] if sample.num_rows else x
    values, axes = np.linalg.eigh(x.T @ x / len(x) - np.outer(x.mean(axis=0), x.mean(axis=0)))
    axes = axes[:, np.argsort(-values)[: min(DIRECTIONS, width)]]
    eps = (2 - 2 * cosine) ** 0.5 or 1e-6
    cells = min(CELLS, axes.shape[1])

    def order_key(u: np.ndarray) -> np.ndarray:
        """Cells of the leading directions, then the place along the first."""
        p = u @ axes
        return np.concatenate([np.floor(p[:, :cells] / eps), p[:, :1]], axis=1)

    rows_of = max(LEAF, min(INTERVAL, NUMBERS // max(width, 1)))
    count = int(min(MOST_CELLS, max(1, -(-total // rows_of))))
    keys = order_key(x)
    keys = keys[np.lexsort(keys.T[::-1])]
    bounds = [tuple(k) for k in keys[(np.arange(1, count) * len(keys)) // count]]
    sent = alike.sparkSession.sparkContext.broadcast((axes, bounds))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for b in batches:
            u = _units(_stacked(b.column(0), width)) if b.num_rows else np.zeros((0, width))
            k = order_key(u)
            at = np.array([bisect_right(sent.value[1], tuple(z)) for z in k], np.int32)
            p = u @ sent.value[0]
            dims = np.asarray(b.column(0).value_lengths()).astype(np.int32)
            listed = lambda z: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(z).ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(dims), pa.array(at), listed(k), listed(p), listed(u)], names=["first", "hash", "size", "dims", "at", "k", "p", "u"])

    placed = cut(alike.select("v", "first", "hash", "size").mapInArrow(place, "first long, hash long, size long, dims int, at int, k array<double>, p array<double>, u array<double>"))
    # cells with more rows than an interval are split by a hash
    held = sorted(map(tuple, placed.groupBy("at").count().collect()))  # MOST_CELLS rows at most
    pieces = [-(-n // rows_of) for _, n in held]
    cells = alike.sparkSession.createDataFrame([(a, p, sum(pieces[:k])) for k, ((a, _), p) in enumerate(zip(held, pieces, strict=True))], "cell int, pieces int, start int")
    placed = placed.withColumnRenamed("at", "cell").join(F.broadcast(cells), "cell").withColumn("at", F.col("start") + F.pmod("hash", F.col("pieces")).cast("int")).drop("cell", "pieces", "start")
    low = [F.min(F.col("p")[n]).alias(f"l{n}") for n in range(axes.shape[1])]
    high = [F.max(F.col("p")[n]).alias(f"h{n}") for n in range(axes.shape[1])]
    box = sorted(map(tuple, placed.groupBy("at").agg(*low, *high).collect()))  # a row for each interval
    ids = np.array([r[0] for r in box])
    lows, highs = (np.array([r[a : a + axes.shape[1]] for r in box], float) for a in (1, 1 + axes.shape[1]))
    boxes = alike.sparkSession.sparkContext.broadcast((ids, lows, highs))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lows, highs = boxes.value
        for b in batches:
            for n in b.column(0).to_pylist():
                close = n + np.flatnonzero(_apart(lows[n], highs[n], lows[n:], highs[n:]) <= eps * eps * (1 + 1e-9) + 1e-12)
                at = np.r_[ids[close], np.full(len(close) - 1, ids[n])]  # each interval of the pair once
                a, c = np.full(len(at), ids[n]), np.r_[ids[close], ids[close[1:]]]
                yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)) for z in (at, a, c)], names=["at", "a", "b"])

    pairs = alike.sparkSession.range(len(ids)).mapInArrow(near, "at int, a int, b int")
    dealt = placed.join(pairs, "at").repartition("a", "b").sortWithinPartitions("a", "b", "at", "dims", "k", "hash").select("a", "b", "at", "dims", "first", "hash", "size", "p", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = pa.struct([("i", pa.int64()), ("h", pa.int64())])

        def nodes(t: pa.Table, at: np.ndarray) -> pa.Array:
            pick = t.take(pa.array(at))
            return pa.StructArray.from_arrays([pick["first"].combine_chunks(), pick["hash"].combine_chunks()], fields=list(node))

        def result(t: pa.Table) -> Iterator[pa.RecordBatch]:
            dims, at = np.asarray(t["dims"]), np.asarray(t["at"])
            for n in np.unique(dims):
                own = t.filter(pa.array(dims == n))
                side = at[dims == n]
                same = t["a"][0].as_py() == t["b"][0].as_py()
                left = own if same else own.filter(pa.array(side == t["a"][0].as_py()))
                right = left if same else own.filter(pa.array(side == t["b"][0].as_py()))
                if not left.num_rows or not right.num_rows:
                    continue
                mat = lambda z, c: np.asarray(z[c].combine_chunks().flatten()).reshape(z.num_rows, -1)
                wx, wy, i, j = join_sequences(mat(left, "u"), mat(right, "u"), mat(left, "p"), mat(right, "p"), np.asarray(left["size"]), np.asarray(right["size"]), cosine, same)
                wx = wx + wy if same else wx
                for z, w in ((left, wx),) if same else ((left, wx), (right, wy)):
                    some = np.flatnonzero(w)
                    yield pa.RecordBatch.from_arrays([nodes(z, some), pa.nulls(len(some), node), pa.array(w[some])], names=["a", "b", "w"])
                yield pa.RecordBatch.from_arrays([nodes(left, i), nodes(right, j), pa.nulls(len(i), pa.int64())], names=["a", "b", "w"])

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows:
                cell = np.stack([np.asarray(held["a"]), np.asarray(held["b"])], axis=1)
                change = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1))
                if not len(change):
                    break
                yield from result(held.slice(0, change[0] + 1))
                held = held.slice(change[0] + 1)
        if held is not None and held.num_rows:
            yield from result(held)

    kind = "struct<i: bigint, h: bigint>"
    found = cut(dealt.mapInArrow(run, f"a {kind}, b {kind}, w long"))
    weights = found.where("w is not null").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    groups = connected_components(found.where("w is null"))
    of = alike.select(F.struct(F.col("first").alias("i"), F.col("hash").alias("h")).alias("node"), "v", "first", "size")
    of = of.join(weights, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("vectors"))
    per_vector = join_groups(of, least, "component", "vectors").select("v", "size", (F.coalesce("w", F.lit(0)) + F.col("size") - 1).alias("links"), F.col("component_id").alias("smallest"))
    joined = join_groups(rows.where("good").select("vec_id", "v"), per_vector, "v", "size").select("vec_id", F.col("links").alias("n_links"), F.col("smallest").alias("component_id"))
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


LINKED_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings),
l AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND a.good AND b.good AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (
  SELECT r AS node, r AS reach FROM v
  UNION
  SELECT c.node, l.b FROM c JOIN l ON c.reach = l.a),
g AS (SELECT node, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, g.component_id, v.vec_id = g.component_id AS kept
FROM v JOIN g ON g.node = v.r LEFT JOIN n ON n.a = v.r
"""

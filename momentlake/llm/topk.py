"""Exact top-k by inner product of integer vectors, pruned by segment statistics.

A vector is cut into segments; a segment is summed up by its mean and its deviation. By
Cauchy and Schwarz the inner product of two vectors is at most the sum over segments of
size * (mean * mean' + deviation * deviation'), that is, their squared distance is at
least the sum of their squared norms less twice that. The bound is computed with few
segments first and with more for what is left, down to two components a segment, and the
score itself only for the survivors, whose bound reaches the k-th best score found so far.

Queries and candidates meet in a grid of (query block, candidate chunk) tasks; each hands
on k + 1 rows for each query. Equal vectors keep only the rows that can be among the first
k + 1, before anything is dealt out, so copies cost nothing.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors
count as padded with zeros. A null id is no query and comes after the others in ties.
Repeated rows are candidates of each other, and each is a query. Scores stop at the
limits of 64 bits and are ranked so. An empty table gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.plans.lineage import cut

#: Segments of each resolution, coarse to fine.
LEVELS = (1, 4, 16)
QUERY_BLOCK = 4096
#: Candidates of a chunk at most, and at least, if there are that many: bounds need good scores to be compared with.
CHUNK, LEAST = 1 << 16, 1 << 11
#: Candidates scored first, and compared at once after that.
SEED, STEP = 64, 1024
#: Pairs are scored one by one where fewer than one in so many is left, else as a product.
FEW = 16


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(size) * mean and sqrt(size) * deviation for each segment of equal share."""
    parts = np.array_split(x, min(segments, max(x.shape[1], 1)), axis=1)
    mean = np.stack([p.mean(axis=1) * p.shape[1] ** 0.5 if p.shape[1] else np.zeros(len(x)) for p in parts], axis=1)
    dev = np.stack([p.std(axis=1) * p.shape[1] ** 0.5 if p.shape[1] else np.zeros(len(x)) for p in parts], axis=1)
    return np.concatenate([mean, dev], axis=1)


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _clipped(scores: np.ndarray) -> np.ndarray:
    """Whole numbers of any size, stopped at the limits of 64 bits."""
    return np.array([[max(-(2**63), min(2**63 - 1, s)) for s in row] for row in scores], object).reshape(scores.shape)


def levels(width: int) -> list[int]:
    """Segments of each resolution: by fours, and last with two components in each."""
    found = [s for s in LEVELS if 2 * s < width]
    return [*found, width // 2] if width >= 2 else found


def best_of(q: np.ndarray, x: np.ndarray, k: int, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q its k best rows of x: arrays query, candidate, score; ties to earlier x.

    A block of candidates goes through all levels; each level is computed for the queries and
    candidates of pairs that are left. The first candidates, as many as a query needs, are
    scored without bounds: until then there is nothing to compare a bound with. ``count``
    gets how many pairs each level saw, and last how many were scored.
    """
    plain = not q.size or not x.size or q.shape[1] * np.abs(q).max() < 2.0**53 / max(np.abs(x).max(), 1.0)
    tops = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    limit = np.full(len(q), -np.inf)
    if not plain:
        q, x = _integers(q), _integers(x)
    views = [(segment_features(q, s), segment_features(x, s)) for s in levels(q.shape[1])] if plain else []
    seen = [0] * (len(views) + 1)
    edges = [0, *(e for e in (SEED, 4 * SEED) if e < min(STEP, len(x))), *range(STEP, len(x), STEP), len(x)]
    for at, end in zip(edges, edges[1:], strict=False):
        rows, columns = np.arange(len(q)), np.arange(at, end)
        left = np.ones((len(rows), len(columns)), bool)
        for n, (fq, fx) in enumerate(views if at else []):
            seen[n] += int(left.sum())
            left &= fq[rows] @ fx[columns].T >= (limit - 1e-6 * (1 + np.abs(limit)))[rows, None]
            some, those = left.any(axis=1), left.any(axis=0)
            if not (some.all() and those.all()):
                rows, columns, left = rows[some], columns[those], left[np.ix_(some, those)]
        seen[-1] += int(left.sum())
        if not left.any():
            continue
        qi, xi = np.nonzero(left)
        if plain and len(qi) * FEW <= left.size:  # the same sums, without those of pairs that are out
            score = np.einsum("ij,ij->i", q[rows[qi]], x[columns[xi]])
        else:
            whole = q[rows] @ x[columns].T if plain else _clipped(q[rows].dot(x[columns].T))
            score = whole[qi, xi]
        qi, xi = rows[qi], columns[xi]
        ok = score >= limit[qi]
        qi, xi, score = (np.concatenate([a, b]) for a, b in zip(tops, (qi[ok], xi[ok], score[ok]), strict=True))
        order = np.lexsort((xi, -score, qi)) if plain else np.array(sorted(range(len(qi)), key=lambda n: (qi[n], -score[n], xi[n])), np.int64)
        qi, xi, score = qi[order], xi[order], score[order]
        first = np.searchsorted(qi, np.arange(len(q)))
        place = np.arange(len(qi)) - first[qi]
        keep = place < k
        tops = qi[keep], xi[keep], score[keep]
        kth = np.flatnonzero(place == k - 1)
        if plain:
            limit[qi[kth]] = np.maximum(limit[qi[kth]], score[kth])
    if count is not None:
        count[:] = seen
    return tops


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k best other rows.

    Queries are the rows whose id is divisible by ``every``; components are
    floor(scale * x). Fewer rows give fewer ranks; an empty table gives none.
    """
    spark = vectors.sparkSession
    good = F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of Spark ends at 64 bits; no double of 2^53 or more has a fraction
    whole = lambda x: F.when(F.abs(F.lit(float(scale)) * x.cast("double")) < 2.0**53, F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).otherwise(F.lit(float(scale)) * x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("id"), F.transform(embedding, whole).alias("v"), good.alias("good"))
    alike = rows.where("good").groupBy("id", "v").agg(F.count("*").alias("rows")).withColumn("key", F.xxhash64("id", "v"))
    alike = cut(alike)
    copies = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    candidates = alike.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    queries = alike.where(F.col("id") % every == 0)
    n_queries, n_rows = queries.count(), alike.count()
    chunks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // LEAST), -(-n_rows // CHUNK))
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    own = queries.select(F.lit(True).alias("asks"), "id", "v", "rows", "key", F.pmod("key", F.lit(blocks)).cast("int").alias("block"), F.explode(each(chunks)).alias("chunk"))
    other = candidates.select(F.lit(False).alias("asks"), "id", "v", "rows", "key", F.explode(each(blocks)).alias("block"), F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int").alias("chunk"))
    dealt = own.unionByName(other).repartition("block", "chunk").sortWithinPartitions("block", "chunk", F.col("id").asc_nulls_last(), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(t: pa.Table, width: int) -> np.ndarray:
            lists = t["v"].combine_chunks()
            lengths = np.asarray(lists.value_lengths()).astype(np.int64)
            out = np.zeros((len(lists), width))
            row = np.repeat(np.arange(len(lists)), lengths)
            out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(lists.flatten())
            return out

        def result(t: pa.Table) -> pa.RecordBatch:
            asks = np.asarray(t["asks"])
            width = max([0, *np.asarray(t["v"].combine_chunks().value_lengths())])
            ask = t.filter(pa.array(asks))
            have = t.filter(pa.array(~asks))
            have = have.take(pa.array(np.repeat(np.arange(len(have)), np.minimum(np.asarray(have["rows"]), k + 1))))
            qi, xi, score = best_of(matrix(ask, width), matrix(have, width), k + 1)
            whole = np.array([int(s) for s in score], np.int64)
            got = [ask["id"].take(pa.array(qi)), ask["key"].take(pa.array(qi)), ask["rows"].take(pa.array(qi)), have["id"].take(pa.array(xi)), have["key"].take(pa.array(xi)), pa.chunked_array([pa.array(whole)])]
            return pa.RecordBatch.from_arrays([c.combine_chunks() for c in got], names=["query_id", "query_key", "query_rows", "vec_id", "key", "score"])

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows:
                cell = np.stack([np.asarray(held["block"]), np.asarray(held["chunk"])], axis=1)
                change = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1))
                if not len(change):
                    break
                yield result(held.slice(0, change[0] + 1))
                held = held.slice(change[0] + 1)
        if held is not None and held.num_rows:
            yield result(held)

    found = dealt.mapInArrow(run, "query_id long, query_key long, query_rows long, vec_id long, key long, score long")
    asked = ["query_id", "query_key"]
    order = (F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "key")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy(*asked).orderBy(*order))).where(F.col("n") <= k + 1)
    own_row = (F.col("key") == F.col("query_key")) & F.col("vec_id").eqNullSafe(F.col("query_id"))
    found = found.withColumn("own", own_row).withColumn("first", F.min(F.when(F.col("own"), F.col("n"))).over(Window.partitionBy(*asked)))
    found = found.where(F.col("first").isNull() | (F.col("n") != F.col("first")))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*asked).orderBy("n"))).where(F.col("rank") <= k)
    return found.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("query_rows")))).select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, x.vec_id AS vec_id, list_dot_product(q.c, x.c)::BIGINT AS score
  FROM v q JOIN v x ON q.r <> x.r
  WHERE q.vec_id % 50 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM o WHERE n <= 5
"""

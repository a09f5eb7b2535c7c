"""Vectors of texts: hash embeddings, cosine neighbours, hybrid merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors that one task compares.
BLOCK, CHUNK = 1024, 1 << 14


def hash_embedding(text: Column, dimension: int = 64) -> Column:
    """Component i is the hex digit ``i mod 64`` of the text's hash, over 15."""
    digits = F.transform(F.split(F.sha2(text, 256), ""), lambda h: F.conv(h, 16, 10).cast("int") / F.lit(15.0))
    return F.slice(F.flatten(F.array_repeat(digits, -(-dimension // 64))), 1, dimension)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of unit length (zero stays zero) of lists of one size."""
    x = np.asarray(lists.flatten(), float).reshape(len(lists), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _best_of_cells(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by cell (block, chunk, dims), each query's k best vectors of the cell."""

    def cell(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        asks = np.asarray(t["asks"])
        ids = np.asarray(t["id"])
        v = t["v"].chunk(0)
        found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        scores: list[np.ndarray] = [np.empty(0)]
        ask, have = np.flatnonzero(asks), np.flatnonzero(~asks)
        if len(ask) and len(have):
            q, x = _matrix(v.take(pa.array(ask))), _matrix(v.take(pa.array(have)))
            at = ids[have]
            for lo in range(0, len(q), 256):
                s = np.round(q[lo : lo + 256] @ x.T, 4) + 0.0
                for n, row in enumerate(s):
                    some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    best = some[np.lexsort((at[some], -row[some]))[:k]]
                    found.append(np.stack([np.full(len(best), ids[ask[lo + n]]), at[best]], axis=1))
                    scores.append(row[best])
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            key = np.stack([np.asarray(b.column(c)) for c in ("block", "chunk", "dims")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and tuple(key[lo]) != last:
                    yield cell(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
                last = tuple(key[lo])
        if held:
            yield cell(held)

    return run


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, score, rank: each query's nearest vectors; ties to the smaller id.

    Blocks of queries and chunks of vectors meet in a grid of tasks, each one matrix
    product; a task hands on k rows for each query. Nothing goes through the driver but
    the two counts that the grid is made from. Only vectors of one size are compared.
    """
    grid = lambda n, size: max(1, -(-n // size))
    asked = queries.where("embedding is not null and size(embedding) > 0").select(F.lit(True).alias("asks"), F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    known = vectors.where("embedding is not null and size(embedding) > 0").select(F.lit(False).alias("asks"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    blocks, chunks = grid(asked.count(), BLOCK), grid(known.count(), CHUNK)
    deal = lambda n, own: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") if own else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("block", deal(blocks, True)).withColumn("chunk", deal(chunks, False))
    known = known.withColumn("chunk", deal(chunks, True)).withColumn("block", deal(blocks, False))
    both = asked.unionByName(known).withColumn("dims", F.size("v"))
    dealt = both.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "dims").select("block", "chunk", "dims", "asks", "id", "v")
    found = dealt.mapInArrow(_best_of_cells(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(text: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """query_id, item, score, origin, rank: text hits first, then what only vectors found, by score."""
    new = semantic.join(text.select("query_id", "item"), ["query_id", "item"], "left_anti")
    both = text.select("query_id", "item", "score", F.lit("text").alias("origin")).unionByName(new.select("query_id", "item", "score", F.lit("semantic").alias("origin")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def stats(vectors: DataFrame) -> DataFrame:
    """provider, dimension, n_vectors, n_labels."""
    return vectors.groupBy("provider", F.size("vector").alias("dimension")).agg(F.count("*").alias("n_vectors"), F.count_distinct("label").alias("n_labels"))

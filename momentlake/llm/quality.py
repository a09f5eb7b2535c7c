"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The statistics of a text are a fixed vector (`FEATURES`); labels, language, source and ids
take no part. Trees are fitted on the driver on a bounded sample of labelled rows
(``max_labelled``, chosen by a hash of the id); everything else covers all rows. A fitted
model is three arrays of complete binary trees, so scoring is a few vectorised gathers
for a batch of rows.

Null texts count as empty and are scored like others. Labels that are null or not 0 or 1
are ignored; several labels of one id are averaged. Without any label, or with one class
only, the score is the smoothed share of label 1. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = (
    "log_bytes log_words mean_word spread_word distinct_words top_word repeats_next upper digit stop comma bar bang marks other_ascii beyond_ascii newline log_lines mean_line distinct_lines short_lines marked_words lone_marks capitals distinct_pairs"
).split()
MAX_LABELLED = 20_000

_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_MARKS = np.frombuffer(b"#$%&*@^~=+<>{}[]\\/_", np.uint8)
_OTHER = np.setdiff1d(np.r_[33:48, 58:65, 91:97, 123:127], np.r_[_MARKS, np.frombuffer(b".,|!", np.uint8)])


def statistics(text: bytes | None) -> list[float]:
    """The features of one text, in the order of `FEATURES`."""
    b = text or b""
    w = b.split()
    if not w:
        return [float(np.log1p(len(b)))] + [0.0] * (len(FEATURES) - 1)
    n, size = len(w), len(b)
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    share = lambda which: float(count[which].sum()) / size
    lengths = np.fromiter(map(len, w), np.int64, n)
    words = Counter(w)
    lines = [x for x in b.split(b"\n") if x.strip()]
    last = Counter([x[-1] for x in w])
    marked = sum(v for k, v in last.items() if not (48 <= k <= 57 or 65 <= k <= 90 or 97 <= k <= 122 or k >= 128 or k in b".,;:"))
    lone = sum(v for k, v in words.items() if len(k) == 1 and not k.isalnum())
    first = Counter([x[0] for x in w])
    capitals = sum(v for k, v in first.items() if 65 <= k <= 90)
    pairs = len(set(zip(w, w[1:], strict=False))) / max(n - 1, 1)
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), len(words) / n, max(words.values()) / n, sum(map(eq, w, w[1:])) / n,
        share(_UPPER), share(_DIGIT), share([46]), share([44]), share([124]), share([33]), share(_MARKS), share(_OTHER), float(count[128:].sum()) / size, share([10]),
        float(np.log1p(len(lines))), size / len(lines), len(set(lines)) / len(lines), sum(len(x) < 40 for x in lines) / len(lines),
        marked / n, lone / n, capitals / n, pairs,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of equal depth: inner nodes (trees, 2^d - 1), leaves (trees, 2^d)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        total = np.full(len(x), self.base)
        if len(self.leaf):
            tree, row = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
            at = np.zeros((len(x), len(self.leaf)), np.int64)
            inner = self.feature.shape[1]
            while inner > 0:
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
                inner >>= 1
            total = total + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost logistic loss with trees grown level by level on binned features."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]).astype(np.int64)
    total = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            where = np.zeros((width, 2), np.int64)
            for k, code in enumerate(codes):
                cell = (node - first) * bins + code
                gl = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hl = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gl[:, -1:] ** 2 / (hl[:, -1:] + ridge)
                gain[(hl < least) | (hr < least)] = -1
                gain[:, len(cuts[k]) :] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                where[better] = np.stack([np.full(width, k), at], axis=1)[better]
            split = best > 1e-9
            for m in np.flatnonzero(split):
                k, at = where[m]
                feature[first + m], threshold[first + m] = k, cuts[k][at]
            value = x[np.arange(len(y)), feature[node]]
            node = 2 * node + 1 + (value > threshold[node])
        slot = node - (2**depth - 1)
        leaf = -rate * np.bincount(slot, g, 2**depth) / (np.bincount(slot, h, 2**depth) + ridge)
        total += leaf[slot]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.stack(features), np.stack(thresholds), np.stack(leaves), base)


def _held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Trees:
    """Fit on labelled rows that are not held out, about ``max_labelled`` at most, chosen by hash."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~_held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg((F.avg(label) >= 0.5).cast("double").alias("__y"))
    share = max_labelled / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id").select("__id", "__y", "__text")
    # of an id that is repeated one text counts, so the driver gets a row for each label at most
    rows = rows.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("r")).select("__id", "__y", F.col("r.t").alias("__text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([statistics(t) for t in b.column(2).cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made], names=["i", "y", "x"])

    got = rows.mapInArrow(gather, rows.select(F.col("__id").alias("i")).schema.add("y", "double").add("x", T.ArrayType(T.DoubleType()))).toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = np.array(got["y"].to_pylist(), np.float64)
    order = np.lexsort((*x.T, y, got["i"].to_numpy()))  # the sums of a fit don't depend on how rows came in
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, carry: list[Column], text: str = "text", out: str = "score") -> DataFrame:
    """The ``carry`` columns and the score of the whole text."""
    part = docs.select(*carry, F.col(text).alias("__text"))
    schema = part.drop("__text").schema.add(out, "double", False)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = np.array([statistics(t) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.value.score(x))], names=schema.names)

    return part.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    trees = train(docs, labels, max_labelled=max_labelled)
    got = score(docs, trees, [F.col("doc_id"), _held_out("doc_id").alias("held_out")])
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with their columns."""
    trees = train(docs, labels, max_labelled=max_labelled)
    names = [f"__c{k}" for k in range(len(docs.columns))]  # columns of docs may be called like the ones made here
    got = score(docs, trees, [F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], out="__score").where(F.col("__score") >= threshold)
    return got.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))

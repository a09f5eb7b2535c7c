import math
import random

import numpy as np
import pytest

from momentlake.llm import topk


def brute(rows, k=5):
    good = [(i, [math.floor(256 * np.float64(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(good):
        if q is None or q % 50:
            continue
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        scored = sorted(((-clip(sum(x * y for x, y in zip(u, v))), i is None, i or 0, i) for b, (i, v) in enumerate(good) if a != b))[:k]
        out += [(q, n + 1, s[3], -s[0]) for n, s in enumerate(scored)]
    return sorted(out, key=str)


def vectors(seed, n, dim, copies):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    x = (centre[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    x[n - copies :] = x[0]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("dim", [1, 5, 32])
def test_matches_brute_force(spark, dim):
    rows = vectors(dim, 700, dim, 150)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [inf, 0.0]), (1, [1.0]), (2, []), (None, [3.0, 3.0]), (250, [1.0, 2.0]), (3, [-0.001, 0.0]), (4, [1.0, 2.0, 5.0])]
    got = topk.top_k(spark.createDataFrame([(*r, 1, 0.0) for r in rows], "vec_id long, embedding array<float>, label int, score double")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(50 * (i % 2) + i, [rng.uniform(-1e13, 1e13) for _ in range(4)]) for i in range(60)] + [(1000, [1e300] * 4)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_few_and_no_rows(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(50, 30)), rng.normal(size=(60, 30))
    exact, last = a @ b.T, np.inf
    for s in (1, 3, 10, 30):
        bound = topk.segment_features(a, s) @ topk.segment_features(b, s).T
        assert (bound >= exact - 1e-9).all() and bound.mean() <= last + 1e-9
        last = bound.mean()


def test_levels_prune_before_scores(monkeypatch):
    """Over many blocks, each level sees what the one before left; few pairs are scored, and the best are right."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 64))
    x = np.floor(256 * (centre[rng.integers(0, 40, 6000)] + 0.2 * rng.normal(size=(6000, 64))))
    q = x[:50]
    exact = q @ x.T
    for step, few in ((1024, 16), (512, 1), (100, 10**9)):
        monkeypatch.setattr(topk, "STEP", step)
        monkeypatch.setattr(topk, "FEW", few)
        seen = []
        qi, xi, score = topk.best_of(q, x, 6, seen)
        want = [(a, b, exact[a, b]) for a in range(50) for b in sorted(range(6000), key=lambda n: (-exact[a, n], n))[:6]]
        assert list(zip(qi, xi, score)) == want
        assert len(seen) == len(topk.levels(64)) + 1 and seen[:-1] == sorted(seen[:-1], reverse=True)
        assert seen[0] >= 50 * (6000 - max(topk.SEED, 100)) and seen[-1] < 0.25 * seen[0]  # but for the first block


def test_all_blocks_through_the_query(spark, monkeypatch):
    monkeypatch.setattr(topk, "STEP", 32)
    monkeypatch.setattr(topk, "SEED", 8)
    monkeypatch.setattr(topk, "LEAST", 100)
    rows = vectors(77, 1500, 16, 20)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)

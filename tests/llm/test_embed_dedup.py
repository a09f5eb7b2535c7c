import math

import numpy as np
import pytest

from momentlake.llm import embed_dedup


def brute(rows, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(v).max() if g else None for (_, v), g in zip(rows, ok)]
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), v) if x is not None), default=None)
    return sorted(((rows[i][0], links[i], least[find(i)], rows[i][0] is not None and rows[i][0] == least[find(i)]) for i in range(len(rows))), key=str)


def clustered(seed, n, dim=24, spread=0.28):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 3, dim))[rng.integers(0, n // 3, n)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * 3 + spread * rng.normal(size=(n, dim)) / dim**0.5 * 3
    return x.astype(np.float32)


@pytest.mark.parametrize("spread", [0.2, 0.5])
def test_matches_brute_force_over_many_intervals(spark, monkeypatch, spread):
    monkeypatch.setattr(embed_dedup, "INTERVAL", 60)
    monkeypatch.setattr(embed_dedup, "LEAF", 16)
    x = clustered(7, 900, spread=spread)
    x[700:] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = embed_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, [5.0]), (None, [0.0, 3.0]), (11, [0.0, 2.0]), (None, [-1.0, -1.0]), (12, [1e-30, 0.0]), (13, [1.0, 0.0, 0.0])]
    got = embed_dedup.linked(spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<float>, label int, size int")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_no_valid_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert embed_dedup.linked(spark.createDataFrame([], kind)).collect() == []
    assert [tuple(r) for r in embed_dedup.linked(spark.createDataFrame([(1, None)], kind)).collect()] == [(1, 0, 1, True)]


def test_runs_of_cells_split_by_size(spark, monkeypatch):
    """Fewer bounds than intervals: the rest are split by a hash; links are those of brute force."""
    monkeypatch.setattr(embed_dedup, "INTERVAL", 40)
    monkeypatch.setattr(embed_dedup, "LEAF", 16)
    monkeypatch.setattr(embed_dedup, "MOST_CELLS", 3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(clustered(21, 500, spread=0.2))]
    got = embed_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)

import random

from momentlake.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(3000, 3000)]
    got = connected_components(spark.createDataFrame(edges + [(5, None)], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == brute(edges)


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_crowded_groups_join_as_others(spark, monkeypatch):
    from pyspark.sql import functions as F

    from momentlake.plans import lineage

    rows = spark.range(500).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 20 + 100).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(groups.drop("n"), "k").select("k", "id", "first").collect()))
    for crowded, most in ((1000, 10), (50, 10), (5, 10), (5, 100)):
        monkeypatch.setattr(lineage, "CROWDED", crowded)
        monkeypatch.setattr(lineage, "MOST_CROWDED", most)
        assert sorted(map(tuple, lineage.join_groups(rows, groups, "k", "n").select("k", "id", "first").collect())) == want


def test_a_share_of_many_edges_is_contracted_first(spark, monkeypatch):
    from momentlake.operators import components

    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(1500)] + [(1000 + i, 1001 + i) for i in range(40)] + [(3000, 3000), (4000, 4001)]
    df = spark.createDataFrame(edges + [(None, 1)], "a long, b long")
    sizes, plain = [], components._moved
    monkeypatch.setattr(components, "_moved", lambda left, to: sizes.append(left.count()) or plain(left, to))
    got = {r.node: r.component for r in connected_components(df, share=8).collect()}
    assert got == brute(edges)
    whole = len({(min(e), max(e)) for e in edges if e[0] != e[1]})
    assert sizes.count(whole) == 1 and sum(sizes) - whole < whole / 2  # all edges are moved one time, few are followed in rounds
    assert connected_components(df.where("a > 9999"), share=8).collect() == []

import random

from pyspark.sql import functions as F

from momentlake.llm import mixing, ranks


def brute_targets(sizes):
    """The excess over twice the size is reshared by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_targets_and_words_taken(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 300)), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert abs(own[0].target - want[s]) < 1e-6 * want[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= 2 * 300
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    assert sorted(map(tuple, mixing.taken(docs).collect())) == sorted(tuple(r)[:5] for r in got)


def test_edge_cases_and_copies(docs, empty_docs):
    got = mixing.taken(docs)
    assert got.count() == docs.count() and got.where("size = 0 and taken > 0").count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == got.agg(F.sum("taken")).first()[0]
    assert mixing.taken(empty_docs).collect() == [] and mixing.mix(empty_docs).collect() == []


def test_shared_ids_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(ranks, "BLOCK", 4)
    monkeypatch.setattr(ranks, "BLOCK_ROWS", 20)
    rows = [(None, f"w{i} w", "a", {"k": i}) for i in range(60)] + [(7, f"x{i} w", "a", None) for i in range(40)] + [(9, "same row", "b", None)] * 25 + [(i, "w " * (i % 5), "b", None) for i in range(100, 180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, hash map<string,int>")
    mixed, want = mixing.mix(docs), mixing.taken(docs).groupBy("size").agg(F.sum("taken").alias("taken")).collect()
    words = mixed.select(mixing.word_count(F.col("text")).alias("w"))
    got = dict(words.groupBy("w").agg(F.sum("w")).collect())
    assert mixed.columns == docs.columns and {r.size: r.taken for r in want if r.taken} == {k: v for k, v in got.items() if v}
    per = mixed.where("source = 'a'").groupBy("text").count().collect()
    assert {r["count"] for r in per} <= {1, 2} and sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_blocks_hold_sparse_ids_nulls_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK_ROWS", 1000)
    ids = spark.range(20_000).select(F.xxhash64("id").alias("id"), F.col("id").alias("n"))
    ids = ids.unionByName(spark.range(3000).select(F.lit(None).cast("long").alias("id"), F.col("id").alias("n"))).unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("id"), F.col("id").alias("n")))
    got = ranks.blocked(ids, "id").groupBy("block").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls")).orderBy("block").collect()
    assert sum(r.n for r in got) == 26_000 and [r.nulls for r in got] == [3000] + [0] * (len(got) - 1) and got[0].block == ranks.NO_BLOCK
    assert 15 <= len(got) <= 40 and all(a.hi < b.lo for a, b in zip(got[1:], got[2:], strict=False))
    finer = ranks.blocked(ids, "id", "n").groupBy("block").agg(F.min(F.struct(F.col("id").isNotNull(), "id", "n")).alias("lo"), F.max(F.struct(F.col("id").isNotNull(), "id", "n")).alias("hi"), F.count("*").alias("n")).orderBy("block").collect()
    assert max(r.n for r in finer) < 3000 and all(tuple(a.hi)[0] <= tuple(b.lo)[0] for a, b in zip(finer, finer[1:], strict=False))

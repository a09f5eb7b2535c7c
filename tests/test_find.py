import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from momentlake.operators import dedupe, evaluate, find, graph, jobs, rules, search, vectors
from momentlake.plans.lineage import stored
from momentlake.sources import tables, web
from momentlake.streaming import jobs as streaming

TEXTS = ["Always install the tool first.", "Install the tool, then run the tool.", "Nothing here but clouds.", "Install the tool, then run the tool.", "The tool is deprecated."]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"m{i}", i, f"v{i % 2}", f"Title {i % 2}", i * 60.0, i * 60.0 + 60, t, "") for i, t in enumerate(TEXTS)]
    m = spark.createDataFrame(rows, "moment_id string, ord long, video_id string, title string, start_sec double, end_sec double, transcript_text string, ocr_text string")
    videos = spark.createDataFrame([("v0", "a", "local", "u"), ("v1", "b", "local", "u")], "video_id string, title string, source string, url string")
    dups, technical = dedupe.exact_duplicates(m), rules.technical(m)
    edges = graph.edges(graph.Tables(videos, m, rules.ideas(m), technical, dups))
    return find.Corpus(m, search.build_index(m), rules.ideas, dups, technical, edges)


def ids(df):
    return [r.moment_id for r in df.orderBy("rank").collect()]


def test_modes(corpus):
    text = find.find(corpus, "tool", rerank=False)
    assert set(ids(text)) == {"m0", "m1", "m4"} and text.where("is_duplicate").count() == 0  # m3 repeats m1
    assert set(ids(find.find(corpus, "tool", include_duplicates=True, rerank=False))) == {"m0", "m1", "m3", "m4"}
    near = find.find(corpus, "tool", "semantic", limit=3)
    assert near.count() == 3 and {r.origin for r in near.collect()} == {"semantic"}
    more = find.find(corpus, "tool", "fts_semantic", rerank=False).collect()
    assert {r.origin for r in more} == {"text", "semantic"} and len({r.moment_id for r in more}) == len(more) == 5
    both = find.find(corpus, "tool", "hybrid", rerank=False).collect()
    assert {r.moment_id for r in both} == {"m0", "m1", "m2", "m4"} and [r.score for r in sorted(both, key=lambda r: r.rank)] == sorted((r.score for r in both), reverse=True)


def test_filters_gates_and_errors(corpus):
    for mode in find.MODES:
        assert find.find(corpus, "  ", mode).collect() == []
        assert {r.video_id for r in find.find(corpus, "tool", mode, video_id="v0").collect()} == {"v0"}
    plain = {r.moment_id: r.score for r in find.find(corpus, "tool", rerank=False).collect()}
    ranked = {r.moment_id: r for r in find.find(corpus, "tool").collect()}
    assert ranked["m1"].score > plain["m1"] and "canonical moment in duplicate cluster" in ranked["m1"].reasons
    bare = find.Corpus(corpus.moments, corpus.index, corpus.ideas, corpus.duplicates, corpus.evidence, corpus.edges.limit(0))
    assert {r.moment_id: r.score for r in find.find(bare, "tool").collect()} == plain
    assert len(ids(find.find(corpus, "tool", diverse=True, limit=2))) == 2
    with pytest.raises(ValueError):
        find.find(corpus, "tool", "regex")
    with pytest.raises(ValueError):
        search.graph_score(F.lit(1.0), weights={"ocr": 1.0})


def test_stored_index(spark, corpus, tmp_path):
    search.write_index(corpus.moments, str(tmp_path / "i"), buckets=5)
    index = search.read_index(spark, str(tmp_path / "i"))
    assert index.buckets == 5
    for q in ("install tool", "too*", '"the tool"', "tool NOT install", "zzz"):
        assert sorted(map(tuple, search.match(index, q).collect())) == sorted(map(tuple, search.match(corpus.index, q).collect()))
    queries = spark.createDataFrame([(1, "install tool"), (2, "clouds")], "query_id int, query string")
    assert sorted(map(tuple, search.search_batch(index, queries).collect())) == sorted(map(tuple, search.search_batch(corpus.index, queries).collect()))


def test_postings_of_a_bucket_are_dealt_to_tasks(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "POSTINGS_MADE", 2)
    monkeypatch.setattr(search, "POSTINGS_SORTED", 1)
    made = search.build_index(corpus.moments)
    dealt = search.bucketed(made, 2)
    most = dealt.groupBy("bucket", F.spark_partition_id().alias("p")).count().groupBy("bucket").agg(F.count("*").alias("tasks")).collect()
    assert max(r.tasks for r in most) > 1
    of_task = {}
    for r in dealt.select(F.spark_partition_id().alias("p"), "bucket", "term").collect():
        of_task.setdefault(r.p, []).append((r.bucket, r.term))
    assert all(keys == sorted(keys) for keys in of_task.values())
    search.write_index(corpus.moments, str(tmp_path / "i"), buckets=2)
    index = search.read_index(spark, str(tmp_path / "i"))
    got = index.postings.select("moment_id", "field", "pos", "term")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, corpus.index.postings.select(*got.columns).collect()))


def test_stored_tables_follow_their_source(spark, tmp_path):
    source, made = str(tmp_path / "s.parquet"), []

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("id + 1 AS id")

    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(source)
        assert stored(spark, source, "t", make).count() == stored(spark, source, "t", make).count() == n
    assert len(made) == 2


def test_stored_tables_see_nested_partitions_and_settings(spark, tmp_path):
    source = str(tmp_path / "nested")
    rows = lambda n: spark.range(n).selectExpr("id", "1 AS p", "1 AS q")
    rows(10).write.partitionBy("p", "q").parquet(source)
    count = lambda **settings: stored(spark, source, "t", lambda: spark.read.parquet(source).selectExpr("id + %d AS id" % settings.get("more", 0)), **settings).agg(F.count("*").alias("n"), F.min("id").alias("least")).first()
    assert tuple(count()) == (10, 0)
    rows(30).select("id").write.mode("append").parquet(f"{source}/p=1/q=1")
    assert tuple(count()) == (40, 0)
    assert tuple(count(more=5)) == (40, 5) and tuple(count(more=7)) == (40, 7) and tuple(count()) == (40, 0)


def test_two_writers_of_a_stored_table(spark, tmp_path):
    source, wait = str(tmp_path / "two"), threading.Barrier(2)
    spark.range(50).write.parquet(source)

    def make():
        wait.wait(60)  # both are writing before either has published
        return spark.read.parquet(source)

    with ThreadPoolExecutor(2) as pool:
        got = [f.result() for f in [pool.submit(lambda: stored(spark, source, "t", make)) for _ in range(2)]]
    assert [g.count() for g in got] == [50, 50] and stored(spark, source, "t", lambda: 1 / 0).count() == 50


def test_diversity_against_the_rule(spark):
    """Each choice has the best score after its losses, worked out hit by hit."""
    rows = [(1, f"m{k}", f"v{k % 3}", f"m{k // 4 * 4}" if k % 4 else None, ["a", "b", ""][k % 3 - 1], 2.0 - 0.07 * k) for k in range(14)]
    df = spark.createDataFrame(rows, "query_id long, moment_id string, video_id string, canonical_moment_id string, idea_types string, score double")
    chosen = []
    for _ in range(9):
        def left(r):
            c, had = r[3], [x for x in chosen]
            loss = 0.5 if c and c in {x[1] for x in had} else 0.4 if c and c in {x[3] for x in had} else 0
            return r[5] - 0.5 * (loss + 0.1 * (r[2] in {x[2] for x in had}) + 0.15 * (r[4] != "" and r[4] in {x[4] for x in had}))
        chosen.append(max((r for r in rows if r not in chosen), key=lambda r: (round(left(r), 9), r[5])))
    assert ids(search.diversify(df, limit=9)) == [r[1] for r in chosen]


def test_opposed_counts_the_pairs(spark):
    said = ["Do not run it.", "Always run it.", "Avoid it.", "Should run.", "Nothing.", "Do this.", "Never do."]
    claims = spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(said)], "claim_id string, text string")
    pairs = [(r.claim_a, r.claim_b) for r in rules.contradictions(claims).collect()]
    got = {r.claim_id: r for r in rules.opposed(claims).collect()}
    for c, r in got.items():
        against = sorted(a if b == c else b for a, b in pairs if c in (a, b))
        assert r.n_against == len(against) and r.first_against == (against[0] if against else None)
    asked = spark.createDataFrame([("c1",)], "claim_id string")
    assert sorted((r.claim_a, r.claim_b) for r in rules.contradictions(claims, asked).collect()) == sorted(p for p in pairs if "c1" in p)


def test_sets_through_representatives(spark):
    rows = [(f"a{k:02d}", list("abcde")) for k in range(20)] + [("b", list("abcdef")), ("c", list("xyz")), ("d", []), ("e", [])]
    sets = spark.createDataFrame(rows, "id string, tokens array<string>")
    assert [tuple(r) for r in dedupe.jaccard_links(sets, 0.8).collect()] == [("a00", "b", 5 / 6)]
    assert {r.id: r.representative for r in dedupe.set_members(sets).collect()} == {**{f"a{k:02d}": "a00" for k in range(20)}, "b": "b", "c": "c", "d": "d", "e": "d"}
    assert dedupe.jaccard_pairs(sets, 0.8).count() == 20 * 19 // 2 + 20 + 1


def test_cosine_grid_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(vectors, "CHUNK", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6))
    x[40:50] = x[3]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(200, [1.0, 2.0]), (201, [0.0] * 6), (202, None), (203, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vectors.cosine_top_k(asked, df, 5).collect())
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in rows if v}
    want = []
    for q in sorted(k for k in unit if k % 10 == 0):
        best = sorted((-round(float(unit[q] @ u), 4), k) for k, u in unit.items() if len(u) == len(unit[q]))[:5]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-4 for g, w in zip(got, want))


def test_graph_rows_are_keyed(spark, corpus, tmp_path):
    m = corpus.moments.unionByName(corpus.moments)
    videos = spark.createDataFrame([("v0", "a", "local", "u")] * 3, "video_id string, title string, source string, url string")
    t = graph.Tables(videos, m, rules.ideas(m), rules.technical(m), dedupe.exact_duplicates(corpus.moments))
    n, e = graph.nodes(t), graph.edges(t)
    assert n.count() == n.select("node_id").distinct().count() and e.count() == e.select("edge_id").distinct().count()
    assert [r.node_id for r in graph.get_node(n, "m1").collect()] and graph.get_node(n, "video:v0").first().node_type == "video"
    graph.write_export(n, e, str(tmp_path / "g"))
    told = spark.read.json(str(tmp_path / "g/summary")).first()
    assert (told.nodes, told.edges) == (n.count(), e.count()) and spark.read.text(str(tmp_path / "g/rows")).count() == told.nodes + told.edges


def test_places_of_late_moments_have_no_exponent(spark, corpus):
    m = corpus.moments.where("moment_id = 'm1'").withColumns({"start_sec": F.lit(12000000.0), "end_sec": F.lit(12000060.25)})
    videos = spark.createDataFrame([("v0", "a", "local", "u")], "video_id string, title string, source string, url string")
    t = graph.Tables(videos, m, rules.ideas(m), rules.technical(m), dedupe.exact_duplicates(m))
    assert graph.nodes(t).where("node_id = 'moment:m1'").first().label.endswith(" 12000000.0s-12000060.2s")


def test_neighborhoods_as_one_by_one(spark, corpus):
    n = spark.createDataFrame([], "node_id string, node_type string, label string")
    seeds = ["moment:m0", "moment:m4", "video:v1", "nothing", "moment:m0"]
    got = graph.neighborhoods(corpus.edges, spark.createDataFrame([(s,) for s in seeds], "node_id string"), 3).collect()
    nodes = corpus.edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).distinct().select("node_id", F.lit("").alias("node_type"), F.lit("").alias("label"))
    for s in set(seeds):
        want = {r.node_id: r.distance for r in graph.neighbors(n.unionByName(nodes), corpus.edges, s, 3).collect()}
        assert {r.node_id: r.distance for r in got if r.seed == s} == want


def _edges_of(spark, pairs):
    return spark.createDataFrame([(f"e{k}", a, b, "t", 1.0) for k, (a, b) in enumerate(pairs)], "edge_id string, source_node_id string, target_node_id string, edge_type string, weight double")


@pytest.mark.parametrize(("hub", "hops"), [(0, 2), (2, 1), (2, 3), (4, 4), (1000, 3)])
def test_neighborhoods_by_hubs(spark, monkeypatch, hub, hops):
    for name, value in (("HUB", hub), ("NODES", 4), ("SEEDS", 2), ("ROWS", 100)):
        monkeypatch.setattr(graph, name, value)
    dice = random.Random(7)
    pairs = [(f"n{k:02d}", f"n{dice.choice([0, 1, dice.randrange(40)]):02d}") for k in range(40)] + [(f"n{k:02d}", f"leaf{k}") for k in range(0, 40, 3)] + [("a", "b"), ("n00", "n00")]
    seeds = ["n00", "n05", "n12", "n30", "leaf3", "leaf9", "a", "nothing", "n05"]
    got = [tuple(r) for r in graph.neighborhoods(_edges_of(spark, pairs), spark.createDataFrame([(s,) for s in seeds], "node_id string"), hops).select("seed", "node_id", "distance").collect()]
    want = []
    for s in set(seeds):
        far, last = {s: 0}, {s}
        for k in range(1, hops + 1):
            last = {y for p in pairs for x, y in (p, p[::-1]) if x in last} - far.keys()
            far |= dict.fromkeys(last, k)
        want += [(s, v, d) for v, d in far.items() if d]
    assert sorted(got) == sorted(want)


def test_neighborhoods_behind_a_hub_are_not_written(spark, monkeypatch):
    """300 seeds and 600 nodes around one node: what is written on the way is in proportion to the links, not to the 179,700 rows."""
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(cut(df)) or written[-1])
    seeds = spark.range(300).select(F.concat(F.lit("n"), "id").alias("node_id"))
    got = graph.neighborhoods(_edges_of(spark, [("h", f"n{k}") for k in range(600)]), seeds, 2)
    assert sum(df.count() for df in written) < 10_000
    assert {(r.distance, r["count"]) for r in got.groupBy("distance").count().collect()} == {(1, 300), (2, 300 * 599)}


def test_counters_come_with_the_write(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 7 AS k")
    told = tables.write_counted(rows, str(tmp_path / "t"), least=F.min("id"), sevens=F.count_if(F.col("k") == 0))
    assert told == {"rows": 100, "least": 0, "sevens": 15} and spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_files_and_listings(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"queries": [{"query": "a", "expected_terms": ["x"], "expected_video_id": "v"}, {"query": "b"}]}')
    got = evaluate.load_queries(spark, str(tmp_path / "q.json")).collect()
    assert [(r.query_id, r.query, r.expected_terms) for r in got] == [(0, "a", ["x"]), (1, "b", None)]
    (tmp_path / "list.txt").write_text("http://a.example/1\n\n# no\nhttp://b.example/2\n")
    lines = web.source_list(spark.read.text(str(tmp_path / "list.txt")))
    assert [r.source for r in lines.collect()] == ["http://a.example/1", "http://b.example/2"]
    rows = spark.createDataFrame([(k, k * 10) for k in range(5)], "job_id int, created_at int")
    assert [r.job_id for r in jobs.newest(rows, 2).collect()] == [4, 3]


def test_streams(spark, tmp_path):
    events = [(1, 1, "2024-01-01 00:00:00", "running"), (1, 2, "2024-01-01 00:00:30", "ready"), (2, 3, "2024-01-01 00:10:00", "running"), (3, 4, "2024-01-01 05:00:00", "running")]
    df = spark.createDataFrame(events, "job_id long, event_id long, ts string, status string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "e"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    late = streaming.run_to_table(streaming.stuck_stream(read()), str(tmp_path / "s")).collect()
    assert [(r.job_id, r.status) for r in late] == [(2, "error")]
    seen = streaming.run_to_table(streaming.activity(read()), str(tmp_path / "a")).collect()
    assert sorted((r.status, r.n) for r in seen) == [("ready", 1), ("running", 2)]
    entries = spark.createDataFrame([("v", k, k * 3.0, k * 3.0 + 3, f"segment {k}.") for k in range(60)], "video_id string, seq int, start_sec double, end_sec double, text string")
    entries.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(entries.schema).parquet(str(tmp_path / "t"))
    streaming.ingest(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 2

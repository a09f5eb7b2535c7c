import pytest
from pyspark.sql import functions as F

from momentlake.operators import batch, dedupe, evaluate, find, graph, rules, search

TEXTS = [
    ("Always install the tool first. See src/main.py now.", "git push origin main"), ("Install the tool, then run the tool.", ""), ("Nothing here but clouds.", ""), ("Install the tool, then run the tool.", ""),
    ("The tool is deprecated. For example, avoid the Playwright Browser.", "class Parser"), ("", ""), ("Élan vital; the toolbox and another tool for example", "run it"), ("elephants run before the tool, do not run", "an elephant"),
]
QUERIES = [
    "tool", "install tool", "tool OR example", "tool NOT install", '"for example"', "eleph*", "ocr : run", "(run OR push) tool", "tool NOT install another", "page.goto", "élan", "don't", "NEAR(install tool, 3)", "zzz", "zzz tool", "zzz OR clouds",
    "NEAR(the tool run, 6) OR clouds", "Install the tool, then run the tool.", "the tool too*", '"the too" *', "  ", None, "...", "tool", "run NOT (run OR push)", "a AND", "title AND run", "NEAR(tool)",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"m{i}", i, f"v{i % 2}", f"Title {i % 2}", i * 60.0, i * 60.0 + 60, t, o) for i, (t, o) in enumerate(TEXTS)]
    m = spark.createDataFrame(rows, "moment_id string, ord long, video_id string, title string, start_sec double, end_sec double, transcript_text string, ocr_text string").cache()
    videos = spark.createDataFrame([("v0", "a", "local", "u"), ("v1", "b", "local", "u")], "video_id string, title string, source string, url string")
    dups, technical = dedupe.exact_duplicates(m).cache(), rules.technical(m).cache()
    edges = graph.edges(graph.Tables(videos, m, rules.ideas(m), technical, dups)).cache()
    return find.Corpus(m, search.build_index(m), rules.ideas, dups, technical, edges)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


def test_matches_and_scores_as_one_by_one(spark, corpus, queries):
    got = {}
    for r in batch.match_all(corpus.index, corpus.moments, queries).collect():
        assert got.setdefault(r.query_id, {}).setdefault(r.moment_id, r.bm25) == r.bm25
    for k, q in enumerate(QUERIES):
        want = {r.moment_id: r.bm25 for r in search.match(corpus.index, q or "").collect()}
        assert got.get(k, {}) == pytest.approx(want), q


def test_stored_index_gives_the_same(spark, corpus, queries, tmp_path):
    search.write_index(corpus.moments, str(tmp_path / "i"), buckets=3)
    index = search.read_index(spark, str(tmp_path / "i"))
    told = lambda i: sorted((r.query_id, r.moment_id, round(r.bm25, 9)) for r in batch.match_all(i, corpus.moments, queries).collect())
    assert told(index) == told(corpus.index)


@pytest.mark.parametrize("settings", [{}, {"diverse": True, "limit": 2, "weights": {"title_boost": 2.0}}, {"rerank": False, "include_duplicates": True}])
def test_whole_searches_as_one_by_one(spark, corpus, settings):
    asked = ["tool", "run OR clouds", '"for example"', "zzz"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    shown = ["moment_id", "video_id", "title", "transcript_snippet", "ocr_snippet", "idea_summary", "idea_types", "raw_score", "score", "reasons", "origin", "canonical_moment_id", "is_duplicate", "is_variant", "collapsed_count", "rank"]
    got = batch.find_all(corpus, queries, **settings).select("query_id", *shown).collect()
    for k, q in enumerate(asked):
        want = sorted(tuple(r) for r in find.find(corpus, q, **settings).select(*shown).collect())
        assert sorted(tuple(r)[1:] for r in got if r.query_id == k) == want, q


def test_video_filter_and_empty_table(spark, corpus):
    queries = spark.createDataFrame([(1, "tool", "v0"), (2, "tool", None), (3, "tool", "zz")], "query_id long, query string, video_id string")
    got = batch.find_all(corpus, queries).groupBy("query_id").agg(F.collect_set("video_id").alias("v")).collect()
    assert {r.query_id: set(r.v) for r in got} == {1: {"v0"}, 2: {"v0", "v1"}}
    assert batch.find_all(corpus, queries.limit(0)).collect() == []


def test_rare_places_of_phrases_are_read(spark, corpus):
    phrases = spark.createDataFrame([("p", ["run", "the", "tool"], False, None), ("q", ["the", "deprec"], True, None), ("r", ["the", "zzz"], False, None)], "phrase string, terms array<string>, prefix boolean, field string")
    assert {r.phrase: (r.k, r.term) for r in batch._anchors(corpus.index, phrases).collect()} == {"p": (0, "run"), "q": (1, "deprecated")}


def test_evaluation_of_whole_searches(spark, corpus):
    expected = spark.createDataFrame([(0, "tool", ["install", "zzz"], "v1"), (1, "zzz", None, "v0"), (2, "run", ["clouds"], None)], "query_id long, query string, expected_terms array<string>, expected_video_id string")
    found = batch.find_all(corpus, expected.select("query_id", "query"))
    rows = {r.query_id: r for r in evaluate.per_search(found, expected).collect()}
    one = {k: find.find(corpus, q).collect() for k, q in enumerate(("tool", "zzz", "run"))}
    for k, hits in one.items():
        r = rows[k]
        assert (r.n, r.collapsed, r.n_videos) == (len(hits), max((h.collapsed_count for h in hits), default=0), len({h.video_id for h in hits}))
        assert r.n_clusters == len({h.canonical_moment_id for h in hits if h.canonical_moment_id}) and r.n_duplicates == sum(h.is_duplicate or h.is_variant for h in hits)
        assert r.n_types == len({t for h in hits for t in h.idea_types.split(",") if t})
    assert (rows[0].video_hits, rows[0].term_hits, rows[0].term_checks) == (1, 1, 2) and (rows[1].n, rows[1].term_checks) == (0, 0)
    told = evaluate.search_summary(evaluate.per_search(found, expected)).first()
    assert told.total_queries == 3 and told.top1_hits == 2 and told.avg_duplicates_collapsed == round(sum(r.collapsed for r in rows.values()) / 3, 2)

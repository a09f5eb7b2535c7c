"""Queries of batched whole searches and of evaluation over them: every benchmark text, whole, is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions import rules as R
from momentlake.functions import text as T
from momentlake.operators import batch, evaluate, search
from momentlake.plans import graph_queries as G
from momentlake.plans import search_queries as Q
from momentlake.plans import sql as S
from momentlake.plans.rule_queries import IDEAS_CTE, TECHNICAL_CTES
from momentlake.sources.corpus import moments, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _snippet(text: str, at: str) -> str:
    head = f"CASE WHEN length({text}) <= 240 THEN {text} ELSE substr({text}, 1, 240) || '...' END"
    start, end = f"greatest({at} - 121, 0)", f"least(length({text}), {at} + 119)"
    return f"CASE WHEN {text} = '' THEN '' WHEN {at} IS NULL THEN {head} ELSE CASE WHEN {start} > 0 THEN '... ' ELSE '' END || substr({text}, {start} + 1, {end} - {start}) || CASE WHEN {end} < length({text}) THEN ' ...' ELSE '' END END"


_at = lambda text: f"list_min(list_filter(list_transform(list_filter(terms, lambda x: length(x) >= 2), lambda x: strpos(lower({text}), x)), lambda p: p > 0))"
_some = lambda text: f"len(list_filter(terms, lambda x: contains({text}, x))) > 0"
_TESTS = (("transcript", 0.5, _some("lower(ts)")), ("OCR", 0.3, _some("lower(os)")), ("idea", 0.2, _some("lower(idea_summary)")), ("title", 0.5, _some("lower(title)")), ("has_ideas", 0.1, "idea_types <> ''"))
_BOOST = " + ".join(f"CASE WHEN {t} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for _, v, t in _TESTS)
_FLAGS = ", ".join([
    "contains(lower(title), low) AS query_in_title", f"{_some('tl')} AS query_in_transcript", f"{_some('ol')} AS query_in_ocr", f"{_some('il')} AS query_in_idea", *(f"({S.has_any('tl', p)} OR {S.has_any('ol', p)}) AS {n}_match" for n, p in R.HIT_PHRASES.items()),
])

# A text with a full stop or a comma is no sentence of the match language, so it is sought as one phrase.
_FOUND = (
    IDEAS_CTE, *Q._POST, *Q._SUMMARY[1:], *TECHNICAL_CTES, *Q.DUPS_CTES, G._REAL_DUPS, *G._REAL((Q._EDGE_COUNTS,)),
    rf"qs AS (SELECT item_id AS query_id, lower(text) AS low, ' ' || array_to_string({S.tokens('substr(trim(text), 1, 500)')}, '  ') || ' ' AS p, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS terms, list_distinct({S.tokens('text')}) AS expected, 'src' || (item_id % 20) AS video FROM benchmark)",
    "fs AS (SELECT moment_id, ' ' || array_to_string(l, '  ') || ' ' AS s FROM ft WHERE len(l) > 0)",
    "ph AS (SELECT query_id, moment_id, sum((length(s) - length(replace(s, p, ''))) // length(p)) AS f FROM qs JOIN fs ON contains(s, p) GROUP BY query_id, moment_id)",
    "pn AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS hits FROM ph)",
    f"ps AS (SELECT pn.query_id, pn.moment_id, 0.0::DOUBLE + {Q._bm25('pn.f', 'pn.hits')} AS bm25 FROM pn JOIN sz USING (moment_id), co)",
    "pt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, moment_id) AS place FROM ps) WHERE place <= 30)",
    f"s0 AS (SELECT pt.query_id, pt.bm25, m.*, qs.terms, coalesce(isum.idea_summary, '') AS idea_summary, coalesce(isum.idea_types, '') AS idea_types, {_at('m.transcript_text')} AS ta, {_at('m.ocr_text')} AS oa FROM pt JOIN m USING (moment_id) JOIN qs USING (query_id) LEFT JOIN isum USING (moment_id))",
    f"s1 AS (SELECT *, {_snippet('transcript_text', 'ta')} AS ts, {_snippet('ocr_text', 'oa')} AS os FROM s0)",
    f"s2 AS (SELECT *, round(bm25, 4) AS raw_score, round(bm25 + ({_BOOST}), 4) AS score FROM s1)",
    "s3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_score DESC, moment_id) AS rank FROM s2)",
    "s4 AS (SELECT s3.*, rd.canonical_moment_id AS c, rd.duplicate_type AS t, x.moment_id IS NOT NULL AS dropped FROM s3 LEFT JOIN rd ON rd.moment_id = s3.moment_id LEFT JOIN s3 x ON x.query_id = s3.query_id AND x.moment_id = rd.canonical_moment_id)",
    "s5 AS (SELECT *, count(*) FILTER (WHERE dropped) OVER (PARTITION BY query_id) AS gone FROM s4)",
    "s6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM s5 WHERE NOT dropped)",
    f"s7 AS (SELECT s6.query_id, s6.moment_id, s6.video_id, s6.raw_score, s6.score AS before, s6.c, coalesce(s6.t = 'exact', false) AS is_duplicate, CASE WHEN s6.place = 1 THEN s6.gone ELSE 0 END AS collapsed, lower(ts || os || idea_summary) AS shown, fe.* EXCLUDE (moment_id, title, tl, ol, il), {_FLAGS.replace('title', 'fe.title', 1)} FROM s6 JOIN fe ON fe.moment_id = s6.moment_id JOIN qs ON qs.query_id = s6.query_id WHERE s6.place <= 10)".replace("list_filter(terms", "list_filter(qs.terms"),
    f"s8 AS (SELECT *, {Q._SCORE.replace('1.0::DOUBLE', 'before', 1)} AS score, {Q._REASONS} AS reasons FROM s7)",
    "fd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_score DESC, moment_id) AS rank FROM s8)",
)


def build(spark: SparkSession, sf_dir: str) -> None:
    """Make all stored tables that searches read, so that no search pays for them."""
    G._corpus(spark, sf_dir)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, expected_terms (all of the text) and expected_video_id of each benchmark text."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array_distinct(T.fts_tokens(F.col("text"))).alias("expected_terms"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("expected_video_id"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Q.index_already(spark, sf_dir) or search.counted(moments(spark, sf_dir))
    return batch.find_all(G._corpus(spark, sf_dir, index=index), _asked(spark, sf_dir).select("query_id", "query"))


@query(S.with_moments("SELECT query_id, moment_id, raw_score, score, reasons, is_duplicate, collapsed::BIGINT AS collapsed_count, rank::INTEGER AS rank FROM fd", *_FOUND))
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a search for all benchmark texts in one plan: text, boosts, duplicates, graph."""
    return _found(spark, sf_dir).select("query_id", "moment_id", "raw_score", "score", "reasons", "is_duplicate", F.col("collapsed_count").cast("long").alias("collapsed_count"), "rank")


_EVAL = (
    *_FOUND,
    "ty AS (SELECT query_id, count(DISTINCT x) AS n_types FROM (SELECT query_id, unnest(string_split(idea_types, ',')) AS x FROM fd) WHERE x <> '' GROUP BY query_id)",
    "th AS (SELECT query_id, count(*) AS term_hits FROM (SELECT query_id, expected, unnest(expected) AS x FROM qs) e WHERE EXISTS (SELECT 1 FROM fd WHERE fd.query_id = e.query_id AND contains(fd.shown, lower(e.x))) GROUP BY query_id)",
    """pq AS (SELECT qs.query_id, count(fd.moment_id) AS n, coalesce(max(CASE WHEN fd.video_id = qs.video THEN 1 END), 0) AS video_hits, any_value(len(qs.expected)) AS term_checks, coalesce(max(fd.collapsed), 0) AS collapsed,
      count(DISTINCT fd.video_id) AS n_videos, count(DISTINCT fd.c) AS n_clusters, count(*) FILTER (WHERE fd.is_duplicate) AS n_duplicates, count(*) FILTER (WHERE fd.video_id = qs.video) AS in_video,
      round(coalesce(max(CASE WHEN fd.video_id = qs.video THEN 1.0::DOUBLE / fd.rank END), 0.0::DOUBLE), 4) AS reciprocal_rank
    FROM qs LEFT JOIN fd ON fd.query_id = qs.query_id GROUP BY qs.query_id)""",
    "pw AS (SELECT pq.*, coalesce(ty.n_types, 0) AS n_types, coalesce(th.term_hits, 0) AS term_hits FROM pq LEFT JOIN ty USING (query_id) LEFT JOIN th USING (query_id))",
)


def _per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_search(_found(spark, sf_dir), _asked(spark, sf_dir))


_PER_QUERY = ["query_id", "n", "video_hits", "term_hits", "term_checks", "collapsed", "n_videos", "n_clusters", "n_duplicates", "n_types", "reciprocal_rank"]


@query(S.with_moments("SELECT " + ", ".join(c if c in ("query_id", "reciprocal_rank") else f"{c}::BIGINT AS {c}" for c in _PER_QUERY) + " FROM pw", *_EVAL))
def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_query(spark, sf_dir).select(*_PER_QUERY)


_PCT = lambda n: f"round(count(*) FILTER (WHERE n >= {n}) * 100.0::DOUBLE / count(*), 1)"
_MEAN = lambda c: f"round(sum({c})::DOUBLE / count(*), 2)"
_METRICS = {
    "total_queries": "count(*)", "top1_hits": "count(*) FILTER (WHERE n >= 1)", "top1_pct": _PCT(1), "top3_hits": "count(*) FILTER (WHERE n >= 3)", "top3_pct": _PCT(3), "top5_hits": "count(*) FILTER (WHERE n >= 5)", "top5_pct": _PCT(5),
    "video_hits": "sum(video_hits)::BIGINT", "term_hits": "sum(term_hits)::BIGINT", "term_checks": "sum(term_checks)::BIGINT", "term_pct": "round(sum(term_hits) * 100.0::DOUBLE / nullif(sum(term_checks), 0), 1)", "avg_results_returned": _MEAN("n"),
    "precision": "round(sum(in_video)::DOUBLE / nullif(sum(n), 0), 4)", "mrr": "round(avg(reciprocal_rank), 4)", "avg_duplicates_collapsed": _MEAN("collapsed"), "total_collapsed": "sum(collapsed)::BIGINT", "avg_unique_videos_in_topk": _MEAN("n_videos"),
    "avg_unique_clusters_in_topk": _MEAN("n_clusters"), "avg_duplicate_in_topk": _MEAN("n_duplicates"), "avg_idea_type_diversity_in_topk": _MEAN("n_types"),
}


@query(S.with_moments("SELECT " + ", ".join(f"{x} AS {k}" for k, x in _METRICS.items()) + " FROM pw", *_EVAL))
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.search_summary(_per_query(spark, sf_dir)).select(*_METRICS)


@query(S.with_moments(" UNION ALL ".join(f"SELECT '{k}' AS metric, ({x})::DOUBLE AS value FROM pw" for k, x in _METRICS.items()), *_EVAL))
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(evaluate.search_summary(_per_query(spark, sf_dir)).select(*_METRICS))

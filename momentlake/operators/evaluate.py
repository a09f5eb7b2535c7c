"""Evaluation of search results against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, expected_terms, expected_video_id of a JSON file with a list ``queries``."""
    kind = "queries array<struct<query: string, expected_terms: array<string>, expected_video_id: string, expected_moment_contains: string>>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.posexplode("queries").alias("query_id", "q")).select("query_id", "q.*")


def per_query(results: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each expected query: results, hits of its video and terms, variety, reciprocal rank.

    ``results``: query_id, video_id, rank, shown (text); a term is hit if any result shows it.
    """
    e = expected.select("query_id", "expected_video_id", F.coalesce("expected_terms", F.array().cast("array<string>")).alias("terms"))
    r = results.select("query_id", "video_id", "rank", F.lower("shown").alias("low"))
    right = F.col("video_id") == F.col("expected_video_id")
    joined = e.join(r, "query_id", "left").withColumn("seen", F.filter("terms", lambda t: F.contains(F.col("low"), F.lower(t))))
    out = joined.groupBy("query_id").agg(
        F.count("rank").alias("n"), F.coalesce(F.max(F.when(right, 1)), F.lit(0)).cast("long").alias("video_hits"), F.size(F.array_distinct(F.flatten(F.collect_set("seen")))).cast("long").alias("term_hits"),
        F.max(F.size("terms")).cast("long").alias("term_checks"), F.count_distinct("video_id").alias("n_videos"), F.count_if(right).alias("right"), F.round(F.coalesce(F.max(F.when(right, 1.0 / F.col("rank"))), F.lit(0.0)), 4).alias("reciprocal_rank"),
    )
    return out


def summary(per_query: DataFrame) -> DataFrame:
    """One row of totals and means; a top-n hit means at least n results, as published.

    precision and mrr are true measures against the expected video.
    """
    total = F.count("*")
    share = lambda c: F.when(total > 0, F.round(c * 100.0 / total, 1)).otherwise(0.0)
    at_least = lambda n: F.count_if(F.col("n") >= n)
    mean = lambda c: F.round(F.sum(c) / total, 2)
    return per_query.agg(
        total.alias("total_queries"), at_least(1).alias("top1_hits"), share(at_least(1)).alias("top1_pct"), at_least(3).alias("top3_hits"), share(at_least(3)).alias("top3_pct"), at_least(5).alias("top5_hits"), share(at_least(5)).alias("top5_pct"),
        F.sum("video_hits").alias("video_hits"), F.sum("term_hits").alias("term_hits"), F.sum("term_checks").alias("term_checks"), F.round(F.sum("term_hits") * 100.0 / F.nullif(F.sum("term_checks"), F.lit(0)), 1).alias("term_pct"),
        mean("n").alias("avg_results_returned"), mean("n_videos").alias("avg_unique_videos"), F.round(F.sum("right") / F.nullif(F.sum("n"), F.lit(0)), 4).alias("precision"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"),
    )


def report(one_row: DataFrame) -> DataFrame:
    """metric, value: the summary as lines."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns))
    return one_row.select(F.explode(pairs).alias("p")).select("p.*")


def per_search(results: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each expected query over whole searches (`batch.find_all`), queries without results too.

    Terms are looked for in what a result shows (snippets and ideas). collapsed is how many
    duplicates were dropped, n_clusters how many duplicate clusters, n_duplicates how many
    flagged rows, entities the sum of entity links and n_types how many idea types the
    results have.
    """
    e = expected.select("query_id", "expected_video_id", F.coalesce("expected_terms", F.array().cast("array<string>")).alias("terms"))
    shown = F.lower(F.concat("transcript_snippet", "ocr_snippet", "idea_summary"))
    links = F.col("entity_degree") if "entity_degree" in results.columns else F.lit(0)
    flagged = (F.col("is_duplicate") | F.col("is_variant")).cast("int").alias("flagged")
    r = results.select("query_id", "video_id", "rank", "collapsed_count", "canonical_moment_id", flagged, links.alias("links"), F.filter(F.split("idea_types", ","), lambda t: t != "").alias("types"), shown.alias("low"))
    right = F.col("video_id") == F.col("expected_video_id")
    joined = e.join(r, "query_id", "left").withColumn("seen", F.filter("terms", lambda t: F.contains(F.col("low"), F.lower(t))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    different = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long")
    # terms are counted one by one, also such that a query names twice
    found = joined.groupBy("query_id").agg(
        F.count("rank").alias("n"), zero(F.max(F.when(right, 1))).alias("video_hits"), F.max("terms").alias("terms"), F.array_distinct(F.flatten(F.collect_set("seen"))).alias("seen"), zero(F.max("collapsed_count")).alias("collapsed"),
        F.count_distinct("video_id").alias("n_videos"), F.count_distinct("canonical_moment_id").alias("n_clusters"), zero(F.sum("flagged")).alias("n_duplicates"), zero(F.sum("links")).alias("entities"), different("types").alias("n_types"),
        zero(F.count_if(right)).alias("right"), F.round(F.coalesce(F.max(F.when(right, 1.0 / F.col("rank"))), F.lit(0.0)), 4).alias("reciprocal_rank"),
    )
    hits = F.size(F.filter("terms", lambda t: F.array_contains(F.col("seen"), t))).cast("long")
    return found.withColumns({"term_hits": hits, "term_checks": F.size("terms").cast("long")}).drop("terms", "seen")


def search_summary(per_search: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: `summary`, and means of duplicates, clusters, entities and idea types. ``seconds`` that the batch took give latencies."""
    total = F.count("*")
    mean = lambda c: F.when(total > 0, F.round(F.sum(c) / total, 2)).otherwise(0.0)
    more = per_search.agg(
        mean("collapsed").alias("avg_duplicates_collapsed"), F.sum("collapsed").alias("total_collapsed"), mean("n_videos").alias("avg_unique_videos_in_topk"), mean("n_clusters").alias("avg_unique_clusters_in_topk"),
        mean("n_duplicates").alias("avg_duplicate_in_topk"), mean("entities").alias("avg_entity_coverage_in_topk"), mean("n_types").alias("avg_idea_type_diversity_in_topk"),
    )
    both = summary(per_search).drop("avg_unique_videos").crossJoin(more)  # one row each
    if seconds is None:
        return both
    ms = F.lit(seconds * 1000)
    return both.withColumns({"total_latency_ms": F.round(ms, 2), "avg_query_latency_ms": F.when(F.col("total_queries") > 0, F.round(ms / F.col("total_queries"), 2)).otherwise(0.0)})

"""One search over text, vectors or both, with filters, duplicates, the graph and diversity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.operators import assembly, search, vector_store
from momentlake.plans.lineage import cut

MODES = ("fts", "semantic", "fts_semantic", "hybrid")
NO_DUPLICATES = "dup_id string, moment_id string, canonical_moment_id string, duplicate_type string"


@dataclass
class Corpus:
    """What a search reads. ``ideas`` gives the ideas of given moments; without ``edges`` nothing is reranked; with ``vectors`` nothing is embedded but queries.

    ``evidence`` may be a function of moments as well, and ``edges`` one of moments, their
    ideas and their evidence, so that nothing is extracted from moments that aren't hits;
    ``index`` one that gives the index for a query.
    """

    moments: DataFrame
    index: search.Index | Callable[[str], search.Index]
    ideas: Callable[[DataFrame], DataFrame]
    duplicates: DataFrame | None = None
    evidence: DataFrame | Callable[[DataFrame], DataFrame] | None = None
    edges: DataFrame | Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None
    dimension: int = 64
    vectors: vector_store.VectorStore | None = None

    def has_edges(self) -> bool:
        return self.edges is not None and (callable(self.edges) or not self.edges.isEmpty())

    def around(self, own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ideas, evidence and edges of the moments given, and maybe of others."""
        ideas = cut(self.ideas(own))
        evidence = self.evidence if self.evidence is not None else own.sparkSession.createDataFrame([], "moment_id string, modality string")
        evidence = cut(evidence(own)) if callable(evidence) else evidence
        return ideas, evidence, cut(self.edges(own, ideas, evidence)) if callable(self.edges) else self.edges


def _text_hits(c: Corpus, query: str, limit: int, video_id: str | None) -> DataFrame:
    found = search.match(c.index(query) if callable(c.index) else c.index, query)
    if video_id is not None:
        found = found.join(c.moments.where(F.col("video_id") == video_id).select("moment_id"), "moment_id", "left_semi")
    return search.results(c.moments, found, query, limit, c.ideas).withColumn("origin", F.lit("text"))


def _near_hits(c: Corpus, query: str, limit: int, video_id: str | None) -> DataFrame:
    """Hits by vectors alone, in the columns of text hits: the score is the cosine."""
    among = c.moments if video_id is None else c.moments.where(F.col("video_id") == video_id)
    only = None if video_id is None or c.vectors is None else among.select(F.col("ord").alias("vec_id"))
    near = cut(assembly.semantic(among, query, limit, c.dimension, c.vectors, only).select("moment_id", F.col("score").alias("bm25")))
    made = search.results(c.moments, near, query, limit, c.ideas).drop("score", "raw_score", "reasons", "rank").join(F.broadcast(near), "moment_id")  # limit rows
    return search.ranked(made.withColumns({"raw_score": F.col("bm25"), "score": F.col("bm25"), "reasons": F.lit("semantic"), "origin": F.lit("semantic")}).drop("bm25"))


def _together(first: DataFrame, then: DataFrame) -> DataFrame:
    return first.unionByName(then.join(first.select("moment_id"), "moment_id", "left_anti").select(*first.columns))


def _reranked(c: Corpus, hits: DataFrame, query: str, limit: int, diverse: bool, include: bool, weights: dict[str, float] | None) -> DataFrame:
    """Hits by graph score; the features are those of the hits only."""
    own = cut(c.moments.join(F.broadcast(hits.select("moment_id")), "moment_id", "left_semi"))  # a few times limit rows
    duplicates = c.duplicates if c.duplicates is not None else own.sparkSession.createDataFrame([], NO_DUPLICATES)
    ideas, evidence, edges = c.around(own)
    f = search.features(own, ideas, evidence, duplicates, edges, query)
    f = f.withColumnsRenamed({"idea_types": "types_of", "canonical_moment_id": "canonical_of"})
    score, reasons = search.graph_score(F.col("score"), diverse, include, weights)
    joined = hits.drop("rank").join(f, "moment_id").withColumns({"reasons": reasons, "score": score})
    joined = joined.withColumns({"idea_types": F.col("types_of"), "canonical_moment_id": F.coalesce(F.nullif("canonical_of", F.lit("")), "canonical_moment_id")}).select(*(x for x in hits.columns if x != "rank"))
    joined = cut(joined)
    if not diverse:
        return search.ranked(joined).where(F.col("rank") <= limit)
    order = search.diversify(joined.withColumn("query_id", F.lit(1).cast("long")), limit).select("moment_id", "rank")
    return joined.join(F.broadcast(order), "moment_id")  # limit rows


def find(c: Corpus, query: str, mode: str = "fts", video_id: str | None = None, limit: int = 10, include_duplicates: bool = False, diverse: bool = False, rerank: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """The best ``limit`` moments for a query: hits with score, reasons, origin and rank.

    fts: by text; semantic: by vectors; fts_semantic: text hits, then others by vectors;
    hybrid: twice as many of both, together by score. Duplicates of other hits are dropped
    (near ones stay with ``diverse``) unless included. Hits are reranked where there is a
    graph. A blank query finds nothing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    empty = lambda df: df.where(F.lit(False))
    duplicates = c.duplicates if c.duplicates is not None else c.moments.sparkSession.createDataFrame([], NO_DUPLICATES)
    graph = rerank and c.has_edges()
    if mode == "semantic":
        hits = _near_hits(c, query, limit, video_id) if query.strip() else empty(_text_hits(c, query, limit, video_id))
        return search.collapse(hits, duplicates, limit, include=True)
    if mode == "hybrid":
        text = search.collapse(_text_hits(c, query, 2 * limit, video_id), duplicates, 2 * limit, include=True).drop("is_duplicate", "is_variant", "canonical_moment_id", "collapsed_count")
        both = _together(text, _near_hits(c, query, 2 * limit, video_id)) if query.strip() else text
        hits = search.collapse(search.ranked(both.drop("rank")), duplicates, 2 * limit, diverse, include_duplicates)
    else:
        hits = search.collapse(_text_hits(c, query, limit, video_id), duplicates, limit, diverse, include_duplicates)
        if mode == "fts_semantic" and query.strip():
            near = search.collapse(_near_hits(c, query, 2 * limit, video_id), duplicates, 2 * limit, include=True)
            hits = _together(hits, near)
    hits = cut(hits)
    if graph:
        return _reranked(c, hits, query, limit, diverse, include_duplicates, weights)
    return search.ranked(hits.drop("rank")).where(F.col("rank") <= limit)

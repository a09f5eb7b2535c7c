"""Whole searches for many queries in one plan: match, BM25, boosts, duplicates, graph, diversity.

Every step is keyed by query_id. A query becomes a program over leaves (phrases, NEAR groups);
leaves that queries share are looked up once. A phrase is read from the postings of its
rarest term and checked against the tokens of those moments, so frequent terms of long phrases
are never read. Of a query's leaves only the cheapest ones that cover all its matches are
turned into candidates; the others are looked up for candidates alone. What doesn't depend on
a query (ideas, evidence, duplicates, degrees) is made once for the union of all hits.

A blank or null query finds nothing; a repeated query_id is an error of the caller. Columns of
``queries`` other than query_id, query and video_id (an optional filter) are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlake.functions import text as T
from momentlake.functions.match import Near, Op, parse
from momentlake.operators import search
from momentlake.operators.find import NO_DUPLICATES, Corpus
from momentlake.plans.lineage import MOST_CROWDED, cut, having

AND, OR, NOT = -1, -2, -3
_CODES = {"AND": AND, "OR": OR, "NOT": NOT}
_COMPILED = "program array<int>, leaves array<struct<parts: array<struct<terms: array<string>, prefix: boolean>>, field: string, distance: int, scored: boolean>>"


def _compile(query: str | None) -> tuple[list[int], list[dict]]:
    """A query's tree in postfix order: numbers of leaves, and negative codes of operators."""
    program: list[int] = []
    leaves: list[dict] = []

    def walk(node, scored: bool) -> None:
        if isinstance(node, Op):
            walk(node.left, scored)
            walk(node.right, scored and node.name != "NOT")
            program.append(_CODES[node.name])
            return
        near = isinstance(node, Near)
        parts = [{"terms": search.fold(p.text), "prefix": p.prefix} for p in (node.parts if near else (node,))]
        program.append(len(leaves))
        leaves.append({"parts": parts, "field": None if near else node.field, "distance": node.distance if near else None, "scored": scored})

    if (tree := parse(query or "")) is not None:
        walk(tree, True)
    return program, leaves


def _compiled(query: Column) -> Column:
    @F.pandas_udf(_COMPILED)
    def compiled(queries: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_compile(q) for q in queries], columns=["program", "leaves"])

    return compiled(query)


def _told(*columns) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def _leaves(asked: DataFrame) -> DataFrame:
    """query_id, leaf_no, leaf (equal for equal leaves), parts, field, distance, scored."""
    each = asked.select("query_id", F.posexplode("leaves").alias("leaf_no", "l")).select("query_id", "leaf_no", "l.*")
    return each.withColumn("leaf", _told("parts", "field", "distance"))


def _anchors(index: search.Index, phrases: DataFrame) -> DataFrame:
    """phrase, k, term: the rarest place of each phrase and the index terms that may stand there."""
    each = phrases.select("phrase", "prefix", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("k", "word"))
    begins = F.col("prefix") & (F.col("k") == F.col("n_terms") - 1)
    exact = each.where(~begins).select("phrase", "k", F.col("word").alias("term"))
    open_ = each.where(begins).select("phrase", "k", "word")
    sizes = open_.select(F.length("word").alias("size")).distinct()  # of words in queries of 500 characters at most
    longer = index.terms.join(F.broadcast(sizes), F.length("term") >= F.col("size")).select("term", F.substring("term", F.lit(1), F.col("size")).alias("word"))
    may = exact.unionByName(open_.join(longer, "word").select("phrase", "k", "term"))
    known = may.join(index.terms.select("term", "n"), "term")
    totals = each.select("phrase", "k").join(known.groupBy("phrase", "k").agg(F.sum("n").alias("n")), ["phrase", "k"], "left")
    rarest = totals.groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("r")).select("phrase", "r.k")
    return known.join(rarest, ["phrase", "k"]).select("phrase", "k", "term")


def _places(index: search.Index, moments: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, moment_id, field, at: where each of ``phrases`` (phrase, terms, prefix, field) begins."""
    anchors, on = _anchors(index, phrases), ["term"]
    if index.buckets:
        anchors, on = anchors.withColumn("bucket", search.bucket_of(F.col("term"), index.buckets)), ["bucket", "term"]
    else:  # no bucket rules postings out, so the terms go to where the texts are, if they are few
        anchors = cut(anchors)
        anchors = F.broadcast(anchors) if anchors.count() <= MOST_CROWDED else anchors
    within = phrases.select("phrase", "terms", "prefix", F.col("field").alias("only"))
    found = index.postings.join(anchors, on).join(within, "phrase").where(F.col("only").isNull() | (F.col("only") == F.col("field")))
    found = found.select("phrase", "moment_id", "field", (F.col("pos") - F.col("k")).alias("at"), "terms", "prefix").where("at >= 0")
    shape = ("phrase", "moment_id", "field", "at")
    single = found.where(F.size("terms") == 1).select(*shape)
    several = cut(found.where(F.size("terms") > 1))
    tokens = search.field_tokens(having(moments, several, "moment_id"))
    n = F.size("terms")
    here = lambda size: F.slice("tokens", F.col("at") + 1, size)
    last = F.startswith(F.get("tokens", F.col("at") + n - 1), F.element_at("terms", -1))
    fits = F.when(F.col("prefix"), (here(n - 1) == F.slice("terms", F.lit(1), n - 1)) & last).otherwise(here(n) == F.col("terms"))
    return single.unionByName(several.join(tokens, ["moment_id", "field"]).where(fits).select(*shape))


def _leaf_hits(index: search.Index, moments: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf, moment_id, f: how often each leaf occurs in a moment."""
    distinct = cut(leaves.select("leaf", "parts", "field", "distance").dropDuplicates(["leaf"]))
    parts = distinct.select("leaf", "field", "distance", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "p"))
    parts = parts.select("leaf", "field", "distance", "n_parts", "part", "p.terms", "p.prefix").withColumn("phrase", _told("terms", "prefix", "field"))
    phrases = parts.select("phrase", "terms", "prefix", "field").dropDuplicates(["phrase"])
    places = cut(_places(index, moments, phrases))
    alone = parts.where("distance is null").select("leaf", "phrase").join(places, "phrase").groupBy("leaf", "moment_id").agg(F.count("*").alias("f"))
    groups = parts.where("distance is not null")
    most = groups.agg(F.max("n_parts")).first()[0]
    if most is None:
        return alone
    own = groups.drop("field").join(places, "phrase").select("leaf", "part", "n_parts", "distance", "moment_id", "field", "at")
    found = own.where("part = 0").select("leaf", "moment_id", "field", "n_parts", "distance", F.col("at").alias("lo"), F.col("at").alias("hi"))
    done = [found.where("n_parts = 1")]
    for k in range(1, most):
        step = own.where(F.col("part") == k).select("leaf", "moment_id", "field", "at")
        found = found.where(F.col("n_parts") > k).join(step, ["leaf", "moment_id", "field"]).withColumns({"lo": F.least("lo", "at"), "hi": F.greatest("hi", "at")}).drop("at")
        found = found.where(F.col("hi") - F.col("lo") <= F.col("distance") + F.col("n_parts"))
        done.append(found.where(F.col("n_parts") == k + 1))
    near = reduce(DataFrame.unionByName, done).groupBy("leaf", "moment_id").agg(F.count_distinct("field", "lo").alias("f"))
    return alone.unionByName(near)


def _evaluated(program: Column, kind: str, leaf: Callable[[Column], Column], both: Callable[[Column, Column, Column], Column]) -> Column:
    """The value of a postfix program; ``both`` joins two values by an operator's code."""

    def step(stack: Column, code: Column) -> Column:
        n = F.size(stack)
        return F.when(code >= 0, F.concat(stack, F.array(leaf(code)))).otherwise(F.concat(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(both(code, F.get(stack, n - 2), F.get(stack, n - 1)))))

    return F.get(F.aggregate(program, F.array().cast(f"array<{kind}>"), step), F.lit(0))


def match_all(index: search.Index, moments: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, moment_id, bm25`` of all queries; the same as `search.match` one by one."""
    asked = cut(queries.select("query_id", "query", _compiled(F.col("query")).alias("c")).select("query_id", "query", "c.*"))
    leaves = _leaves(asked)
    hits = cut(_leaf_hits(index, moments, leaves))
    counts = hits.groupBy("leaf").agg(F.count("*").alias("hits"))
    own = cut(leaves.select("query_id", "leaf_no", "leaf", "scored").join(counts, "leaf", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long")))
    # of two sides that must both match the one with fewer hits is enough to find candidates
    by_no = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("leaf_no", "hits", "leaf"))).alias("of"))
    take = lambda code: F.struct(F.get("of", code)["hits"].alias("hits"), F.array(F.get("of", code)["leaf"]).alias("leaves"))
    fewer = lambda code, a, b: F.when(code == NOT, a).when(code == OR, F.struct((a["hits"] + b["hits"]).alias("hits"), F.array_union(a["leaves"], b["leaves"]).alias("leaves"))).otherwise(F.when(a["hits"] <= b["hits"], a).otherwise(b))
    cover = asked.select("query_id", "program").join(by_no, "query_id").select("query_id", F.explode(_evaluated(F.col("program"), "struct<hits: bigint, leaves: array<string>>", take, fewer)["leaves"]).alias("leaf"))
    among = cover.join(hits.select("leaf", "moment_id"), "leaf").select("query_id", "moment_id").distinct()
    if "video_id" in queries.columns:
        only = queries.select("query_id", F.col("video_id").alias("only"))
        among = among.join(only, "query_id").join(moments.select("moment_id", "video_id"), "moment_id").where(F.col("only").isNull() | (F.col("only") == F.col("video_id"))).select("query_id", "moment_id")
    among = cut(among)
    sizes = index.sizes if index.buckets else search.sizes_of(having(moments, among, "moment_id"))
    told = among.join(own, "query_id").join(hits, ["leaf", "moment_id"], "left").join(sizes, "moment_id").crossJoin(F.broadcast(index.corpus))  # one row of corpus totals
    part = F.when(F.col("scored"), F.coalesce(search.bm25(F.col("f"), F.col("hits"), F.col("n"), F.col("size"), F.col("mean")), F.lit(0.0))).otherwise(0.0)
    whole = told.groupBy("query_id", "moment_id").agg(F.array_sort(F.collect_list(F.struct("leaf_no", F.col("f").isNotNull().alias("hit"), part.alias("s")))).alias("of"))
    hit = lambda code: F.get("of", code)["hit"]
    logic = lambda code, a, b: F.when(code == AND, a & b).when(code == OR, a | b).otherwise(a & ~b)
    found = whole.join(asked.select("query_id", "program"), "query_id").where(_evaluated(F.col("program"), "boolean", hit, logic))
    return found.select("query_id", "moment_id", F.aggregate("of", F.lit(0.0), lambda a, x: a + x["s"]).alias("bm25"))


def text_hits(c: Corpus, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Each query's best ``3 * limit`` by BM25 with snippets, boosts, score and rank, as `search.results` gives for one."""
    best = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "moment_id")
    top = match_all(c.index, c.moments, queries).withColumn("place", F.row_number().over(best)).where(F.col("place") <= 3 * limit).drop("place")
    top = cut(top)
    own = cut(having(c.moments, top, "moment_id"))
    told = own.join(search.idea_summaries(c.ideas(own)), "moment_id", "left")
    words = F.filter(F.split(F.lower(F.col("query")), r"(?U)\s+"), lambda t: t != "")
    hit = top.join(told, "moment_id").join(queries.select("query_id", words.alias("terms")), "query_id")
    return search.boosted(hit, F.col("terms"), "query_id").withColumn("origin", F.lit("text"))


def find_all(c: Corpus, queries: DataFrame, limit: int = 10, include_duplicates: bool = False, diverse: bool = False, rerank: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """The best ``limit`` moments for each of ``queries`` (query_id long, query, maybe video_id), in the columns of `find`.

    Reranked hits also tell entity_degree, and how many degrees and idea types they have.
    """
    spark = c.moments.sparkSession
    duplicates = c.duplicates if c.duplicates is not None else spark.createDataFrame([], NO_DUPLICATES)
    hits = cut(search.collapse(text_hits(c, queries, limit), duplicates, limit, diverse, include_duplicates))
    if not rerank or not c.has_edges():
        return search.ranked(hits.drop("rank")).where(F.col("rank") <= limit)
    own = cut(having(c.moments, hits, "moment_id"))
    ideas, evidence, edges = c.around(own)
    f = search.moment_features(own, ideas, evidence, duplicates, edges).withColumnsRenamed({"idea_types": "types_of", "canonical_moment_id": "canonical_of"})
    asked = queries.select("query_id", F.lower("query").alias("low"), F.filter(F.split(F.lower(F.col("query")), r"(?U)\s+"), lambda t: t != "").alias("terms"))
    joined = hits.drop("rank", "title").join(f, "moment_id").join(asked, "query_id")
    joined = joined.withColumns(search.query_flags(F.col("low"), F.col("terms")))
    score, reasons = search.graph_score(F.col("score"), diverse, include_duplicates, weights)
    joined = joined.withColumns({"reasons": reasons, "score": score})
    joined = joined.withColumns({"idea_types": F.col("types_of"), "canonical_moment_id": F.coalesce(F.nullif("canonical_of", F.lit("")), "canonical_moment_id")})
    joined = cut(joined.select(*(x for x in hits.columns if x != "rank"), "entity_degree"))
    if not diverse:
        return search.ranked(joined).where(F.col("rank") <= limit)
    order = search.diversify(joined, limit).select("query_id", "moment_id", "rank")
    return joined.join(order, ["query_id", "moment_id"])

"""The property graph of a corpus: nodes, edges, neighbourhoods, statistics, components, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.functions import text as T
from momentlake.operators import rules
from momentlake.operators.components import connected_components
from momentlake.plans.lineage import cut, join_groups


@dataclass
class Tables:
    """What a graph is made of."""

    videos: DataFrame
    moments: DataFrame
    ideas: DataFrame
    evidence: DataFrame
    duplicates: DataFrame
    claims: DataFrame | None = None


#: `neighborhoods`: nodes with more ways on than this are hubs; nodes of a cell; seeds of a list (the rows that a task holds at once); rows of a task.
HUB, NODES, SEEDS, ROWS = 250, 2000, 100, 5_000_000
#: With more rows than that many tasks take, tasks get more rows each.
MOST_TASKS = 10_000


def _node(kind: str, ref: str = "ref_id"):
    return F.concat(F.lit(f"{kind}:"), F.col(ref))


def nodes(t: Tables) -> DataFrame:
    """node_id, node_type, ref_id, label, metadata; of equal ids the first stage's row stays."""
    meta = lambda **cols: F.create_map(*(x for k, c in cols.items() for x in (F.lit(k), c.cast("string")))).alias("metadata")
    place = lambda: F.concat(F.col("video_id"), F.lit(" "), T.one_decimal(F.col("start_sec")), F.lit("s-"), T.one_decimal(F.col("end_sec")), F.lit("s"))
    m, none = t.moments, F.create_map().cast("map<string,string>").alias("metadata")
    parts = [
        ("video", t.videos.select(F.col("video_id").alias("ref_id"), F.col("title").alias("label"), meta(source=F.col("source")))),
        ("moment", m.select(F.col("moment_id").alias("ref_id"), place().alias("label"), meta(video_id=F.col("video_id"), start_sec=F.col("start_sec"), end_sec=F.col("end_sec"), transcript_preview=F.substring("transcript_text", 1, 100), ocr_preview=F.substring("ocr_text", 1, 100)))),
        ("idea", t.ideas.select(F.col("idea_id").alias("ref_id"), F.concat(F.lit("["), "type", F.lit("] "), F.substring("text", 1, 120)).alias("label"), meta(moment_id=F.col("moment_id"), idea_type=F.col("type"), text=F.col("text"), confidence=F.col("confidence")))),
        ("evidence", t.evidence.select(F.col("evidence_id").alias("ref_id"), F.concat(F.lit("["), "modality", F.lit("] "), F.substring("content", 1, 120)).alias("label"), meta(moment_id=F.col("moment_id"), modality=F.col("modality"), content_preview=F.substring("content", 1, 200), confidence=F.col("confidence")))),
        ("entity", mentions(t).groupBy("label").agg(F.min("entity_type").alias("entity_type")).select(F.col("label").alias("ref_id"), "label", meta(entity_type=F.col("entity_type")))),
        ("duplicate_cluster", m.join(t.duplicates.select(F.col("canonical_moment_id").alias("moment_id")).distinct(), "moment_id").select(F.col("moment_id").alias("ref_id"), F.concat(F.lit("Cluster: "), place()).alias("label"), meta(canonical_moment_id=F.col("moment_id")))),
        ("entity", t.videos.select("source").distinct().select(F.concat(F.lit("source:"), "source").alias("ref_id"), F.col("source").alias("label"), meta(entity_type=F.lit("source")))),
    ]
    if t.claims is not None:
        parts.append(("claim", t.claims.select(F.col("claim_id").alias("ref_id"), F.substring("text", 1, 200).alias("label"), none)))
    rows = [df.select(_node(kind).alias("node_id"), F.lit(k).alias("stage"), F.lit(kind).alias("node_type"), "ref_id", "label", "metadata") for k, (kind, df) in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    first = F.min_by(F.struct("node_type", "ref_id", "label", "metadata"), F.struct("stage", "label")).alias("r")
    return out.groupBy("node_id").agg(first).select("node_id", "r.*")


def mentions(t: Tables) -> DataFrame:
    """label, entity_type of the entities in moments, ideas and claims (once for each text)."""
    found = rules.moment_entities(t.moments).select("label", "entity_type")
    found = found.unionByName(rules.entities(t.ideas, "idea_id", F.col("text")).select("label", "entity_type"))
    if t.claims is not None:
        found = found.unionByName(rules.entities(t.claims, "claim_id", F.col("text")).select("label", "entity_type"))
    return found


def edges(t: Tables) -> DataFrame:
    """edge_id, source_node_id, target_node_id, edge_type, weight; equal edges once."""
    one = F.lit(1.0)

    def edge(df: DataFrame, source, target, kind, weight=one) -> DataFrame:
        return df.select(source.alias("source_node_id"), target.alias("target_node_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"), weight.alias("weight"))

    moment, idea, seen, video = _node("moment", "moment_id"), _node("idea", "idea_id"), _node("evidence", "evidence_id"), _node("video", "video_id")
    d = t.duplicates
    cluster, canonical = _node("duplicate_cluster", "canonical_moment_id"), _node("moment", "canonical_moment_id")
    both_ways = d.select("canonical_moment_id", "moment_id").unionByName(
        d.join(d.select(F.col("canonical_moment_id").alias("moment_id")).distinct(), "moment_id", "left_semi").select(F.col("moment_id").alias("canonical_moment_id"), F.col("canonical_moment_id").alias("moment_id"))
    )
    kind = F.col("duplicate_type")
    dup_kind = F.when(kind == "same_idea", "moment_same_idea_as").when(kind == "variant", "moment_variant_of").otherwise("moment_duplicate_of")
    parts = [
        edge(d.select("canonical_moment_id").distinct(), cluster, canonical, "cluster_canonical_moment"),
        edge(both_ways.where("moment_id <> canonical_moment_id").distinct(), cluster, moment, "cluster_has_moment"),
        edge(t.ideas, moment, idea, "moment_expresses_idea"),
        edge(t.ideas, idea, moment, "idea_mentioned_in_moment"),
        edge(t.evidence, moment, seen, "moment_has_evidence"),
        edge(t.evidence, seen, moment, "evidence_supports_idea"),
        edge(t.moments, video, moment, "video_contains_moment"),
        edge(rules.entities(t.ideas, "idea_id", F.col("text")), idea, _node("entity", "label"), "idea_mentions_entity"),
        edge(d, moment, canonical, dup_kind, F.col("similarity_score")),
        edge(t.videos, video, F.concat(F.lit("entity:source:"), F.col("source")), "video_from_source"),
    ]
    if t.claims is not None:
        claim = _node("claim", "claim_id")
        first = Window.partitionBy("moment_id").orderBy("evidence_id")
        three = t.evidence.withColumn("n", F.row_number().over(first)).where("n <= 3").select("moment_id", "evidence_id")
        parts += [
            edge(t.claims, moment, claim, "moment_supports_claim"),
            edge(t.claims.select("claim_id", "moment_id").join(three, "moment_id"), claim, seen, "claim_supported_by_evidence"),
            edge(rules.entities(t.claims, "claim_id", F.col("text")), claim, _node("entity", "label"), "claim_mentions_entity"),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ident = F.concat(F.lit("edge:"), T.short_hash(F.concat_ws("|", "edge_type", "source_node_id", "target_node_id"), 12))
    return out.groupBy("source_node_id", "target_node_id", "edge_type").agg(F.max("weight").alias("weight")).select(ident.alias("edge_id"), *out.columns)


def ends(e: DataFrame) -> DataFrame:
    """node_id, other, edge_type, weight: each edge from both of its ends."""
    way = lambda a, b: F.struct(F.col(a).alias("node_id"), F.col(b).alias("other"))
    return e.select("edge_id", "edge_type", "weight", F.explode(F.array(way("source_node_id", "target_node_id"), way("target_node_id", "source_node_id"))).alias("w")).select("w.*", "edge_id", "edge_type", "weight")


def degrees(e: DataFrame) -> DataFrame:
    """node_id, degree (other nodes), n_edges."""
    both = ends(e)
    return both.groupBy("node_id").agg(F.count_distinct(F.when(F.col("other") != F.col("node_id"), F.col("other"))).alias("degree"), F.count("*").alias("n_edges"))


def get_node(n: DataFrame, node_or_ref: str) -> DataFrame:
    """The node of this id, else the first of this reference by id."""
    found = n.where((F.col("node_id") == node_or_ref) | (F.col("ref_id") == node_or_ref))
    return found.orderBy((F.col("node_id") == node_or_ref).desc(), "node_id").limit(1)


def get_nodes(n: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, and the columns of the node of this id, else of the first of this reference by id, for each row of ``asked`` (asked); those not found are left out."""
    names = F.explode(F.array(F.struct(F.col("node_id").alias("asked"), F.lit(0).alias("own")), F.struct(F.col("ref_id").alias("asked"), F.lit(1).alias("own"))))
    rows = n.withColumn("name", names).select("name.*", *n.columns).join(asked.select("asked").distinct(), "asked")
    first = F.min_by(F.struct(*n.columns), F.struct("own", "node_id")).alias("r")
    return rows.groupBy("asked").agg(first).select("asked", "r.*")


def neighbors(n: DataFrame, e: DataFrame, node_id: str, hops: int = 1) -> DataFrame:
    """node_id, node_type, label, distance of what lies within ``hops`` undirected steps."""
    spark = e.sparkSession
    links = ends(e).select("node_id", "other").distinct()
    reached = spark.createDataFrame([(node_id, 0)], "node_id string, distance int")
    frontier = reached
    for k in range(1, hops + 1):
        step = links.join(frontier.select("node_id"), "node_id").select(F.col("other").alias("node_id")).distinct()
        frontier = step.join(reached, "node_id", "left_anti").withColumn("distance", F.lit(k))
        if hops > 1:
            frontier = cut(frontier)
        reached = reached.unionByName(frontier)
    return reached.where("distance > 0").join(n.select("node_id", "node_type", "label"), "node_id")


def _walk(links: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node_id, distance of what lies within ``steps`` steps of each of ``starts`` (start, steps), itself included; only the nodes reached last are followed."""
    frontier = starts.select("start", F.col("start").alias("node_id"), F.lit(0).alias("distance"), "steps")
    reached, most = frontier.drop("steps"), starts.agg(F.max("steps")).first()[0] or 0
    for k in range(1, most + 1):
        step = frontier.where(F.col("steps") >= k).join(links, "node_id").select("start", F.col("other").alias("node_id"), "steps").distinct()
        frontier = cut(step.join(reached.select("start", "node_id"), ["start", "node_id"], "left_anti").select("start", "node_id", F.lit(k).alias("distance"), "steps"))
        reached = reached.unionByName(frontier.drop("steps"))
    return reached


def _hubs(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """node_id of nodes from which more than ``HUB`` ways lead on: to seeds, or to nodes that have other neighbours as well."""
    ends_here = links.groupBy("node_id").agg(F.count("*").alias("n")).where("n = 1").join(seeds.withColumnRenamed("seed", "node_id"), "node_id", "left_anti")
    ways = links.join(ends_here.select(F.col("node_id").alias("other")), "other", "left_anti")
    return cut(ways.groupBy("node_id").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("node_id"))


def _classes(near: DataFrame, key: str) -> DataFrame:
    """``key``, class, near: the hubs near each key and their distances, and what names that set."""
    sets = near.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("hub", "distance"))).alias("near"))
    return cut(sets.select(key, F.sha2(F.to_json("near"), 256).alias("class"), "near"))


def neighborhoods(e: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """seed, node_id, distance of what lies within ``hops`` undirected steps of each of ``seeds`` (node_id).

    A seed without edges reaches nothing, repeated seeds count once.

    Behind a hub all seeds find the same nodes, so the rows are as many as seeds times nodes
    there. Those rows are neither shuffled nor written: seeds walk without hubs, hubs walk
    through everything, and nodes (and seeds) near the same hubs at the same distances are one
    class. The least distance is found for pairs of classes; lists of seeds are sent to cells of
    ``NODES`` nodes and multiplied out there, as the last step, a list and a node at a time.
    """
    links = cut(ends(e).where("node_id <> other").select("node_id", "other").distinct())
    seeds = cut(seeds.select(F.col("node_id").alias("seed")).distinct())
    hubs = _hubs(links, seeds)
    alone = _walk(links.join(hubs, "node_id", "left_anti"), seeds.select(F.col("seed").alias("start"), F.lit(hops).alias("steps"))).withColumnRenamed("start", "seed")
    asked = hubs.join(seeds.select(F.col("seed").alias("node_id"), F.lit(hops).alias("steps")), "node_id", "left")  # a hub that is no seed is a step off at least
    near = _walk(links, asked.select(F.col("node_id").alias("start"), F.coalesce("steps", F.lit(hops - 1)).alias("steps"))).withColumnRenamed("start", "hub")

    of_seeds = near.withColumnRenamed("node_id", "seed").join(seeds, "seed")
    s = _classes(of_seeds, "seed")
    least = of_seeds.groupBy("hub").agg(F.min("distance").alias("least"))
    n = _classes(near.join(least, "hub").where(F.col("distance") + F.col("least") <= hops), "node_id")
    sizes = cut(n.groupBy("class").agg(F.count("*").alias("size")))
    of = lambda c, name: c.select("class", "near").dropDuplicates(["class"]).select(F.col("class").alias(name), F.explode("near").alias("h")).select(name, "h.hub", F.col("h.distance").alias(f"{name}_distance"))
    both = of(s, "seed_class").join(of(n, "class"), "hub").withColumn("distance", F.col("seed_class_distance") + F.col("class_distance"))
    pairs = cut(both.where(F.col("distance").between(1, hops)).groupBy("seed_class", "class").agg(F.min("distance").alias("distance")))

    s, n = s.select("seed", F.col("class").alias("seed_class")), n.select("node_id", "class")
    other_way = pairs.withColumnRenamed("distance", "by_hub")
    found = alone.where("distance > 0").join(s, "seed", "left").join(n, "node_id", "left").join(other_way, ["seed_class", "class"], "left")
    found = found.select("seed", "node_id", F.least("distance", "by_hub").alias("distance"))

    cells = sizes.withColumn("cells", F.ceil(F.col("size") / NODES))
    told = alone.groupBy("node_id").agg(F.collect_list("seed").alias("told"))
    members = join_groups(n.join(told, "node_id", "left"), cells, "class", "size").select("class", F.pmod(F.xxhash64("node_id"), "cells").alias("cell"), "node_id", "told")
    lists = F.pmod(F.xxhash64("seed"), F.lit(seeds.count() // SEEDS + 1))
    offers = cut(pairs.join(s, "seed_class").groupBy("class", "distance", lists.alias("list")).agg(F.collect_list("seed").alias("seeds")))
    rows = offers.join(sizes, "class").agg(F.sum(F.size("seeds") * F.col("size"))).first()[0] or 0
    tasks = max(e.sparkSession.sparkContext.defaultParallelism, min(int(rows // ROWS) + 1, MOST_TASKS))
    offers = offers.join(cells.drop("size"), "class").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    met = members.repartition(tasks, "class", "cell").join(offers.repartition(tasks, "class", "cell"), ["class", "cell"])
    left = F.when(F.col("told").isNull(), F.col("seeds")).otherwise(F.array_except("seeds", "told"))
    return found.unionByName(met.select("distance", "node_id", left.alias("seeds")).select(F.explode("seeds").alias("seed"), "node_id", "distance"))


def moment_context(n: DataFrame, e: DataFrame) -> DataFrame:
    """One row for each moment with an edge: what its direct neighbours say about it."""
    both = ends(e).where(F.startswith("node_id", F.lit("moment:")) & (F.col("node_id") != F.col("other")))
    modality = n.where("node_type = 'evidence'").select(F.col("node_id").alias("other"), F.col("metadata")["modality"].alias("modality"))
    is_a = lambda kind: F.startswith("other", F.lit(f"{kind}:"))
    c = both.join(modality, "other", "left").groupBy(F.substr(F.col("node_id"), F.lit(8)).alias("moment_id")).agg(
        F.array_join(F.sort_array(F.collect_set(F.when(is_a("entity"), F.substr(F.col("other"), F.lit(8))))), ",").alias("entities"),
        F.count_distinct(F.when(is_a("idea"), F.col("other"))).alias("idea_count"),
        F.array_join(F.sort_array(F.collect_set("modality")), ",").alias("evidence_modalities"),
        F.count_distinct(F.when(is_a("moment"), F.col("other"))).alias("related_moment_count"),
        F.count_if(F.col("edge_type") == "moment_duplicate_of").alias("duplicate_count"),
        F.count_if(F.col("edge_type").isin("moment_variant_of", "moment_same_idea_as")).alias("variant_count"),
        F.max(is_a("duplicate_cluster")).alias("clustered"),
    )
    said = F.array_join(F.array_compact(F.array(F.when(F.col("duplicate_count") > 0, F.format_string("%d duplicate", "duplicate_count")), F.when(F.col("variant_count") > 0, F.format_string("%d variant", "variant_count")))), ", ")
    return c.withColumn("cluster_info", F.when(F.col("clustered"), F.concat(said, F.lit(" moment(s)"))).otherwise("")).drop("clustered")


def components(n: DataFrame, e: DataFrame) -> DataFrame:
    """node_id, component: the smallest node id that can be reached."""
    linked = connected_components(e, "source_node_id", "target_node_id").withColumnRenamed("node", "node_id")
    return n.select("node_id").join(linked, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))


def stats(n: DataFrame, e: DataFrame) -> DataFrame:
    """metric, value: totals, counts by type, average degree, clusters, components."""
    value = lambda df: df.select("metric", F.col("value").cast("double"))
    total_n = n.agg(F.count("*").alias("value")).withColumn("metric", F.lit("nodes"))
    total_e = e.agg(F.count("*").alias("value")).withColumn("metric", F.lit("edges"))
    by_n = n.groupBy(F.concat(F.lit("nodes:"), "node_type").alias("metric")).agg(F.count("*").alias("value"))
    by_e = e.groupBy(F.concat(F.lit("edges:"), "edge_type").alias("metric")).agg(F.count("*").alias("value"))
    average = n.agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("e"))).select(F.lit("average_degree").alias("metric"), F.when(F.col("n") > 0, F.round(2 * F.col("e") / F.col("n"), 4)).otherwise(0.0).alias("value"))  # two rows of totals
    parts = components(n, e).agg(F.count_distinct("component").alias("value")).withColumn("metric", F.lit("components"))
    out = value(total_n)
    for df in (total_e, by_n, by_e, average, parts):
        out = out.unionByName(value(df))
    return out


def export(n: DataFrame, e: DataFrame) -> DataFrame:
    """kind, id, json: one JSON object for each node and edge, to be written as lines."""
    node = n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.to_json(F.struct("node_id", "node_type", "ref_id", "label", "metadata")).alias("json"))
    edge = e.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.to_json(F.struct("edge_id", "source_node_id", "target_node_id", "edge_type", "weight")).alias("json"))
    return node.unionByName(edge)


def write_export(n: DataFrame, e: DataFrame, path: str) -> None:
    """`export` as lines of JSON below ``path``, and one line that tells when, how many nodes and edges, and of which types."""
    export(n, e).select("json").write.mode("overwrite").text(f"{path}/rows")
    counts = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"{c}s"), F.sum("n").alias("total"))  # noqa: E731  a row for each type
    told = counts(n, "node_type").withColumnRenamed("total", "nodes").crossJoin(counts(e, "edge_type").withColumnRenamed("total", "edges"))
    told.select(F.to_json(F.struct(F.current_timestamp().alias("created_at"), "nodes", "edges", "node_types", "edge_types")).alias("json")).write.mode("overwrite").text(f"{path}/summary")

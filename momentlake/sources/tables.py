"""Tables as Parquet: schemas, checks and the ways to write into them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIDEO_SOURCES = ("youtube", "vimeo", "generic", "local", "webpage")
VIDEO_STATES = ("pending", "processing", "ready", "error")
IDEA_TYPES = ("definition", "step", "warning", "example", "comparison", "claim", "question")
IDEA_SOURCES = ("rule", "model", "manual")
RUN_STATES = ("running", "completed", "failed")
ITEM_TYPES = ("moment", "idea")


def _schema(text: str) -> T.StructType:
    """Fields by name and type; a ``!`` after the type forbids nulls. Needs an active session."""
    fields = [part.strip().split(" ", 1) for part in text.split(";")]
    return T.StructType([T.StructField(n, T._parse_datatype_string(k.rstrip("!")), not k.endswith("!")) for n, k in fields])


SCHEMAS = {
    "videos": "video_id string!; title string!; source string!; url string; duration_sec double!; status string!; transcript_path string; error_message string; metadata map<string,string>; created_at timestamp!",
    "moments": "moment_id string!; video_id string!; start_sec double!; end_sec double!; transcript_text string!; ocr_text string; ideas array<struct<idea_id:string,moment_id:string,type:string,text:string,confidence:double,source:string>>; keyframe_paths array<string>; content_hash string; parent_moment_id string; embedding array<double>; metadata map<string,string>; created_at timestamp!; ord bigint!",
    "ideas": "idea_id string!; moment_id string!; type string!; text string!; confidence double; source string",
    "modal_evidence": "evidence_id string!; moment_id string!; modality string!; content string!; confidence double; source string; metadata map<string,string>; created_at timestamp!",
    "keyframes": "keyframe_id string!; moment_id string; video_id string!; timestamp_sec double!; file_path string!; width int; height int; ocr_text string; metadata map<string,string>",
    "duplicates": "dup_id string!; moment_id string!; canonical_moment_id string!; similarity_score double; novelty_score double; method string; duplicate_type string; item_type string; reason string",
    "graph_nodes": "node_id string!; node_type string!; ref_id string; label string!; metadata map<string,string>",
    "graph_edges": "edge_id string!; source_node_id string!; target_node_id string!; edge_type string!; weight double; metadata map<string,string>",
    "claims": "claim_id string!; claim_text string!; claim_type string!; normalized_claim string; confidence double; source_moment_id string!; evidence_ids array<string>",
    "embedding_vectors": "vector_id string!; item_type string!; item_id string!; run_id string!; vector array<double>!",
    "freshness_scores": "item_type string!; item_id string!; freshness_score double; stale_reason string; superseded_by string",
    "ingestion_runs": "run_id string!; video_id string!; status string!; pipeline_steps array<string>; error_message string; started_at timestamp!; completed_at timestamp",
    "transcript_entries": "video_id string!; seq int!; start_sec double!; end_sec double!; text string!",
}

RULES: dict[str, dict[str, tuple[str, ...]]] = {
    "videos": {"source": VIDEO_SOURCES, "status": VIDEO_STATES}, "ideas": {"type": IDEA_TYPES, "source": IDEA_SOURCES}, "ingestion_runs": {"status": RUN_STATES}, "embedding_vectors": {"item_type": ITEM_TYPES},
}


def schema(name: str) -> T.StructType:
    return _schema(SCHEMAS[name])


def violations(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Rows against the table's rules, with a column ``broken``: nulls, values, repeated keys."""
    tests: list[Column] = []
    for f in schema(name).fields:
        if f.name in df.columns and not f.nullable:
            tests.append(F.when(F.col(f.name).isNull(), f"{f.name} is null"))
    for c, values in RULES.get(name, {}).items():
        if c in df.columns:
            tests.append(F.when(~F.col(c).isin(*values), f"{c} is not one of its values"))
    out = df
    if key:
        repeated = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
        out = df.join(repeated, key, "left")
        tests.append(F.when(F.col("__n").isNotNull(), f"{key} is repeated"))
    out = out.withColumn("broken", F.array_join(F.array_compact(F.array(*tests)), "; ")).where("broken <> ''")
    return out.drop("__n")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new`` and those of ``old`` without a new one of the same key; of new rows the last by all columns."""
    kept = old.join(new.select(*key).distinct(), list(key), "left_anti").select(*old.columns)
    rest = [c for c in old.columns if c not in key]
    once = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r")).select(*key, "r.*").select(*old.columns)
    return kept.unionByName(once)


def insert_if_absent(old: DataFrame, new: DataFrame, *key: str, order: str | None = None) -> DataFrame:
    """``old`` and the first new row of each key that it lacks, by ``order`` (a column of new), then by all columns.

    The first is a partial minimum, so a key repeated often never meets in one task.
    """
    rest = [c for c in old.columns if c not in key]
    by = F.struct(*([F.col(order).alias("__order")] if order else []), *rest)
    once = new.groupBy(*key).agg(F.min(by).alias("r")).select(*key, "r.*").select(*old.columns)
    return old.unionByName(once.join(old.select(*key), list(key), "left_anti").select(*old.columns))


def insert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``old`` and ``new``; the query fails where a key of ``new`` would be there twice. Keys are counted by partial aggregates."""
    side = lambda df, old_rows: df.select(*key, F.lit(old_rows).alias("__old"))
    counted = side(new, 0).unionByName(side(old.join(new.select(*key).distinct(), list(key), "left_semi"), 1))
    twice = counted.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").agg(F.count("*").alias("__twice"))
    checked = twice.select(F.when(F.col("__twice") > 0, F.raise_error(F.lit("key is there already"))).otherwise(F.lit(True)).cast("boolean").alias("__ok"))
    return old.unionByName(new).crossJoin(F.broadcast(checked)).where("__ok").drop("__ok")  # one row


def delete_cascade(tables: dict[str, DataFrame], video_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of these videos, derived tables included."""
    gone = tables["moments"].join(video_ids, "video_id", "left_semi").select("moment_id")
    out = {}
    for name, df in tables.items():
        if name == "duplicates":
            df = df.join(gone, "moment_id", "left_anti").join(gone.withColumnRenamed("moment_id", "canonical_moment_id"), "canonical_moment_id", "left_anti").select(*df.columns)
        elif "video_id" in df.columns:
            df = df.join(video_ids, "video_id", "left_anti").select(*df.columns)
        elif "moment_id" in df.columns:
            df = df.join(gone, "moment_id", "left_anti").select(*df.columns)
        elif "source_moment_id" in df.columns:
            df = df.join(gone.withColumnRenamed("moment_id", "source_moment_id"), "source_moment_id", "left_anti").select(*df.columns)
        elif name in ("freshness_scores", "embedding_vectors"):
            df = df.join(gone.withColumnRenamed("moment_id", "item_id"), "item_id", "left_anti").select(*df.columns)
        out[name] = df
    return out


def write(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    """Parquet; with partitions only those that ``df`` holds are replaced."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of every table."""
    each = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def write_counted(rows: DataFrame, path: str, mode: str = "overwrite", **counters: Column) -> dict[str, object]:
    """Write ``rows`` as Parquet and return ``rows`` and the named aggregates, counted in the same scan."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in counters.items())).write.mode(mode).parquet(path)
    return seen.get

"""From parsed sources to moments, ideas and evidence, and the context of a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.functions import text as T
from momentlake.operators import chunking, rules, vector_store, vectors
from momentlake.plans.lineage import cut
from momentlake.sources.transcripts import BLANK

ANCHOR_SCORE = 0.5


def assemble(videos: DataFrame, entries: DataFrame, ocr: DataFrame, frames: DataFrame, fast: bool = False) -> dict[str, DataFrame]:
    """Tables videos, moments, ideas and evidence of ``videos`` (video_id, duration_sec).

    A video without entries gets tiles of silence. A duration that isn't known becomes the
    last end of its entries, or else of its moments. ``fast`` leaves out frames, screen
    texts and ideas: its evidence is transcripts only.
    """
    spoken = chunking.chunks(entries)
    silent = chunking.tiles(videos.join(entries.where(T.collapse(F.col("text")) != "").select("video_id").distinct(), "video_id", "left_anti"))
    columns = ("video_id", "seq", "start_sec", "end_sec", "transcript_text")
    pieces = cut(spoken.select(*columns).unionByName(silent.withColumn("transcript_text", F.lit("")).select(*columns)))
    bare = pieces.withColumn("moment_id", T.moment_id(F.col("video_id").cast("string"), F.col("start_sec"), F.col("end_sec")))

    end = lambda df, name: df.groupBy("video_id").agg(F.max("end_sec").alias(name))
    known = F.when(F.col("duration_sec") > 0, F.col("duration_sec"))
    lasting = videos.join(end(entries, "__said"), "video_id", "left").join(end(pieces, "__cut"), "video_id", "left")
    lasting = lasting.withColumn("duration_sec", F.coalesce(known, F.when(F.col("__said") > 0, F.col("__said")), "__cut", F.lit(0.0))).drop("__said", "__cut")

    seen, shown = (ocr.limit(0), frames.limit(0)) if fast else (ocr, frames)
    moments = bare.join(chunking.screen_text(bare, seen), "moment_id", "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))
    moments = moments.withColumn("content_hash", T.content_hash(T.combined_text(F.col("transcript_text"), F.col("ocr_text"))))
    ideas = rules.ideas(moments)
    ideas = ideas.limit(0) if fast else ideas
    return {"videos": lasting, "moments": moments, "ideas": ideas, "evidence": chunking.evidence(moments, seen, shown, ideas)}


def prompt_context(moments: DataFrame, hits: DataFrame, limit: int = 5) -> DataFrame:
    """video_id, place, moment_id, timestamp_label, transcript_snippet, score: what to tell of each video.

    The best ``limit`` hits of a search in the video come first, then its timeline anchors
    that aren't among them.
    """
    best = Window.partitionBy("video_id").orderBy("rank")
    top = hits.withColumn("o", F.row_number().over(best)).where(F.col("o") <= limit)
    shape = ("video_id", "moment_id", "timestamp_label", "transcript_snippet", "score", "g", "o")
    top = top.withColumn("g", F.lit(0)).select(*shape)
    m = moments.select("moment_id", T.clock_range(F.col("start_sec"), F.col("end_sec")).alias("timestamp_label"), F.substring(F.coalesce("transcript_text", F.lit("")), 1, 240).alias("transcript_snippet"))
    rest = chunking.anchors(moments).join(top.select("moment_id"), "moment_id", "left_anti").join(m, "moment_id")
    rest = rest.withColumns({"score": F.lit(ANCHOR_SCORE), "g": F.lit(1), "o": F.col("place")}).select(*shape)
    told = top.unionByName(rest).withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy("g", "o")))
    return told.select("video_id", "place", "moment_id", "timestamp_label", "transcript_snippet", F.round("score", 4).alias("score"))


def context_ideas(context: DataFrame, ideas: DataFrame) -> DataFrame:
    """video_id, place, idea: the different ideas of a context's moments, in order."""
    said = context.select("video_id", "place", "moment_id").join(ideas.select("moment_id", "pos", F.concat(F.lit("["), "type", F.lit("] "), "text").alias("idea")), "moment_id")
    first = said.groupBy("video_id", "idea").agg(F.min(F.struct("place", "pos")).alias("at"))
    return first.select("video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("at")).alias("place"), "idea")


def _whole_text():
    return F.regexp_replace(F.concat(F.coalesce("transcript_text", F.lit("")), F.lit(" "), F.coalesce("ocr_text", F.lit(""))), BLANK, "")


def hashed_vectors(moments: DataFrame, dimension: int = 64) -> DataFrame:
    """vec_id (the moment's ord), embedding: hash embeddings of all moments that have any text."""
    some = F.coalesce("transcript_text", F.lit("")).rlike(r"[^\s\p{Z}]") | F.coalesce("ocr_text", F.lit("")).rlike(r"[^\s\p{Z}]")  # as `_whole_text` isn't empty, without making it twice
    return moments.where(some).select(F.col("ord").alias("vec_id"), vectors.hash_embedding(_whole_text(), dimension).alias("embedding"))


def semantic(moments: DataFrame, query: str, k: int = 10, dimension: int = 64, store: vector_store.VectorStore | None = None, among: DataFrame | None = None) -> DataFrame:
    """moment_id, video_id, score, rank, reasons: the moments nearest to a query by hash embeddings.

    Moments without any text have no vector. With a ``store`` of `hashed_vectors` nothing is
    embedded but the query, and ``among`` (vec_id) restricts it; without one, filters by
    video go before the call. ``dimension`` is that of the stored run, for the query as well.
    """
    asked = moments.sparkSession.createDataFrame([(0, query)], "query_id long, text string").select("query_id", vectors.hash_embedding(F.col("text"), dimension).alias("embedding"))
    near = vectors.cosine_top_k(asked, cut(hashed_vectors(moments, dimension)), k) if store is None else vector_store.search(store, asked, k, among)
    named = moments.select(F.col("ord").alias("vec_id"), "moment_id", "video_id").join(F.broadcast(near), "vec_id")  # k rows
    return named.select("moment_id", "video_id", "score", "rank", F.lit("semantic").alias("reasons"))

"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.operators import rules


def per_video(moments: DataFrame) -> DataFrame:
    return moments.groupBy("video_id").agg(F.count("*").alias("n_moments"))


def characters(moments: DataFrame) -> DataFrame:
    """Mean length of transcripts, and all characters of transcripts and screen texts."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return moments.agg(F.round(F.avg(size("transcript_text")), 4).alias("avg_transcript"), F.sum(size("transcript_text")).cast("long").alias("transcript_chars"), F.sum(size("ocr_text")).cast("long").alias("ocr_chars"))


def modalities(evidence: DataFrame) -> DataFrame:
    """modality, n, n_moments; counted by moment first, so a hot modality is summed early."""
    each = evidence.groupBy("modality", "moment_id").agg(F.count("*").alias("n"))
    return each.groupBy("modality").agg(F.sum("n").alias("n"), F.count("*").alias("n_moments"))


def coverage(moments: DataFrame, ideas: DataFrame, evidence: DataFrame) -> DataFrame:
    """Shares of moments with ideas and evidence; mentions by ideas, and ideas with a mention."""
    found = rules.entities(ideas, "idea_id", F.col("text"))
    rows = [
        moments.agg(F.count("*").alias("m")), ideas.agg(F.count("*").alias("i"), F.count_distinct("moment_id").alias("mi")), evidence.agg(F.count_distinct("moment_id").alias("me")),
        found.agg(F.count("*").alias("x"), F.count_distinct("idea_id").alias("xi")),
    ]
    one = rows[0]
    for r in rows[1:]:
        one = one.crossJoin(r)  # one row each
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) * 100.0 / F.col(b), 1)).otherwise(0.0)
    return one.select(pct("mi", "m").alias("pct_moments_with_ideas"), pct("me", "m").alias("pct_moments_with_evidence"), pct("x", "i").alias("pct_ideas_with_entities"), pct("xi", "i").alias("pct_ideas_with_an_entity"))

"""Moments from plain documents: one moment for each document, one video for each source.

The documents are invented prose in which rule words hardly occur, so a short phrase is
added by ``doc_id`` to give every rule something to find. ``MOMENTS_SQL`` is the same
table in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = (
    "A moment is a unit of video. Avoid old paths.",
    "First, install the tool. Then run it.",
    "Do not delete the data. For example, keep a copy.",
    "Always keep a backup. This is better than nothing.",
    "You should use this version. The latest API is modern.",
    "The module is deprecated. See src/main/app.py for details.",
    "Error: file not found in /usr/local/bin/tool.sh today.",
    "Run pip install numpy and git commit soon. Call parseText now.",
    "We compare speed versus size. Use snake_case_name here.",
    "The Playwright Browser API uses JSON. y = mx + b holds.",
    "from os.path import join. However the issue remains.",
    "",
)
SCREENS = ("git push origin main", "class Parser in def run", "", "", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores: a small input in fewer files than cores is dealt out, others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, moment_id, video_id, title, start_sec, end_sec, transcript_text, ocr_text."""
    d = spread(table(spark, sf_dir, "documents"))
    pick = lambda given: F.element_at(F.array(*map(F.lit, given)), (F.pmod(F.col("doc_id"), F.lit(len(given))) + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("ord"),
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("moment_id"),
        F.col("source").alias("video_id"),
        F.concat(F.lit("Video "), "source").alias("title"),
        (F.col("doc_id") * 60.0).alias("start_sec"),
        (F.col("doc_id") * 60.0 + 60.0).alias("end_sec"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick(PHRASES)).alias("transcript_text"),
        pick(SCREENS).alias("ocr_text"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, title, source, url: one for each source of the documents."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("video_id")).distinct()
    return names.select(
        "video_id", F.concat(F.lit("Video "), "video_id").alias("title"), F.lit("local").alias("source"), F.concat(F.lit("https://example.org/v/"), "video_id").alias("url")
    )


def _listed(given: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in given) + "]"


MOMENTS_SQL = f"""m AS (
  SELECT doc_id AS ord, source || ':' || doc_id AS moment_id, source AS video_id, 'Video ' || source AS title,
         doc_id * 60.0::DOUBLE AS start_sec, doc_id * 60.0::DOUBLE + 60.0::DOUBLE AS end_sec,
         coalesce(text, '') || ' ' || {_listed(PHRASES)}[doc_id % {len(PHRASES)} + 1] AS transcript_text,
         {_listed(SCREENS)}[doc_id % {len(SCREENS)} + 1] AS ocr_text
  FROM documents)"""

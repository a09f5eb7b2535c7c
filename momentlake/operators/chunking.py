"""Chunks of transcripts, fallback tiles, and what is seen in a moment's time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST = 30.0, 120.0
_SPACE = re.compile(r"\s+")
_END = re.compile(r"[.!?]\s*$")


def chunk_entries(entries: list[tuple[float, float, str]], least: float = LEAST, most: float = MOST) -> list[tuple[float, float, str]]:
    """Cut entries in time order into chunks: none lost, none twice.

    A chunk ends at the last sentence end after ``least`` seconds once ``most`` is passed,
    or else before the entry that passes it. Chunks shorter than ``least`` join the one
    before them where both together stay within ``most``.
    """
    clean = [(float(a), max(float(a), float(b)), _SPACE.sub(" ", t or "").strip()) for a, b, t in entries]
    clean = sorted((e for e in clean if e[2]), key=lambda e: e[0])
    out: list[list] = []
    first = 0
    while first < len(clean):
        start, end, stop = clean[first][0], len(clean) - 1, None
        for k in range(first, len(clean)):
            lasts = clean[k][1] - start
            if lasts >= least and _END.search(clean[k][2]):
                stop = k
            if lasts > most:
                end = stop if stop is not None else max(first, k - 1)
                break
        piece = [start, clean[end][1], " ".join(e[2] for e in clean[first : end + 1])]
        if out and piece[1] - piece[0] < least and piece[1] - out[-1][0] <= most:
            out[-1][1:] = [piece[1], f"{out[-1][2]} {piece[2]}"]
        else:
            out.append(piece)
        first = end + 1
    return [tuple(c) for c in out]


def chunks(entries: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """video_id, seq, start_sec, end_sec, transcript_text from video_id, start_sec, end_sec, text.

    Where a chunk ends depends on where the one before ended, so a video's entries go to
    one group; a video is bounded by its length.
    """

    def run(pdf):
        pdf = pdf.sort_values(["start_sec", "seq"], kind="stable")
        got = chunk_entries(list(zip(pdf["start_sec"], pdf["end_sec"], pdf["text"], strict=True)), least, most)
        rows = [(pdf["video_id"].iloc[0], k, *c) for k, c in enumerate(got)]
        return type(pdf)(rows, columns=["video_id", "seq", "start_sec", "end_sec", "transcript_text"])

    part = entries.select("video_id", "seq", "start_sec", "end_sec", "text")
    kind = part.schema["video_id"].dataType.simpleString()
    return part.groupBy("video_id").applyInPandas(run, f"video_id {kind}, seq int, start_sec double, end_sec double, transcript_text string")


def tiles(videos: DataFrame, size: float = 60.0) -> DataFrame:
    """video_id, seq, start_sec, end_sec: the duration in pieces of 60 s; 60 s where it isn't known."""
    lasts = F.when(F.coalesce("duration_sec", F.lit(0.0)) <= 0, F.lit(size)).otherwise(F.col("duration_sec"))
    rows = videos.select("video_id", lasts.alias("lasts"), F.explode(F.sequence(F.lit(0), F.ceil(lasts / size).cast("int") - 1)).alias("seq"))
    return rows.select("video_id", "seq", (F.col("seq") * size).alias("start_sec"), F.least((F.col("seq") + 1) * size, F.col("lasts")).alias("end_sec"))


def frame_times(videos: DataFrame, interval: float = 30.0) -> DataFrame:
    """video_id, seq, timestamp_sec: one each interval, one at least, none after the end."""
    count = F.greatest(F.lit(1), F.ceil(F.col("duration_sec") / interval).cast("int"))
    rows = videos.select("video_id", "duration_sec", F.explode(F.sequence(F.lit(0), count - 1)).alias("seq"))
    return rows.select("video_id", "seq", F.least(F.col("seq") * interval, F.col("duration_sec")).alias("timestamp_sec"))


def seen_in(moments: DataFrame, points: DataFrame, cell: float = 120.0) -> DataFrame:
    """Points (video_id, timestamp_sec, ..) with the moment_id of each moment around them, ends included.

    A range join as an equi-join on cells of time: a moment is in each cell that it meets,
    a point in one.
    """
    of = lambda c: F.floor(F.col(c) / cell)
    m = moments.select("moment_id", "video_id", "start_sec", "end_sec", F.explode(F.sequence(of("start_sec"), of("end_sec"))).alias("cell"))
    joined = points.withColumn("cell", of("timestamp_sec")).join(m, ["video_id", "cell"])
    return joined.where(F.col("timestamp_sec").between(F.col("start_sec"), F.col("end_sec"))).drop("cell", "start_sec", "end_sec")


def screen_text(moments: DataFrame, ocr: DataFrame) -> DataFrame:
    """moment_id, ocr_text: the different texts seen, in order of time."""
    seen = seen_in(moments, ocr.where(F.trim("text") != ""))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("timestamp_sec", "text"))), lambda x: x["text"])
    return seen.groupBy("moment_id").agg(F.array_join(F.array_distinct(texts), " ").alias("ocr_text"))


def evidence(moments: DataFrame, ocr: DataFrame, frames: DataFrame, ideas: DataFrame) -> DataFrame:
    """moment_id, modality, content, confidence of transcripts, screen texts, frames and ideas."""
    said = moments.where(F.trim("transcript_text") != "").select("moment_id", F.lit("transcript").alias("modality"), F.col("transcript_text").alias("content"), F.lit(1.0).alias("confidence"))
    seen = seen_in(moments, ocr).select("moment_id", F.lit("ocr").alias("modality"), F.col("text").alias("content"), F.col("confidence").cast("double").alias("confidence"))
    shown = seen_in(moments, frames).select("moment_id", F.lit("visual").alias("modality"), F.col("path").alias("content"), F.lit(1.0).alias("confidence"))
    meant = ideas.select("moment_id", F.lit("idea").alias("modality"), F.col("text").alias("content"), "confidence")
    return said.unionByName(seen).unionByName(shown).unionByName(meant)


def anchors(moments: DataFrame) -> DataFrame:
    """video_id, moment_id, place: the moments at a quarter, a half and three quarters of each video.

    Two moments are both anchors, a single one is the anchor.
    """
    w = Window.partitionBy("video_id")
    rows = moments.select("video_id", "moment_id", (F.row_number().over(w.orderBy("start_sec", "moment_id")) - 1).alias("place"), F.count("*").over(w).alias("n"))
    n, p = F.col("n"), F.col("place")
    three = (p == F.floor(n / 4)) | (p == F.floor(n / 2)) | (p == F.floor(3 * n / 4))
    return rows.where(F.when(n >= 3, three).otherwise(F.lit(True))).select("video_id", "moment_id", F.col("place").cast("int").alias("place"))

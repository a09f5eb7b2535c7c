"""Transcript files as rows: SRT, VTT, plain text and JSON, parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlake.sources.files import decoded, with_empty

#: Of one video's files the first of these is read.
EXTENSIONS = ("vtt", "srt", "txt", "json")
BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """video_id, kind, text of the transcript of each video in a folder: one file each, by extension."""
    scan = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), "value")
    files, path = with_empty(spark, scan, "file", EXTENSIONS), decoded(F.col("file"))
    name = F.regexp_extract(path, r"([^/]+)\.([A-Za-z0-9]+)$", 1)
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    text = F.regexp_replace(F.coalesce("value", F.lit("")), "^﻿", "")
    files = files.select(name.alias("video_id"), kind.alias("kind"), text.alias("text"))
    order = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("kind"))
    return files.groupBy("video_id").agg(F.min_by(F.struct("kind", "text"), order).alias("f")).select("video_id", "f.*")


def seconds(stamp: Column) -> Column:
    """h:m:s or m:s with a comma or a point; 0 for other shapes."""
    p = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    part = lambda k: F.try_element_at(p, F.lit(k)).try_cast("double")
    return F.coalesce(F.when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(p) == 2, part(1) * 60 + part(2)), F.lit(0.0))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def _cues(text: Column, drop: str, notes: bool, first_word: bool) -> Column:
    """Array of (start_sec, end_sec, text) of the blocks with a time line and a text."""
    blocks = F.transform(F.split(_trim(text), r"\n[\s\p{Z}]*\n"), _trim)

    def cue(block: Column) -> Column:
        lines = F.split(block, r"\r\n|\n|\r")
        times = F.filter(lines, lambda x: F.contains(x, F.lit("-->")))
        words = F.filter(lines, lambda x: ~F.contains(x, F.lit("-->")) & ~(_trim(x) if not notes else x).rlike(drop))
        ends = F.split(_trim(F.try_element_at(times, F.lit(-1))), "-->")
        stamp = lambda k: F.regexp_extract(_trim(F.try_element_at(ends, F.lit(k))), r"^\S*" if first_word else r"(?s)^.*$", 0)
        said = F.array_join(F.transform(words, _trim), " ")
        is_note = F.exists(lines, lambda x: F.startswith(x, F.lit("NOTE ")) & ~F.contains(x, F.lit("-->"))) if notes else F.lit(False)
        ok = (F.size(lines) >= 2) & (F.size(times) > 0) & (F.size(words) > 0) & ~is_note
        return F.when(ok, F.struct(seconds(stamp(1)).alias("start_sec"), seconds(stamp(2)).alias("end_sec"), said.alias("text")))

    return F.array_compact(F.transform(blocks, cue))


def parse_srt(files: DataFrame) -> DataFrame:
    """video_id, seq, start_sec, end_sec, text; lines of digits only are dropped anywhere."""
    return _rows(files, _cues(F.col("text"), r"^\d+$", False, False))


def parse_vtt(files: DataFrame) -> DataFrame:
    """As `parse_srt`, without the header and notes; lines that name a cue stay text."""
    body = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), r"(?s)^WEBVTT.*?(?=\n\S)", "")
    return _rows(files, _cues(body, r"^(?:Kind:|Language:)", True, True))


def _rows(files: DataFrame, cues: Column) -> DataFrame:
    return files.select("video_id", F.posexplode(cues).alias("seq", "c")).select("video_id", "seq", "c.*")


def parse_txt(files: DataFrame) -> DataFrame:
    """Sentences laid end to end: time in proportion to length, 30 s in all and 1 s each at least."""
    paragraphs = F.filter(F.transform(F.split("text", "\n\n"), _trim), lambda p: p != "")
    rows = files.select("video_id", paragraphs.alias("p")).where(F.size("p") > 0)
    total = F.aggregate("p", F.lit(0), lambda n, p: n + F.length(p))
    rate = F.greatest(total / F.lit(15.0), F.lit(30.0)) / total
    told = F.flatten(F.transform("p", lambda p: F.split(p, r"(?<=[.!?])[\s\p{Z}]+")))
    told = F.filter(F.transform(told, _trim), lambda s: s != "")
    spoken = rows.select("video_id", rate.alias("rate"), F.posexplode(told).alias("seq", "text"))
    spoken = spoken.withColumn("lasts", F.greatest(F.length("text") * F.col("rate"), F.lit(1.0)))
    sofar = Window.partitionBy("video_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("lasts").over(sofar)
    return spoken.select("video_id", "seq", (end - F.col("lasts")).alias("start_sec"), end.alias("end_sec"), "text")


def parse_json(files: DataFrame) -> DataFrame:
    """Entries of a JSON list; what is no list gives none."""
    entries = F.from_json("text", "array<struct<start_sec: double, end_sec: double, text: string>>")
    return _rows(files, entries)


def parse(files: DataFrame) -> DataFrame:
    """Entries of files of any kind, dispatched by their kind; empty files give none."""
    filled = files.where(_trim(F.col("text")) != "")
    parts = [f(filled.where(F.col("kind") == k)) for k, f in (("srt", parse_srt), ("vtt", parse_vtt), ("txt", parse_txt), ("json", parse_json))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

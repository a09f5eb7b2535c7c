"""Urls: which provider serves them, their normal form and the video's id; source lists and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions.text import short_hash
from momentlake.sources.files import decoded, with_empty

# Hosts of the known providers and extensions of media files.
SHORT_HOSTS = ("youtu.be", "www.youtu.be")
WATCH_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com")
VIMEO_HOSTS = ("vimeo.com", "www.vimeo.com", "player.vimeo.com")
MEDIA = ("mp4", "mkv", "mov", "avi", "webm", "m4v")
PROVIDERS = ("youtube", "vimeo", "generic", "local", "webpage")


def authority(url: Column) -> Column:
    """The part between // and the next / ? or #, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def provider(url: Column, hint: Column | None = None) -> Column:
    """The named provider if the hint is one, else by host, else generic for http(s), else local."""
    host = authority(url)
    found = (
        F.when(host.isin(*SHORT_HOSTS, *WATCH_HOSTS), "youtube").when(host.isin(*VIMEO_HOSTS), "vimeo")
        .when(F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)).isin("http", "https"), "generic").otherwise("local")
    )
    return found if hint is None else F.when(hint.isin(*PROVIDERS), hint).otherwise(found)


def normal_url(url: Column) -> Column:
    """Watch urls and short ones in one form without other parameters; others as they are."""
    host = authority(url)
    short = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*/+([^/?#]*)", 1)
    watch = F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*&)?v=([^&#]+)", 1)
    video = F.when(host.isin(*SHORT_HOSTS), short).when(host.isin(*WATCH_HOSTS), watch).otherwise("")
    return F.when(video != "", F.concat(F.lit("https://www.youtube.com/watch?v="), video)).otherwise(url)


def video_id(url: Column) -> Column:
    """The eleven characters of a watch or short url, else the first 16 hex digits of the hash."""
    own = F.regexp_extract(url, r"(?:v=|youtu\.be/)([a-zA-Z0-9_-]{11})", 1)
    return F.when((provider(url) == "youtube") & (own != ""), own).otherwise(short_hash(url))


def source_list(lines: DataFrame) -> DataFrame:
    """Lines of a list file that are neither blank nor comments."""
    line = F.trim("value")
    return lines.select(line.alias("source")).where((line != "") & ~F.startswith(line, F.lit("#")))


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size of the media files of a folder, by extension; contents aren't read."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.input_file_name().alias("file"), F.col("length").alias("size"))
    path = decoded(F.col("file"))
    return with_empty(spark, scan, "file", MEDIA).select(path.alias("path"), F.regexp_extract(path, r"([^/]+)$", 1).alias("name"), F.coalesce("size", F.lit(0)).alias("size"))

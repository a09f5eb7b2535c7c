"""Contract of video providers, and caches of what they and speech recognition return.

Nothing here reaches the network: a provider that does is written by the user against
`VideoProvider`, runs in `ingest`, and its results are tables like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.sources import web

ENTRIES = "video_id string, seq int, start_sec double, end_sec double, text string"
META = "source string, video_id string, provider string, title string, url string, duration_sec double, error string"


@dataclass
class Metadata:
    title: str = ""
    url: str | None = None
    duration_sec: float = 0.0
    extra: dict[str, str] = field(default_factory=dict)


class VideoProvider:
    """What a provider may do; all but ``metadata`` have a default."""

    name = "generic"

    def detect(self, source: str) -> bool:
        return source.startswith(("http://", "https://"))

    def normalize(self, source: str) -> str:
        return source

    def metadata(self, source: str) -> Metadata:
        raise NotImplementedError

    def captions(self, source: str) -> list[dict] | None:
        """Entries start_sec, end_sec, text; None where there are none."""
        return None


def fetch(sources: DataFrame, providers: Iterable[VideoProvider]) -> DataFrame:
    """Metadata of each source by the first provider that detects it; an error is a row, not a failure."""
    known = list(providers)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for source, video in zip(pdf["source"], pdf["video_id"], strict=True):
                own = next((p for p in known if p.detect(source)), None)
                try:
                    if own is None:
                        raise ValueError("no provider")
                    m = asdict(own.metadata(own.normalize(source)))
                    rows.append((source, video, own.name, m["title"], m["url"], m["duration_sec"], None))
                except Exception as e:  # noqa: BLE001  whatever a provider raises is told in the row
                    rows.append((source, video, own.name if own else None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "video_id", "provider", "title", "url", "duration_sec", "error"])

    return sources.select("source", web.video_id(F.col("source")).alias("video_id")).mapInPandas(run, META)


def cached_entries(spark: SparkSession, folder: str, videos: DataFrame, recognize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Transcript entries of ``videos`` (video_id): those in the cache, and of the others what ``recognize`` makes, which is added to it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    have = spark.read.schema(ENTRIES).parquet(folder) if there else spark.createDataFrame([], ENTRIES)
    missing = videos.select("video_id").distinct().join(have.select("video_id").distinct(), "video_id", "left_anti")
    if not missing.isEmpty():
        recognize(missing).select("video_id", "seq", "start_sec", "end_sec", "text").write.mode("append").parquet(folder)
    return spark.read.schema(ENTRIES).parquet(folder).join(videos.select("video_id").distinct(), "video_id", "left_semi")


def checked_media(spark: SparkSession, paths: DataFrame, folder: str) -> DataFrame:
    """path, size, error of the paths asked for: missing files and files of other kinds are told as errors."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    there = web.media_files(spark, folder).select(plain("path").alias("local"), "size")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = paths.select("path", plain("path").alias("local")).join(there, "local", "left")
    return out.select("path", "size", F.when(~kind.isin(*web.MEDIA), F.concat(F.lit("unsupported format: "), kind)).when(F.col("size").isNull(), "file not found").when(F.col("size") == 0, "empty file").alias("error"))


def demo_corpus(spark: SparkSession, videos: int = 3, moments: int = 16) -> dict[str, DataFrame]:
    """Tables videos and transcript_entries made from a rule: topics by video, and every fifth entry repeats the one before."""
    topics = F.array(*(F.lit(t) for t in ("install the tool and run it", "train the model on data", "design the page for people", "compare speed versus size")))
    v = spark.range(videos).select(F.concat(F.lit("demo"), F.col("id").cast("string")).alias("video_id"), F.concat(F.lit("Demo "), F.col("id").cast("string")).alias("title"), F.lit("local").alias("source"), F.lit(None).cast("string").alias("url"), (F.lit(40.0) * moments).alias("duration_sec"))
    e = spark.range(videos * moments).select(F.concat(F.lit("demo"), (F.col("id") % videos).cast("string")).alias("video_id"), F.floor(F.col("id") / videos).cast("int").alias("seq"))
    told = F.when(F.col("seq") % 5 == 4, F.col("seq") - 1).otherwise(F.col("seq"))
    text = F.concat(F.lit("Always "), F.element_at(topics, (told % 4 + 1).cast("int")), F.lit(", step "), told.cast("string"), F.lit("."))
    return {"videos": v, "transcript_entries": e.select("video_id", "seq", (F.col("seq") * 40.0).alias("start_sec"), (F.col("seq") * 40.0 + 40.0).alias("end_sec"), text.alias("text"))}

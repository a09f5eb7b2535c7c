"""Cutting lineage so that a lost executor costs a re-read and not a recomputation."""

from __future__ import annotations

import functools
import hashlib
import pathlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in ``spark.checkpoint.dir``.

    Only a session that names none and runs in one local JVM, as tests do, gets a
    temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="momentlake-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a checkpoint and return a frame that reads it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written to the shared folder for the length of an iteration.

    A checkpoint keeps the size that the planner had guessed for it, and guesses multiply
    from round to round; a table has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        drop_folder(self.spark, self.folder)


@functools.cache
def code_version() -> str:
    """A hash of this package's source files: what the code makes may change with it."""
    root = pathlib.Path(__file__).resolve().parents[1]
    told = hashlib.sha256()
    for path in sorted(root.rglob("*.py")):
        told.update(f"{path.relative_to(root)}\0".encode() + path.read_bytes())
    return told.hexdigest()


def state_of(spark: SparkSession, source: str) -> str:
    """A hash of the names, sizes and times of all data files at and below ``source``, at any depth of partitions."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def _folder_of(spark: SparkSession, source: str, name: str, parts: tuple[str, ...], settings: dict) -> str:
    told = " ".join([state_of(spark, source), code_version(), repr(sorted(settings.items())), repr(parts)])
    return f"{shared_folder(spark)}/stored/{hashlib.sha256(told.encode()).hexdigest()[:20]}/{name}"


def _published(spark: SparkSession, folder: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/published")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def stored_already(spark: SparkSession, source: str, name: str, *parts: str, **settings) -> DataFrame | None:
    """The table of `stored`, where one was written for this state, else None."""
    folder = _folder_of(spark, source, name, parts, settings)
    found = _published(spark, folder)
    return spark.read.parquet(f"{folder}/{found[0]}") if found else None


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], *parts: str, **settings) -> DataFrame:
    """A derived table, written to the shared folder for each state of ``source`` and read from then on.

    The state is that of all files below ``source``; ``settings`` that ``make`` depends on and
    the package's code count as well. ``parts`` are columns that the table is partitioned by.
    Each writer writes a folder of its own and then publishes it by an empty file of the same
    name; readers take the first published one, so writers at the same time can't mix.
    """
    folder = _folder_of(spark, source, name, parts, settings)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not _published(spark, folder):
        own = uuid.uuid4().hex
        make().write.partitionBy(*parts).parquet(f"{folder}/{own}")
        fs.mkdirs(jvm(f"{folder}/published"))
        fs.createNewFile(jvm(f"{folder}/published/{own}"))
    return spark.read.parquet(f"{folder}/{_published(spark, folder)[0]}")


#: A key with more rows than this is crowded; at most so many crowded keys are broadcast.
CROWDED, MOST_CROWDED = 1000, 100_000


def having(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``ids``; few ids are sent to all tasks, so that rows with texts aren't shuffled."""
    ids = cut(ids.select(key).distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_CROWDED else ids, key, "left_semi")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group, but for ``size``, which tells how many rows a key has.

    ``groups`` has one row for each key. Rows of crowded keys stay where they are: their
    groups are few and sent to all tasks, the others are shuffled. With more crowded keys
    than ``MOST_CROWDED`` all are shuffled, and adaptive execution splits what is skewed.
    """
    groups = cut(groups)
    crowded = groups.where(F.col(size) > CROWDED).drop(size)
    n = crowded.count()
    if n == 0 or n > MOST_CROWDED:
        return rows.join(groups.drop(size), key)
    marked = rows.join(F.broadcast(crowded.withColumn("__crowded", F.lit(True))), key, "left")
    few = marked.where("__crowded is null").select(*rows.columns).join(groups.where(F.col(size) <= CROWDED).drop(size), key)
    return few.unionByName(marked.where("__crowded").select(*few.columns))

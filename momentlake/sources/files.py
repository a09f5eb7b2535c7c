"""Files of a folder as rows, empty ones included, which scans leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def decoded(path: Column) -> Column:
    """The path as written, of the escaped form that scans give."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def with_empty(spark: SparkSession, scan: DataFrame, file: str, extensions: tuple[str, ...]) -> DataFrame:
    """``scan`` with a row of nulls for each file of these extensions of which it has none.

    ``file`` is its column of escaped paths. The listing is the one the scan has planned by.
    """
    names = [(p,) for p in scan.inputFiles() if p.rsplit(".", 1)[-1].lower() in extensions]
    listed = spark.createDataFrame(names, StructType([StructField(file, StringType())]))
    return listed.join(scan, file, "left")

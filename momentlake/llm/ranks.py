"""Distributed numbering: ranks in an order without sorting a group in one task.

Rows are counted in cells; a cell is a run of the order: ids of one block. Blocks come from
a range partitioning, so they hold about ``BLOCK_ROWS`` rows each whether ids are dense or
hashes. Only cell counts are summed along a group; inside a cell a window numbers at most the
rows of one block. Equal rows are counted first and expanded afterwards, so repeats of one
row never meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.plans.lineage import cut

#: Rows of a block, about; and copies of a row that one task makes.
BLOCK_ROWS, BLOCK = 1 << 16, 4096
#: Sorts before every block of an id.
NO_BLOCK = -1


def blocked(rows: DataFrame, key: str, *then: str, name: str = "block") -> DataFrame:
    """``rows`` (without a column of that name) with their block: blocks are in the order of ``key``, nulls first.

    Rows with one key share a block, unless ``then`` cuts further, in its order; nulls are all
    in `NO_BLOCK` without it. The result is written, so a lost task can't draw other bounds.
    """
    counted = cut(rows)
    blocks = max(1, -(-counted.count() // BLOCK_ROWS))
    own = F.col(key)
    if then:
        return cut(counted.repartitionByRange(blocks, own.asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in then)).withColumn(name, F.spark_partition_id().cast("long")))
    # rows without a key are dealt by a hash, which the block then doesn't tell
    apart = counted.withColumn("__apart", F.when(own.isNull(), F.xxhash64(*rows.columns)))
    dealt = apart.repartitionByRange(blocks, own.asc_nulls_first(), F.col("__apart").asc_nulls_first())
    return cut(dealt.drop("__apart").withColumn(name, F.when(own.isNull(), F.lit(NO_BLOCK)).otherwise(F.spark_partition_id()).cast("long")))


def expanded(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``name``; a row repeated often is dealt to many tasks."""
    few = rows.where(times <= BLOCK).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    many = rows.where(times > BLOCK).withColumns({"__times": times, "__part": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / BLOCK)))})
    many = many.repartition(F.xxhash64(*rows.columns, "__part"))
    last = F.least((F.col("__part") + 1) * BLOCK, F.col("__times")) - 1
    return few.unionByName(many.withColumn(name, F.explode(F.sequence(F.col("__part") * BLOCK, last))).drop("__part", "__times"))

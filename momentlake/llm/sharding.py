"""Sharding by weighted rendezvous hashing.

Each record key is hashed with each shard's number; the shard with the best score
log(u) / weight takes the record. A further shard can only win records for itself, and a
record's shard depends on its key, the shards and their weights alone.

Null keys are hashed as one key. Sizes count the text's bytes plus 1, null texts none.
Equal rows share a shard and get neighbouring slots. Texts of any length are read whole; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlake.llm.ranks import blocked

SHARDS = 16


def _bid(key: Column, shard: int, weight: float) -> Column:
    """A shard's bid for a key: its score, and the lower number in ties."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    word = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return F.struct((F.ln((word + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))).alias("score"), F.lit(-shard).alias("less"))


def best_bid(key: Column, weights: list[float]) -> Column:
    """The winning bid; minus ``less`` is the shard's number, 0 to len(weights) - 1."""
    bids = [_bid(key, k, w) for k, w in enumerate(weights) if w > 0]
    return F.greatest(*bids) if len(bids) > 1 else bids[0]


def shard_of(key: Column, weights: list[float]) -> Column:
    return -best_bid(key, weights)["less"]


def sharded(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Slots number a shard's rows from 0 without gaps, by id, size and checksum.
    grown_shard is the shard if one more of weight 1 is added.
    """
    weights = weights or [1.0] * shards
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"))
    bid = rows.withColumn("__best", best_bid(F.col("doc_id"), weights))  # once for both shards, and where the texts are read
    more = _bid(F.col("doc_id"), len(weights), 1.0)
    sharded_rows = bid.withColumns({"shard": -F.col("__best.less"), "grown_shard": F.when(more > F.col("__best"), F.lit(len(weights))).otherwise(-F.col("__best.less"))}).drop("__best")
    alike = sharded_rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("n"))
    placed = blocked(alike, "doc_id", "size", "text_crc32", name="__block")
    cells = placed.groupBy("shard", "__block").agg(F.sum("n").alias("cell"))
    start = cells.select("shard", "__block", (F.sum("cell").over(Window.partitionBy("shard").orderBy("__block")) - F.col("cell")).alias("start"))
    order = Window.partitionBy("shard", "__block").orderBy(*(F.col(c).asc_nulls_first() for c in ("doc_id", "size", "text_crc32")))
    numbered = placed.withColumn("__before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).join(start, ["shard", "__block"])
    slots = F.sequence(F.col("start") + F.col("__before"), F.col("start") + F.col("__before") + F.col("n") - 1)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")


SHARDED_SQL = """
WITH RECURSIVE step(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
b AS (
  SELECT row_number() OVER () AS r, doc_id, text,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
d AS (
  SELECT r, doc_id, len(bytes) + 1 AS size,
         CASE WHEN text IS NULL THEN NULL
              ELSE xor(list_reduce(bytes, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295) END AS text_crc32
  FROM b, tab),
s AS (
  SELECT r, k, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || k), 1, 13))::BIGINT AS h FROM d, range(17) t(k)),
p AS (
  SELECT r, arg_max(k, h) FILTER (WHERE k < 16) AS shard, arg_max(k, h) AS grown_shard FROM s GROUP BY r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1)::BIGINT AS slot,
       grown_shard::INTEGER AS grown_shard
FROM d JOIN p USING (r)
"""

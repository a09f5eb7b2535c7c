import zlib
from collections import Counter

from pyspark.sql import functions as F

from momentlake.llm import sharding


def test_shards_slots_and_growth(docs, empty_docs):
    rows = sharding.sharded(docs).collect()
    assert len(rows) == docs.count()
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, None if r.text is None else zlib.crc32(r.text.encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.sharded(empty_docs).collect() == []


def test_few_rows_move_and_weights_hold(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    at = lambda w: sharding.shard_of(F.col("doc_id"), w)
    moved = ids.select(at([1.0] * 16).alias("a"), at([1.0] * 17).alias("b")).where("a <> b")
    assert moved.where("b <> 16").count() == 0 and 900 < moved.count() < 1450
    counts = {r["s"]: r["count"] for r in ids.select(at([1.0, 3.0]).alias("s")).groupBy("s").count().collect()}
    assert 2.7 < counts[1] / counts[0] < 3.3

"""A text index that takes changes: a change set by content hash, delta postings, tombstones, folding by partition.

Below one folder there are ``postings`` (by bucket of the term), ``sizes`` (by a hash of the
moment: content hash, size and the buckets that its terms are in), ``dead`` (moments whose
earlier rows count no more) and ``manifest``. Every row tells its generation ``g``; a row is
live if its moment has no tombstone of a later one. A writer writes folders of its own and
then publishes them by a manifest that must not be there yet, so readers see a whole state,
and of two writers at once the second fails and can be run again.

`sync` and `update` write only what changed. `fold` rewrites the buckets that deltas or dead
moments are in, and leaves the files of all others as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.operators.search import BUCKETS, FIELDS, Index, bucket_of, field_tokens
from momentlake.plans.lineage import cut

PARTS = 64
SCHEMAS = {
    "postings": "moment_id string, field string, pos int, term string, g long, bucket int",
    "sizes": "moment_id string, hash string, size int, buckets array<int>, g long, part int",
    "dead": "moment_id string, g long",
}
KEYS = {"postings": "bucket", "sizes": "part"}


class IndexFolder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> dict:
        """The newest state: g, rows, tokens, and the folders of each table."""
        found = [n for n in self._names("manifest") if n.endswith(".json")]
        if not found:
            return {"g": 0, "rows": 0, "tokens": 0, "postings": [], "sizes": [], "dead": []}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/{found[-1]}").collect()))

    def _publish(self, state: dict) -> None:
        text = bytearray(json.dumps(state).encode())
        own = self._path(f"{self.path}/manifest/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(own, False)
        out.write(text)
        out.close()
        at = self._path(f"{self.path}/manifest/{state['g']:09d}.json")
        if self._fs.exists(at) or not self._fs.rename(own, at):
            self._fs.delete(own, False)
            raise RuntimeError("the index was changed meanwhile: run this again")

    def _write(self, name: str, rows: DataFrame) -> list[str]:
        """Folders of ``name`` that hold the rows now."""
        own, key = f"w={uuid.uuid4().hex}", KEYS.get(name)
        at = f"{self.path}/{name}/{own}"
        if key is None:
            rows.write.parquet(at)
            return [own]
        order = [key, "term"] if name == "postings" else [key, "moment_id"]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(key).parquet(at)
        return [f"{own}/{n}" for n in self._names(f"{name}/{own}") if n.startswith(f"{key}=")]

    def _rows(self, name: str, state: dict) -> DataFrame:
        folders = [f"{self.path}/{name}/{f}" for f in state[name]]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*folders)

    def _live(self, name: str, state: dict) -> DataFrame:
        rows = self._rows(name, state)
        if not state["dead"]:
            return rows
        dead = self._rows("dead", state).groupBy("moment_id").agg(F.max("g").alias("until"))
        return rows.join(dead, "moment_id", "left").where("until is null or until <= g").drop("until")

    def read(self) -> Index:
        """The index as of the newest state, as `search.build_index` would make it."""
        state = self.manifest()
        mean = state["tokens"] / state["rows"] if state["rows"] else None
        corpus = self.spark.createDataFrame([(state["rows"], mean)], "n long, mean double")
        return Index(self._live("postings", state).drop("g"), self._live("sizes", state).select("moment_id", "size"), corpus, BUCKETS)

    def sync(self, moments: DataFrame) -> dict[str, int]:
        """Make the index that of ``moments``; what isn't there any more is deleted. Returns counts of kinds of change."""
        return self._change(moments, None)

    def update(self, moments: DataFrame, gone: DataFrame | None = None) -> dict[str, int]:
        """Insert or update ``moments`` and delete the moment_ids of ``gone`` (of an id in both, the deletion counts)."""
        return self._change(moments, moments.select("moment_id").where(F.lit(False)) if gone is None else gone.select("moment_id").distinct())

    def _change(self, moments: DataFrame, gone: DataFrame | None) -> dict[str, int]:
        """Rows without an id are left out; of several rows of one id the greatest by hash is taken.

        Only ids, hashes and sizes of all moments are shuffled; texts are read for the hash
        and again for what changed.
        """
        state = self.manifest()
        g = state["g"] + 1
        fields = [c for c in FIELDS if c in moments.columns]
        named = moments.where("moment_id is not null").select(F.col("moment_id").cast("string").alias("moment_id"), *fields)
        named = named.withColumn("hash", F.sha2(F.to_json(F.struct(*fields)), 256))
        new = named.groupBy("moment_id").agg(F.max("hash").alias("hash"))
        old = self._live("sizes", state).select("moment_id", F.col("hash").alias("old_hash"), F.col("size").alias("old_size"))
        both = new.join(old, "moment_id", "full")
        if gone is not None:
            both = both.join(gone.where("moment_id is not null").select(F.col("moment_id").cast("string").alias("moment_id"), F.lit(True).alias("gone")), "moment_id", "left")
        else:
            both = both.withColumn("gone", F.col("hash").isNull())
        removed = F.coalesce("gone", F.lit(False))
        kind = F.when(removed & F.col("old_hash").isNotNull(), "deleted").when(removed | F.col("hash").isNull(), None)
        kind = kind.when(F.col("old_hash").isNull(), "inserted").when(F.col("old_hash") != F.col("hash"), "updated")
        changes = cut(both.withColumn("kind", kind).where("kind is not null").select("moment_id", "kind", "hash", "old_size"))
        counts = {r.kind: (r.n, r.tokens) for r in changes.groupBy("kind").agg(F.count("*").alias("n"), F.sum("old_size").alias("tokens")).collect()}
        told = {k: counts[k][0] if k in counts else 0 for k in ("inserted", "updated", "deleted")}
        if not counts:
            return told
        made = changes.where("kind <> 'deleted'").select("moment_id", "hash")
        texts = named.join(made, ["moment_id", "hash"], "left_semi").dropDuplicates(["moment_id"])
        tokens = cut(field_tokens(texts))
        postings = tokens.select("moment_id", "field", F.posexplode("tokens").alias("pos", "term")).withColumns({"g": F.lit(g).cast("long"), "bucket": bucket_of(F.col("term"))})
        sized = tokens.groupBy("moment_id").agg(
            F.sum(F.size("tokens")).cast("int").alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("tokens", lambda t: bucket_of(t)))))).alias("buckets")
        )  # five fields of a moment at most
        sizes = made.join(sized, "moment_id").select("moment_id", "hash", "size", "buckets", F.lit(g).cast("long").alias("g"), F.pmod(F.xxhash64("moment_id"), F.lit(PARTS)).cast("int").alias("part"))
        dead = changes.where("kind <> 'inserted'").select("moment_id", F.lit(g).cast("long").alias("g"))
        state["postings"] += self._write("postings", postings)
        fresh = self._write("sizes", sizes)
        state["sizes"] += fresh
        added = self._rows("sizes", {"sizes": fresh}).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if told["updated"] or told["deleted"]:
            state["dead"] += self._write("dead", dead)
        state["rows"] += told["inserted"] - told["deleted"]
        state["tokens"] += added - sum(t or 0 for _, t in counts.values())
        self._publish(state | {"g": g})
        return told

    def fold(self) -> dict[str, list[int]]:
        """Rewrite the buckets and parts that have deltas or dead rows; returns which. At most ``BUCKETS`` and ``PARTS`` numbers come to the driver."""
        state = self.manifest()
        name_of = lambda f: int(f.rsplit("=", 1)[1])
        touched: dict[str, set[int]] = {}
        for name in KEYS:
            keys = [name_of(f) for f in state[name]]
            touched[name] = {k for k in keys if keys.count(k) > 1}
        if state["dead"]:
            gone = self._rows("sizes", state).join(self._rows("dead", state).groupBy("moment_id").agg(F.max("g").alias("until")), "moment_id").where("g < until")
            touched["sizes"] |= {r.part for r in gone.select("part").distinct().collect()}
            touched["postings"] |= {r.b for r in gone.select(F.explode("buckets").alias("b")).distinct().collect()}
        if not any(touched.values()):
            return {k: [] for k in touched}
        after = dict(state, dead=[], g=state["g"] + 1)
        for name, keys in touched.items():
            if keys:
                live = self._live(name, state).where(F.col(KEYS[name]).isin(*sorted(keys)))
                after[name] = [f for f in state[name] if name_of(f) not in keys] + self._write(name, live)
        self._publish(after)
        return {k: sorted(v) for k, v in touched.items()}

"""URL filters as a sort-merge range join.

The host is turned around, label by label, each label followed by a dot. A host rule is
then the interval of all keys that its own key begins, and intervals are nested or
disjoint. Rules and urls are dealt to the same key ranges (a rule to each range that its
interval meets) and sorted; one sweep over a range keeps a stack of the rules that are
active at the current key. Each entry of the stack holds its host's path prefixes in
order, with the next shorter prefix of each, so the longest one that fits is found by a
binary search. Range bounds are drawn from a bounded sample of keys with a hash of the
row, so a host that holds most urls is spread over many ranges.

A url that is null or has no ``://`` has an empty host and path and fits no rule but one
for the empty host. Repeated rows and null ids are judged row by row. Of equal rules the
smallest verdict counts; rules with a null host, path or verdict are ignored. Urls of any
length are judged whole. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that the range bounds are drawn from.
SAMPLE = 50_000
_LAST = "\U0010ffff"

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to / ? or #, in ASCII lower case; then up to ? or #."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class HostRules:
    """The path rules of one host, to be found by the longest prefix."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.verdicts, self.shorter, self.open = key, host, [], [], [], []

    def add(self, path: str, verdict: str) -> None:
        """Paths come in order; of equal ones the first stays."""
        if self.paths and self.paths[-1] == path:
            return
        while self.open and not path.startswith(self.paths[self.open[-1]]):
            self.open.pop()
        self.shorter.append(self.open[-1] if self.open else -1)
        self.open.append(len(self.paths))
        self.paths.append(path)
        self.verdicts.append(verdict)

    def find(self, path: str) -> int:
        n = bisect_right(self.paths, path) - 1
        while n >= 0 and not path.startswith(self.paths[n]):
            n = self.shorter[n]
        return n


class Sweep:
    """The stack of active rules at the current key."""

    def __init__(self):
        self.stack: list[HostRules] = []

    def _to(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self._to(key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(HostRules(key, host))
        self.stack[-1].add(path, verdict)

    def url(self, key: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict of the longest rule that fits; the deeper host on ties."""
        self._to(key)
        best: tuple[int, str | None, str | None] = (-1, None, None)
        for entry in self.stack:
            n = entry.find(path) if entry.host or key == entry.key else -1
            if n >= 0:
                length = len(entry.host) + len(entry.paths[n])
                if length >= best[0]:
                    best = length, entry.host + entry.paths[n], entry.verdicts[n]
        return best[1], best[2]


def judge(pages: DataFrame, rules: DataFrame, carry: list[Column], url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """The ``carry`` columns with host, path, rule and verdict of every row.

    ``rules`` has host, path and verdict; a rule's string is its host and path.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.struct(*carry).alias("carry"), host.alias("host"), path.alias("path"), F.xxhash64(F.monotonically_increasing_id(), F.col(url)).alias("salt")).withColumn("key", reversed_host(F.col("host")))
    share = SAMPLE / max(pages.count(), 1)
    drawn = urls if share >= 1 else urls.where(F.pmod("salt", F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = sorted((r.key, r.salt) for r in drawn.select("key", "salt").toLocalIterator())
    bounds = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []
    given = rules.where("host is not null and path is not null and verdict is not null").distinct()
    given = given.select(F.lit(None).cast(urls.schema["carry"].dataType).alias("carry"), F.translate("host", UPPER, LOWER).alias("host"), "path", F.lit(0).cast("long").alias("salt"), "verdict").withColumn("key", reversed_host(F.col("host")))
    both = given.withColumn("is_url", F.lit(0)).unionByName(urls.withColumns({"verdict": F.lit(None).cast("string"), "is_url": F.lit(1)}))
    shared = spark.sparkContext.broadcast(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at = [], []
            for n, (key, salt, is_url) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "salt", "is_url")), strict=True)):
                first = bisect_right(shared.value, (key, salt)) if is_url else bisect_left(shared.value, (key, -(1 << 63)))
                last = first if is_url else bisect_right(shared.value, (key + _LAST, 0))
                row += [n] * (last - first + 1)
                at += range(first, last + 1)
            taken = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "at"])

    dealt = both.mapInArrow(place, T.StructType([*both.schema.fields, T.StructField("at", T.IntegerType())])).repartitionById(ranges, "at").sortWithinPartitions("key", "is_url", "path", "verdict")
    kind = dealt.select("carry", "host", "path").schema.add("rule", "string").add("verdict", "string")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, last, found = Sweep(), None, (None, None)
        for b in batches:
            rule, verdict = [], []
            for key, host, path, said, is_url in zip(*(b.column(c).to_pylist() for c in ("key", "host", "path", "verdict", "is_url")), strict=True):
                if not is_url:
                    active.rule(key, host, path, said)
                    last = None
                    continue
                if (key, path) != last:
                    last, found = (key, path), active.url(key, path)
                rule.append(found[0])
                verdict.append(found[1] or default)
            urls_only = b.filter(pa.array([bool(x) for x in b.column("is_url").to_pylist()], pa.bool_()))
            yield pa.RecordBatch.from_arrays([urls_only.column("carry"), urls_only.column("host"), urls_only.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=kind.names)

    return dealt.mapInArrow(sweep, kind).select("carry.*", "host", "path", "rule", "verdict")


def judged_pages(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` under the standing rules."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules, [F.col("page_id")])


JUDGED_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u),
p AS (
  SELECT row_number() OVER () AS r, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM h),
k(rule_host, rule_path, said) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT p.r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(said, length(rule_host || rule_path)) AS said
  FROM p JOIN k ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY p.r)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.said, 'allow') AS verdict FROM p LEFT JOIN m ON m.r = p.r
"""

"""Mixing sources to target weights by systematic sampling.

A source's target is its weighted share of the mix, stopped at ``most`` times its size,
the excess going to the others by weight (solved in closed form: sources are capped in
order of size over weight). Every document of a source is expected target / size times.
These expected copies are summed along the source in order of document size, one offset
in [0, 1) drawn from the source's name is added, and a document is taken once for each
integer that the sum crosses in it. The order by size keeps the words taken within about
one largest document of the target.

Sizes are words, of texts of any length. Null and empty texts have size 0. A null source is
a source of its own, after the others. Null ids come first among equal sizes, rows that
share an id and a size in the order of a hash. Repeated rows are sampled one by one. An
empty table gives an empty mix. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlake.llm.ranks import BLOCK, blocked, expanded
from momentlake.plans.lineage import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line breaks, VT and FF; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row for each source.

    With K sources sorted by size over weight, the capped ones are the first; source k is
    capped if its cap is at most its share of what the capped ones before it leave.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    names = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0)).cast("decimal(38,0)")
    step = (
        sizes.withColumn("weight", pick)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("left_weight", F.sum("weight").over(everything) - before("weight"))
        .withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - before("cap").cast("double"))
        .withColumn("capped", F.col("cap") * F.col("left_weight").cast("double") <= F.col("weight") * F.col("left"))
    )
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("left") / F.col("left_weight").cast("double")))).over(everything)["col2"]
    return step.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def _narrow(docs: DataFrame, doc_id: str, text: str, source: str, tell: Column) -> DataFrame:
    """``id, key, source, size, block, hash, rows``: equal rows are one with a count; no texts."""
    part = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), tell.alias("hash"))
    part = part.withColumn("key", _key(F.col("source")))
    return blocked(part.groupBy("key", "source", "size", "id", "hash").agg(F.count("*").alias("rows")), "id")


def _starts(narrow: DataFrame) -> DataFrame:
    """``key, size, id, total, start``: how many rows of the source come before those of an id and size.

    Only counts of cells are summed along a source; a window over single ids sees one block of them.
    """
    cells = narrow.groupBy("key", "size", "block").agg(F.sum("rows").alias("cell"))
    of_size = cells.groupBy("key", "size").agg(F.sum("cell").alias("n"))
    of_size = of_size.select("key", "size", (F.sum("n").over(Window.partitionBy("key").orderBy("size")) - F.col("n")).alias("before"))
    along = F.sum("cell").over(Window.partitionBy("key", "size").orderBy("block")) - F.col("cell")
    begins = cells.select("key", "size", "block", along.alias("within")).join(of_size, ["key", "size"]).select("key", "size", "block", (F.col("before") + F.col("within")).alias("begins"))
    ids = narrow.groupBy("key", "size", "block", "id").agg(F.sum("rows").alias("total"))
    inside = F.sum("total").over(Window.partitionBy("key", "size", "block").orderBy(F.col("id").asc_nulls_first())) - F.col("total")
    return ids.withColumn("inside", inside).join(begins, ["key", "size", "block"]).select("key", "size", "id", "total", (F.col("begins") + F.col("inside")).alias("start"))


def _apart(narrow: DataFrame, starts: DataFrame) -> DataFrame:
    """``narrow`` with ``start`` of each row. Different rows of one id and size come in order of their hash,

    first by the last bits of the hash, so that rows without an id don't meet in one task.
    """
    same = (F.col("o.key") == F.col("n.key")) & (F.col("o.size") == F.col("n.size")) & F.col("o.id").eqNullSafe(F.col("n.id"))
    joined = cut(narrow.alias("n").join(starts.alias("o"), same).select("n.*", "o.total", "o.start"))
    several = joined.where("total > rows").withColumn("bucket", F.pmod("hash", F.lit(BLOCK)))
    own = ["key", "size", "id"]
    buckets = several.groupBy(*own, "bucket").agg(F.sum("rows").alias("cell"))
    buckets = buckets.withColumn("skip", F.sum("cell").over(Window.partitionBy(*own).orderBy("bucket")) - F.col("cell"))
    inside = F.sum("rows").over(Window.partitionBy(*own, "bucket").orderBy("hash")) - F.col("rows")
    same = (F.col("b.key") == F.col("s.key")) & (F.col("b.size") == F.col("s.size")) & F.col("b.id").eqNullSafe(F.col("s.id")) & (F.col("b.bucket") == F.col("s.bucket"))
    dealt = several.withColumn("inside", inside).alias("s").join(buckets.alias("b"), same).withColumn("at", F.col("s.start") + F.col("b.skip") + F.col("s.inside"))
    dealt = dealt.select(*(F.col(f"s.{c}").alias(c) for c in narrow.columns), F.col("at").alias("start"))
    return joined.where("total = rows").select(*narrow.columns, "start").unionByName(dealt)


def _goals(narrow: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str) -> DataFrame:
    """``key, source_size, target, rate, offset`` of each source."""
    totals = narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = targets(totals, weights, share, most).withColumn("key", _key(F.col("source"))).drop("source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("key"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return goal.withColumns({"rate": rate, "offset": offset})


def _copies(after: Column, most: int) -> Column:
    """Whole numbers that the sum crosses in the row that comes after ``after`` others."""
    crossed = lambda rank: F.floor(F.col("rate") * rank + F.col("offset"))
    return F.least(crossed(after + 1) - crossed(after), F.lit(most)).cast("long")


def taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row; taken counts repeats."""
    narrow = _narrow(docs, doc_id, text, source, F.lit(0))
    ranked = _starts(narrow).join(_goals(narrow, weights, share, most, seed), "key")
    each = expanded(ranked, F.col("total"), "nth").withColumnRenamed("id", "doc_id")
    return each.select("doc_id", "size", "source_size", "target", (_copies(F.col("start") + F.col("nth"), most) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it was taken.

    Copies are computed on rows without texts; then each text is shuffled once, to a hash
    join with the rows that are taken. Equal rows are one row until then: the first of
    them is repeated.
    """
    names = [f"__c{k}" for k in range(len(docs.columns))]  # columns of docs may be called like the ones made here
    own = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    at = lambda c: names[docs.columns.index(c)]
    tell = F.xxhash64(*(F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in own.schema))
    narrow = _narrow(own, at(doc_id), at(text), at(source), tell)
    ranked = _apart(narrow, _starts(narrow)).join(_goals(narrow, weights, share, most, seed), "key")
    back = [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]
    pick = ranked.withColumn("copies", _copies(F.col("start"), most)).where("rows > 1 or copies > 0").select("id", "hash", "rows", "copies", "start", "rate", "offset")
    pick = cut(pick)
    keyed = own.withColumns({"hash": tell, "own": F.col(at(doc_id))})
    same = (keyed["hash"] == F.col("p.hash")) & keyed["own"].eqNullSafe(F.col("p.id"))
    single = keyed.join(pick.where("rows = 1").select("id", "hash", "copies").alias("p").hint("shuffle_hash"), same)
    single = single.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*back)
    repeated = pick.where("rows > 1")
    if repeated.isEmpty():
        return single
    again = expanded(repeated, F.col("rows"), "nth").select("id", "hash", _copies(F.col("start") + F.col("nth"), most).alias("copies")).where("copies > 0")
    again = again.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("id", "hash")
    one = keyed.join(repeated.select("id", "hash").alias("p").hint("shuffle_hash"), same, "left_semi").groupBy("own", "hash").agg(F.first(F.struct(*names)).alias("row"))
    again = again.alias("a").join(one, (F.col("a.hash") == one["hash"]) & F.col("a.id").eqNullSafe(one["own"])).select("row.*")
    return single.unionByName(again.select(*back))


TAKEN_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
s AS (SELECT source, k, sum(size) AS source_size FROM d GROUP BY source, k),
w AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
c AS (
  SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER o, 0)::DOUBLE AS left_words
  FROM w
  WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (2 * source_size)::DOUBLE * left_weight::DOUBLE <= weight::DOUBLE * left_words AS capped FROM c),
lev AS (SELECT arg_min(left_words / left_weight::DOUBLE, (2 * source_size)::DOUBLE / weight::DOUBLE) AS level FROM f WHERE NOT capped),
t AS (
  SELECT k, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE weight::DOUBLE * level END AS target,
         ('0x' || substr(md5('mix' || k), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM f LEFT JOIN lev ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.k ORDER BY d.size, d.doc_id NULLS FIRST) AS n
  FROM d JOIN t ON d.k = t.k)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (least(floor(rate * n::DOUBLE + u) - floor(rate * (n - 1)::DOUBLE + u), 2) * size)::BIGINT AS taken
FROM r
"""

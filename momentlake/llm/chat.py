"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation once for each turn it had so far. The turns of every
conversation are numbered and digested, and a rolling hash of each prefix is kept (the
XOR of hashes of place and digest, 128 bits, one ordered window). A conversation whose
whole hash is a proper prefix of a longer one is dropped by an anti-join; of equal
conversations the smallest id stays. Only what stays is rendered.

Turns are ordered by turn, nulls first, then by digest. A null role or text is rendered
as empty but differs from an empty one. Rows without an id form one conversation.
Repeated rows are turns of their own. A conversation must fit one row, as its rendering
does. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.plans.lineage import cut

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"


def _digest():
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    length = F.coalesce(F.length("role").cast("string"), F.lit("-"))
    return F.md5(F.concat(length, F.lit(":"), some("role"), F.when(F.col("text").isNull(), "N").otherwise("T"), some("text")))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that no longer one begins with."""
    part = turns.select("conv_id", "turn", _digest().alias("digest"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = part.withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    rolled = cut(
        numbered.select("conv_id", "at", "n", F.bit_xor(F.xxhash64("at", "digest")).over(sofar).alias("h1"), F.bit_xor(F.xxhash64("digest", "at", F.lit(7))).over(sofar).alias("h2"))
    )
    whole = rolled.where("at = n").groupBy("at", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))  # copies are one row before the join
    begun = rolled.where("at < n").select("at", "h1", "h2").distinct()
    return whole.join(begun, ["at", "h1", "h2"], "left_anti").select("conv_id", F.col("at").cast("long").alias("n_turns"))


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, text`` of every maximal conversation, rendered turn by turn."""
    stay = maximal(turns).withColumnRenamed("conv_id", "kept")
    part = turns.select("conv_id", "turn", _digest().alias("digest"), "role", "text").join(stay, F.col("conv_id").eqNullSafe(F.col("kept")))
    line = lambda t: F.concat(F.lit(HEAD), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(TAIL))
    found = part.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "digest", "role", "text"))).alias("turns"))
    return found.select("conv_id", "n_turns", F.array_join(F.transform("turns", line), "").alias("text"))


FORMATTED_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text,
         md5(coalesce(length(role)::VARCHAR, '-') || ':' || coalesce(role, '') || CASE WHEN text IS NULL THEN 'N' ELSE 'T' END || coalesce(text, '')) AS g
  FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, list(g ORDER BY turn NULLS FIRST, g) AS gs,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, g) AS text
  FROM t GROUP BY conv_id),
m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c l WHERE l.n > c.n AND l.gs[1:c.n] = c.gs)),
k AS (SELECT *, row_number() OVER (PARTITION BY gs ORDER BY conv_id NULLS LAST) AS r FROM m)
SELECT conv_id, n AS n_turns, text FROM k WHERE r = 1
"""

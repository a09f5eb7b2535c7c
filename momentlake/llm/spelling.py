"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters share
it, whatever their order. Words one letter apart have keys one letter value apart (one word
has a letter more) or the difference of two values apart (one letter is exchanged). A word
with each of its letters' values taken off its key finds both: it meets the keys of words
that lack that letter, and the reduced keys of words that have another in its place. One of
two halves of such words is the same, so the half is part of the join key, which keeps words
of the same letters in many orders apart; the order of letters is verified last.

Words are counted over whole texts before any join, partially aggregated, so hot words cost
a row for each task. A form is at least ``times`` as frequent as its variant, so chains of
forms are as long as the logarithm of the counts; they are followed by doubling.

Null texts have no words; a null id is written as '' in the hash that decides on deletions.
Repeated rows count again. Words of any length are kept whole. Words without a near word
have no form and are their own root. An empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.plans.lineage import Scratch, cut

LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: Every so many hashes of an id and a run, a letter is deleted.
NOISE = 199
POWER, PRIME = 5, (1 << 61) - 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: runs of letters (A-Z lower-cased, one letter deleted where the hash says so) of enough letters and occurrences."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{least_letters},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__id"), run.alias("__run"))
    # lower() would also change the capitals beyond ASCII
    low = F.when(F.col("__run").rlike("[À-Þ]"), F.translate("__run", _UPPER, _LOWER)).otherwise(F.lower("__run"))
    hashed = runs.select(low.alias("run"), F.crc32(F.concat("__id", F.lit(":"), low).cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % NOISE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _value(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    power = c
    for _ in range(POWER - 1):
        power = power * c
    return power


def anagram_key(letters: Column) -> Column:
    """The sum of the letters' powers; equal for every order of them."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: (a + _value(c)) % PRIME)


def _keyed(words: DataFrame) -> DataFrame:
    part = words.withColumn("letters", F.split("word", "")).withColumn("size", F.length("word"))
    return part.withColumn("key", anagram_key(F.col("letters")))


def _less(keyed: DataFrame, half: Column, first: Column, last: Column) -> DataFrame:
    """``word, n, size, key, less, side, half`` for each letter's value taken off.

    The letter is at ``half`` or behind it (then the first letters stay: side p) or at ``first``
    or before it (then the last ones from ``last`` on stay: side s), once for each letter and side.
    """
    entry = lambda c, side: F.struct(F.pmod(F.col("key") - _value(c), F.lit(PRIME)).alias("less"), F.lit(side).alias("side"))
    behind = F.transform(F.array_distinct(F.slice("letters", half + 1, F.greatest(F.col("size") - half, F.lit(0)))), lambda c: entry(c, "p"))
    before = F.transform(F.array_distinct(F.slice("letters", F.lit(1), first + 1)), lambda c: entry(c, "s"))
    each = keyed.select("word", "n", "size", "key", F.explode(F.concat(behind, before)).alias("e")).select("word", "n", "size", "key", "e.less", "e.side")
    return each.withColumn("half", F.when(F.col("side") == "p", F.substring("word", F.lit(1), half)).otherwise(F.substring("word", last + 1, F.col("size"))))


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: all pairs of words that one inserted, deleted or replaced letter parts, both ways round."""
    base = cut(_keyed(words))
    half = F.floor(F.col("size") / 2).cast("int")
    exchanged = cut(_less(base, half, half - 1, half))
    short = F.floor((F.col("size") - 1) / 2).cast("int")
    longer = _less(base, short, short, short + 1)
    sides = F.explode(F.array(F.struct(F.lit("p").alias("side"), F.substring("word", F.lit(1), half).alias("half")), F.struct(F.lit("s").alias("side"), F.substring("word", half + 1, F.col("size")).alias("half"))))
    whole = base.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("key").alias("less"), (F.col("size") + 1).alias("size"), sides.alias("e"))
    whole = whole.select("near", "near_n", "less", "size", "e.side", "e.half")

    one = F.levenshtein(F.col("word"), F.col("near"), 1) == 1
    other = exchanged.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("key").alias("other"), "less", "side", "half", "size")
    same = exchanged.join(other, ["less", "side", "half", "size"]).where((F.col("key") != F.col("other")) & one).select("word", "n", "near", "near_n")
    begins = F.substring("word", F.lit(1), short) == F.substring("near", F.lit(1), short)
    more = longer.join(whole, ["less", "side", "half", "size"]).where(((F.col("side") == "p") | ~begins) & one).select("word", "n", "near", "near_n")
    both = more.select(F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("e")).select("e.*")
    return same.select("word", "near", "near_n").unionByName(both)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last form of each chain, found by doubling."""
    scratch = Scratch(forms.sparkSession)
    ends = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ends.join(further, "root", "left_semi").isEmpty():
            ends = cut(ends)
            scratch.drop()
            return ends
        ends = scratch.table(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    words = cut(word_counts(docs))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    known = words.join(best, "word", "left").withColumn("ok", F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False)))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), F.col("best.near")).alias("form"), F.when(F.col("ok"), -F.col("best.less")).alias("form_n"))
    known = cut(known)
    found = known.join(roots(known.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


VARIANTS_SQL = r"""
WITH RECURSIVE step(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run
  FROM documents),
u AS (SELECT id, run, count(*) AS c FROM r GROUP BY id, run),
h AS (
  SELECT run, c, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT),
                                 lambda s, x: xor(s // 256, t[xor(s % 256, x) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM u, tab),
d AS (SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word),
g AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS best FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN best END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n
  FROM w LEFT JOIN g ON w.word = g.word),
chain(word, last, k) AS (
  SELECT word, word, 0 FROM f
  UNION ALL
  SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON chain.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT word, arg_max(last, k) AS root FROM chain GROUP BY word) l ON f.word = l.word
"""

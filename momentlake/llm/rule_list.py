"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditionals.

Statistics of whole texts are DataFrame expressions only; no Python runs on executors. Rules
that reject are learned by sequential covering: a rule grows test by test (information gain)
on two thirds of the labelled rows, is pruned on the others, and the rows it covers are set
aside before the next grows. The list becomes one ordered conditional; a text that no rule
covers is kept.

The labelled rows given to the learner are ``max_labelled`` at most (about, chosen by a hash
of the id; one text for a repeated id), and those whose crc32 of the id leaves 1 modulo 3
are held out to measure the list. Labels that are null or not 0 or 1 are ignored; several
labels of one id are averaged. Without labels of both kinds the list is empty and all that
pass the base are kept.

Null texts count as empty; empty texts have no words and fail the base. Repeated rows are
judged alike, one by one. Texts of any length are read whole: the work for a text of n words
is n log n. An empty table gives no rows; further columns are ignored, or carried along by
`kept_rows`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
LEAST_WORDS, MOST_REPEATED = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules test: shares of a text's words, lines or characters.
FEATURES = ("symbols_a_word", "mean_word", "repeat_words", "dup_lines", "distinct_words", "capitals", "digits", "marks_a_word", "stops_a_word", "words_a_line", "single_words")

_GAP, _SYMBOL = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words in three-word windows that are found twice or more in the list."""
    n = F.size(words)

    def covered(at: Column) -> Column:
        # windows begin at sorted places; each adds the words that the one before it hasn't covered
        new = F.transform(at, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, k - 1))))
        return F.aggregate(new, F.lit(0), lambda a, b: a + b)

    def places(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, k: (x["w"] == F.get(ordered, k - 1)["w"]) | (x["w"] == F.get(ordered, k + 1)["w"]))
        return F.sort_array(F.transform(again, lambda x: x["k"]))

    def counted(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, k: F.struct(w.alias("w"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(_let(ordered, places), covered))

    windows = F.transform(F.slice(words, F.lit(1), n - 2), lambda w, k: F.concat_ws(" ", w, F.get(words, k + 1), F.get(words, k + 2)))
    return F.when(n < 4, 0).otherwise(_let(windows, counted))


def statistics(text: Column) -> Column:
    """A struct of `BASE` and `FEATURES` of a text."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), F.size(F.array_distinct(words)).alias("distinct"),
            F.size(F.filter(words, lambda w: F.length(w) == 1)).alias("single"), _repeated(words).cast("long").alias("n_repeat_words"),
        )

    def whole(w: Column, lines: Column) -> Column:
        n_lines, dup = F.size(lines), F.size(lines) - F.size(F.array_distinct(lines))
        symbols, n, chars = count(_SYMBOL).cast("long"), w["n_words"], w["word_chars"]
        base = (n, chars, symbols, dup.cast("long"), w["n_repeat_words"])
        features = (
            share(symbols, n), share(chars, n), share(w["n_repeat_words"], n), share(dup, n_lines), share(w["distinct"], n), share(count(r"\p{Lu}"), chars), share(count(r"\d"), chars), share(count("[!?]"), n), share(count("[.,;:]"), n),
            share(n, n_lines), share(w["single"], n),
        )
        return F.struct(*(c.alias(x) for c, x in zip((*base, *features), (*BASE, *FEATURES), strict=True)))

    words = F.array_remove(F.split(text, _GAP), "")
    return _let(_let(words, of), lambda w: _let(lines, lambda x: whole(w, x)))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])


@dataclass(frozen=True)
class Test:
    """``feature > threshold`` if above, else ``feature <= threshold``."""

    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.feature] > self.threshold) == self.above

    def column(self, stats: Column) -> Column:
        c = stats[FEATURES[self.feature]]
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([t.holds(x) for t in rule]) if rule else np.ones(len(x), bool)


def _best_test(x: np.ndarray, y: np.ndarray) -> Test | None:
    """The test of greatest information gain; of equal ones that with the widest gap between the values it parts."""
    p0, n0 = float(y.sum()), float(len(y) - y.sum())
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, float] = (1e-9, 0.0)
    found = None
    for k, v in enumerate(x.T):
        order = np.argsort(v, kind="stable")
        v, c = v[order], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        spread = v[-1] - v[0]
        for above in (True, False):
            p = p0 - c[at] if above else c[at].astype(float)
            n = (len(v) - 1 - at if above else at + 1) - p
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / (p + n)) - before), -1)
            gap = (v[at + 1] - v[at]) / spread
            i = np.lexsort((-gap, -np.round(gain, 9)))[0]
            if (round(float(gain[i]), 9), float(gap[i])) > best:
                best = (round(float(gain[i]), 9), float(gap[i]))
                found = Test(k, above, float((v[at[i]] + v[at[i] + 1]) / 2))
    return found


def grow(x: np.ndarray, y: np.ndarray, most_tests: int = 4) -> Rule:
    """Tests are added until only rows of class 1 are covered, or none gains."""
    rule: Rule = ()
    while len(rule) < most_tests and len(y) > y.sum() > 0:
        test = _best_test(x, y)
        if test is None:
            break
        rule = (*rule, test)
        on = test.holds(x)
        x, y = x[on], y[on]
    return rule


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> tuple[Rule, float]:
    """The start of ``rule`` with the best smoothed precision on ``x``, and that precision; of equal ones the longest."""
    worth = []
    for size in range(len(rule), 0, -1):
        on = covers(rule[:size], x)
        p, n = int(y[on].sum()), int(on.sum() - y[on].sum())
        worth.append(((p + 1) / (p + n + 2), size))
    if not worth:
        return (), 0.0
    value, size = max(worth)
    return rule[:size], value


def learn(x: np.ndarray, bad: np.ndarray, held: np.ndarray, most_rules: int = 16) -> list[Rule]:
    """Rules that cover the bad rows, one after another; ``held`` rows prune and don't grow.

    A rule that isn't mostly right on the rows kept for pruning ends the list.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        growing = left & ~held
        rule, worth = prune(grow(x[growing], bad[growing]), x[left & held], bad[left & held])
        if not rule or worth < 0.5:
            break
        on = left & covers(rule, x)
        if 2 * bad[on].sum() <= on.sum():
            break
        rules.append(rule)
        left &= ~on
    return rules


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The rules that reject what ``label`` marks 0, from rows that pass the base and aren't held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~_held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg((F.avg(label) < 0.5).alias("__bad"))
    share = max_labelled / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    rows = rows.select("__id", "__bad", statistics(F.col("__text")).alias("s"))
    # of a repeated id one text is learned from, so the driver gets a row for each label at most; whether it
    # passes the base is asked last: a filter here would be moved below the join and count in all texts
    rows = rows.groupBy("__id", "__bad").agg(F.min(F.struct(base_failed(F.col("s")).alias("failed"), *(F.col(f"s.{f}").alias(f) for f in FEATURES))).alias("f"))
    got = [r for r in rows.select("f.failed", "__bad", (F.pmod(F.xxhash64("__id"), F.lit(3)) == 0).alias("held"), *(f"f.{f}" for f in FEATURES)).collect() if not r[0]]
    x = np.array([tuple(r)[3:] for r in got], np.float64).reshape(-1, len(FEATURES))
    bad, held = np.array([r[1] for r in got], bool), np.array([r[2] for r in got], bool)
    order = np.lexsort((*x.T, held, bad))  # the list doesn't depend on how rows came in
    return learn(x[order], bad[order], held[order])


def first_rule(rules: list[Rule], stats: Column) -> Column:
    """The first rule that covers a text, as text; null if none does."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        on = rule[0].column(stats)
        for test in rule[1:]:
            on = on & test.column(stats)
        found = F.when(on, " and ".join(map(str, rule))).otherwise(found)
    return found


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``kept`` and ``rule`` (the one that rejects) of every row."""
    got = docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s", base_failed(F.col("s")).alias("base_failed"), first_rule(rules, F.col("s")).alias("rule"))
    return got.select("doc_id", *(F.col(f"s.{b}").alias(b) for b in BASE), "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def filtered(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """`judged` by the rules that the labels teach."""
    return judged(docs, train(docs, labels, max_labelled=max_labelled))


def kept_rows(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base and that no rule rejects, with their columns."""
    names = [f"__c{k}" for k in range(len(docs.columns))]  # columns of docs may be called like the one made here
    own = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    got = own.withColumn("__s", statistics(F.col(names[docs.columns.index(text)])))
    got = got.where(~base_failed(F.col("__s")) & first_rule(rules, F.col("__s")).isNull())
    return got.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


#: The base columns; the learned part has no SQL.
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS k, w FROM w),
t AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM g),
a AS (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM t),
c AS (SELECT r, count(DISTINCT k + i) AS n FROM a, range(3) o(i) WHERE n > 1 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN c USING (r)
"""

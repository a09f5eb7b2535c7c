"""Source divergence audit: how the words of each source differ from its language's and from other sources'.

Terms are found in bytes: a lookup table over concatenated UTF-8 buffers lower-cases A-Z and
marks what is no letter, so boundaries are where marks change. Slices are grouped by their
xxHash, every slice is compared with the first of its group byte by byte, and slices that
differ (a collision) are grouped by their bytes. What leaves a task is counts of terms.

A language keeps the terms of at least ``least`` of its rows. Kept counts are dealt by a hash
of the term into blocks of about ``BLOCK_ROWS`` counts; each block is a sparse matrix of
sources by terms (CSR), and sums over its rows (``reduceat``) give each pair's share of the
divergence. All arithmetic is on integers, so sums don't depend on how terms were dealt.

Null texts, languages and sources count as ''. Every row is a document, repeated rows and
rows without an id too. Texts of any length are read whole, in pieces cut between terms. An
empty table gives no rows; further columns are ignored, whatever their names. Results have
a row for each pair of sources of a language, so they grow with the square of the number of
sources (not of documents).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.plans.lineage import cut

LEAST, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes that are looked up at a time, and counts in a block.
PIECE, BLOCK_ROWS = 1 << 22, 1 << 16

#: Lower-cased byte of each byte that belongs to a term, else 0.
TABLE = np.zeros(256, np.uint8)
TABLE[65:91] = TABLE[97:123] = np.arange(97, 123)
TABLE[128:] = np.arange(128, 256)


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``lowered, start, end, text`` of the terms of the texts that ``offsets`` bound in ``data``."""
    low = TABLE[data]
    word = low != 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]  # texts follow each other without a gap
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return low, start, end, np.searchsorted(offsets, start, side="right") - 1


def grouped(low: np.ndarray, start: np.ndarray, end: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """``code`` of each slice and the slice that is first of each code: equal codes, equal bytes."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = low.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    size = end - start
    at = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(at, size)
    other = first[code]
    # reading past a shorter first slice is harmless: lengths are compared as well
    there = np.minimum(np.repeat(start[other], size) + step, len(low) - 1)
    wrong = (np.add.reduceat((low[np.repeat(start, size) + step] != low[there]).astype(np.int64), at) > 0) | (size != size[other])
    if wrong.any():
        known: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(wrong).tolist():
            term = raw[start[i] : end[i]]
            if term not in known:
                known[term] = len(first) + len(more)
                more.append(i)
            code[i] = known[term]
        first = np.concatenate([first, np.array(more, np.int64)])
    return code, first


def _strings(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(low[at]))


def _counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """``group, term, occurrences, documents`` of texts that belong to groups."""
    low, start, end, text = slices(data, offsets)
    code, first = grouped(low, start, end)
    if not len(code):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(first)
    pair, times = np.unique(text * n + code, return_counts=True)
    key = group[pair // n] * n + pair % n
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    docs = np.diff(np.append(at, len(key)))
    used = first[key[at] % n]
    return key[at] // n, _strings(low, start[used], end[used]), np.add.reduceat(times, at), docs


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """``data`` cut between terms into pieces of about PIECE bytes."""
    at = 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data):
            gap = np.flatnonzero(TABLE[data[to : to + PIECE]] == 0)
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + PIECE, len(data))
        yield data[at:to]
        at = to


def _long_text(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms and occurrences of one text, looked at piece by piece."""
    total: Counter = Counter()
    for part in _pieces(data):
        _, terms, times, _ = _counts(part, np.array([0, len(part)]), np.zeros(1, np.int64))
        total.update(dict(zip(terms.cast(pa.binary()).to_pylist(), times.tolist(), strict=True)))
    raw = np.frombuffer(b"".join(total), np.uint8)
    end = np.cumsum(np.fromiter(map(len, total), np.int64, len(total)))
    return _strings(raw, np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end, end), np.fromiter(total.values(), np.int64, len(total))


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of batches of ``lang, source, text``; a row without a term tells that a group occurs."""
    names = ["lang", "source", "term", "n", "docs"]
    for b in batches:
        known: dict[tuple[str, str], int] = {}
        group = np.array([known.setdefault(k, len(known)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64)
        langs, sources = (pa.array([k[i] for k in known], pa.string()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(known), pa.string()), pa.array(np.zeros(len(known), np.int64)), pa.array(np.bincount(group, minlength=len(known)).astype(np.int64))], names=names)
        text = pc.fill_null(b.column(2), "")
        if not b.num_rows or text.buffers()[2] is None:
            continue
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8)
        at = 0
        while at < len(text):
            to = max(int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1, at + 1)
            part = data[offsets[at] : offsets[to]]
            if to == at + 1 and len(part) > PIECE:
                terms, times = _long_text(part)
                g, docs = np.repeat(group[at], len(times)), np.ones(len(times), np.int64)
            else:
                g, terms, times, docs = _counts(part, offsets[at : to + 1] - offsets[at], group[at:to])
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(g)), sources.take(pa.array(g)), terms, pa.array(times.astype(np.int64)), pa.array(docs.astype(np.int64))], names=names)
            at = to


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, source, term, n, first`` of the terms that a language keeps; each group also has a row without a term.

    ``first`` marks one row of each kept term of a language.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    part = docs.select(some("lang"), some("source"), "text").mapInArrow(_tokenized, "lang string, source string, term string, n long, docs long")
    each = part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    told = each.withColumns({"in_lang": F.sum("docs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return told.where((F.col("in_lang") >= least) | F.col("term").isNull()).select("lang", "source", "term", "n", (F.col("first") & F.col("term").isNotNull()).alias("first"))


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """``1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms))``, exact while the denominator is under 9 * 10**15: three digits at a time."""
    below = total + SMOOTH * terms
    rest, found = count + SMOOTH, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        found = found * 1000 + more
    return 1 + found


def _block(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Of the terms of one block: each pair's share of the divergence, and each group's leading terms."""
    names = np.array(groups["source"].to_pylist(), object)
    order = np.argsort(np.array([x.encode() for x in names], object), kind="stable")
    names, total = names[order], groups["n"].to_numpy()[order]
    lang, terms, whole = groups["lang"][0].as_py(), groups["terms"][0].as_py(), groups["lang_n"][0].as_py()
    row_of = {x: k for k, x in enumerate(names)}
    row = np.array([row_of[x] for x in counts["source"].to_pylist()], np.int64)
    words = np.array([x.encode() for x in counts["term"].to_pylist()], object)
    n = counts["n"].to_numpy()
    kept, col = np.unique(words, return_inverse=True) if len(words) else (words, np.zeros(0, np.int64))
    order = np.lexsort((col, row))
    row, col, n = row[order], col[order], n[order]
    base = share(np.zeros(len(names), np.int64), total, terms) if terms else np.zeros(len(names), np.int64)
    out: list[tuple[str, str, str, int]] = []
    if len(n):
        p = share(n, total[row], terms)
        ptr = np.searchsorted(row, np.arange(len(names) + 1))
        full = np.flatnonzero(np.diff(ptr))
        by_col = np.argsort(col, kind="stable")
        q = share(np.add.reduceat(n[by_col], np.searchsorted(col[by_col], np.arange(len(kept)))), np.int64(whole), terms)
        over = np.flatnonzero(p > q[col])
        over = over[np.lexsort((col[over], q[col[over]] - p[over], row[over]))]
        place = np.arange(len(over)) - np.searchsorted(row[over], row[over])
        out += [(names[row[i]], "term", kept[col[i]].decode(errors="replace"), int(p[i] - q[col[i]])) for i in over[place < TOP]]
    for g in range(len(names)):
        value = np.zeros(len(names), np.int64)
        if len(n):
            own = slice(ptr[g], ptr[g + 1])
            here = np.full(len(kept), base[g])
            here[col[own]] = p[own]
            sums = np.concatenate([[0], np.cumsum(np.sort(p[own]))])
            under = np.searchsorted(np.sort(p[own]), base)
            size = len(sums) - 1
            # as if the others had no term here, then what their terms change
            value += (len(kept) - size) * np.abs(base - base[g]) + base * under - sums[under] + (sums[-1] - sums[under]) - base * (size - under)
            value[full] += np.add.reduceat(np.abs(p - here[col]) - np.abs(base[row] - here[col]), ptr[full])
        out += [(names[g], "pair", names[h], int(value[h])) for h in range(len(names)) if h != g]
    source, part, item, value = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, least: int = LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence to each other source (part pair) and the terms that a source has more of than its language (part term, ranks to TOP)."""
    counts = cut(term_counts(docs, least))
    blocks = counts.count() // block_rows + 1
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("firsts"))
    lang = Window.partitionBy("lang")
    groups = own.select("lang", "source", "n", F.sum("firsts").over(lang).alias("terms"), F.sum("n").over(lang).alias("lang_n"))
    groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = counts.where("term is not null").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    parts = dealt.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInArrow(_block, "lang string, source string, part string, item string, value long")
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc())
    return whole.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP))


AUDIT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY lang, source, term),
k AS (SELECT lang, term FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, v.v
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM x),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(f.value), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT s.lang, s.source, t.source AS other, sum(abs(s.p - t.p)) AS value
    FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term GROUP BY s.lang, s.source, t.source) f
  ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT * FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

"""SimHash near-duplicates.

A document's fingerprint has a bit set where over half of its shingle hashes have it.
Links are pairs of fingerprints within a Hamming radius. Equal fingerprints collapse
first, so a group of copies is one row from there on. Rows that can be close meet in
buckets: either keys that every pair within the radius must share at least once (exact),
or keys of randomly drawn bits with a stated miss rate. Inside a bucket the comparison is
bit-sliced (`bitslice`); it gives back a spanning forest and not all pairs. A bucket that
holds more than ``CHUNK`` rows is cut into chunks whose pairs go to separate tasks, so
nothing is capped and no task holds more than two chunks.

Null and empty texts have fingerprint zero and are linked like any other. Null ids are
carried along. Repeated rows are equal fingerprints. Texts of any length are read whole. An
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from momentlake.operators.components import connected_components
from momentlake.plans.lineage import Scratch, cut, join_groups

SEED = 42
#: Rows of a bucket that one task compares with each other.
CHUNK = 4096
#: Crowded keys that are broadcast; beyond it the join shuffles.
MOST_BROADCAST = 100_000
#: Texts, about, in which common shingles are counted, and how many such shingles are sent to all tasks.
SAMPLED, MOST_COMMON = 5000, 200_000
#: Rows and shingles of a family that one task compares with each other.
FAMILY_ROWS, FAMILY_SHINGLES = 2048, 1 << 20
#: Texts of up to so many shingles are short.
SHORT = 48
#: Rows collected before a comparison starts.
BATCH = 1 << 16

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: bytes | None, words: int) -> list[bytes]:
    """Space-joined runs of ``words`` words; the whole sequence where there are fewer."""
    w = (text or b"").lower().split()  # for bytes: A-Z, and white space 0x20, 0x09-0x0D
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[k:] for k in range(words)), strict=False)]


def fingerprint(parts: list[bytes], bits: int) -> bytes:
    """Little-endian fingerprint of 64 (XXH64) or 128 (XXH3) bits; zero for no parts."""
    if not parts:
        return bytes(bits // 8)
    return _majority(_hashes(parts, bits))


def _hashes(parts: list[bytes], bits: int) -> np.ndarray:
    """A row of bytes for each shingle."""
    if bits == 64:
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts)).view(np.uint8)
    else:
        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, SEED) for x in parts]), np.uint8)
    return h.reshape(-1, bits // 8)


def _majority(h: np.ndarray) -> bytes:
    width = h.shape[1]
    cells = (h + np.arange(width, dtype=np.intp) * 256).ravel()
    ones = np.bincount(cells, minlength=width * 256).reshape(width, 256) @ _BYTE_BITS
    return np.packbits((2 * ones > len(h)).ravel(), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, carry: list[Column], text: str = "text", words: int = 3, bits: int = 64, distinct: bool = False) -> DataFrame:
    """The ``carry`` columns with fp0 (and fp1): the fingerprint in signed 64-bit words.

    ``distinct`` counts a repeated shingle once.
    """
    part = docs.select(*carry, F.col(text).alias("__text"))
    names = [f"fp{k}" for k in range(bits // 64)]
    schema = part.drop("__text").schema
    for n in names:
        schema = schema.add(n, "long", False)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            made = []
            for t in texts:
                s = shingles(t, words)
                made.append(fingerprint(list(set(s)) if distinct else s, bits))
            got = np.frombuffer(b"".join(made), np.int64).reshape(len(made), -1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(got[:, k]) for k in range(len(names)))], names=[*b.schema.names[:-1], *names])

    return part.mapInArrow(prints, schema)


def exact_keys(fp: Column, radius: int) -> Column:
    """Keys of a 64-bit print: any two prints within ``radius`` bits share at least one.

    The print is cut into radius + 2 blocks; at least two blocks of such a pair agree.
    """
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    cut_out = [F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(blocks)]
    return F.array(*(F.xxhash64(F.lit(f"{i},{j}"), cut_out[i], cut_out[j]) for i, j in combinations(range(blocks), 2)))


def sampled_keys(prints: DataFrame, bits: int, tables: int, key_bits: int) -> DataFrame:
    """One row (key, fp0, fp1..) for each print and table; a key is ``key_bits`` drawn bits.

    Two prints that differ in d of ``bits`` bits miss each other in all tables with a
    probability near (1 - (1 - d / bits) ** key_bits) ** tables.
    """
    draw = np.random.default_rng(SEED)
    places = np.stack([draw.choice(bits, key_bits, replace=False) for _ in range(tables)])
    names = prints.columns

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                fp = np.stack([np.asarray(c).astype(np.int64) for c in b.columns], axis=1)
                on = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").astype(np.int64)
                keys = np.stack([on[:, p] @ (1 << np.arange(key_bits)) + (t << key_bits) for t, p in enumerate(places)], axis=1)
                rows = np.repeat(fp, tables, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(names)))], names=["key", *names])

    return prints.mapInArrow(spread, "key long, " + ", ".join(f"{n} long" for n in names))


def links_in_buckets(rows: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Spanning links ``a, b, d`` of prints that share a key and differ in ``radius`` bits at most.

    ``rows``: key and the print's words fp0.. ; a and b are structs of those words.
    """
    names = [c for c in rows.columns if c != "key"]
    crowded = cut(rows.groupBy("key").count().where(F.col("count") > chunk))
    hot = crowded.count()
    if hot:  # at most one key in ``chunk`` rows
        side = F.broadcast(crowded) if hot <= MOST_BROADCAST else crowded
        chunks = F.coalesce(F.ceil(F.col("count") / F.lit(chunk)), F.lit(1)).cast("int")
        dealt = (
            rows.join(side, "key", "left")
            .withColumn("chunks", chunks)
            .withColumn("side", F.pmod(F.xxhash64(*names), F.col("chunks")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("key", F.least("side", "with").alias("lo"), F.greatest("side", "with").alias("hi"), "side", *names)
        )
    else:
        dealt = rows.select("key", *(F.lit(0).alias(c) for c in ("lo", "hi", "side")), *names)
    dealt = dealt.repartition(F.col("key"), F.col("lo"), F.col("hi")).sortWithinPartitions("key", "lo", "hi", *names)
    struct = "struct<" + ", ".join(f"{n}: bigint" for n in names) + ">"
    kind = pa.struct([(n, pa.int64()) for n in names])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from momentlake.llm.bitslice import forest_within

        def result(x: np.ndarray) -> pa.RecordBatch:
            head, fp = x[:, :3], np.ascontiguousarray(x[:, 4:]).view(np.uint64)
            group = np.cumsum(np.r_[False, (head[1:] != head[:-1]).any(axis=1)])
            i, j, d = forest_within(fp, group, x[:, 3], x[:, 1] != x[:, 2], radius)
            ends = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[at, 4 + k])) for k in range(len(names))], fields=list(kind)) for at in (i, j)]
            return pa.RecordBatch.from_arrays([*ends, pa.array(d.astype(np.int32))], names=["a", "b", "d"])

        left = np.empty((0, 4 + len(names)), np.int64)
        for b in batches:
            left = np.concatenate([left, np.stack([np.asarray(c).astype(np.int64) for c in b.columns], axis=1)]) if b.num_rows else left
            if len(left) < BATCH:
                continue
            change = np.flatnonzero((left[1:, :3] != left[:-1, :3]).any(axis=1))
            if len(change):
                yield result(left[: change[-1] + 1])
                left = left[change[-1] + 1 :]
        if len(left):
            yield result(left)

    return dealt.mapInArrow(compare, f"a {struct}, b {struct}, d int")


def fingerprint_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: 64-bit prints linked within ``radius``.

    The search is exact. component_id is the smallest id whose print can be reached; null
    only where all ids reached are null.
    """
    prints = cut(fingerprints(docs, [F.col(doc_id).alias("doc_id")], text, words))
    first = prints.groupBy("fp0").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    rows = first.select(F.explode(exact_keys(F.col("fp0"), radius)).alias("key"), "fp0")
    found = links_in_buckets(rows, radius).select(F.col("a.fp0").alias("a"), F.col("b.fp0").alias("b"))
    groups = connected_components(found)
    of = first.join(groups.withColumnRenamed("node", "fp0"), "fp0", "left").withColumn("component", F.coalesce("component", "fp0"))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("prints"))
    named = join_groups(of, least, "component", "prints").select("fp0", "rows", "component_id")
    return join_groups(prints, named, "fp0", "rows").select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


#: For near_duplicates: at the similarity s asked for a pair differs in acos(2 s / (1 + s)) / pi of
#: the bits on average, so wide prints keep the spread around that small.
WIDE_BITS, TABLES, KEY_BITS = 128, 48, 12
#: One in so many of the links that the tables propose is contracted before the others.
TABLES_FIRST = 8


def radius_for(similarity: float, bits: int = WIDE_BITS, spreads: float = 3.0) -> int:
    """Bits within which a pair of this Jaccard similarity falls but for ``spreads`` deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(bits * p + spreads * (bits * p * (1 - p)) ** 0.5))


def _shingle_sets(part: DataFrame, words: int) -> DataFrame:
    """fp0, fp1 and the sorted hashes of the distinct shingles of each row's text, where the print agrees."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for n, (t, f0, f1) in enumerate(zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                s = list(set(shingles(t, words)))
                if np.frombuffer(fingerprint(s, WIDE_BITS), np.int64).tolist() == [f0, f1]:
                    keep.append(n)
                    out.append(np.sort(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in s), np.uint64, len(s)).view(np.int64)))
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep)), b.column(2).take(pa.array(keep)), pa.array(out, pa.list_(pa.int64()))], names=["fp0", "fp1", "parts"])

    return part.select("text", "fp0", "fp1").mapInArrow(sets, "fp0 long, fp1 long, parts array<long>")


def table_shape(prints: int) -> tuple[int, int]:
    """Bits of a key and number of tables for so many prints.

    A bit more for each doubling beyond 2 ** 18 prints keeps buckets of one size; 1.18 times
    the tables for each bit keep the rate of pairs that share none.
    """
    more = max(0, (max(prints, 1) - 1).bit_length() - 18)
    return KEY_BITS + more, int(np.ceil(TABLES * 1.18**more))


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that a sample of the texts repeats, and in how many of its texts.

    They only set the order of shingles in `_prefixed`; any order gives the same pairs.
    """
    share = max(1, rows.count() // SAMPLED)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                s = list(set(shingles(t, words)))
                if s:
                    yield pa.RecordBatch.from_arrays([pa.array(_hashes(s, WIDE_BITS).view(np.int64)[:, 0])], names=["key"])

    some = rows.select("text", "__hash").distinct().where(F.pmod("__hash", F.lit(share)) == 0).select("text").mapInArrow(spread, "key long")
    top = some.groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(MOST_COMMON).toArrow()
    key, count = np.asarray(top["key"]), np.asarray(top["count"])
    order = np.argsort(key)
    return key[order], count[order]


def _prefixed(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Each row's __id, __hash, print, number of distinct shingles, and, of a short text, the prefix of their hashes.

    Shingles are put in one order for all texts, common ones last. Two texts of the
    similarity share a shingle among the first n - ceil(similarity * n) + 1 of each. Texts
    that can't be similar to one of ``SHORT`` shingles or fewer have no prefix.
    """
    known = rows.sparkSession.sparkContext.broadcast(_common(rows, words))
    part = rows.select("__id", "__hash", "text")
    schema = part.drop("text").schema.add("fp0", "long", False).add("fp1", "long", False).add("size", "integer", False).add("prefix", ArrayType(LongType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = known.value
        for b in batches:
            prints, sizes, firsts = [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                s = list(set(shingles(t, words)))
                if not s:
                    prints.append(bytes(WIDE_BITS // 8))
                    sizes.append(0)
                    firsts.append(np.empty(0, np.int64))
                    continue
                h = _hashes(s, WIDE_BITS)
                key = h.view(np.int64)[:, 0]
                prints.append(_majority(h))
                sizes.append(len(s))
                if similarity * len(s) > SHORT:
                    firsts.append(np.empty(0, np.int64))
                    continue
                often = np.zeros(len(key), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                    often = np.where(common[at] == key, count[at], 0)
                take = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
                firsts.append(key[np.lexsort((key, often))[:take]])
            fp = np.frombuffer(b"".join(prints), np.int64).reshape(len(prints), -1)
            made = [pa.array(np.ascontiguousarray(fp[:, k])) for k in range(2)] + [pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *made], names=[*b.schema.names[:2], "fp0", "fp1", "size", "prefix"])

    return part.mapInArrow(run, schema)


def _between(prints: DataFrame, groups: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs a, b of short texts' prints of different groups that can reach the similarity: none is left out.

    ``prints`` as `_prefixed` makes them; ``groups`` has node and component of the prints
    that are linked already. Only keys that groups share are joined. From the first shared
    key on no more can be shared than the shorter rest, so others of the pair may be passed over.
    """
    ends = lambda *names: [f(n).alias(f"{n}_{f.__name__}") for n in names for f in (F.min, F.max)]
    differ = lambda x, y: f"{x}_min <> {x}_max or {y}_min <> {y}_max"
    index = prints.where(F.size("prefix") > 0).select("fp0", "fp1", "size", F.posexplode("prefix").alias("at", "key"))
    several = scratch.table(index.groupBy("key").agg(*ends("fp0", "fp1")).where(differ("fp0", "fp1")).select("key"))
    of = groups.select(F.col("node.fp0").alias("fp0"), F.col("node.fp1").alias("fp1"), F.col("component.fp0").alias("c0"), F.col("component.fp1").alias("c1"))
    shared = index.join(several, "key").distinct().join(of, ["fp0", "fp1"], "left").withColumns({"c0": F.coalesce("c0", "fp0"), "c1": F.when(F.col("c0").isNull(), F.col("fp1")).otherwise(F.col("c1"))})
    shared = scratch.table(shared)
    crossing = shared.groupBy("key").agg(*ends("c0", "c1")).where(differ("c0", "c1")).select("key")
    live = scratch.table(shared.join(crossing, "key"))
    side = lambda x: live.select("key", F.struct("fp0", "fp1").alias(x), F.struct("c0", "c1").alias(f"c{x}"), F.col("size").alias(f"n{x}"), F.col("at").alias(f"at{x}"))
    size = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-6
    rest = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-6
    apart = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") <= SHORT)
    return side("a").join(side("b"), "key").where(apart & size & rest).select("a", "b").distinct()


def _verified(sets: DataFrame, radius: int, similarity: float, rows_of_chunk: int = FAMILY_ROWS, shingles_of_chunk: int = FAMILY_SHINGLES) -> DataFrame:
    """A spanning forest ``a, b`` of the links within each family: every pair within the radius is checked exactly.

    ``sets``: c0, c1 (the family), fp0, fp1, parts (sorted shingle hashes). A large family is
    cut into chunks, whose pairs go to separate tasks. Pairs are checked where the sets are
    and never leave a task; those whose ends are joined already are passed over.
    """
    sizes = sets.groupBy("c0", "c1").agg(F.greatest(F.ceil(F.count("*") / rows_of_chunk), F.ceil(F.sum(F.size("parts")) / shingles_of_chunk)).cast("int").alias("chunks"))
    dealt = (
        sets.join(sizes, ["c0", "c1"])
        .withColumn("side", F.pmod(F.xxhash64("fp0", "fp1"), F.col("chunks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("c0", "c1", F.least("side", "with").alias("lo"), F.greatest("side", "with").alias("hi"), "side", "fp0", "fp1", "parts")
    )
    dealt = dealt.repartition(F.col("c0"), F.col("c1"), F.col("lo"), F.col("hi")).sortWithinPartitions("c0", "c1", "lo", "hi", "fp0", "fp1")
    kind = pa.struct([("fp0", pa.int64()), ("fp1", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from momentlake.llm.bitslice import similar_forest

        def result(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            fp = np.stack([np.asarray(t["fp0"]), np.asarray(t["fp1"])], axis=1)
            parts = t["parts"].chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64()))
            cross = t["lo"][0] != t["hi"][0]
            i, j = similar_forest(fp.view(np.uint64), np.asarray(parts.value_lengths()).astype(np.int64), np.asarray(parts.flatten()), np.asarray(t["side"]), cross, radius, similarity)
            ends = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(fp[at, k])) for k in range(2)], fields=list(kind)) for at in (i, j)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            head = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in range(4)], axis=1)
            starts = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            if held and [x[-1].as_py() for x in held[-1].columns[:4]] != head[0].tolist():
                yield result(held)
                held = []
            for at, end in zip(starts, starts[1:], strict=False):
                held.append(b.slice(at, end - at))
                if end < b.num_rows:
                    if len(held) > 1 or held[0].num_rows > 1:
                        yield result(held)
                    held = []
        if held:
            yield result(held)

    struct = "struct<fp0: bigint, fp1: bigint>"
    return dealt.mapInArrow(compare, f"a {struct}, b {struct}")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, tables: int | None = None, key_bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one of the smallest id stays.

    Texts are near copies where the Jaccard similarity of their distinct word shingles is
    ``similarity`` or more. Buckets of 128-bit prints, compared bit by bit, hand on forests
    of the pairs within `radius_for`; what they join is a family. In a family every pair
    within the radius is then checked exactly on the whole texts (`_verified`), so no link
    is lost behind another that fails. Prints of short texts vary more: their pairs are
    proposed by prefixes of the shingles, without exception (`_between`), and checked, too.
    Equal prints count as copies. Keys and tables grow with the number of prints
    (`table_shape`) unless given. Null and empty texts are copies of each other. Of equal
    rows one stays; null ids sort last. An empty table gives an empty one. Columns are those
    of ``docs``.
    """
    names = [f"__c{k}" for k in range(len(docs.columns))]  # columns of docs may be called like the ones made here
    own = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    body = F.col(names[docs.columns.index(text)])
    scratch = Scratch(docs.sparkSession)
    rows = own.withColumns({"__id": F.col(names[docs.columns.index(doc_id)]), "__hash": F.xxhash64(F.coalesce(body, F.lit("")))})
    bare = rows.select("__id", "__hash", body.alias("text"))
    prints = scratch.table(_prefixed(bare, words, similarity))
    fp = F.struct("fp0", "fp1")
    per_row = prints.groupBy("fp0", "fp1", "__id", "__hash").count()
    best = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__hash").alias("h"), F.col("count").alias("c"))).alias("best")
    nodes = cut(per_row.groupBy("fp0", "fp1").agg(best))

    radius, shape = radius_for(similarity), table_shape(nodes.count())
    proposed = links_in_buckets(sampled_keys(nodes.select("fp0", "fp1"), WIDE_BITS, tables or shape[1], key_bits or shape[0]), radius)
    families = connected_components(proposed.select("a", "b"), share=TABLES_FIRST)  # a family is linked in most tables

    def sets_of(members: DataFrame) -> DataFrame:
        wanted = members.join(nodes, ["fp0", "fp1"]).select("fp0", "fp1", F.col("best.i").alias("id"), F.col("best.h").alias("h"))
        texts = bare.join(wanted, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("h"))).select("text", "fp0", "fp1")
        return _shingle_sets(texts, words).groupBy("fp0", "fp1").agg(F.max("parts").alias("parts"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = np.asarray(x.values), np.asarray(y.values)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(both >= similarity * (len(u) + len(v) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    def sure(proposed: DataFrame) -> DataFrame:
        sets = sets_of(proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node.*")).select(fp.alias("node"), "parts")
        pairs = proposed.join(sets.select(F.col("node").alias("a"), F.col("parts").alias("pa")), "a").join(sets.select(F.col("node").alias("b"), F.col("parts").alias("pb")), "b")
        kind = proposed.schema["a"].dataType.simpleString()
        return pairs.select("a", "b", "pa", "pb").mapInArrow(checked, f"a {kind}, b {kind}")

    member = families.select("node.fp0", "node.fp1", F.col("component.fp0").alias("c0"), F.col("component.fp1").alias("c1"))
    whole = scratch.table(sets_of(member.select("fp0", "fp1")).join(member, ["fp0", "fp1"]))
    links = cut(_verified(whole, radius, similarity))
    groups = connected_components(links)
    between = cut(_between(prints, groups, similarity, scratch))
    if not between.isEmpty():
        groups = connected_components(links.union(sure(between)))
    scratch.drop()
    of = nodes.select(fp.alias("node"), "best").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keep = of.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.i").alias("__keep"), F.col("best.h").alias("__text"), F.col("best.c").alias("__rows"))
    stay = rows.join(keep, F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__hash") == F.col("__text")))
    repeated = stay.where("__rows > 1").dropDuplicates(["__keep", "__text"])
    back = [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]
    return stay.where("__rows = 1").select(*back).union(repeated.select(*back))

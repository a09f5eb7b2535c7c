import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from momentlake.llm import bitslice, simhash


def brute_print(text, words):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_matches_brute_force_with_edge_cases(docs):
    rows = docs.select("doc_id", "text").collect()
    got = simhash.fingerprint_components(docs).collect()
    prints = [brute_print(r.text, 3) for r in rows]
    roots = brute_components(prints, 2)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min((x for x in (least.get(root), r.doc_id) if x is not None), default=None)
    want = sorted(((r.doc_id, format(p, "016x"), least[root]) for r, p, root in zip(rows, prints, roots)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_empty_table(empty_docs):
    assert simhash.fingerprint_components(empty_docs).collect() == []
    assert simhash.near_duplicates(empty_docs).collect() == []


def test_crowded_buckets_are_cut_without_loss(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, dtype=np.int64)
    prints = sorted({int(base) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (200, 2))})
    rows = spark.createDataFrame([(p,) for p in prints], "fp0 long").select(F.explode(simhash.exact_keys(F.col("fp0"), 2)).alias("key"), "fp0")
    found = simhash.links_in_buckets(rows, 2, chunk=8).collect()
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        assert (r.a.fp0 ^ r.b.fp0).bit_count() == r.d <= 2
        parent[find(r.a.fp0)] = find(r.b.fp0)
    want = brute_components(prints, 2)
    groups = {}
    for p, w in zip(prints, want):
        groups.setdefault(w, set()).add(find(p))
    assert all(len(g) == 1 for g in groups.values()) and len({find(p) for p in prints}) == len(set(want))


def test_bit_sliced_distances_match_popcounts():
    rng = np.random.default_rng(1)
    for width, radius in ((1, 2), (1, 20), (2, 31)):
        prints = rng.integers(0, 2**63, (300, width), dtype=np.uint64)
        prints[150:] = prints[:150] ^ (np.uint64(1) << rng.integers(0, 63, (150, width), dtype=np.uint64))
        group = np.sort(rng.integers(0, 4, 300))
        prints = prints[rng.permutation(300)]
        none = np.zeros(300, bool)
        i, j, d = bitslice.forest_within(prints, group, group, none, radius)
        dist = np.bitwise_count(prints[:, None] ^ prints[None]).sum(-1)
        assert (dist[i, j] == d).all() and (d <= radius).all() and (group[i] == group[j]).all()
        near = [(int(dist[a, b]), a, b) for a in range(300) for b in range(a + 1, 300) if group[a] == group[b] and dist[a, b] <= radius]
        parent, weight = list(range(300)), 0

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for w, a, b in sorted(near):
            if find(a) != find(b):
                parent[find(a)] = find(b)
                weight += w
        assert weight == d.sum()


def test_near_duplicates_keep_one_of_each_group(docs, prose, spark):
    kept = simhash.near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()

    def parts(t):
        return set(simhash.shingles((t or "").encode(), 5))

    for a in range(len(rows)):
        for b in range(a):
            x, y = parts(rows[a].text), parts(rows[b].text)
            assert not (x == y or len(x & y) >= 0.8 * len(x | y)), (rows[a].doc_id, rows[b].doc_id)
    ids = [r.doc_id for r in rows]
    assert sum(200 <= (i or 0) < 240 for i in ids) == 1 and 200 in ids and ids.count(303) == 1
    texts = {r.text for r in docs.collect()}
    assert len({r.text for r in rows}) == len(rows) and {r.text for r in rows} <= texts


def test_recall_of_sampled_keys(spark, prose):
    """Pairs at a similarity just over the threshold are proposed but for a few in a hundred."""
    rows = []
    for k in range(150):
        w = prose(400, 5000 + k).split()
        v = list(w)
        for at in range(8, 400, 50):
            v[at] = f"other{k}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    kept = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() <= 150 * 1.03


def test_pairs_behind_failed_forest_links_are_found(spark, prose):
    """A and B are copies of 0.8; related texts that are no copies of either lie nearer to both."""
    rows, later = [], []
    for k in range(40):
        w = prose(400, 9000 + k).split()
        a, b = list(w), list(w)
        for at in range(8, 200, 48):
            a[at] = f"left{k}"
        for at in range(208, 400, 48):
            b[at] = f"right{k}"
        rows += [(1000 * k, " ".join(a)), (1000 * k + 1, " ".join(b))]
        for n in range(30):  # half of the changes of each, and many words more
            c = list(w)
            for at in range(8, 400, 96):
                c[at] = f"mid{k}"
            later.append((1000 * k + 10 + n, " ".join(c) + " " + prose(60 + n, 100 * k + n)))
    docs = spark.createDataFrame(rows + later, "doc_id long, text string")
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in rows + later}
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    kept = [r.doc_id for r in simhash.near_duplicates(docs).collect()]
    ids = [i for i in kept]
    assert not [(i, j) for i in ids for j in ids if i < j and i // 1000 == j // 1000 and near(sets[i], sets[j])]


def test_short_near_copies_are_all_found(spark, prose):
    """Eight words and the same with one more: four of five shingles, a similarity of 0.8."""
    rows = [row for k in range(400) for row in ((2 * k, f"w{k} " + prose(7, 100_000 + k)), (2 * k + 1, f"w{k} " + prose(7, 100_000 + k) + " added"))]
    kept = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2 * k for k in range(400)]


def brute_groups(sets, similarity=0.8):
    """Components of the pairs that similar, by all pairs."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                parent[find(a)] = find(b)
    return [find(x) for x in range(len(sets))]


@pytest.mark.parametrize("seed, changes", [(1, (2, 9)), (2, (5, 8)), (3, (1, 14))])
def test_dense_clusters_keep_the_rows_of_brute_force(spark, prose, seed, changes):
    """600 texts with some words of one base changed, most pairs between 0.6 and 0.9."""
    rng, base = random.Random(seed), prose(300, 77_000 + seed).split()
    texts = []
    for k in range(600):
        w = list(base)
        for at in rng.sample(range(300), rng.randrange(*changes)):
            w[at] = f"changed{k}x{at}"
        texts.append(" ".join(w))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    groups = brute_groups(sets)
    kept = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    least = {}
    for k, g in enumerate(groups):
        least.setdefault(g, k)
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


@pytest.mark.parametrize("share", [0.8, 0.85])
def test_recall_at_the_threshold(spark, prose, share):
    """Pairs of texts, alone, at just the similarity: 98 of 100 and more are found."""
    rows, pairs = [], 0
    for k in range(600):
        w = prose(250, 300_000 + k).split()
        v, at = list(w), 3
        x = set(simhash.shingles(" ".join(w).encode(), 5))
        while at < 250:
            u = list(v)
            u[at] = f"new{k}x{at}"
            y = set(simhash.shingles(" ".join(u).encode(), 5))
            if len(x & y) < share * len(x | y):
                break
            v, at = u, at + 7
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        pairs += 1
    kept = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept <= pairs * 1.02


def test_sets_compared_in_a_family():
    """Chunks, lists instead of bits, and one side only: the groups are those of all pairs."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(45, 60), replace=False), rng.integers(0, 2**62, rng.integers(0, 6))])) for _ in range(120)]
    prints, side = np.zeros((120, 2), np.uint64), rng.integers(0, 2, 120)
    sizes, values = np.array([len(x) for x in sets]), np.concatenate(sets)
    want = brute_groups([set(x.tolist()) for x in sets])
    for most in (1 << 30, 0):
        bitslice.MOST_BITS, kept = most, bitslice.MOST_BITS
        i, j = bitslice.similar_forest(prints, sizes, values, side, False, 5, 0.8)
        a, b = bitslice.similar_forest(prints, sizes, values, side, True, 5, 0.8)
        bitslice.MOST_BITS = kept
        assert len(i) == 120 - len(set(want)) and all(want[x] == want[y] for x, y in zip(i, j, strict=True))
        assert (side[a] != side[b]).all()


def test_families_in_chunks(spark):
    rng = random.Random(3)
    rows = []
    for f in range(3):
        for k in range(50):
            rows.append((f, f, k, f, sorted(rng.sample(range(100 * f, 100 * f + 30), 28))))
    sets = spark.createDataFrame(rows, "c0 long, c1 long, fp0 long, fp1 long, parts array<long>").repartition(4)
    for most in (2048, 7):
        links = simhash._verified(sets, 64, 0.8, rows_of_chunk=most).collect()
        parent = {(r[2], r[3]): (r[2], r[3]) for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in links:
            parent[find(tuple(r.a))] = find(tuple(r.b))
        own = {(r[2], r[3]): set(r[4]) for r in rows}
        assert all(len(own[tuple(r.a)] & own[tuple(r.b)]) >= 0.8 * len(own[tuple(r.a)] | own[tuple(r.b)]) for r in links)
        names = sorted(own)
        want = brute_groups([own[n] for n in names])
        assert len({find(n) for n in names}) == len(set(want))


def test_keys_grow_with_the_prints():
    assert simhash.table_shape(1) == simhash.table_shape(1 << 18) == (12, 48)
    assert simhash.table_shape(1 << 28) == (22, 252)

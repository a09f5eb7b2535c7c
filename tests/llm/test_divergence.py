import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from momentlake.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, least):
    """rows: (lang, source, text)."""
    docs, count, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(terms(text))
        count[lang, source].update(found)
        docs.update((lang, t) for t in found)
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        share = lambda c, kept=kept: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", more, 50)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def got(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in frame.collect())


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("Ab", "é", "zz", "Ünd", "ﬁ", "q") for b in ("", "x", "Y", "ß", "日本")]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "cé", None])
        skew = words if source != "a" else words[:12]
        rows.append((lang, source, rng.choice(["", " ", None, " "]) if i % 50 == 0 else rng.choice([" ", ", ", "1", "\n"]).join(rng.choice(skew) for _ in range(rng.randrange(1, 60)))))
    rows += [("xx", "lone", "word"), ("yy", "one", None), ("yy", "two", ""), ("yy", None, "123 !")] + [("en", "b", "same text here")] * 40
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, source string, text string, n long, docs long, term string").repartition(3)


@pytest.mark.parametrize("block_rows", [1 << 16, 7])
def test_whole_audit_against_brute_force(spark, mixed, block_rows):
    assert got(D.audit(frame(spark, mixed), least=30, block_rows=block_rows)) == brute(mixed, 30)


def test_all_terms_kept_and_none(spark, mixed):
    few = mixed[:60]
    assert got(D.audit(frame(spark, few), least=1)) == brute(few, 1)
    assert got(D.audit(frame(spark, few), least=1000)) == brute(few, 1000)
    assert D.audit(frame(spark, []).limit(0)).collect() == []


def test_long_texts_in_pieces(spark, mixed, monkeypatch):
    text = " ".join(f"w{i % 997}é Tail" for i in range(3000)) + "日" * 5000 + " end"
    monkeypatch.setattr(D, "PIECE", 1000)
    for data in (text.encode(), b"", b"   ", "é".encode() * 3000):
        found, times = D._long_text(np.frombuffer(data, np.uint8))
        assert dict(zip(found.to_pylist(), times.tolist(), strict=True)) == Counter(terms(data.decode()))
    rows = [("en", "a", text), ("en", "b", text[:2000]), ("en", "a", "Tail")]
    batch = D.pa.record_batch([D.pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])
    total = Counter()
    for b in D._tokenized(iter([batch])):
        for r in b.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    want = Counter()
    for _, s, t in rows:
        want.update((s, x) for x in terms(t))
    assert {k: v for k, v in total.items() if k[1] is not None} == want


@pytest.mark.parametrize("digest", [lambda b: len(b) % 3, lambda b: 0, lambda b: b[0]])
def test_colliding_hashes_change_nothing(digest):
    text = " ".join(random.Random(2).choice(["a", "ab", "abc", "b", "ba", "bab", "c", "cc", "abcd", "abce"]) for _ in range(500)).encode()
    data = np.frombuffer(text, np.uint8)
    low, start, end, _ = D.slices(data, np.array([0, len(data)]))
    code, first = D.grouped(low, start, end, digest)
    words = text.split()
    assert all(words[first[c]] == w for c, w in zip(code, words, strict=True))
    assert len(set(code.tolist())) == len(set(words))


def test_texts_side_by_side_do_not_merge():
    parts = [b"ab", b"", b"cd ef", b"gh"]
    data = np.frombuffer(b"".join(parts), np.uint8)
    low, start, end, text = D.slices(data, np.cumsum([0, *map(len, parts)]))
    assert [(bytes(low[a:b]), t) for a, b, t in zip(start, end, text, strict=True)] == [(b"ab", 0), (b"cd", 2), (b"ef", 2), (b"gh", 3)]


def test_shares_are_exact_for_large_counts():
    rng = random.Random(5)
    for _ in range(200):
        total = rng.randrange(1, 8 * 10**15)
        n, v = rng.randrange(0, total + 1), rng.randrange(1, 10**6)
        assert int(D.share(np.array([n]), np.array([total]), v)[0]) == 1 + 10**9 * (n + 5) // (total + 5 * v)

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from momentlake.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(n):
    near = defaultdict(list)
    for a in n:
        near[a] = [b for b in n if b != a and one_apart(a, b)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def told(frame):
    got = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def corpus(seed):
    """Texts of words in many spellings, some far more frequent; anagrams and odd letters among them."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abéß") for _ in range(rng.randrange(5, 9))) for _ in range(25)] + ["straßeÀ", "ÀÉÎÕÜÿ", "a×b÷cd", "theory", "Theory", "oretyh"]
    words = []
    for s in stems:
        words += [s] * rng.choice([3, 6, 40, 300])
        for _ in range(6):
            i, c = rng.randrange(len(s)), rng.choice("abéßx")
            words += [rng.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :], "".join(rng.sample(s, len(s)))])] * rng.choice([4, 5, 7, 30])
    words += ["abcdef"] * 6 + ["abcdeg"] * 40 + ["abcdhg"] * 250 + ["abcihg"] * 1600  # a chain of forms
    words += ["n" * 3000] * 5 + ["n" * 2999 + "m"] * 25 + ["short"] * 9
    rng.shuffle(words)
    rows, at = [], 0
    while at < len(words):
        k = rng.randrange(1, 200)
        rows.append((len(rows) if rng.random() < 0.97 else None, "".join(w + rng.choice([" ", ", ", "1", "\n", "日"]) for w in words[at : at + k])))
        at += k
    return [*rows, (10_000, None), (10_001, ""), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "w", 3, 4) for r in rows], "doc_id long, text string, word string, n long, size long").repartition(3)
    n = counted(rows)
    assert dict(S.word_counts(docs).collect()) == n
    want = brute(n)
    assert told(S.variants(docs)) == want
    assert sum(v[0] is not None for v in want.values()) > 30 and want["abcdef"][1] == "abcihg"


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_every_pair_one_letter_apart(spark, letters):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(500)})
    got = [(r.word, r.near) for r in S.near_words(spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a != b and one_apart(a, b))


def test_keys_are_sums_whatever_the_order(spark):
    got = spark.createDataFrame([("éabc",), ("cbaé",), ("ÿ" * 50,), ("",)], "word string").select("word", S.anagram_key(F.split("word", "")).alias("k")).collect()
    for r in got:
        assert r.k == sum(ord(c) ** S.POWER for c in r.word) % S.PRIME


def test_long_chains_are_followed_to_the_end(spark):
    chain = spark.createDataFrame([(f"w{i:03d}", f"w{i + 1:03d}") for i in range(37)] + [("x", "y"), ("z", "y")], "word string, form string")
    assert dict(S.roots(chain).collect()) == {f"w{i:03d}": "w037" for i in range(37)} | {"x": "y", "z": "y"}


def test_empty_table_and_columns(spark, docs, empty_docs):
    got = S.variants(empty_docs)
    assert got.collect() == [] and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert told(S.variants(docs)) == brute(counted(rows))

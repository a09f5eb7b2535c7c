import random

import numpy as np
from pyspark.sql import functions as F

from momentlake.llm import quality


def corpus(spark, prose):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        text = prose(80, i) if good else rng.choice([" | ".join(prose(40, i).split()), prose(40, i).upper() + "!!", "Spam " * 60])
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    labels += [(0, None, 0), (None, 1, 0), (5, 7, 0), (1, labels[1][1], 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, prose):
    docs, labels = corpus(spark, prose)
    got = quality.scored(docs, labels).join(labels.where("quality in (0, 1)").dropDuplicates(["doc_id"]), "doc_id").where("held_out")
    rows = got.collect()
    assert len(rows) > 100 and np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    again = quality.scored(docs.repartition(5), labels.repartition(2)).select("doc_id", "score").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, quality.scored(docs, labels).select("doc_id", "score").collect()))


def test_held_out_labels_are_not_learned(spark, prose):
    docs, labels = corpus(spark, prose)
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.scored(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_edge_cases(docs, empty_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, none).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality.scored(docs, some).count() == docs.count()
    assert quality.accepted(docs, some).columns == docs.columns
    assert quality.scored(empty_docs, none).collect() == []


def test_trees_match_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.fit(x, y, rounds=30)

    def walk(row):
        total = t.base
        for f, c, leaf in zip(t.feature, t.threshold, t.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > c[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x), [walk(r) for r in x]) and ((t.score(x) >= 0.5) == y).mean() > 0.95


def test_statistics_against_plain_counting():
    texts = ["One two two.  THREE,\n\nfour|five! $x ä\n" + "long line of words " * 5, "", "   ", "a", "! ! ?", "1 22 333\n1 22 333\n", "A b C d", "tail|", "x" * 100]
    for t in texts:
        got = dict(zip(quality.FEATURES, quality.statistics(t.encode())))
        b, words = t.encode(), t.encode().split()
        if not words:
            assert got["log_bytes"] == np.log1p(len(b)) and not any(v for k, v in got.items() if k != "log_bytes")
            continue
        size, n = len(b), len(words)
        of = lambda test: sum(map(test, b)) / size
        lines = [x for x in b.split(b"\n") if x.strip()]
        want = {
            "log_bytes": np.log1p(size), "log_words": np.log1p(n), "mean_word": sum(map(len, words)) / n, "distinct_words": len(set(words)) / n,
            "top_word": max(words.count(w) for w in words) / n, "repeats_next": sum(words[k] == words[k + 1] for k in range(n - 1)) / n,
            "upper": of(lambda c: chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": of(lambda c: chr(c) in "0123456789"), "stop": of(lambda c: c == ord(".")), "comma": of(lambda c: c == ord(",")),
            "bar": of(lambda c: c == ord("|")), "bang": of(lambda c: c == ord("!")), "beyond_ascii": of(lambda c: c > 127), "newline": of(lambda c: c == 10), "marks": of(lambda c: chr(c) in "#$%&*@^~=+<>{}[]\\/_"),
            "log_lines": np.log1p(len(lines)), "mean_line": size / len(lines), "distinct_lines": len(set(lines)) / len(lines), "short_lines": sum(len(x) < 40 for x in lines) / len(lines),
            "lone_marks": sum(len(w) == 1 and not w.isalnum() for w in words) / n, "capitals": sum(w[:1].isupper() for w in words) / n, "distinct_pairs": len({(words[k], words[k + 1]) for k in range(n - 1)}) / max(n - 1, 1),
            "spread_word": (sum((len(w) - sum(map(len, words)) / n) ** 2 for w in words) / n) ** 0.5,
        }
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), t


def test_fit_against_all_splits():
    """A tree of one level takes the best of all splits at the bins' edges; leaves are the Newton steps."""
    rng = np.random.default_rng(6)
    for _ in range(5):
        x, y = rng.integers(0, 12, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
        y[x[:, 1] > 7] = 1
        trees = quality.fit(x, y, rounds=1, depth=1, rate=1.0, ridge=1.0, least=2.0)
        p = (y.sum() + 1) / (len(y) + 2)
        g, h = p - y, np.full(len(y), p * (1 - p))
        best = None
        for k in range(3):
            for cut in np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])):
                left = x[:, k] <= cut
                if h[left].sum() < 2 or h[~left].sum() < 2:
                    continue
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, k, cut
        left = x[:, best[1]] <= best[2]
        assert (trees.feature[0, 0], trees.threshold[0, 0]) == best[1:]
        leaves = [-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)]
        assert np.allclose(trees.leaf[0], leaves)
        assert np.allclose(trees.score(x), 1 / (1 + np.exp(-(np.log(p / (1 - p)) + np.where(left, *leaves)))))


def test_a_repeated_id_is_learned_from_once(spark, prose):
    docs, labels = corpus(spark, prose)
    again = docs.unionByName(docs.where("doc_id = 3").selectExpr("doc_id", "text", "lang", "source", "explode(sequence(1, 500)) AS k").drop("k"))
    a, b = (quality.train(d, labels) for d in (docs, again))
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.threshold, b.threshold)

import random

import pytest

WORDS = "the of and to in is it that for was on are with as be this by at from or an they which one had but not what all were when we there can said".split()


@pytest.fixture(scope="session")
def prose():
    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "s"]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs(spark, prose):
    """Documents with copies, near copies, nulls, empty, long and repeated rows, and clashing extra columns."""
    rows = [(i, prose(30 + 7 * (i % 13), i % 40), "en", f"src{i % 4}") for i in range(120)]
    base = prose(300, 999).split()
    rows += [(200 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "en", "src0") for k in range(40)]
    rows += [(300, None, "en", None), (301, "", "en", "src1"), (302, "", None, "src1"), (303, "one", "en", "src2"), (303, "one", "en", "src2")]
    rows += [(None, prose(50, 7), "en", "src3"), (None, None, None, None), (400, "x" * 70_000 + " " + prose(9000, 5), "en", "src0"), (401, " " * 5000, "en", "src2")]
    full = [(*r, 1, 2, "t", 0.5) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, size long, count long, id string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

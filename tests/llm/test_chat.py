import random

from momentlake.llm import chat


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role, text))
    keyed = {c: tuple((r, x) for _, _, r, x in sorted(v, key=lambda z: z[:2])) for c, v in convs.items()}
    kept = {}
    for c, k in keyed.items():
        if any(len(o) > len(k) and o[: len(k)] == k for o in keyed.values()):
            continue
        kept[k] = min((x for x in (kept.get(k, c), c) if x is not None), default=None)
    return sorted((c, len(k), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in k)) for k, c in kept.items())


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for c in range(200):
        seed = random.Random(rng.randrange(12))
        turns = [(("user", "assistant")[n % 2], f"t{seed.randrange(3)}") for n in range(6)]
        rows += [(c, n, *t) for n, t in enumerate(turns[: rng.randrange(1, 7)])]
    rows += [(900, 0, None, "a"), (901, 0, "", "a"), (902, 0, "user", None), (903, 0, "user", ""), (904, None, "user", "n"), (904, 1, "user", "m")]
    rows += [(905, 0, "ab", "c"), (906, 0, "a", "bc"), (907, 0, "user", "x" * 50_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, n_turns int").repartition(4)
    assert sorted(map(tuple, chat.formatted(df).collect())) == brute(rows)


def test_repeated_turns_and_null_ids(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "q"), (2, 0, "user", "a")]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(((r.conv_id, r.n_turns) for r in got), key=str) == [(1, 2), (None, 1)]


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []

import pytest
from pyspark.sql import functions as F

from momentlake.functions import rules as R
from momentlake.operators import rules


def moments(spark, *texts, ocr=""):
    return spark.createDataFrame([(f"m{i}", t, ocr) for i, t in enumerate(texts)], "moment_id string, transcript_text string, ocr_text string")


@pytest.mark.parametrize(
    "text, kind",
    [
        ("A browser is a program for pages.", "definition"), ("Be careful with this setting.", "warning"), ("First, open the settings page.", "step"), ("Tools such as this one help us.", "example"),
        ("This one is better than that.", "comparison"), ("Seven plain different words make no idea", None), ("Eight plain different words make up one claim", "claim"), ("Too short", None),
    ],
)
def test_ideas(spark, text, kind):
    got = rules.ideas(moments(spark, text)).collect()
    assert [r.type for r in got] == ([kind] if kind else [])


def test_ideas_are_kept_once_and_numbered_by_sentence(spark):
    got = rules.ideas(moments(spark, "It is a tool.  Short. It is a tool. Then run it now!")).orderBy("pos").collect()
    assert [(r.pos, r.type, r.text, r.idea_id) for r in got] == [(0, "definition", "It is a tool.", "idea:m0:0"), (3, "step", "Then run it now!", "idea:m0:3")]


@pytest.mark.parametrize(
    "text, kind, confidence",
    [
        ("This is a definition of it.", "definition", 0.8), ("Never touch this button.", "warning", 0.8), ("You should prefer the other.", "recommendation", 0.8), ("It is faster by far.", "comparison", 0.7),
        ("The fix is known now.", "error_solution", 0.7), ("Install it and go on.", "step", 0.65), ("One drawback remains here.", "limitation", 0.65), ("The sky has clouds.", "factual", 0.5),
    ],
)
def test_claims(spark, text, kind, confidence):
    (r,) = rules.claims(moments(spark, text)).collect()
    assert (r.type, r.confidence) == (kind, confidence)


def test_contradictions(spark):
    df = spark.createDataFrame([("a", "Do not use it."), ("b", "Use it always."), ("c", "do not go"), ("d", "nothing")], "claim_id string, text string")
    got = {(r.claim_a, r.claim_b): r.reason for r in rules.contradictions(df).collect()}
    assert got == {("a", "b"): "negative vs positive directive", ("a", "c"): "negative vs positive directive", ("b", "c"): "positive vs negative directive"}


def test_pairs_of_contradictions_are_not_shuffled(spark):
    texts = ["Do not use it.", "Use it always.", "do not go", "nothing", "never", "Should run."]
    df = spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(texts * 3)], "claim_id string, text string")
    found = rules.contradictions(df)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = [(r.claim_a, r.claim_b) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) > 0
    some = {"c0", "c1", "c2", "c8"}
    asked = spark.createDataFrame([(c,) for c in some], "claim_id string")
    assert sorted((r.claim_a, r.claim_b) for r in rules.contradictions(df, asked).collect()) == sorted(p for p in pairs if some & set(p))


def test_technical(spark):
    text = "See src/app/main.py, run pip install numpy. Error: bad thing\ncall parseText and snake_case; y = mx + b; from os.path import join"
    m = moments(spark, text)
    row = m.select(*(f(F.col("transcript_text")).alias(n) for n, f in (("p", rules.file_paths), ("c", rules.commands), ("e", rules.errors), ("q", rules.equations), ("i", rules.code_identifiers), ("m", rules.imports)))).first()
    assert "src/app/main.py" in row.p and "pip install numpy" in row.c and row.e == ["Error: bad thing"] and "y = mx + b" in row.q
    assert {"parseText", "snake_case"} <= set(row.i) and row.m == ["os.path", "join"]
    assert {r.modality for r in rules.technical(m).collect()} == {"file_path", "command", "error", "equation", "code"}


def test_entities_first_spelling_wins(spark):
    got = rules.moment_entities(moments(spark, "The Positional Encoding uses JSON and json via playwright.", ocr="JSON")).orderBy("pos").collect()
    assert [(r.label, r.entity_type) for r in got] == [("The Positional Encoding", "capitalized_phrase"), ("JSON", "acronym"), ("Playwright", "known_term"), ("Positional Encoding", "known_term")]


@pytest.mark.parametrize("text, score", [("plain", 1.0), ("deprecated", 0.7), ("deprecated but new", 0.9), ("the api", 0.9), ("legacy api", 0.6), ("latest", 1.0)])
def test_freshness(spark, text, score):
    assert abs(moments(spark, text).select(rules.freshness(F.col("transcript_text")).alias("s")).first().s - score) < 1e-9


def test_dialects_spell_out_classes():
    assert R.re2(r"\bis\s+a\b") == r"(?:^|[^\p{L}\p{N}_])is[\s\p{Z}]+a(?:$|[^\p{L}\p{N}_])"
    assert R.re2(r"[-/\w.]\S") == r"[-/\p{L}\p{N}_.][^\s\p{Z}]"


@pytest.mark.parametrize("name, extract", [("FILE_PATHS", rules.file_paths), ("COMMANDS", rules.commands), ("ERRORS", rules.errors), ("EQUATIONS", rules.equations), ("CODE_IDENTIFIERS", rules.code_identifiers), ("IMPORTS", rules.imports)])
def test_patterns_are_tried_only_where_the_text_holds_what_they_need(spark, name, extract):
    texts = [
        "See src/app/main.py or C src\\lib and /usr/bin/x", "NPM run x; pip install y; python -m z; git push; uvicorn a:b; gunicorn a:b; docker ps; kubectl get; conda list; curl -s u; wget u", "yarn add x, npx start",
        "make all; echo 'hi there'; cat /etc/x; grep -rn a; chmod 7 x; ssh a@b; scp a b; sudo su; ./run.sh", "ſudo x, maKe y, pıp install z, İmport", "Error: x", "Traceback: y", "no module named z", "Command Not Found", "TypeError",
        "failed: x", "exit code 3", "404 Not Found", "unable to go", "timed out", "WARNING: it is DEPRECATED", "panic: x", "assert a failed", "y = mx + b, det(A), A^T B, sum (x), lambda x, P = PDP^-1, Ax = b, 1 + 2 = 3, \\(a\\) \\[b\\]",
        "def run, snake_case, parseText, HTTPServer, git push", "from os.path import join; require('a/b')", "plain words only", "",
    ]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    patterns, need = getattr(R, name), getattr(R, f"{name}_NEED")
    ignore = name in ("FILE_PATHS", "COMMANDS", "ERRORS")
    every = [F.regexp_extract_all("t", F.lit(R.java(p, ignore)), F.lit(0)) for p in patterns]
    folded = rules._folded(F.col("t")) if ignore else F.col("t")
    for p, found, n in zip(patterns, every, need, strict=True):
        rows = df.where(F.size(found) > 0).select(rules._holds(folded, n).alias("held")).collect()
        assert rows and all(r.held for r in rows), p
    assert "regexp_extract_all" in (shown := str(extract(F.col("t")))) and (name == "FILE_PATHS" or "contains" in shown.lower())


def test_letters_that_patterns_take_for_plain_ones_are_folded(spark):
    own = spark.createDataFrame([(chr(k),) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000], "c string")
    taken = own.where(F.rlike("c", F.lit(R.java("^(?:" + "|".join("abcdefghijklmnopqrstuvwxyz") + ")$", True))))
    assert taken.count() >= 52 and taken.where(~rules._folded(F.col("c")).rlike("^[a-z]$")).count() == 0


def test_a_text_is_hashed_once(spark, monkeypatch):
    from momentlake.operators import dedupe

    read = []
    monkeypatch.setattr(dedupe, "cut", lambda df: read.append(df) or df.localCheckpoint())
    got = dedupe.exact_duplicates(spark.createDataFrame([(f"m{k}", k, "the same", "") for k in range(3)], "moment_id string, ord long, transcript_text string, ocr_text string"))
    assert got.count() == 2 and len(read) == 1

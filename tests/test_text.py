import difflib
import random
import re

from pyspark.sql import functions as F

from momentlake.functions import text as T
from momentlake.operators import chunking, dedupe, vectors
from momentlake.sources import tables, transcripts, web


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_normalize_like_python(spark):
    for t in ["  Ça va?  C'est l'été_2 !", "a b\tc\n—d", "", "ÄÖÜ-ß", "日本 語"]:
        want = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t.lower())).strip()
        assert one(spark, T.normalize_text(F.col("t")), t=t) == want


def test_small_functions(spark):
    assert one(spark, T.normalize_claim(F.col("t")), t="The cat is on a mat, not the X") == "cat mat"
    assert one(spark, T.combined_text(F.lit(" a "), F.lit(None).cast("string"), F.lit(""), F.lit("b"))) == "a b"
    assert one(spark, T.grams(F.col("t")), t="abcab") == ["abc", "bca", "cab"] and one(spark, T.grams(F.col("t")), t="ab") == ["ab"] and one(spark, T.grams(F.col("t")), t="") == []
    assert one(spark, T.sentences(F.col("t")), t="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.fts_tokens(F.col("t")), t="Éléphant's_nose, 2") == ["elephant", "s", "nose", "2"]
    assert [one(spark, T.clock(F.lit(s))) for s in (0.0, 59.9, 61.0, 3600.0, 36061.5)] == ["0:00", "0:59", "1:01", "1:00:00", "10:01:01"]
    assert [one(spark, T.clock_seconds(F.lit(s))) for s in ("1:01", "1:00:00", "x", "5")] == [61.0, 3600.0, None, None]
    assert one(spark, T.deep_link(F.lit("http://a?b=1"), F.lit(61.7))) == "http://a?b=1&t=61s" and one(spark, T.deep_link(F.lit("http://a"), F.lit(0.0))) == "http://a?t=0s"
    assert [one(spark, T.human_size(F.lit(n))) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert one(spark, T.preview_hash(F.lit(" "), F.lit(None).cast("string"))) == "empty"


def test_snippet(spark):
    long = "x" * 300 + " needle " + "y" * 300
    got = one(spark, T.snippet(F.col("t"), ["a", "needle"]), t=long)
    assert got == "... " + long[181:421] + " ..."
    assert one(spark, T.snippet(F.col("t"), ["zzz"]), t=long) == long[:240] + "..." and one(spark, T.snippet(F.col("t"), ["q"]), t="") == ""


def test_urls(spark):
    f = lambda u: one(spark, web.normal_url(F.lit(u)))
    want = "https://www.youtube.com/watch?v=abcdefghijk"
    assert f("https://youtu.be/abcdefghijk?t=3") == f("http://M.youtube.com/watch?list=1&v=abcdefghijk#x") == want
    assert f("https://youtu.be/") == "https://youtu.be/" and f("https://www.youtube.com/watch?list=1") == "https://www.youtube.com/watch?list=1" and f("https://a.b/watch?v=x") == "https://a.b/watch?v=x"
    p = lambda u, h=None: one(spark, web.provider(F.lit(u), None if h is None else F.lit(h)))
    assert [p("https://youtu.be/x"), p("https://Vimeo.com/1"), p("http://a.b"), p("/a/b.mp4"), p("http://a.b", "webpage"), p("http://a.b", "auto")] == ["youtube", "vimeo", "generic", "local", "webpage", "generic"]
    assert one(spark, web.video_id(F.lit(want))) == "abcdefghijk" and len(one(spark, web.video_id(F.lit("/a.mp4")))) == 16


SRT = "1\n00:00:01,000 --> 00:00:04,500\nHello\nthere\n\n2\n00:01:05,000 --> 00:01:09,000\n42\n\n3\n01:00:00,250 --> 01:00:01,000\nend\n"
VTT = "﻿WEBVTT\nKind: captions\n\nNOTE a remark\nx\n\ncue-1\n00:01.000 --> 00:04.000 align:start\nHi <b>you</b>\n\n00:00:05.000 --> 00:00:06.000\nbye"


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    (tmp_path / "b.vtt").write_text(VTT)
    (tmp_path / "b.srt").write_text(SRT)
    (tmp_path / "c.txt").write_text("One sentence here. Another!\n\nA last paragraph.")
    (tmp_path / "d.json").write_text('[{"start_sec": 1.0, "end_sec": 2.0, "text": "j"}]')
    (tmp_path / "e.txt").write_text("  ")
    (tmp_path / "f.mp4").write_text("")
    (tmp_path / "g h+i.srt").write_text(SRT)
    (tmp_path / "g h+i.vtt").write_text("")
    (tmp_path / "j.MOV").write_text("x")
    files = transcripts.discover(spark, str(tmp_path))
    assert {r.video_id: r.kind for r in files.collect()} == {"a": "srt", "b": "vtt", "c": "txt", "d": "json", "e": "txt", "g h+i": "vtt"}
    got = {}
    for r in transcripts.parse(files).orderBy("video_id", "seq").collect():
        got.setdefault(r.video_id, []).append((r.start_sec, r.end_sec, r.text))
    assert got["a"] == [(1.0, 4.5, "Hello there"), (3600.25, 3601.0, "end")]
    assert got["b"] == [(1.0, 4.0, "cue-1 Hi <b>you</b>"), (5.0, 6.0, "bye")] and got["d"] == [(1.0, 2.0, "j")] and "e" not in got and "g h+i" not in got
    times = got["c"]
    assert [t for *_, t in times] == ["One sentence here.", "Another!", "A last paragraph."] and times[0][0] == 0 and 29 < times[-1][1] <= 30
    assert all(abs(x[1] - y[0]) < 1e-9 for x, y in zip(times, times[1:]))
    assert sorted((r.name, r.size) for r in web.media_files(spark, str(tmp_path)).collect()) == [("f.mp4", 0), ("j.MOV", 1)]


def test_chunks_lose_nothing():
    rng = random.Random(3)
    for n in (1, 5, 200):
        entries = [(3.0 * i, 3.0 * i + 3, f"segment {i}" + rng.choice([".", "", ""])) for i in range(n)]
        mixed = rng.sample(entries, n)
        got = chunking.chunk_entries(mixed)
        assert got == chunking.chunk_entries(entries)
        assert " ".join(t for *_, t in got) == " ".join(t for *_, t in entries)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:])) and all(b - a <= 123 for a, b, _ in got)  # a sentence end may pass the limit by one entry
    assert chunking.chunk_entries([]) == [] and chunking.chunk_entries([(0, 500, "long")]) == [(0.0, 500.0, "long")]
    assert chunking.chunk_entries([(5, 1, " "), (9, 3, "a")]) == [(9.0, 9.0, "a")]


def test_range_join_and_anchors(spark):
    m = spark.createDataFrame([(f"m{i}", "v", 60.0 * i, 60.0 * i + 60) for i in range(4)] + [("w0", "w", 0.0, 1000.0)], "moment_id string, video_id string, start_sec double, end_sec double")
    p = spark.createDataFrame([("v", 60.0), ("v", 61.0), ("w", 500.0), ("x", 1.0)], "video_id string, timestamp_sec double")
    got = {(r.moment_id, r.timestamp_sec) for r in chunking.seen_in(m, p).collect()}
    assert got == {("m0", 60.0), ("m1", 60.0), ("m1", 61.0), ("w0", 500.0)}
    assert {(r.moment_id, r.place) for r in chunking.anchors(m).collect()} == {("m1", 1), ("m2", 2), ("m3", 3), ("w0", 0)}


def test_similar_texts_are_those_of_brute_force(spark):
    rng = random.Random(6)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(40)] + ["", ""]
    for t in list(texts[:15]):
        w = t.split()
        w[rng.randrange(12)] = "other"
        texts.append(" ".join(w))
    rows = [(f"m{i:03}", i, t) for i, t in enumerate(texts)]
    want = {}

    def sim(a, b):
        jac = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        tri = lambda s: {s[i : i + 3] for i in range(len(s) - 2)} or ({s} if s else set())
        return (jac(set(a.split()), set(b.split())) + jac(tri(a), tri(b)) + difflib.SequenceMatcher(None, a, b).ratio()) / 3

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if (s := sim(texts[i], texts[j])) >= 0.75:
                want[rows[i][0], rows[j][0]] = s
    got = {(r.a, r.b): r.similarity for r in dedupe.similar_texts(spark.createDataFrame(rows, "id string, pos int, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 15


def test_duplicates_types_and_canonical(spark):
    base = "this talk explains how a browser loads pages and why it waits for the network before it draws"
    rows = [("a", 1, base, ""), ("b", 2, base + "!", ""), ("c", 3, base + " careful avoid error install", "x"), ("d", 4, "nothing alike here", "")]
    got = {r.moment_id: r for r in dedupe.duplicates(spark.createDataFrame(rows, "moment_id string, ord long, transcript_text string, ocr_text string")).collect()}
    assert got["b"].duplicate_type == "exact" and got["b"].canonical_moment_id == "a" and got["b"].similarity_score == 1.0
    assert got["a"].canonical_moment_id == "c" and got["a"].duplicate_type == "variant" and set(got) == {"a", "b"}


def test_vectors(spark):
    v = one(spark, vectors.hash_embedding(F.lit("abc"), 70))
    assert len(v) == 70 and v[0] == int("b", 16) / 15 and v[64:] == v[:6]
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == 1 / 2**0.5
    assert one(spark, vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))) == 0.0


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(old, new, "k")) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(tables.insert_if_absent(old, new, "k", order="v")) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(tables.insert(old, spark.createDataFrame([(9, "z")], "k long, v string"), "k")) == [(1, "a"), (2, "b"), (9, "z")]
    import pytest

    with pytest.raises(Exception, match="there already"):
        tables.insert(old, new, "k").collect()
    ideas = spark.createDataFrame([("i1", "m", "step", "t", 0.5, "rule"), ("i1", None, "odd", "t", 0.5, "rule")], "idea_id string, moment_id string, type string, text string, confidence double, source string")
    broken = {r.type: r.broken for r in tables.violations(ideas, "ideas", "idea_id").collect()}
    assert broken == {"step": "idea_id is repeated", "odd": "moment_id is null; type is not one of its values; idea_id is repeated"}
    assert [f.name for f in tables.schema("moments").fields][:3] == ["moment_id", "video_id", "start_sec"]


def test_sizes_and_places_print_as_in_c(spark):
    sizes = [1280, 1792, 2304, (1 << 20) + (1 << 18), 1023]
    assert [one(spark, T.human_size(F.lit(n))) for n in sizes] == ["1.2 KB", "1.8 KB", "2.2 KB", "1.2 MB", "1023 B"]
    assert one(spark, T.human_size(F.lit(None).cast("int"))) is None
    values = [0.25, 0.75, 0.35, 59.95, 12000000.0, 1e15, -3.25]
    assert [one(spark, T.one_decimal(F.lit(x))) for x in values] == ["%.1f" % x for x in values]
    assert one(spark, T.one_decimal(F.lit(None).cast("double"))) is None

from momentlake.operators import assembly

ENTRIES = [(1, k, 20.0 * k, 20.0 * k + 20, f"Segment {k} is a tool. Never stop it here.") for k in range(9)] + [(2, 0, 0.0, 5.0, "  ")]


def tables(spark, fast):
    videos = spark.createDataFrame([(1, 0.0), (2, 90.0), (3, None)], "video_id long, duration_sec double")
    entries = spark.createDataFrame(ENTRIES, "video_id long, seq long, start_sec double, end_sec double, text string")
    ocr = spark.createDataFrame([(1, 10.0, "git push", 0.5), (1, 11.0, "git push", 0.5), (2, 60.0, "edge", 0.9)], "video_id long, timestamp_sec double, text string, confidence double")
    frames = spark.createDataFrame([(2, 30.0, "a.png")], "video_id long, timestamp_sec double, path string")
    return {k: v.collect() for k, v in assembly.assemble(videos, entries, ocr, frames, fast).items()}


def test_assemble(spark):
    got = tables(spark, False)
    assert {r.video_id: r.duration_sec for r in got["videos"]} == {1: 180.0, 2: 90.0, 3: 60.0}
    m = {v: sorted((r.start_sec, r.end_sec, r.ocr_text) for r in got["moments"] if r.video_id == v) for v in (1, 2, 3)}
    assert m[1][0][0] == 0 and m[1][-1][1] == 180 and m[1][0][2] == "git push" and all(a[1] == b[0] for a, b in zip(m[1], m[1][1:]))
    assert m[2] == [(0.0, 60.0, "edge"), (60.0, 90.0, "edge")] and m[3] == [(0.0, 60.0, "")]  # a point on the border is in both
    assert " ".join(r.transcript_text for r in sorted((r for r in got["moments"] if r.video_id == 1), key=lambda r: r.seq)) == " ".join(e[4] for e in ENTRIES[:9])
    kinds = [r.modality for r in got["evidence"]]
    assert kinds.count("transcript") == len(m[1]) and kinds.count("ocr") == 4 and kinds.count("visual") == 1 and kinds.count("idea") == len(got["ideas"]) > 0
    assert len({r.moment_id for r in got["moments"]}) == len(got["moments"]) and all(len(r.content_hash) == 64 for r in got["moments"])


def test_fast_mode_has_transcripts_only(spark):
    got = tables(spark, True)
    assert {r.modality for r in got["evidence"]} == {"transcript"} and got["ideas"] == [] and {r.ocr_text for r in got["moments"]} == {""}


def test_prompt_context(spark):
    m = spark.createDataFrame([("v", f"m{k}", 60.0 * k, 60.0 * k + 60, f"text {k}") for k in range(8)] + [("w", "one", 0.0, 60.0, None)], "video_id string, moment_id string, start_sec double, end_sec double, transcript_text string")
    hits = spark.createDataFrame([("v", f"m{k}", "l", "s", 3.0 - r, r) for r, k in enumerate((4, 7, 0, 1, 3, 5), 1)], "video_id string, moment_id string, timestamp_label string, transcript_snippet string, score double, rank int")
    context = assembly.prompt_context(m, hits)
    got = sorted((r.video_id, r.place, r.moment_id, r.score) for r in context.collect())
    assert [x[2] for x in got] == ["m4", "m7", "m0", "m1", "m3", "m2", "m6", "one"] and [x[3] for x in got][5:] == [0.5] * 3
    ideas = spark.createDataFrame([("m4", 0, "step", "b"), ("m4", 1, "step", "a"), ("m2", 0, "step", "b"), ("m2", 1, "tip", "c")], "moment_id string, pos int, type string, text string")
    told = sorted((r.place, r.idea) for r in assembly.context_ideas(context, ideas).collect())
    assert told == [(1, "[step] b"), (2, "[step] a"), (3, "[tip] c")]


def test_semantic_finds_the_same_text(spark):
    m = spark.createDataFrame([(k, f"m{k}", "v", t, None) for k, t in enumerate(("red fox", "", "blue", None))], "ord long, moment_id string, video_id string, transcript_text string, ocr_text string")
    got = assembly.semantic(m, "red fox", 5).orderBy("rank").collect()
    assert [r.moment_id for r in got] == ["m0", "m2"] and got[0].score == 1.0

from pyspark.sql import functions as F

from momentlake.operators import embeddings, health, runs
from momentlake.sources import providers


def test_providers_tell_errors_as_rows(spark):
    class Own(providers.VideoProvider):
        name = "own"

        def detect(self, source):
            return "own" in source

        def metadata(self, source):
            if "bad" in source:
                raise ValueError("no such video")
            return providers.Metadata("A title", source, 12.0)

    sources = spark.createDataFrame([("http://own/1",), ("http://own/bad",), ("file.mp4",)], "source string")
    got = {r.source: (r.provider, r.title, r.error) for r in providers.fetch(sources, [Own()]).collect()}
    assert got == {"http://own/1": ("own", "A title", None), "http://own/bad": ("own", None, "no such video"), "file.mp4": (None, None, "no provider")}


def test_recognition_is_cached(spark, tmp_path):
    asked = []

    def recognize(videos):
        asked.append(sorted(r.video_id for r in videos.collect()))
        return videos.select("video_id", F.lit(0).alias("seq"), F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"), F.lit("said").alias("text"))

    of = lambda *names: spark.createDataFrame([(n,) for n in names], "video_id string")
    folder = str(tmp_path / "cache")
    assert providers.cached_entries(spark, folder, of("a", "b"), recognize).count() == 2
    assert providers.cached_entries(spark, folder, of("b", "c"), recognize).count() == 2
    assert providers.cached_entries(spark, folder, of("a"), recognize).count() == 1 and asked == [["a", "b"], ["c"]]


def test_media_are_checked(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x")
    (tmp_path / "b.mp4").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.mp4", "b.mp4", "c.txt", "d.mkv")], "path string")
    got = {r.path.rsplit("/", 1)[1]: r.error for r in providers.checked_media(spark, paths, str(tmp_path)).collect()}
    assert got["a.mp4"] is None
    assert got["c.txt"] == "unsupported format: txt" and got["d.mkv"] == "file not found" and got["b.mp4"] == "empty file"


def test_demo_corpus(spark):
    demo = providers.demo_corpus(spark)
    assert demo["videos"].count() == 3 and demo["transcript_entries"].count() == 48
    assert demo["transcript_entries"].select("video_id", "text").distinct().count() < 48


def test_embedding_store(spark):
    items = spark.createDataFrame([("a", "one text"), ("b", "another"), ("c", " ")], "item_id string, text string")
    made = embeddings.embed(items, embeddings.hash_provider(16))
    assert made.count() == 2 and {len(r.vector) for r in made.collect()} == {16}
    stored = embeddings.store(made, embeddings.embed(items.limit(1).withColumn("text", F.lit("new")), embeddings.hash_provider(16)))
    assert stored.count() == 2 and embeddings.runs(stored).first().item_count == 2
    assert embeddings.near(stored, embeddings.hash_provider(16), "another").orderBy("rank").first().item_id == "b"
    none = embeddings.embed(items, embeddings.provider("no such"))
    assert embeddings.near(none, embeddings.null_provider(), "x").collect() == []


def test_runs(spark):
    rows = spark.createDataFrame([("r1", "running", None, None), ("r2", "running", None, None)], "run_id string, status string, error_message string, completed_at timestamp")
    got = {r.run_id: r for r in runs.complete(rows, rows.where("run_id = 'r1'"), "failed", "broken").collect()}
    assert got["r1"].status == "failed" and got["r1"].error_message == "broken" and got["r1"].completed_at and got["r2"].completed_at is None
    made = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "id string, created_at int")
    assert [r.id for r in runs.newest(made, "id", 2).collect()] == ["b", "c"]


def test_health(spark):
    found = health.doctor({"graph_nodes": spark.range(3), "postings": spark.range(0)})
    assert {r.metric: r.value for r in found.collect()} == {"rows:graph_nodes": 3, "rows:postings": 0, "graph built": 1, "index built": 0}
    text = health.markdown({"State": found})
    assert text.startswith("# Report") and "- rows:graph_nodes: 3" in text and set(health.tools()) == set(health.TOOLS)
    assert health.timings({"range": lambda: spark.range(10)}, 1)["range"] > 0

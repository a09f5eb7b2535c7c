import corpus_pipeline
from momentlake.llm import mixing, queries
from momentlake.llm.simhash import shingles


def test_stages_take_effect(spark, tmp_path, prose):
    texts = [prose(120, i) for i in range(120)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(500 + i, texts[i], "en", "s0", 1) for i in range(10)]
    w = texts[5].split()
    rows += [(600, " ".join(w[:60] + ["changed"] + w[61:]), "en", "s1", 1)]
    rows += [(700 + i, " | ".join(prose(60, 900 + i).split()), "en", "s2", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(700 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r[0] for r in rows if not 700 <= r[0] < 730}
    one = corpus_pipeline.drop_near_copies(spark, good, str(tmp_path))
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == list(range(120))
    mixed = corpus_pipeline.mix_sources(spark, one, str(tmp_path))
    assert mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect()) and len(shingles(texts[0].encode(), 5)) > 0


CLASH = ("score", "size", "copies", "count", "fp0", "best", "key", "n", "held_out", "__id", "__key", "__size", "__hash", "__text")


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path, prose):
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    schema = plain + ", " + ", ".join(f"`{c}` string" for c in CLASH)
    odd = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, prose(50, 1), None, None, None), (3, prose(50, 1), "en", "s", 1), (4, "x" * 200_000, "en", "s", 1), (5, "a b " * 50_000, "en", "t", 1), (6, "one", "en", "t", 1)]
    docs = spark.createDataFrame([(*r, *(f"{c}{k % 2}" for c in CLASH)) for k, r in enumerate(odd)], schema)
    for name, rows in (("odd", docs), ("none", docs.limit(0)), ("bare", spark.createDataFrame([], plain))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        d = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, d, f"{tmp_path}/{name}").columns == d.columns
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (name == "odd") == bool(out) and all(len(r.ids_sha256) == 64 for r in out)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id, len(r.text or "")) for r in kept) == sorted((i, len(t or "")) for i, t, *_ in (odd[1], odd[5], *odd[6:]))


def test_registered():
    names = {k.split("_")[0] for k in queries.queries()}
    assert names == {f"op{n}" for n in range(1, 14)} and set(corpus_pipeline.queries()) == {"pipeline"}
    assert set(queries.oracle_sql()) <= set(queries.queries()) and mixing.SHARE == 1.5

import pytest

from momentlake.operators import search
from momentlake.operators.increment import IndexFolder

SCHEMA = "moment_id string, title string, transcript_text string, extra int"
OLD = [(f"m{i}", "a title", f"install tool number n{i} of many words", i) for i in range(30)] + [("empty", "", None, 0), ("gone", None, "last lonelyword here", 0)]
NEW = [(f"m{i}", "a title", f"install tool number n{i} of {'other' if i == 3 else 'many'} words", 7) for i in range(1, 30)] + [("empty", "", None, 0), ("fresh", "b", "quite new tool", 0)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _same(got: search.Index, moments):
    want = search.build_index(moments)
    cols = ("moment_id", "field", "pos", "term")
    assert sorted(map(tuple, got.postings.select(*cols).collect())) == sorted(map(tuple, want.postings.select(*cols).collect()))
    assert sorted(map(tuple, got.sizes.collect())) == sorted(map(tuple, want.sizes.collect()))
    assert tuple(got.corpus.first()) == pytest.approx(tuple(want.corpus.first()))
    for q in ("tool", "install tool", '"number n3 of"', "n1*", "lonelyword"):
        assert {(r[0], round(r[1], 6)) for r in search.match(got, q).collect()} == {(r[0], round(r[1], 6)) for r in search.match(want, q).collect()}


def test_changes_equal_a_fresh_index(spark, tmp_path):
    folder = IndexFolder(spark, str(tmp_path))
    assert folder.sync(_frame(spark, OLD)) == {"inserted": 32, "updated": 0, "deleted": 0}
    assert folder.sync(_frame(spark, OLD + OLD[:3])) == {"inserted": 0, "updated": 0, "deleted": 0}
    assert folder.sync(_frame(spark, NEW)) == {"inserted": 1, "updated": 1, "deleted": 2}
    _same(folder.read(), _frame(spark, NEW))
    folder.fold()
    _same(folder.read(), _frame(spark, NEW))
    assert folder.fold() == {"postings": [], "sizes": []}
    # back again, twice the same moment: a tombstone doesn't reach later rows
    folder.sync(_frame(spark, OLD))
    folder.sync(_frame(spark, NEW))
    assert folder.sync(_frame(spark, OLD)) == {"inserted": 2, "updated": 1, "deleted": 1}
    _same(folder.read(), _frame(spark, OLD))


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    folder = IndexFolder(spark, str(tmp_path))
    folder.sync(_frame(spark, OLD))
    before = folder.manifest()
    times = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    told = folder.update(_frame(spark, [("fresh", None, "zebra", 0), (None, None, "no id", 0)]), spark.createDataFrame([("m1",), ("unknown",)], "moment_id string"))
    assert told == {"inserted": 1, "updated": 0, "deleted": 1}
    touched = folder.fold()
    after = folder.manifest()
    assert 0 < len(touched["postings"]) < 12 and after["dead"] == []
    kept = {f for f in before["postings"] if int(f.rsplit("=", 1)[1]) not in touched["postings"]}
    assert kept and kept <= set(after["postings"])
    assert all(p.stat().st_mtime_ns == t for p, t in times.items())
    _same(folder.read(), _frame(spark, [r for r in OLD if r[0] != "m1"] + [("fresh", None, "zebra", 0)]))


def test_second_writer_fails_and_leaves_the_state(spark, tmp_path):
    folder = IndexFolder(spark, str(tmp_path))
    folder.sync(_frame(spark, OLD))
    state = folder.manifest()
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        folder._publish(state)
    assert folder.manifest() == state


def test_empty(spark, tmp_path):
    folder = IndexFolder(spark, str(tmp_path))
    assert folder.sync(_frame(spark, [])) == {"inserted": 0, "updated": 0, "deleted": 0}
    assert folder.read().postings.count() == 0
    folder.sync(_frame(spark, OLD))
    assert folder.sync(_frame(spark, []))["deleted"] == 32
    folder.fold()
    assert folder.read().postings.count() == 0 and folder.read().corpus.first()["n"] == 0

"""The file source plans by bytes and pushes filters down; the versioned table loses nothing and shows nothing half done."""

import os
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changelens.sources import datasource as D
from changelens.sources import records
from changelens.sources.export import WRITERS, write_documents


@pytest.fixture
def source(spark):
    D.register(spark)
    return lambda folder, **options: spark.read.format("document_files").options(path=str(folder), **options).load()


def test_round_trip_of_every_format(spark, source, tmp_path):
    rows = [(f"n{k}", kind, f"Title {k}", text) for k, (kind, text) in enumerate((kind, text) for kind in WRITERS for text in ("one <b> & two\n\nthree é漢🙂\x01", "", None, "x" * 5000))]
    made = write_documents(spark.createDataFrame(rows, "name string, format string, title string, text string"), str(tmp_path)).collect()
    assert {(r.path, r.length) for r in made} == {(str(p), p.stat().st_size) for p in tmp_path.iterdir()}
    got = {(r.format, os.path.basename(r.path)): r for r in source(tmp_path).collect()}
    assert len(got) == len(rows)
    for name, kind, title, text in rows:
        r = got[kind, f"{name}.{kind}"]
        if text and kind != "txt":
            assert r.status == "parsed" and all(x.strip() in r.text for x in text.replace("\x01", "").split("\n"))
        assert r.title == (None if r.status != "parsed" else title if kind == "md" else name)
        assert text or kind in ("md", "xlsx") or (r.status, r.unit, r.text) in {("failed", None, None), ("scanned_or_no_text", None, None)}


def test_files_are_planned_by_bytes_and_chosen_before_they_are_opened(spark, source, tmp_path):
    for k in range(10):
        (tmp_path / f"f{k}.txt").write_text("y" * 1000)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g.md").write_text("# A\n\nb\n\n# C\n\nd")
    (tmp_path / "_hidden.txt").write_text("no")
    (tmp_path / "big.txt").write_text("z" * 5000)
    (tmp_path / "odd.bin").write_text("?")
    df = source(tmp_path, maxBytes=2000, partitionBytes=4 * (1000 + D.OPEN_BYTES))
    assert df.rdd.getNumPartitions() == 4  # 13 files of which one is named only, four to a task
    by = {os.path.basename(r.path): r for r in df.where("format <> 'md'").collect()}
    assert (by["big.txt"].status, by["big.txt"].error, by["odd.bin"].status) == ("failed", "file_too_large", "unsupported") and "_hidden.txt" not in by
    assert [(r.unit, r.location) for r in df.where("format = 'md'").orderBy("unit").collect()] == [(1, "A"), (2, "C")]
    reader = D.DocumentReader({"path": str(tmp_path)}, ["path"])
    left = list(reader.pushFilters([D.EqualTo(("format",), "md"), D.EqualTo(("unit",), 1), D.StringStartsWith(("path",), str(tmp_path))]))
    assert [f.attribute for f in left] == [("unit",)] and [[os.path.basename(p) for p, _ in part.files] for part in reader.partitions()] == [["g.md"]]
    assert df.where(F.col("path").startswith(f"{tmp_path}/f")).count() == 10 and df.where("format in ('docx', 'pdf')").count() == 0


def table(spark, path, version=None):
    one = spark.read.format("versioned_table").option("path", str(path))
    return (one.option("version", version) if version else one).load()


def append(df, path, mode="append", **options):
    df.write.format("versioned_table").options(path=str(path), **options).mode(mode).save()


def test_competing_writers_lose_nothing(spark, tmp_path):
    """Writers planned on one version publish at once: each gets a version of its own, each row stays."""
    D.register(spark)
    schema = spark.range(1).schema
    writers = [D.VersionWriter({"path": str(tmp_path)}, schema, False) for _ in range(6)]
    written = [[w.write(iter([pa.RecordBatch.from_pydict({"id": list(range(100 * k + 50 * part, 100 * k + 50 * part + 50))})])) for part in (0, 1)] for k, w in enumerate(writers)]
    threads = [threading.Thread(target=w.commit, args=(m,)) for w, m in zip(writers, written, strict=True)]
    [x.start() for x in threads], [x.join() for x in threads]
    assert D.versions(*D.store(str(tmp_path))) == list(range(1, 7))
    assert sorted(r.id for r in table(spark, tmp_path).collect()) == list(range(600))
    assert table(spark, tmp_path, 1).count() == 100  # an earlier version stays as it was
    assert not D.publish(str(tmp_path), 6, {"files": []}) and table(spark, tmp_path).count() == 600
    assert writers[0].write(iter([])).file is None


def test_a_failed_task_leaves_no_row(spark, tmp_path):
    D.register(spark)
    append(spark.range(10), tmp_path)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        append(bad, tmp_path)
    assert table(spark, tmp_path).count() == 10 and D.versions(*D.store(str(tmp_path))) == [1]


def test_an_overwrite_of_what_has_changed_is_refused(spark, tmp_path):
    D.register(spark)
    append(spark.range(3), tmp_path)
    append(spark.range(5), tmp_path)
    with pytest.raises(Exception, match="made for 1"):
        append(spark.range(1), tmp_path, "overwrite", expected=1)
    assert table(spark, tmp_path).count() == 8
    append(spark.range(1), tmp_path, "overwrite", expected=2)
    assert table(spark, tmp_path).count() == 1 and len(list((tmp_path / "data").iterdir())) >= 3


def test_a_merge_is_made_again_when_another_was_faster(spark, tmp_path, monkeypatch):
    rows = lambda low, high, v: spark.range(low, high).select("id", F.lit(v).alias("v"))
    merge = lambda low, high, v: records.merge_versioned(rows(low, high, v), str(tmp_path), ["id"])
    assert merge(0, 10, "a") == {"inserted": 10, "updated": 0, "unchanged": 0}
    asked = []

    def versions(*where):
        """The first merge to ask learns of a version that the second has replaced by the time it publishes."""
        known = D.versions(*where)
        asked.append(known[-1])
        if len(asked) == 1:
            assert merge(0, 4, "b") == {"inserted": 0, "updated": 4, "unchanged": 0}
        return known

    monkeypatch.setattr(records, "versions", versions)
    assert merge(2, 14, "c") == {"inserted": 4, "updated": 8, "unchanged": 0}
    assert asked == [1, 1, 2]
    assert {r.id: r.v for r in table(spark, tmp_path).collect()} == {k: "b" if k < 2 else "c" for k in range(14)}
    assert merge(2, 4, "c") == {"inserted": 0, "updated": 0, "unchanged": 2}
    assert D.versions(*D.store(str(tmp_path))) == [1, 2, 3]  # nothing new, no version

"""The versioned project store: failures at every step, self-reading writes and concurrent writers."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from spanloom.schema import SPANS
from spanloom.session import scratch_path
from spanloom.sources import files as FS
from spanloom.sources import versions as VS


def _spans(spark, rows):
    return spark.createDataFrame([(p, d, 0, t, "l", 0, 1, {}) for p, d, t in rows], SPANS)


def _texts(df):
    return sorted((r.project, r.text) for r in df.collect())


def _store(spark):
    path = scratch_path(spark, "store") + "/spans"
    FS.write_spans(_spans(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]), path)
    return path


def _csv(spark, text):
    d = scratch_path(spark, "csv").removeprefix("file:")
    os.makedirs(d)
    with open(f"{d}/d.csv", "w", encoding="utf-8") as f:
        f.write(text)
    return f"{d}/d.csv"


def test_write_that_reads_its_own_project(spark):
    path = _store(spark)
    own = FS.read_spans(spark, path, "a")
    FS.write_spans(own.where("text = 'y'"), path, "a")
    assert _texts(FS.read_spans(spark, path)) == [("a", "y"), ("b", "z")]
    FS.write_spans(FS.read_spans(spark, path).withColumn("text", F.upper("text")), path)
    assert _texts(FS.read_spans(spark, path)) == [("a", "Y"), ("b", "Z")]
    FS.write_spans(FS.read_spans(spark, path, "a").where("false"), path, "a")
    assert _texts(FS.read_spans(spark, path)) == [("b", "Z")] and FS.read_spans(spark, path, "a").count() == 0


def test_failed_write_keeps_the_old_data(spark):
    path = _store(spark)
    bad = FS.read_spans(spark, path, "a").withColumn(
        "text", F.when(F.col("text") == "y", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        FS.write_spans(bad, path, "a")
    assert _texts(FS.read_spans(spark, path)) == [("a", "x"), ("a", "y"), ("b", "z")]


def test_failed_or_unfinished_switch_keeps_the_old_data(spark, monkeypatch):
    path = _store(spark)
    store = path.rpartition("/")[0]
    new = _spans(spark, [("a", 5, "new")])

    def lost(*args):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(VS, "_create", lost)
        with pytest.raises(OSError):
            FS.write_spans(new, path, "a")
    assert _texts(FS.read_spans(spark, path, "a")) == [("a", "x"), ("a", "y")]
    # A pointer that its writer did not finish is passed over, by readers and by the next writer.
    folder = f"{store}/pointers/project=a".removeprefix("file:")
    for number, text in (("0000000002", ""), ("0000000003", '{"spans": "')):
        with open(f"{folder}/{number}", "w", encoding="utf-8") as f:
            f.write(text)
    assert _texts(FS.read_spans(spark, path)) == [("a", "x"), ("a", "y"), ("b", "z")]
    FS.write_spans(new, path, "a")
    assert _texts(FS.read_spans(spark, path)) == [("a", "new"), ("b", "z")]
    assert VS.prune(spark, store, "a") == 2
    assert _texts(FS.read_spans(spark, path)) == [("a", "new"), ("b", "z")]
    assert [x for x in sorted(os.listdir(folder)) if x.isdigit()] == ["0000000004"]


def test_two_writers(spark):
    path = _store(spark)
    store = path.rpartition("/")[0]
    base = VS.current(spark, store, "a")
    version = VS.new_version()
    VS.stage(_spans(spark, [("a", 9, "late")]), store, "spans", version)
    FS.write_spans(_spans(spark, [("a", 8, "first")]), path, "a")
    with pytest.raises(VS.ChangedMeanwhile):
        VS.commit(spark, store, "a", base, {"spans": version})
    assert _texts(FS.read_spans(spark, path, "a")) == [("a", "first")]
    # A change of another table of the project does not stand in the way.
    VS.commit(spark, store, "a", base, {"notes": "v1"})
    assert set(VS.current(spark, store, "a")) == {"spans", "notes"}


def test_ingest_switches_all_tables_or_none(spark, monkeypatch):
    root = scratch_path(spark, "projects")
    FS.ingest_project(spark, _csv(spark, 'query,annotations\nab,"[{""text"":""a"",""label"":""l"",""start"":0,""end"":1}]"\n'),
                      "p", root)
    FS.save_vocab(spark, root, "p", spark.createDataFrame([("p", "k", 0, "t")], "project string, key string, pos int, term string"))
    real, done = VS.stage, []

    def third_fails(df, store, table, version):
        done.append(table)
        if len(done) == 3:
            raise OSError("executor folder full")
        real(df, store, table, version)

    with monkeypatch.context() as m:
        m.setattr(VS, "stage", third_fails)
        with pytest.raises(OSError):
            FS.ingest_project(spark, _csv(spark, "query\nother\n"), "p", root)
    t = FS.load_project(spark, root, "p")
    assert [r.query for r in t["docs"].collect()] == ["ab"] and t["spans"].count() == 1
    before = {k: df for k, df in t.items()}
    t = FS.ingest_project(spark, _csv(spark, "query\nother\n"), "p", root)
    assert [r.query for r in t["docs"].collect()] == ["other"] and t["spans"].count() == 0
    assert [r.term for r in t["vocab"].collect()] == ["t"]
    assert before["spans"].count() == 1  # a reader that had begun still has its version


def test_dataset_may_have_a_version_column(spark):
    root = scratch_path(spark, "projects")
    t = FS.ingest_project(spark, _csv(spark, "query,version\nq,7\n"), "p", root)
    assert [(r.query, r.version) for r in t["docs"].collect()] == [("q", "7")]
    with pytest.raises(ValueError, match="_version"):
        FS.ingest_project(spark, _csv(spark, "query,_version\nq,7\n"), "p", root)


def test_null_project(spark):
    path = scratch_path(spark, "store") + "/spans"
    FS.write_spans(_spans(spark, [(None, 0, "x"), ("a", 0, "y")]), path)
    FS.write_spans(_spans(spark, [(None, 0, "z")]), path)
    assert sorted(((r.project or "-"), r.text) for r in FS.read_spans(spark, path).collect()) == [("-", "z"), ("a", "y")]

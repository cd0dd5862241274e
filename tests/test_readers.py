"""Records over several lines read by many tasks; nothing unreadable vanishes from any reader."""

from __future__ import annotations

import csv
import io
import json
import os
import random

import pytest

from spanloom.session import scratch_path
from spanloom.sources import csv_records as CR
from spanloom.sources import files as FS


def _folder(spark, **files):
    d = scratch_path(spark, "in").removeprefix("file:")
    os.makedirs(d)
    for name, data in files.items():
        with open(os.path.join(d, name.replace("__", ".")), "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())
    return d


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _table(seed, n):
    rnd = random.Random(seed)
    parts = ["a", "é", "日本", '"', '""', ",", "\n", "\r\n", "\n\n", " ", "x" * 30, "😀", "'"]
    return [[str(i), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))), rnd.choice(["", "p,q", "z"])]
            for i in range(n)]


def _csv(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["pk", "query", "extra"], *rows])
    return out.getvalue()


def test_csv_over_many_splits(spark, small_splits):
    one, two = _table(1, 120), [[str(1000 + int(r[0])), *r[1:]] for r in _table(2, 60)]
    d = _folder(spark, a__csv="﻿" + _csv(one, "\r\n"), b__csv=_csv(two), c__csv="pk,query,extra\n", d__csv="")
    assert spark.read.text(d).rdd.getNumPartitions() > 10
    rows, rejects = CR.read(spark, d)
    got = sorted(((int(r.pk), r.query or "", r.extra or "") for r in rows.collect()))
    assert got == sorted((int(a), b, c) for a, b, c in one + two)
    assert rejects.count() == 0
    numbered = FS.read_docs_csv(spark, d, "p").orderBy("doc_id").collect()
    assert [r.pk for r in numbered] == [r[0] for r in one + two]
    assert [r.doc_id for r in numbered] == list(range(180))


def test_csv_like_the_whole_file_reader(spark, small_splits):
    d = _folder(spark, a__csv=_csv(_table(5, 150)))
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(d)
    rows, _ = CR.read(spark, d)
    assert rows.columns[:-2] == whole.columns
    assert sorted(map(str, rows.drop("_file", "_record").collect())) == sorted(map(str, whole.collect()))


def test_csv_rejects(spark, small_splits):
    long = "word " * 200
    d = _folder(spark, a__csv=f'pk,query\n1,ok\n2,a,b\n3\n4,"{long}\nx,y"\n\n5,"never closed\n6,swallowed\n',
                b__csv='pk,query\n7,"a,b"\n8,,\n')
    rows, rejects = CR.read(spark, d)
    assert sorted((r.pk, r.query) for r in rows.collect() if r.pk != "3") == [
        ("1", "ok"), ("4", f"{long}\nx,y"), ("7", "a,b")]
    assert [r.query for r in rows.where("pk = '3'").collect()] == [None]
    assert sorted((r.record, r.reason) for r in rejects.collect()) == [(2, "field_count"), (2, "field_count"),
                                                                       (6, "open_quote")]
    root = scratch_path(spark, "projects")
    t = FS.ingest_project(spark, d, "p", root, fmt="csv")
    assert t["docs"].count() == 4 and t["rejects"].count() == 3
    with pytest.raises(ValueError, match="headers"):
        CR.read(spark, _folder(spark, a__csv="a,query\n", b__csv="b,query\n"))
    with pytest.raises(ValueError, match="no header"):
        CR.read(spark, _folder(spark, a__csv=""))
    odd = _folder(spark, a__csv="q,,Q,query\n1,2,3,4\n")
    assert FS.read_docs_csv(spark, odd, "p").columns == ["project", "doc_id", "q0", "_c1", "Q2", "query"]


def test_json_lines_and_arrays(spark):
    d = _folder(spark, a__jsonl='{"query": "a"}\n{"query": "b"\n{"query": "c", "n": [1]}\n\nnonsense\n')
    docs, rejects = FS.read_docs_json_checked(spark, d, "p", multiline=False)
    assert docs.columns == ["project", "doc_id", "n", "query"]
    assert [(r.doc_id, r.query, r.n) for r in docs.orderBy("doc_id").collect()] == [(0, "a", None), (1, "c", "[1]")]
    assert [r.reason for r in rejects.collect()] == ["invalid_line"] * 2
    d = _folder(spark, a__json='[{"query": "a"}]', b__json='[{"query": "b"}, {"que')
    docs, rejects = FS.read_docs_json_checked(spark, d, "p")
    assert [r.query for r in docs.collect()] == ["a"] and [r.reason for r in rejects.collect()] == ["invalid_file"]
    t = FS.ingest_project(spark, _folder(spark, a__json='{"query": "x"}\n{"query"'), "p", scratch_path(spark, "r"),
                          fmt="jsonl")
    assert t["docs"].count() == 1 and [r.reason for r in t["rejects"].collect()] == ["invalid_line"]


def test_layout_reads_only_the_beginning(spark):
    assert FS.json_layout(spark, _folder(spark, a__json="﻿\n  [1", b__json="")) == "json"
    assert FS.json_layout(spark, _folder(spark, a__json='{"a": 1}\n' * 3)) == "jsonl"
    with pytest.raises(ValueError, match="mixes"):
        FS.json_layout(spark, _folder(spark, a__json="[]", b__json="{}"))


def test_store_objects(spark):
    ann = [{"text": "a", "label": "l", "start": 0, "end": 1}]
    d = _folder(spark, good_annotations__json="﻿" + json.dumps({"0": ann, "x": ann, "-1": [], "2": None}),
                cut_annotations__json=json.dumps({"0": ann})[:-1], list_annotations__json="[1]",
                two_annotations__json=json.dumps({"0": ann}) + " {}", empty_annotations__json="")
    spans, rejects = FS.read_legacy_store(spark, d)
    assert [(r.project, r.doc_id) for r in spans.collect()] == [("good", 0)]
    assert sorted((r.project, r.reason) for r in rejects.collect()) == [
        ("cut", "invalid_file"), ("empty", "invalid_file"), ("good", "invalid_key"), ("list", "invalid_file"),
        ("two", "invalid_file")]


@pytest.mark.parametrize("kind", ["vocab", "label_map"])
def test_key_lists(spark, kind):
    checked = getattr(FS, f"read_{kind}_checked")
    strict = getattr(FS, f"read_{kind}")
    files = {f"good_{kind}__json": json.dumps({"k": ["x", None, 1.0, {"a": 1}], "b": "y", "n": 5, "none": None, "e": []}),
             f"cut_{kind}__json": '{"k": ["x"]', f"list_{kind}__json": '["x"]',
             f"junk_{kind}__json": '{"k": ["x"]} y', f"obj_{kind}__json": '{"k": ["x"], "o": {"a": 1}}'}
    rows, bad = checked(spark, _folder(spark, **files))
    first, last = (rows.columns[1], rows.columns[3])
    got = sorted((r.project, r[first], -1 if r.pos is None else r.pos, str(r[last])) for r in rows.collect())
    assert got == [("good", "b", 0, "y"), ("good", "e", -1, "None"), ("good", "k", 0, "x"), ("good", "k", 1, "None"),
                   ("good", "k", 2, "1.0"), ("good", "k", 3, '{"a":1}'), ("good", "n", 0, "5"),
                   ("good", "none", -1, "None"), ("obj", "k", 0, "x")]
    assert sorted((r.project, r.key or "-", r.reason) for r in bad.collect()) == [
        ("cut", "-", "invalid_file"), ("junk", "-", "invalid_file"), ("list", "-", "invalid_file"),
        ("obj", "o", "not_list")]
    with pytest.raises(ValueError, match="invalid_file"):
        strict(spark, _folder(spark, **files))
    lines = _folder(spark, p__jsonl='{"key": "k", "terms": ["x", 2]}\n{"key": "s", "terms": "one word"}\n{"key"\n'
                                    '{"terms": ["y"]}\n{"key": "o", "terms": {"a": 1}}\n')
    rows, bad = checked(spark, lines, "p", "lines")
    assert sorted((r[first], r[last]) for r in rows.collect()) == [("k", "2"), ("k", "x"), ("s", "one word")]
    assert sorted(r.reason for r in bad.collect()) == ["invalid_line", "no_key", "not_list"]

"""Readers and writers: CSV / JSON datasets, legacy store, vocabulary files, projects."""

from __future__ import annotations

import json
import os

import pytest

from spanloom.operators.ingest import SchemaError, require_query
from spanloom.session import scratch_path
from spanloom.sources import files as FS


def _write(path: str, name: str, data: bytes) -> str:
    path = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(path, exist_ok=True)
    p = os.path.join(path, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_csv_bom_quotes_newlines_and_order(spark):
    d = scratch_path(spark, "csv")
    text = ('﻿query,annotations,extra\r\n'
            '联想拯救者y九千,,a\r\n'
            '"华为mate50,手机","[{""text"": ""华为"", ""label"": ""品牌"", ""start"": 0, ""end"": 2}]",b\r\n'
            '"two\nlines",[],c\r\n'
            'NA,,d\r\n')
    p = _write(d, "sample.csv", text.encode("utf-8"))
    df = FS.read_docs_csv(spark, p, "demo")
    rows = sorted((r.doc_id, r.query, r.extra) for r in df.collect())
    assert rows == [(0, "联想拯救者y九千", "a"), (1, "华为mate50,手机", "b"), (2, "two\nlines", "c"),
                    (3, "NA", "d")]
    assert df.columns[:3] == ["project", "doc_id", "query"]


def test_require_query(spark):
    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(SchemaError):
        require_query(df)


def test_json_array_dataset(spark):
    d = scratch_path(spark, "json")
    recs = [{"query": "苹果macbook pro", "annotations": []}, {"query": "小米电视4s", "n": 5}]
    p = _write(d, "data.json", json.dumps(recs, ensure_ascii=False).encode("utf-8"))
    df = FS.read_docs_json(spark, p, "demo")
    assert sorted((r.doc_id, r.query) for r in df.collect()) == [(0, "苹果macbook pro"), (1, "小米电视4s")]


def test_legacy_store(spark):
    d = scratch_path(spark, "legacy")
    store = {"0": [{"text": "华为", "label": "品牌", "start": 0, "end": 2,
                    "mapped_value": {"brand": "华为"}}],
             "1": [], "2": "not a list"}
    _write(d, "demo_annotations.json", json.dumps(store, ensure_ascii=False).encode("utf-8"))
    spans, rejects = FS.read_legacy_store(spark, d)
    got = [(r.project, r.doc_id, r.text, r.mapped_value) for r in spans.collect()]
    assert got == [("demo", 0, "华为", {"brand": ["华为"]})]
    assert [(r.doc_id, r.reason) for r in rejects.collect()] == [(2, "invalid_json")]


def test_vocab_object_and_lines_round_trip(spark):
    d = scratch_path(spark, "vocab")
    _write(d, "demo_vocab.json", json.dumps(
        {"品牌": ["联想", "华为"], "型号": ["Mate50", 4.0], "空": []}, ensure_ascii=False).encode("utf-8"))
    v = FS.read_vocab(spark, d + "/demo_vocab.json")
    rows = sorted((r.project, r.key, -1 if r.pos is None else r.pos, r.term) for r in v.collect())
    assert rows == [("demo", "品牌", 0, "联想"), ("demo", "品牌", 1, "华为"), ("demo", "型号", 0, "Mate50"),
                    ("demo", "型号", 1, "4.0"), ("demo", "空", -1, None)]
    out = scratch_path(spark, "vocab-lines")
    FS.write_vocab(v, out, fmt="lines")
    back = FS.read_vocab(spark, out, fmt="lines")
    assert sorted((r.key, -1 if r.pos is None else r.pos, r.term) for r in back.collect()) == \
        sorted((k, p, t) for _, k, p, t in rows)


def test_ingest_and_load_project(spark):
    d = scratch_path(spark, "ingest")
    p = _write(d, "demo.csv", "query\n华为mate50手机\n小米电视4s\n".encode("utf-8"))
    root = scratch_path(spark, "projects")
    t = FS.ingest_project(spark, p, "demo", root)
    assert t["docs"].count() == 2 and t["spans"].count() == 0
    assert t["label_map"].where("label = 'cpu'").count() == 5  # default map
    listed = FS.list_projects(t["docs"], t["spans"], None, t["label_map"]).collect()
    assert [(r.project, r.n_docs, r.n_spans, r.has_label_map) for r in listed] == [("demo", 2, 0, True)]

"""Nothing is lost or re-typed: project replacement, readers, replay keys, long and inverted spans."""

from __future__ import annotations

import json
import os
import random

import pytest

from spanloom.functions.mapping import normalize_value
from spanloom.operators import edits as E
from spanloom.operators import ingest as I
from spanloom.operators import spans as S
from spanloom.operators import vocab as V
from spanloom.schema import EDITS, SPANS
from spanloom.session import scratch_path
from spanloom.sources import files as FS
from pyspark.sql import functions as F


def _file(spark, name, text):
    d = scratch_path(spark, "loss").removeprefix("file:")
    os.makedirs(d)
    path = os.path.join(d, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


ANN = json.dumps([{"text": "a", "label": "x", "start": 0, "end": 1}])


def test_replacing_a_project_leaves_nothing_of_the_old_one(spark):
    root = scratch_path(spark, "projects")
    first = _file(spark, "a.jsonl", json.dumps({"query": "abc", "annotations": json.loads(ANN)}) + "\n"
                  + json.dumps({"query": "abd", "annotations": "junk"}))
    t = FS.ingest_project(spark, first, "demo", root)
    assert t["spans"].count() == 1 and t["rejects"].count() == 1
    FS.ingest_project(spark, first, "other", root)
    t = FS.ingest_project(spark, _file(spark, "b.csv", "query\nxyz\n"), "demo", root)
    assert [r.query for r in t["docs"].collect()] == ["xyz"]
    assert t["spans"].count() == 0 and t["rejects"].count() == 0
    assert FS.load_project(spark, root, "other")["spans"].count() == 1
    FS.write_spans(FS.load_project(spark, root, "other")["spans"].limit(0), f"{root}/spans", "other")
    assert FS.load_project(spark, root, "other")["spans"].count() == 0


def test_project_names_stay_text(spark):
    root = scratch_path(spark, "projects")
    src = _file(spark, "a.csv", "query\nq\n")
    for name in ("007", "7", "手机 项目", "a+b"):
        t = FS.ingest_project(spark, src, name, root)
        assert [r.project for r in t["docs"].collect()] == [name]
    assert {r.project for r in spark.read.schema("query string, doc_id long, project string")
            .parquet(f"{root}/docs").collect()} == {"007", "7", "手机 项目", "a+b"}
    with pytest.raises(LookupError):
        FS.load_project(spark, root, "none")
    path = _file(spark, "手机 a+b_vocab.json", '{"k": ["t", 1]}')
    assert {r.project for r in FS.read_vocab(spark, path).collect()} == {"手机 a+b"}


def test_saved_artefacts_and_defaults(spark):
    root = scratch_path(spark, "projects")
    t = FS.ingest_project(spark, _file(spark, "a.csv", "query\nq\n"), "p", root)
    assert t["vocab"].count() == 0 and t["label_map"].where("label = 'cpu'").count() == 5
    FS.save_vocab(spark, root, "p", spark.createDataFrame([("p", "k", 0, "t")], "project string, key string, pos int, term string"))
    lm = spark.createDataFrame([("p", "l", 0, "c")], "project string, label string, pos int, category string")
    FS.save_label_map(spark, root, "p", lm)
    t = FS.load_project(spark, root, "p")
    assert [r.term for r in t["vocab"].collect()] == ["t"] and [r.category for r in t["label_map"].collect()] == ["c"]
    FS.save_label_map(spark, root, "p", t["label_map"].withColumn("category", F.lit("d")))
    t = FS.ingest_project(spark, _file(spark, "b.csv", "query\nr\n"), "p", root)
    assert [r.category for r in t["label_map"].collect()] == ["d"]
    out = scratch_path(spark, "lm")
    FS.write_label_map(lm, out)
    assert [tuple(r) for r in FS.read_label_map(spark, out, fmt="lines").collect()] == [("p", "l", 0, "c")]


def test_json_datasets(spark):
    rows = [{"query": "q1", "annotations": [{"text": "a", "label": "x", "start": 0, "end": 1,
                                             "mapped_value": {"z": 0, "f": False, "v": ["a", None, 2]}}]},
            {"query": "q2", "annotations": [{"text": "a", "label": "x", "start": 0, "end": 1, "mapped_value": 5}]},
            {"query": " q3 ", "annotations": None}]
    for name, text in (("a.json", json.dumps(rows)), ("b.json", "\n".join(map(json.dumps, rows))),
                       ("c.jsonl", "\n".join(map(json.dumps, rows)))):
        root = scratch_path(spark, "projects")
        t = FS.ingest_project(spark, _file(spark, name, text), "p", root)
        assert sorted(r.query for r in t["docs"].collect()) == [" q3 ", "q1", "q2"]
        maps = sorted((r.mapped_value for r in t["spans"].collect()), key=len)
        assert maps == [{}, {"z": [], "f": [], "v": ["a", None, "2"]}]
    with pytest.raises(ValueError):
        FS.ingest_project(spark, _file(spark, "d.json", "\n".join(map(json.dumps, rows))), "p",
                          scratch_path(spark, "projects"), fmt="json")


def test_csv_keeps_outer_spaces_and_keys(spark):
    rows = [("1", "  apple "), ("2", "\ttab"), ("30", 'q"uo,te\nline')]
    path = scratch_path(spark, "csv")
    FS.write_docs_csv(spark.createDataFrame(rows, "pk string, query string"), path)
    got = FS.read_docs_csv(spark, path, "p", key="pk")
    assert sorted((r.pk, r.query, r.doc_id) for r in got.collect()) == sorted((k, q, int(k)) for k, q in rows)
    bad = FS.read_docs_csv(spark, _file(spark, "k.csv", "pk,query\n007,a\n7,b\n"), "p", key="pk")
    with pytest.raises(Exception, match="no plain integer"):
        bad.collect()


def test_store_lines_are_normalised_or_rejected(spark):
    path = _file(spark, "s.jsonl", "\n".join([
        json.dumps({"project": "p", "doc_id": 1, "annotations": [
            {"text": "a", "label": "l", "start": 0, "end": 1, "mapped_value": {"c": "x", "d": ["y"]}}]}),
        "not json", json.dumps({"project": "p", "doc_id": 2, "annotations": []})]))
    spans, rejects = FS.read_annotation_store_checked(spark, path)
    assert [r.mapped_value for r in spans.collect()] == [{"c": ["x"], "d": ["y"]}]
    assert [r.reason for r in rejects.collect()] == ["invalid_line"]


def test_text_after_the_list_is_rejected(spark):
    cells = ["[]", " [ ] ", "[] []", '[{"text":"a"}] junk]', "[], []", "[]] [[]", '[]}, {"a":[]', '["]"]', "[1"]
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate(cells)], "project string, doc_id long, annotations string")
    bad = {r.doc_id for r in I.parse_annotations(df)[1].where("elem is null").collect()}
    assert bad == {2, 3, 4, 5, 6, 8}


def test_blank_labels_and_null_values(spark):
    old = spark.createDataFrame([], "project string, pos int, label string")
    new = spark.createDataFrame([("p", x, i) for i, x in enumerate([" a ", "", " ", "\t", "\n", "　", " \x1c", None])],
                                "project string, label string, seq int")
    assert [r.label for r in V.add_labels(old, new).collect()] == [" a "]
    v = spark.range(1).select(normalize_value(F.parse_json(F.lit('["a", null, 1]'))).alias("v"))
    assert v.first().v == ["a", None, "1"]


def _plain_replay(rows):
    out = {}
    seen = set()
    for r in sorted((r for r in rows if r[2] is not None), key=lambda r: r[2]):
        if (r[0], r[1], r[2]) in seen:
            continue
        seen.add((r[0], r[1], r[2]))
        spans = out.setdefault((r[0], r[1]), [])
        if not any(not (r[7] <= a or r[6] >= b) for a, b in spans):
            spans.append((r[6], r[7]))
    return out


def test_replay_keeps_large_and_null_keys(spark):
    big = 2 ** 53
    rows = [("p", 1, big, "add", None, "a", "l", 0, 5), ("p", 1, big + 1, "add", None, "b", "l", 5, 9),
            ("p", 1, big + 1, "add", None, "b", "l", 5, 9), ("p", 1, None, "add", None, "n", "l", 20, 21),
            ("p", None, 0, "add", None, "a", "l", 0, 5), ("p", None, 1, "add", None, "b", "l", 3, 7),
            (None, 2, 0, "add", None, "a", "l", 0, 2 ** 40), (None, 2, 1, "add", None, "b", "l", 2 ** 39, 2 ** 39 + 1),
            (None, 2, 2, "add", None, "c", "l", 2 ** 40, 2 ** 40 + 3)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], EDITS)
    state, outcomes = E.replay_all(df)
    got = {}
    for r in sorted(state.collect(), key=lambda r: r.ord):
        got.setdefault((r.project, r.doc_id), []).append((r.start, r.end))
    assert got == _plain_replay([(r[0], r[1], r[2], *r[3:6], r[7], r[8]) for r in rows])
    assert sorted(r.outcome for r in outcomes.collect()) == ["accepted"] * 5 + ["no_seq", "overlap", "overlap"]


def test_greedy_add_is_one_rule_for_every_size(spark, monkeypatch):
    """Inverted, empty and nested spans: both folds equal the plain loop."""
    rnd = random.Random(8)
    rows, expect = [("p", 0, 0, 10, 5), ("p", 0, 1, 6, 12), ("p", 0, 2, 0, 3)], {}
    for d in range(1, 60):
        for q in range(rnd.randint(1, 14)):
            a = rnd.randint(0, 12)
            rows.append(("p", d, q, a, a + rnd.randint(-5, 5)))
    for p, d, q, s, e in rows:
        kept = expect.setdefault(d, [])
        if not any(not (e <= a or s >= b) for _, a, b in kept):
            kept.append((q, s, e))
    df = spark.createDataFrame([(*r, "t", "l") for r in rows],
                               "project string, doc_id long, seq long, start long, end long, text string, label string")
    for limit in (1000, 0):
        monkeypatch.setattr(S, "ISLAND_FOLD_MAX", limit)
        got = {}
        for r in S.add_spans(None, df)[1].where("accepted").collect():
            got.setdefault(r.doc_id, set()).add(r.seq)
        assert got == {d: {q for q, _, _ in k} for d, k in expect.items()}


def test_all_requests_of_a_row_apply(spark):
    spans = spark.createDataFrame([("p", 1, i, f"t{i}", "l", i, i + 1, {}) for i in range(5)], SPANS)
    req = spark.createDataFrame([("p", 1, 0, 0), ("p", 1, 3, 1), ("p", 1, 3, 2), ("p", 1, 9, 3)],
                                "project string, doc_id long, ord long, seq long")
    out = sorted((r.ord, r.text) for r in S.remove_span(spans, req).collect())
    assert out == [(0, "t1"), (1, "t2"), (2, "t4")]
    upd = req.withColumns({"text": F.concat(F.lit("u"), "seq"), "label": F.lit("n"), "start": F.lit(0), "end": F.lit(1)})
    assert sorted((r.ord, r.text) for r in S.update_span(spans, upd).collect()) == [
        (0, "u0"), (1, "t1"), (2, "t2"), (3, "u2"), (4, "t4")]


def test_long_spans(spark):
    rows = [("p", 1, 0, 0, 2 ** 40), ("p", 1, 1, 5, 9), ("p", 1, 2, 2 ** 40, 2 ** 40 + 1), ("p", 1, 3, 7, 7),
            ("p", 1, 4, 2 ** 39, 2 ** 41), ("p", 2, 0, 5, 9)]
    df = spark.createDataFrame(rows, "project string, doc_id long, ord long, start long, end long")
    got = sorted((r.ord_a, r.ord_b) for r in S.overlap_pairs(df).collect())
    assert got == [(0, 1), (0, 3), (0, 4), (1, 3), (2, 4)]

"""CSV records over batches and splits of any size; no task sorts or collects the lines of a split."""

from __future__ import annotations

import csv
import io
import random

import pytest

from spanloom.sources import csv_records as C
from spanloom.sources import files as FS


def _write(folder, files):
    for k, text in enumerate(files):
        with open(f"{folder}/f{k}.csv", "w", newline="") as f:
            f.write(text)
    return str(folder)


@pytest.mark.parametrize("rows,split", [(1, "1k"), (3, "300b"), (1000, "64m")])
def test_records_in_any_batches_and_splits(spark, monkeypatch, tmp_path, rows, split):
    monkeypatch.setattr(C, "BATCH_ROWS", rows)
    rnd = random.Random(rows)
    files, want = [], []
    for k in range(3):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(["pk", "query"])
        for i in range(120):
            text = "\n".join(rnd.choice(['', 'a,"b"', "x" * rnd.randrange(40), "é"]) for _ in range(rnd.choice([1, 1, 2, 30])))
            w.writerow([k * 1000 + i, "q" + text])
            want.append((k * 1000 + i, "q" + text))
        files.append(out.getvalue() + ('9999,"never\nclosed\n' * (k == 2)))
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
    before = {c: spark.conf.get(c, None) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        docs, rejects = FS.read_docs_csv_checked(spark, _write(tmp_path, files), "p", key="pk")
        assert sorted((r.doc_id, r.query) for r in docs.collect()) == sorted(want)
        assert [r.reason for r in rejects.collect()] == ["open_quote"]
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_lines_are_not_sorted(spark, monkeypatch, tmp_path):
    plans = {}
    real = C.materialize

    def spy(df, name="stage"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(C, "materialize", spy)
    FS.read_docs_csv(spark, _write(tmp_path, ['pk,query\n1,"a\nb"\n2,c\n']), "p", key="pk")
    assert not any(x in plans["csv-lines"] for x in ("Window", "Sort", "Aggregate"))
    lines = plans["csv-joined"].split("Join Inner")[1].splitlines()
    assert "MapInArrow" in plans["csv-joined"] and "broadcast" in lines[0]

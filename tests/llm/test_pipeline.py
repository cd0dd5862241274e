"""Stages on planted documents; registered queries against their SQL."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from spanloom.session import materialize
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    rnd = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    words = [f"v{rnd.random()}" for _ in range(120)]
    extra = [(10_001, " ".join(words)), (10_002, " ".join([*words[:60], "changed", *words[61:]])),
             (10_003, "before " + item + " after"), (10_004, "plain text with a.b@example.com inside of it"),
             (10_005, None), (10_006, ""), (10_004, "plain text with a.b@example.com inside of it")]
    more = spark.createDataFrame([(*r, "en", "s", 1) for r in extra],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    got = {r["doc_id"]: r for r in docs.where("doc_id > 10000").collect()}
    assert docs.where("doc_id = 10004").count() == 1
    assert set(got) == {10_001, 10_004, 10_005, 10_006}
    assert "<EMAIL>" in got[10_004]["text"] and got[10_004]["n_tokens"] == len(got[10_004]["ids"]) > 0
    assert got[10_005]["text"] is None and got[10_005]["ids"] == []


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_oracle(spark, name):
    assert compare(spark, SF, [name], verbose=False)[name][0] == "ok"

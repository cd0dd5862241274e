"""The forward sum against all segmentations, the counts against finite differences, held-out accuracy."""

import zlib
from dataclasses import replace

import numpy as np
import pytest

from spanloom.llm import language_id as op
from spanloom.llm.pieces import UNIGRAM, Transducer, read_model

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fst():
    return Transducer(replace(read_model(op.MODEL), kind=UNIGRAM))


def test_forward_and_expected_counts(fst):
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(fst.size + 1), 3).T)

    def brute(s):
        if not s:
            return np.zeros(3)
        out = np.full(3, -np.inf)
        for k in range(1, len(s) + 1):
            i = fst.ids.get(s[:k], fst.oov if k == 1 else None)
            if i is not None:
                out = np.logaddexp(out, logp[i] + brute(s[k:]))
        return out

    words = ["thereon", "ciónue", "ß€x", "a", "über", "the"]
    lattice = op.Lattice(fst, [w.encode() for w in words])
    logs = lattice.word_logs(logp)
    for w, got in zip(words, logs, strict=True):
        assert np.allclose(got, brute("▁" + w))
    freq = rng.integers(1, 9, (len(words), 3)).astype(float)
    counts = lattice.expected(logp, freq)
    for piece in (fst.ids["the"], fst.ids["▁the"], fst.ids["n"], fst.oov):
        up, down = logp.copy(), logp.copy()
        up[piece] += 1e-5
        down[piece] -= 1e-5
        slope = ((lattice.word_logs(up) - lattice.word_logs(down)) * freq).sum(axis=0) / 2e-5
        assert np.allclose(counts[piece], slope, atol=1e-4)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(
        [(10_001, None, "en"), (10_002, "", "en"), (10_003, "123 ?!", None), (10_006, "² ½ Ⅷ 12", None), (10_004, "Ünß", None),
         (None, "the thing", "de"), (10_005, "x" * 30_000, None), (10_005, "x" * 30_000, None)],
        "doc_id long, text string, lang string")
    out = op.language_id(docs.unionByName(odd).withColumn("score", docs["doc_id"] * 0)).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in out if r["held_out"] and r["doc_id"] in lang]
    assert len(out) == 1008
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    by = {r["doc_id"]: r for r in out}
    for i in (10_001, 10_002, 10_003, 10_006):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[10_004]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in op.language_id(df).collect()] == ["und"]
    assert op.language_id(df.limit(0)).count() == 0

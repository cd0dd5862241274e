"""Encoding against the public library's own encoder, decoding as an exact round trip."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from spanloom.llm import pieces
from spanloom.llm import sentencepiece_fst as op

sp = pytest.importorskip("sentencepiece")

TEXTS = ["", " ", "  hello  world\n\n\tx é 你 ́", "<s> a </s> <0x41>", "a" * 50, " " * 37 + "x",
         "\x00\x01\ufeff\u200b", "ﬁ①Ａ", "    if x:\n        return y\n", "1234567890" * 3,
         "don’t “quote”… — ×≠∑", "日本語テキスト処理", "🙂🙂👩‍👩‍👧", "the " * 400, "x" * 5000]


@pytest.fixture(scope="module")
def fst():
    return pieces.Transducer(pieces.read_model(op.MODEL))


@pytest.fixture(scope="module")
def library():
    return sp.SentencePieceProcessor(model_file=op.MODEL)


def random_texts(n, seed=0):
    rnd = random.Random(seed)
    parts = ["a", "b", "the", "ing", " ", "  ", "   ", "\n", "é", "ç", "1", "x", "er", "▁", ".", ",", "in", "st"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_equals_library(fst, library):
    for text in TEXTS + random_texts(600):
        ids, _ = fst.encode_words(fst.chunks(text))
        assert ids.tolist() == library.encode(text), text
        assert fst.decode(ids.tolist()) == library.decode(library.encode(text)), text


def test_unigram_path_is_the_cheapest():
    """A small unigram model: the path found equals the minimum over all segmentations."""
    words = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.2, "aba": -3.1, "▁": -1.0, "▁a": -1.7}
    m = pieces.PieceModel(list(words), list(words.values()), [pieces.NORMAL] * len(words),
                          pieces.UNIGRAM, True, False)
    fst = pieces.Transducer(m)

    def cheapest(s):
        if not s:
            return 0.0
        return min((-words[s[:k]] + cheapest(s[k:]) for k in range(1, len(s) + 1) if s[:k] in words))

    for text in ("abab", "a", "babaab", "aabbaa"):
        chunk = fst.chunks(text)
        ids, _ = fst.encode_words(chunk)
        assert np.isclose(fst.cost[ids].sum(), cheapest("".join(chunk)))
        assert fst.decode(ids.tolist()) == text


def test_operator_nulls_repeats_and_other_columns(spark, library, tiny_slices):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "hello▁x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = op.encode(df, check=True).collect()
    assert len(out) == 5
    for r in out:
        assert r["ids"] == library.encode(r["text"] or "")
        assert r["round_trip"] == ("▁" not in (r["text"] or ""))
    back = op.decode(op.encode(df)).collect()
    assert {(r["text"] or "").replace("▁", " ") == r["decoded"] for r in back} == {True}
    assert op.encode(df.limit(0)).count() == 0


def test_long_random_texts(spark, library):
    texts = [" ".join(random_texts(50, seed=s)) for s in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op.encode(df).collect():
        assert r["ids"] == library.encode(r["text"])


def test_memory_of_a_worker_on_a_batch_of_many_words(spark):
    """A batch of 3 MB, nearly all words new: lists and tables of a small part of it at a time."""
    rnd = random.Random(5)
    texts = [" ".join(f"{rnd.getrandbits(24):x}" for _ in range(400)) for _ in range(1000)]
    docs = SimpleNamespace(sparkSession=spark, columns=["text"], schema=StructType.fromDDL("text string"),
                           drop=lambda *names: docs, mapInArrow=lambda run, schema: run)
    run = op.encode(docs)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    op._ENCODERS.clear()
    list(run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    try:
        n = sum(out.num_rows for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        op._ENCODERS.clear()
    assert n == len(texts)
    assert peak < 60e6, peak


def test_batches_are_bounded_in_rows_and_bytes(spark):
    from spanloom.llm import common
    keys = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    old = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        common.small_batches(spark)
        assert [spark.conf.get(k) for k in keys] == [str(common.BATCH_ROWS), str(common.BATCH_BYTES)]
        for k in keys:
            spark.conf.set(k, "7")
        common.small_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["7", "7"]
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)

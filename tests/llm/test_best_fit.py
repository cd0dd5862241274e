"""Ids against the tokenizer, placement against a plain best-fit loop, the packed sequences themselves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import best_fit as op
from spanloom.session import materialize

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(op.VOCABULARY)


@pytest.fixture(scope="module")
def units():
    return op.Words(op.read_vocabulary(op.VOCABULARY))


def ids_of(units, text):
    ids, off = op.encode_texts(pa.array([text, None, text]), units, op.END)
    first = ids[:off[1]].tolist()
    assert ids[off[1]:off[2]].tolist() == [op.END] and ids[off[2]:].tolist() == first and first[-1] == op.END
    return first[:-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(
    st.characters(codec="utf-8"), st.sampled_from(list("abAB'sStT \n\t\x1c\x85 ÀÉßœŒİıΣςſ0½²<|>endoftxfá"))),
    max_size=60))
def test_ids(tokenizer, units, text):
    assert ids_of(units, text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_special_names(tokenizer, units):
    for text in ("a<|endoftext|>b <|startoftext|>", "<|EndOfText|> I'LL don't 's", "x y z　w", ""):
        assert ids_of(units, text) == tokenizer.encode(text, add_special_tokens=False).ids


def plain(lengths, capacity, limit):
    """Best fit by looking at every open bin; the one filled last wins a tie."""
    bins, made, out = [], 0, []  # [number, free]
    for n in lengths:
        best = min((b for b in bins if b[1] >= n), key=lambda b: (b[1], -bins.index(b)), default=None)
        if best is None:
            if len(bins) == limit:
                bins.remove(min(bins, key=lambda b: (b[1], -bins.index(b))))
            best = [made, capacity]
            made += 1
        else:
            bins.remove(best)
        out.append((best[0], capacity - best[1]))
        best[1] -= n
        if best[1]:
            bins.append(best)
    return out


def test_bins():
    rnd = random.Random(1)
    for capacity, limit, n in ((10, 3, 400), (64, 1, 200), (64, 8, 800), (4096, 16, 600)):
        lengths = [rnd.randint(1, capacity) for _ in range(n)]
        bins = op.OpenBins(capacity, limit)
        assert [bins.place(x) for x in lengths] == plain(lengths, capacity, limit)


def test_packing(spark, tiny_slices, tokenizer):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["a", "Straße", "naïve's", "日本", "12"]) for _ in range(rnd.randint(0, 90))), "s", 9)
            for i in range(150)]
    rows += [(500, None, "s", 9), (501, "", "s", 9), (3, rows[3][1], "s", 9), (None, "one two", "s", 9),
             (502, "long text é " * 3000, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int").repartition(3)
    pieces = materialize(op.tokenise(docs, capacity=64), "pieces")
    packed = op.pack(pieces, capacity=64, open_bins=16, per_task=100)
    assert packed.rdd.getNumPartitions() > 1
    packed = materialize(packed, "packed")
    got = packed.collect()
    by_seq, by_doc = {}, {}
    for r in got:
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
    for parts in by_seq.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for doc, text, *_ in rows[:2] + rows[150:]:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [op.END]
        parts = sorted(by_doc[doc])[::2] if doc == 3 else sorted(by_doc[doc])
        assert np.frombuffer(b"".join(p[3] for p in parts), "<u4").tolist() == want
        assert [p[1] for p in parts] == [64 * k for k in range(len(parts))] and all(p[2] == 64 for p in parts[:-1])
    total = sum(r["length"] for r in got)
    assert len(by_seq) <= 1.1 * -(-total // 64) + 16 * 2
    whole = {r["sequence_id"]: r for r in op.sequences(packed).collect()}
    assert {k: bytes(r["ids"]) for k, r in whole.items()} == {
        k: b"".join(x[2] for x in sorted(v)) for k, v in by_seq.items()}
    assert sum(len(r["pieces"]) for r in whole.values()) == len(got)


def test_empty(spark):
    pieces = materialize(op.tokenise(spark.createDataFrame([], "doc_id long, text string")), "pieces")
    assert op.pack(pieces).count() == 0

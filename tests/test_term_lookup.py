"""The look-up of terms by running hashes against str.find, and the greedy sweep against a plain one."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from spanloom.operators import match as M


@pytest.mark.parametrize("bits", [18, 1])
def test_first_places_equal_find(monkeypatch, bits):
    monkeypatch.setattr(M, "SLOT_BITS", bits)
    rnd = random.Random(bits)
    texts = ["".join(rnd.choice("ab😀é\0") for _ in range(rnd.randrange(1, 90))) for _ in range(60)] + ["ab" * 40]
    terms = {"".join(rnd.choice("ab😀é\0") for _ in range(rnd.randrange(1, 5))) for _ in range(80)}
    terms |= {t[a:a + k] for t in texts for a, k in [(rnd.randrange(len(t)), rnd.choice([1, 7, 16, 17, 40]))]}
    terms |= {"ab" * 8 + "x", "ab" * 9, "z"}
    index = M.TermIndex(list(terms))
    got = {(int(i), index.terms[t]): int(p) for i, t, p in zip(*index.find(texts), strict=True)}
    assert got == {(i, t): x.find(t) for i, x in enumerate(texts) for t in terms if t in x}


def test_equal_hashes_are_told_apart(monkeypatch):
    """With every hash equal, each place is still decided by the term itself."""
    monkeypatch.setattr(M, "_running", lambda text: tuple(M.np.zeros(len(text) + 1, M.np.uint64) for _ in range(3)))
    index = M.TermIndex(["a", "b", "ba", "ac", "abc"])
    got = {(int(i), index.terms[t]): int(p) for i, t, p in zip(*index.find(["cba", "xxabac"]), strict=True)}
    assert got == {(0, "a"): 2, (0, "b"): 1, (0, "ba"): 1, (1, "a"): 2, (1, "b"): 3, (1, "ba"): 3, (1, "ac"): 4}


def test_sweep_over_batches():
    rnd = random.Random(2)
    rows = sorted((p, d, rnd.randrange(60), -rnd.randrange(1, 9), "l", 0, "k", "t") for p in ("a", "b") for d in (1, 2)
                  for _ in range(40))
    names = ["project", "doc_id", "start", "neg_len", "label", "pos", "key", "text"]
    want, state = [], {}
    for r in rows:
        end, n = state.get(r[:2], (0, 0))
        if r[2] >= end:
            want.append((*r, n))
            state[r[:2]] = (r[2] - r[3], n + 1)
    for size in (1, 7, 500):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[a:a + size]])
                   for a in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in M._sweep(iter(batches)) for r in b.to_pylist()]
        assert got == want

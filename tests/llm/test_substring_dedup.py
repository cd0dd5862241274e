"""Every window by brute force, over slices and buckets small enough that repeats cross them."""

import hashlib
import random

import numpy as np

from spanloom.llm import substring_dedup as op


def brute(docs, size):
    """Per row (n_words, n_removed, kept); a null id is larger than every id."""
    big = 1 << 62
    first = {}
    rows = [(big if i is None else i, (t or "").encode().split()) for i, t in docs]
    for i, w in rows:
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, big), i)
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone |= set(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def random_docs(seed, n, vocab):
    rnd = random.Random(seed)
    word = [f"w{k}" for k in range(vocab)] + ["é", "ü x"]
    passages = [[rnd.choice(word) for _ in range(rnd.randint(6, 30))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(word) for _ in range(rnd.randint(0, 25))]
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    return docs


def test_against_brute_force(spark, tiny_slices, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_ENTRIES", 40)
    for seed, vocab in ((1, 400), (2, 3)):
        docs = random_docs(seed, 60, vocab)
        docs += [(500, None), (501, ""), (7, docs[7][1]), (7, docs[8][1]), (None, docs[9][1]), (600, docs[3][1]),
                 (601, "x " * 30)]
        random.Random(9).shuffle(docs)
        df = spark.createDataFrame([(*d, b"1") for d in docs], "doc_id long, text string, runs binary")
        out = op.substring_dedup(df.repartition(3), size=10).collect()
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in out)
        assert got == sorted((str(i), *x) for (i, _), x in zip(docs, brute(docs, 10), strict=True))
        assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in out)


def test_production_size(spark):
    rnd = random.Random(1)
    passage = [f"p{rnd.random()}" for _ in range(60)]

    def fresh(n):
        return [f"f{rnd.random()}" for _ in range(n)]

    docs = [(1, " ".join(fresh(13) + passage + fresh(5))), (2, " ".join(fresh(40) + passage + fresh(7))),
            (3, " ".join(passage[:49] + fresh(60))), (4, " ".join(fresh(31) + passage[5:55]))]
    out = {r["doc_id"]: r["n_removed"] for r in op.substring_dedup(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 60, 3: 0, 4: 50}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.substring_dedup(df).count() == 0


def test_packing():
    for pos in ([], [0], [5, 6, 9], [0, 70_000, 70_001]):
        assert op.unpack(op.pack(np.array(pos, dtype=np.int64))).tolist() == pos
    assert op.runs(np.array([1, 2, 3, 7, 9, 10])).tolist() == [[1, 3], [7, 7], [9, 10]]

"""Gradients against finite differences, held-out quality, edge cases."""

import zlib

import numpy as np
import pytest

from spanloom.llm import toxicity as op

SF = "/root/testdata/sf0.1"


def test_step_follows_the_gradient():
    """A plain Adagrad step moves each weight against the sign of the loss's difference."""
    texts = ["bad words here today", "nice words here now", "", "one bad day", "quite fine"]
    y = np.array([1, 0, 0, 1, 0], dtype=np.float32)
    v = op.Vocabulary(texts)
    rng = np.random.default_rng(3)
    m = op.start_model(v, np.arange(5), y, rng)
    for k in op.WIDTHS:
        m.conv[k] += rng.normal(0, 0.3, m.conv[k].shape).astype(np.float32)
    m.out[:] = rng.normal(0, 1, len(m.out))

    def loss():
        words, off = op.tokens(texts)
        code, hashes, distinct = op.factorize(words)
        z = m.logits(code, off, m.word_rows(distinct, hashes))
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    before, start = {k: w.copy() for k, w in m.conv.items()}, loss()
    slope = {}
    for k in op.WIDTHS:
        for at in [(0, 0, 0), (k - 1, 2, 1)]:
            m.conv[k][at] += 1e-2
            high = loss()
            m.conv[k][at] -= 2e-2
            slope[k, at] = (high - loss()) / 2e-2
            m.conv[k][at] = before[k][at]
    op.train_step(m, v, np.arange(5), y, {}, 1e-3)
    for (k, at), g in slope.items():
        if abs(g) > 1e-3:
            assert np.sign(before[k][at] - m.conv[k][at]) == np.sign(g)
    for _ in range(20):
        op.train_step(m, v, np.arange(5), y, {}, 1e-2)
    assert loss() < start


def test_word_vectors_agree():
    m = op.start_model(op.Vocabulary(["ab cde", "f"]), np.arange(2), np.array([1.0, 0.0]), np.random.default_rng(0))
    words, _ = op.tokens(["a bb ccc dddd eeeee ffffff über"])
    _, hashes, distinct = op.factorize(words)
    assert np.allclose(m.word_vectors(distinct, hashes), m.vectors(*op.features(distinct, hashes)), atol=1e-5)


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "y" * 50_000), (-3, "y" * 50_000), (None, "stupid idiot")],
                                "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True).withColumn("score", docs["n_chars"])
    return op.toxicity(both, labels).collect(), {r["doc_id"]: r["toxic"] for r in labels.collect()}


def test_held_out_quality(scored):
    rows, toxic = scored
    held = [r for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
               for r in rows if r["doc_id"] is not None)
    y = np.array([toxic[r["doc_id"]] for r in held])
    s = np.array([r["score"] for r in held])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    p = np.array([r["predicted"] for r in held])
    assert auc > 0.95 and p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.02


def test_edges(scored):
    rows, _ = scored
    assert len(rows) == 10_005
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[-1]["score"] == by[-2]["score"] < 0.5


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    assert [r["score"] for r in op.toxicity(docs, none).collect()] == [0.0]
    assert op.toxicity(docs.limit(0), none.limit(0)).count() == 0


def test_every_labelled_row_counts(spark):
    """More rows than the former samples held: each is counted, trained on or calibrated with, in many shards."""
    n = 12_000
    docs = spark.range(n).selectExpr(
        "id as doc_id", "concat('w', id, if(id % 2 = 0, ' foul', ' fair')) as text", "'xx' as lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic")
    rows = op.training_rows(docs, labels)
    learn = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r["d"] for r in rows.collect()) == learn
    seen = {}
    for r in rows.mapInArrow(op._counts, "lang string, at bigint, n bigint, t bigint").collect():
        key = (r["lang"], r["at"])
        a, b = seen.get(key, (0, 0))
        seen[key] = (a + r["n"], b + r["t"])
    fit = [r["d"] for r in rows.where("fit").collect()]
    at = {w: int(op.common.hash_words([w])[0] % np.uint64(op.BUCKETS)) for w in (b"foul", b"fair")}
    even = sum(i % 2 == 0 for i in fit)
    assert seen[None, at[b"foul"]][1] >= even and seen[None, at[b"fair"]][0] >= len(fit) - even > 3500
    assert sum(k for (x, _), (k, _) in seen.items() if x == "xx") == 2 * len(learn)
    a, b = (op.fit_model(docs.repartition(k), labels, shard_rows=500) for k in (2, 5))
    assert np.array_equal(a.embed, b.embed) and np.array_equal(a.offsets, b.offsets)
    wrong = op.score(docs, a).where("(score >= 0.5) <> (doc_id % 2 = 0)").count()
    assert wrong < n / 1000


def test_recurring_words_are_computed_once(monkeypatch):
    """Many rare words do not push the frequent ones out of a task's table."""
    monkeypatch.setattr(op, "CACHE_WORDS", 200)
    common = [f"often{i}" for i in range(50)]
    slices = [[" ".join(common), " ".join(f"rare{k}x{i}" for i in range(90))] for k in range(20)]
    m = op.start_model(op.Vocabulary(slices[0]), np.arange(2), np.array([1.0, 0.0]), np.random.default_rng(0))
    computed = []
    plain = op.Model.word_rows
    monkeypatch.setattr(op.Model, "word_rows",
                        lambda self, words, *rest: computed.extend(words) or plain(self, words, *rest))
    found = [m.scores(texts) for texts in slices]
    assert len(computed) == len(set(computed)) == 50 + 20 * 90
    for texts, score in zip(slices, found, strict=True):
        assert np.array_equal(score, op.own(m).scores(texts))
    long = [" ".join(f"long{i}" for i in range(2000))]
    assert np.array_equal(m.scores(long), op.own(m).scores(long))
    assert np.array_equal(m.scores(slices[3]), found[3])


def test_steps_agree_with_plain_ones(monkeypatch):
    texts = [None, "", "...", "Straße ΟΔΟΣ, x", "a-b\tA b\n" * 40, " end", "x" * 30_000, "one two three four " * 9]
    words, off = op.tokens(texts)
    code, off2, found = op.coded(texts)
    assert np.array_equal(off, off2) and [found[c] for c in code] == words and len(set(found)) == len(found)
    assert [len(x) for x in op.coded([])] == [0, 1, 0]
    size = np.array([len(w) + 2 for w in found])
    byte = op._BYTE[np.frombuffer(b"".join(b"<" + w + b">" for w in found), dtype=np.uint8)]
    for n, (bucket, count) in zip(op.GRAMS, op.grams(found), strict=True):
        h, _ = op.common.windows(byte, np.concatenate(([0], np.cumsum(size))), n)
        assert np.array_equal(bucket, h % np.uint64(op.BUCKETS)) and np.array_equal(count, np.maximum(size - n + 1, 0))
    values = np.array([5, 1, 5, 5, 0, 1], dtype=np.int32)
    assert sorted(op.distinct(values, np.empty(9, np.int32))) == [0, 1, 5]
    assert [list(x) for x in op.numbers(values, 9)] == [[0, 1, 5], [2, 1, 2, 2, 0, 1]]
    v = op.Vocabulary(texts)
    n, t = np.zeros(op.BUCKETS), np.zeros(op.BUCKETS)
    y = np.array([0, 1, 0, 1, 1, 0, 0, 1])
    op.count_buckets(v, np.arange(8), y, n, t)
    seen = [np.unique(v.buckets(np.unique(v.words(i)))) for i in range(8)]
    assert np.array_equal(n, np.bincount(np.concatenate(seen), minlength=op.BUCKETS))
    assert np.array_equal(t, np.bincount(np.concatenate([seen[i] for i in range(8) if y[i]]), minlength=op.BUCKETS))
    m = op.start_model(v, np.arange(8), y.astype(float), np.random.default_rng(1))
    whole = m.scores(texts)
    monkeypatch.setattr(op, "BLOCK", 5)
    assert np.array_equal(op.own(m).scores(texts), whole)

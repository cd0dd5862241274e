"""Classes by brute force over all pairs; the sketch's agreement against the similarity it estimates."""

import random

import numpy as np

from pyspark.sql import functions as F

from spanloom.llm import near_dup as op


def shingle_set(text):
    w = (text or "").encode().split()
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(docs, threshold=0.8):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(i)
    out = [None] * len(docs)
    for members in groups.values():
        ids = [docs[i][0] for i in members if docs[i][0] is not None]
        for i in members:
            out[i] = (min(ids) if ids else None, len(members))
    return out


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.random()}"
    return " ".join(words)


def planted(seed):
    rnd = random.Random(seed)
    base = [f"b{k}" for k in range(150)]
    chain = [f"c{k}" for k in range(300)]
    common = [f"p{k}" for k in range(60)]
    docs = [(i, edited(rnd, base, rnd.randint(0, 5))) for i in range(40)]        # a cluster, some pairs under 0.8
    docs += [(100 + i, " ".join(chain[i * 8:i * 8 + 160])) for i in range(16)]   # a chain of neighbours
    docs += [(200 + i, " ".join(common + [f"u{i}_{k}" for k in range(40)])) for i in range(30)]  # a shared passage
    docs += [(300, None), (301, ""), (302, "one two"), (303, "one  two"), (304, "two one"), (7, docs[7][1]),
             (None, docs[3][1]), (None, "alone in null"), (305, " ".join(base)), (306, " \n ")]
    rnd.shuffle(docs)
    return docs


def test_classes(spark, tiny_slices):
    docs = planted(1)
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, node int")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in op.near_dup(df).collect())
    exp = brute(docs)
    assert got == sorted((str(i), str(c), n) for (i, _), (c, n) in zip(docs, exp, strict=True))
    kept = op.dedup(df)
    assert kept.columns == df.columns
    full = [(i, t, c) for (i, t), (c, _) in zip(docs, exp, strict=True) if shingle_set(t)]
    empty = [(i, t) for i, t in docs if not shingle_set(t)]
    assert kept.count() == len({(c, frozenset()) if c is not None else (i, t) for i, t, c in full}) + len(empty)
    assert {r["doc_id"] for r in kept.collect() if shingle_set(r["text"])} == {c for _, _, c in full}


def test_prefix_join_alone_finds_all_links(spark, monkeypatch):
    """Without star rounds after the first, what the prefix join adds makes the classes exact."""
    monkeypatch.setattr(op, "ROUNDS", 1)
    docs = planted(2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in op.near_dup(df).collect())
    assert got == sorted((str(i), str(c), n) for (i, _), (c, n) in zip(docs, brute(docs), strict=True))


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    item = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    wa[:60], wb[240:] = 0, 0
    a, b = wa > 0, wb > 0
    both = a & b
    true = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in np.flatnonzero(both))
    m = 4096
    ra = op.registers(item[a], np.zeros(a.sum(), int), wa[a], 1, m)
    rb = op.registers(item[b], np.zeros(b.sum(), int), wb[b], 1, m)
    assert abs((ra == rb).mean() - true) < 4 * np.sqrt(true * (1 - true) / m)
    assert (op.registers(item[:0], np.zeros(0, int), wa[:0], 2, 8) == 0).all()


def test_repeated_lines_do_not_part_equal_sets():
    """A block that one text repeats and the other has once: the sets (0.98 and 0.83) are what counts."""
    for cut in (0, 16):
        texts = []
        for i in range(300):
            block = [f"r{i}_{k}" for k in range(100)]
            rest = [f"s{i}_{k}" for k in range(100)]
            other = rest[:100 - cut] + [f"o{i}_{k}" for k in range(cut)]
            texts += [" ".join(block * 60 + rest).encode(), " ".join(block + other).encode()]
        sets = [set(op.shingles([t])[0].tolist()) for t in texts[:2]]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        _, size, bands = op.sketches(texts)
        assert all(len(b) == len(set(b)) for b in bands) and (size > 0).all()
        assert all(set(a) & set(b) for a, b in zip(bands[::2], bands[1::2], strict=True))


def test_bands_without_repeats_are_unchanged():
    texts = [b"a b c d e f g", b"", b"one two"]
    item, at, count = op.weighted(*op.shingles(texts)[:2])
    keys = op.band_keys(op.registers(item, at, 1 + np.log(count), 3))
    assert op.sketches(texts)[2] == [keys[0].tolist(), [], keys[2].tolist()]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_dup(df).count() == 0 and op.dedup(df).count() == 0


def test_large_group_beside_other_classes(spark):
    """1,000 near copies, texts that differ from them by a quarter and small groups of such: exact classes."""
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(150)]

    def changed(words, n, tag):
        words = list(words)
        for k in rnd.sample(range(len(words)), n):
            words[k] = f"{tag}_{k}"
        return words

    texts = [changed(base, rnd.randint(1, 3), f"n{i}") for i in range(1000)]
    for i in range(60):
        far = changed(base, rnd.randint(5, 12), f"f{i}")
        texts += [far] + [changed(far, 1, f"f{i}x{k}") for k in range(i % 3)]
    rnd.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = [shingle_set(t) for _, t in docs]
    number = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        has[i, [number[g] for g in s]] = 1
    both, size = has @ has.T, has.sum(1)
    linked = both >= 0.8 * (size[:, None] + size[None, :] - both)
    cls = np.arange(len(sets))
    while True:
        new = np.where(linked, cls[None, :], len(sets)).min(1)
        if (new == cls).all():
            break
        cls = new
    got = {r["doc_id"]: r["class_id"] for r in op.near_dup(df).collect()}
    assert [got[i] for i in range(len(sets))] == cls.tolist()
    assert 60 <= len(set(cls.tolist())) < 300
    # What the last join proposes follows the nodes and not their pairs.
    node = F.xxhash64("text")
    nodes = df.select(node.alias("node"), F.col("text").alias("t"))
    buckets = nodes.select(F.lit(1).alias("key"), "node")
    label = df.join(spark.createDataFrame(list(got.items()), "doc_id long, cls long"), "doc_id").select(
        node.alias("node"), "cls")
    pairs = op.prefix_pairs(op.prefixes(buckets, label, nodes, 0.8), 0.8)
    assert pairs.count() < 5 * len(sets)


def test_equal_id_and_text_keep_the_first_row(spark):
    rows = [(1, "a b c d e f", "y", 2), (1, "a b c d e f", "x", 3), (1, "a b c d e f", "x", 3), (2, "a b c d e f", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int").repartition(3)
    assert [tuple(r) for r in op.dedup(df).collect()] == [(1, "a b c d e f", "x", 3)]

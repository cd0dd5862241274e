"""The audit against a plain computation over Python integers; the matrix product against counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from spanloom.llm import divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOW))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update({t: count[g][t] for t in kept})

        def prices(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = prices(count[lang, source]), prices(total)
        pairs = []
        for other in groups:
            if other[0] == lang and other[1] != source:
                o = prices(count[other])
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other[1].encode(), other[1]))
        words = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept
                 if count[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
            out += [(lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def rows(seed, n):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "é", "Straße", "日本", "I", "ſ", "K"]
    weight = [1 / (k + 1) for k in range(len(words))]
    out = []
    for _ in range(n):
        t = " ".join(rnd.choices(words, weight, k=rnd.randint(0, 60)))
        out.append((rnd.choice(["en", "en", "fr", None, ""]), rnd.choice(["a", "b", "B", "é", "😀", None]),
                    rnd.choice([t, t, t, t.upper() + "3x_y\x00z", None, ""])))
    return out


def frame(spark, data):
    full = [(i % 7, t, g, s, "x", 1) for i, (g, s, t) in enumerate(data)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, term string, n int"
                                 ).repartition(4)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_against_integers(spark, tiny_slices, monkeypatch):
    monkeypatch.setattr(op.level_products, "__defaults__", (7,))
    data = rows(3, 300)
    data += [("xx", "only", "rare words here"), ("yy", "p", None), ("yy", "q", ""),
             ("en", "a", "Hot " * 30_000), ("en", "quiet", "...")]
    want = brute(data, 25)
    assert got(op.audit(frame(spark, data), top_terms=25)) == want
    assert any(r[0] == "yy" and r[2] == "pair" and r[4] == 0 for r in want)
    assert sum(r[2] == "term" for r in want) > 100


def test_one_source_and_empty(spark):
    data = [("en", "a", "one two three")] * 4
    assert got(op.audit(frame(spark, data))) == brute(data, 200)
    assert op.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_product():
    rnd = np.random.default_rng(5)
    row = np.repeat(np.arange(40), 3)
    column = np.concatenate([rnd.choice(12, 3, replace=False) for _ in range(40)])
    i, j, n = op.product(row, column, 40)
    want = Counter((a, b) for r in range(40) for a in column[row == r] for b in column[row == r] if a <= b)
    assert {(a, b): k for a, b, k in zip(i.tolist(), j.tolist(), n.tolist(), strict=True)} == dict(want)
    assert op.blocks(np.array([3, 3, 9, 1]), 6) == [(0, 2), (2, 3), (3, 4)]
    assert op.blocks(np.array([], dtype=int), 6) == []


def test_prices_are_exact(spark):
    """Counts over the 64-bit range of count times scale, and the floor of a value that has no exact double."""
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7), (0, 0, 3), (2, 10, 4)], "c long, n long, v long")
    out = df.select(op.price("c", "n", "v").alias("p")).collect()
    assert [r["p"] for r in out] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in
                                     [(10**13, 3 * 10**13, 7), (0, 0, 3), (2, 10, 4)]]
    df = spark.createDataFrame([(1_000_000_001, 7), (5, 1_000_000_001)], "p long, q long")
    assert [r["d"] for r in df.select(op.differ("p", "q").alias("d")).collect()] == [
        (p - q) ** 2 // q for p, q in [(1_000_000_001, 7), (5, 1_000_000_001)]]

"""Every window by brute force on small words, with ties, repeats and nulls."""

import hashlib
import random
import re

from spanloom.llm import decontaminate as op


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        wins = [iw[i:i + 10] for i in range(max(1, len(iw) - 9))] if iw else []
        for win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["a", "B", "c", "é", "x1", "Ü", "zz"]

    def text(n):
        return "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "\x00", "-"]) for _ in range(n))

    items = [(i, text(rnd.randint(8, 16))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "... !"), (103, items[0][1]), (None, "a zz x1 x1 é é"), (104, "zz é zz")]
    docs = []
    for i in range(60):
        piece = items[i % 12][1] if rnd.random() < 0.6 else ""
        docs.append((i, text(rnd.randint(0, 30)) + piece + text(rnd.randint(0, 5))))
    docs += [(200, None), (201, ""), (5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (5, docs[6][1])]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = op.decontaminate(d, b).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out)
    assert got == sorted((str(i), *brute(t, items)) for i, t in docs)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in out)
    left = op.clean(d, b)
    assert left.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(
        str(i) for i, t in docs if brute(t, items)[1] == 0)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    r = op.decontaminate(d, b).collect()
    assert [(x["n_words"], x["n_hit"], x["contaminated"]) for x in r] == [(3, 0, False)]
    assert op.decontaminate(d.limit(0), b).count() == 0
    assert op.clean(d, b).count() == 1


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = op.decontaminate(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_are_not_sent_through_python_workers(spark, monkeypatch):
    """Rows of the program would start further Python workers, idle from then on, in every executor."""
    text = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, text), (2, "one two"), (None, None)], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(7, text)], "item_id long, text string").coalesce(1)
    made = []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: made.append(a))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: made.append(a))
    assert {r["doc_id"] for r in op.clean(d, b).collect()} == {2, None}
    assert not made

"""Base spans against the plain forms of the patterns; the bootstrap on planted contexts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from spanloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_base_spans(spark):
    rnd = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.zz", "1", "12", ".", "1.2.3.4", "256.1.1.1", "4111111111111111",
             "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (988) 555-2485", "+", "(", ")", " ", "-", "  ",
             "é", "😀", "_", "%", "\n", "5", "79927398713", "0", ".com", "+49 30 1234567", "001.2.3.4"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(1200)]
    rows += [(9001, None), (9002, ""), (9003, rows[3][1]), (None, "x@y.zz")]
    out = pii.pii(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base int")).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        spans = brute(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), text[r["doc_id"]]
        assert set(spans) <= set(r["spans"].split(","))  if spans else True
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in spans)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please write to ticket user{i}@x.org today") for i in range(10)]
    rows += [(i, f"the ticket ABC-{i}234 was closed") for i in range(10, 16)]
    rows += [(99, "see the code 12345abc here"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pii(df).collect()}
    assert all(got[i]["n_added"] == 1 and got[i]["spans"] == "email:11:20" for i in range(10, 16))
    assert got[99]["n_added"] == 0 and got[0]["n_added"] == 0
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df.withColumn("rid", df["doc_id"])).collect()}
    assert masked[12] == "the ticket <EMAIL> was closed" and masked[0] == "please write to ticket <EMAIL> today"
    assert masked[99] == "see the code 12345abc here" and masked[100] is None
    assert pii.pii(df.limit(0)).count() == 0 and pii.mask(df.limit(0)).count() == 0


def test_candidates_end_on_a_letter_or_digit(spark):
    key, jwt = "k9" * 40, "eyJh1--_x." + "aB3-_" * 30 + ".Zz9"
    texts = {"the ticket ABC-1234. It was": ["ABC-1234"], "ticket ABC-1234... It": ["ABC-1234"],
             "ticket ABC-1234...It": ["ABC-1234"], "ticket ABC-1234- closed": ["ABC-1234"],
             "ticket ABC-1234-, _id_12345_ (x.y+z-12)": ["ABC-1234", "_id_12345", "x.y+z-12"],
             "see...ABC-1234 and --flag1 -12345 +12345": ["ABC-1234", "flag1", "12345", "+12345"],
             f"key {key}. {jwt}, {'x' * 70}1": [key, jwt, "x" * 70 + "1"],
             "ABC-1234-na\u00efve ABC-1234-\u00c4 \u00e912345 12345\u00e9": ["ABC-1234", "ABC-1234"],
             "user12345.x@localhost @user-123456 abcdef abc1": [], "ABC-1234": ["ABC-1234"], "12345.": ["12345"]}
    rows = list(texts)
    out = spark.createDataFrame([(t,) for t in rows], "t string").select("t", pii.candidates(F.col("t")).alias("c"))
    for r in out.collect():
        assert [s["value"] for s in r["c"]] == texts[r["t"]], r["t"]
        assert all(r["t"][s["start"]:s["end"]] == s["value"] for s in r["c"])


def test_identifiers_at_sentence_ends_are_masked(spark):
    rows = [(i, f"please write to ticket user{i}@x.org today") for i in range(10)]
    rows += [(10 + i, f"the ticket {v}{tail}") for i, (v, tail) in enumerate(
        [("ABC-1234", ". It was"), ("ABC-1235", "... It was"), ("ABC-1236", "- it was"), ("ABC-1237", "."),
         ("k9" * 40, " was"), ("ey1." + "aB3-_" * 40 + "z", ". It was")])]
    tails = [". It was", "... It was", "- it was", ".", " was", ". It was"]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [masked[10 + i] for i in range(6)] == [f"the ticket <EMAIL>{t}" for t in tails]


def test_candidate_runs_are_linear(spark):
    runs = ["a-" * 50_000, "a.." * 20_000 + "1", "a1-" * 20_000 + "@", "-." * 50_000 + "1", "a--" * 20_000, "\u00e9-" * 20_000 + "1"]
    out = spark.createDataFrame([(t,) for t in runs], "t string").select(F.size(pii.candidates(F.col("t"))).alias("n"))
    assert [r["n"] for r in out.collect()] == [0, 0, 1, 0, 0, 0]


def test_long_runs_are_linear(spark):
    rows = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "+1" + " " * 100_000), (4, "a.b" * 50_000 + "@"),
            (5, "x@" + "y." * 50_000)]
    out = pii.pii(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_email"] for r in out.collect()}[1] == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x@y.zz")], "doc_id long, text string")
    for out in (pii.pii(df), pii.mask(df)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_words_beside_other_marks_are_counted(spark):
    """Typographic marks, dashes and no-break spaces beside a word: a pattern's total covers all its places."""
    for word in ("«ticket»", "“ticket”", "—ticket—", "\u00a0ticket\u00a0", "ticket"):
        rows = [(i, f"see {word} user{i}@mail{i}.org today") for i in range(4)]
        rows += [(100 + i, f"see {word} AB-{i}1234 today") for i in range(40)]
        got = pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(r["n_email"] for r in got) == 4 and sum(r["n_added"] for r in got) == 0


def test_long_context_words_are_whole(spark):
    """A word of any length beside an entity, at any distance, is one pattern word."""
    word = "abcdefghij" * 12
    rows = [(i, f"{word}:{' ' * 60}user{i}@mail{i}.org") for i in range(6)]
    rows += [(100 + i, f"{word}{' ' * 60}ref{i}-99") for i in range(3)]
    found = pii.first_pass(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {r["word"] for r in pii._edges(found, "base").collect()} == {word}
    assert {r["word"] for r in pii._edges(found, "cand").collect()} == {word}
    totals = pii.word_totals(spark.createDataFrame(rows, "doc_id long, text string"), "text",
                            spark.createDataFrame([(word,)], "word string")).collect()
    assert [r["total"] for r in totals] == [9]


def test_mask_with_clashing_columns(spark):
    rows = [(1, "mail a@b.org now", [1], "x", 5), (2, None, None, "y", 6), (None, "+49 30 1234567 call", [2], "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans array<int>, _doc string, _row int")
    got = pii.mask(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "mail <EMAIL> now", [1], "x", 5), (2, None, None, "y", 6), (None, "<PHONE> call", [2], "z", 7)], key=str)

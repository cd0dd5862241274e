"""Base counts against a plain loop; line rules on hand-written lines."""

import random
import re

from spanloom.llm import quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = set()
    for i, t in enumerate(tri):
        if tri.count(t) > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_base_counts(spark, tiny_slices):
    rnd = random.Random(4)
    parts = ["a", "é", "the", "x#", "|", "$$", " ", "\n", "\t", "\x0b", "\u00a0", "\u2028", "b c d ", "line.\n", "😀"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 120)))
             for _ in range(150)]
    rows = list(enumerate([*texts, None, "", " \n "])) + [(0, texts[0]), (None, "one two.")]
    out = op.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        got = by[i][0]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"],
                got["n_repeat_words"], got["base_failed"]) == brute(t)
        assert not (got["base_failed"] and got["kept"])
    assert len(by[0]) == 2


def test_line_rules(spark):
    good = "This is a whole sentence with quite a few words in it."
    lines = {
        "Home | About | Contact | Help": "navigation",
        "Menu": "punctuation",
        "BUY!! NOW!! CHEAP!! OFFER!!": "punctuation",
        "so### many*** symbols$$$ here&&& today%%%": "symbols",
        "Please read our cookie policy before you go on with it.": "boilerplate",
    }
    for line, rule in lines.items():
        assert op.line_rule(line.encode(), line.encode().split()) == rule
    assert op.line_rule(good.encode(), good.encode().split()) is None
    # Lines of different words: repeated ones would fall under the rule of repeated windows.
    own = [" ".join(f"{w}{chr(97 + i)}" for w in good[:-1].split()) + "." for i in range(12)]
    text = "\n".join(own)
    df = spark.createDataFrame([(1, text), (2, text + "\n" + "\n".join(lines)),
                                (3, "\n".join(["Home | A | B | C | D | E | F | G"] * 3 + own[:8]))],
                               "doc_id long, text string")
    got = {r["doc_id"]: r for r in op.quality_rules(df).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == text
    assert got[2]["kept"] and got[2]["clean_text"] == text and got[2]["n_lines_removed"] == 5
    assert not got[3]["kept"]
    assert op.quality_rules(df.limit(0)).count() == 0

"""Groups and counts against a plain loop over the tokenizers' own output."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import alignment as op
from spanloom.llm import subwords
from spanloom.session import materialize

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def texts(seed, n):
    rnd = random.Random(seed)
    parts = ["the", "walking", "naïve", "œuvre", "Zürich's", "日本語", "😀", "é", " ", "  ", "\n", "\t", "\x00", "\x1c",
             " ", " ", "...", "1234", "<|endoftext|>", "<s>", "<0x41>", "'ll", "x" * 40, "ß", "​", "-"]
    return ["".join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 60)))
            for _ in range(n)]


def brute(rows):
    """doc_id, n_a, n_b, n_groups, n_best, count_sum and hash of every row, in order."""
    a_tok = tokenizers.Tokenizer.from_file(op.BYTE_LEVEL)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=op.PIECES)
    byte_of = {c: b for b, c in subwords.byte_letters().items()}
    out = []
    for doc, text in rows:
        groups, links = [], []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            ab = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
            bb = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i)
                  else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ab) == b"".join(bb) == b" " + text.encode():
                ends_a, ends_b = (np.cumsum([len(x) for x in t]).tolist() for t in (ab, bb))
                both = sorted(set(ends_a) & set(ends_b))
                i = j = 0
                for end in both:
                    p, q = ends_a.index(end, i), ends_b.index(end, j)
                    groups.append((a[i:p + 1], b[j:q + 1]))
                    links.append((a[p], b[q]))
                    i, j = p + 1, q + 1
        out.append((doc, groups, links))
    n = Counter(x for _, _, links in out for x in links)
    most = Counter()
    for (a, b), k in n.items():
        most[b] = max(most[b], k)
    return [(doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
             sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links),
             hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
                            .encode()).hexdigest() if groups else "") for doc, groups, links in out]


def result(spark, rows, **args):
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, groups string").repartition(3)
    found = op.align(materialize(df, "in"))
    digest = op.F.when(op.F.col("n_a") > 0, op.F.sha2("groups", 256)).otherwise("")
    found = materialize(found.withColumn("sha", digest), "aligned")
    again = op.align(df, digests=True).select("doc_id", "groups")
    assert sorted(map(str, again.collect())) == sorted(
        map(str, found.select("doc_id", op.F.col("sha").alias("groups")).collect()))
    found = found.drop("groups")
    out = op.count_links(found, materialize(op.link_counts(found), "counts"), **args)
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"],
                    r["n_best"], r["count_sum"], r["sha"]) for r in out.collect()))


def test_against_loop(spark, tiny_slices, monkeypatch):
    monkeypatch.setattr(op, "LANE", 8)
    monkeypatch.setattr(op.align_texts, "__defaults__", (8,))
    rows = list(enumerate(texts(7, 250)))
    rows += [(900, None), (901, ""), (902, "a ▁b c"), (903, "word é " * 4000), (None, "one two"), (3, rows[3][1]), (3, rows[3][1])]
    want = sorted((d is None, d or 0, *rest) for d, *rest in brute(rows))
    full = [(d, t, 7, "x") for d, t in rows]
    assert result(spark, full) == want
    assert result(spark, full, broadcast_pairs=0) == want  # counts joined by slice
    assert any(w[2] == 0 for w in want) and max(w[7] for w in want) > 100


def test_written_groups_and_lanes():
    known = op.Vocabularies(op.read_vocabularies())
    t = pa.array(["The naïve coöperation ended", None, "", "x" * 300, " two  spaces "])
    one, many = op.align_texts(t, known, lane=1), op.align_texts(t, known, lane=10**9)
    for a, b in zip(one, many, strict=True):
        assert a.tolist() == b.tolist()
    groups = one[3].to_pylist()
    assert groups[1] == groups[2] == "" and groups[0].count("|") == one[2][1] - one[2][0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = materialize(op.align(df), "aligned")
    assert op.count_links(found, materialize(op.link_counts(found), "counts")).count() == 0

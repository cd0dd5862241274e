"""Invariants and metamorphic checks on driver data."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanloom.operators import edits as E
from spanloom.operators import ingest as I
from spanloom.operators import match as M
from spanloom.operators import metrics as MT
from spanloom.operators import spans as S
from spanloom.plans import bindings as B
from spanloom.schema import SPANS
from spanloom.session import scratch_path
from spanloom.streaming import edits_stream as SE

SF = "/root/testdata/sf0.001"


def rows(df, cols=None):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_containment_strategies_agree(spark):
    docs, vocab = B.corpus_docs(spark, SF), B.corpus_vocab(spark, SF)
    cols = ["project", "doc_id", "pos", "start"]
    ref = rows(M.containment_hits(docs, vocab, "broadcast"), cols)
    assert ref
    assert rows(M.containment_hits(docs, vocab, "ngram"), cols) == ref


def test_ngram_short_terms_and_unicode(spark):
    docs = spark.createDataFrame([("p", 1, "a😀b华为é xx"), ("p", 2, "")],
                                 "project string, doc_id bigint, query string")
    vocab = spark.createDataFrame([("k", 0, "华为"), ("k", 1, "😀"), ("k", 2, "b华为é"), ("k", 3, ""),
                                   ("k", 4, "x"), ("k", 5, "zz")],
                                  "key string, pos int, term string")
    ref = rows(M.containment_hits(docs, vocab, "broadcast"), ["doc_id", "pos", "start"])
    assert ref == [(1, 0, 3), (1, 1, 1), (1, 2, 2), (1, 4, 7)]
    assert rows(M.containment_hits(docs, vocab, "ngram"), ["doc_id", "pos", "start"]) == ref


def test_accepted_spans_are_disjoint_and_partitioning_free(spark):
    adds = B.edit_adds(spark, SF)
    spans, _ = S.add_spans(None, adds)
    got = rows(spans, ["doc_id", "ord", "start", "end"])
    assert S.overlap_pairs(spans).count() == 0
    spans2, _ = S.add_spans(None, adds.repartition(7, "seq"))
    assert rows(spans2, ["doc_id", "ord", "start", "end"]) == got


def test_overlap_pairs_binned_equals_brute_force(spark):
    rnd = random.Random(7)
    data = []
    for doc in range(5):
        for o in range(40):
            s = rnd.randrange(0, 400)
            data.append(("p", doc, o, "t", "L", s, s + rnd.choice([0, 0, 1, 3, 70, 150, -4]), {}))
    spans = spark.createDataFrame(data, SPANS)
    got = rows(S.overlap_pairs(spans, bin_width=16), ["doc_id", "ord_a", "ord_b"])
    want = sorted((a[1], a[2], b[2]) for a in data for b in data
                  if a[1] == b[1] and a[2] < b[2] and not (b[6] <= a[5] or b[5] >= a[6]))
    assert got == want


def test_status_counts_sum_to_docs(spark):
    docs, ann = B.short_docs(spark, SF), B.ann_spans(spark, SF)
    summ = MT.status_summary(MT.doc_status(docs, ann))
    total = summ.select(F.sum(F.col("not_started") + F.col("mapping_incomplete") + F.col("done"))).first()[0]
    assert total == docs.count()


def test_with_doc_id_dense(spark):
    part = B.table(spark, SF, "part").repartition(5)
    ids = [r.doc_id for r in I.with_doc_id(part, order_by=["p_name", "p_partkey"]).collect()]
    assert sorted(ids) == list(range(len(ids)))
    fo = [r.doc_id for r in I.with_doc_id(part).collect()]
    assert sorted(fo) == list(range(len(fo)))


def test_stream_equals_batch_any_split(spark):
    edits = SE.dense_seq(B.edits(spark, SF))
    batch = rows(E.replay_edits(edits), ["doc_id", "ord", "start", "end", "text"])
    src = scratch_path(spark, "t-stream")
    # 3 files, reversed seq blocks, a re-delivered copy of everything.
    arr = edits.unionByName(edits).withColumn("_f", 2 - F.col("seq") % 3)
    arr.repartition(3, "_f").drop("_f").write.parquet(src)
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    SE.run_replay_stream(spark, src, edits.schema, sink, ckpt)
    stream = rows(SE.state_spans(spark, ckpt), ["doc_id", "ord", "start", "end", "text"])
    assert stream == batch
    latest = SE.latest_snapshots(spark.read.parquet(sink))
    assert latest.where("pending > 0").count() == 0
    # Live counts in the snapshots agree with the lists in the state.
    counts = {r.doc_id: r.n_spans for r in latest.collect()}
    per_row = {}
    for r in batch:
        per_row[r[0]] = per_row.get(r[0], 0) + 1
    assert {k: v for k, v in counts.items() if v} == per_row


def test_replay_dedups_repeated_edits(spark):
    edits = B.edits(spark, SF)
    once = rows(E.replay_edits(edits))
    twice = rows(E.replay_edits(edits.unionByName(edits)))
    assert once == twice


def _brute_find(mentions, vocab):
    """The tool's rule, row by row: ``text in term or term in text``, else all terms."""
    out = set()
    for p, mid, key, text in mentions:
        terms = [(pos, t) for (vp, vk, pos, t) in vocab if (vp, vk) == (p, key) and t is not None]
        hit = [(pos, t) for pos, t in terms if text is not None and (text in t or t in text)]
        for pos, t in hit or terms:
            out.add((p, mid, key, text, pos, t, bool(hit)))
    return sorted(out, key=repr)


def test_find_mappings_strategies_equal_brute_force(spark):
    from spanloom.operators import vocab as VC
    rnd = random.Random(11)
    alphabet = "ab华c"
    def word(lo, hi):
        return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi)))
    vocab = [(p, k, i, word(0, 5)) for p in ("p", "q") for k in ("k1", "k2") for i in range(12)]
    vocab += [("p", "k1", 12, vocab[0][3]), ("p", "k3", 0, None)]
    mentions = [(rnd.choice("pq"), f"m{i}", rnd.choice(["k1", "k2", "k3", "k9"]), word(0, 7))
                for i in range(60)] + [("p", "mnull", "k1", None)]
    m = spark.createDataFrame(mentions, "project string, mention_id string, key string, text string")
    v = spark.createDataFrame(vocab, "project string, key string, pos int, term string")
    expect = _brute_find(mentions, vocab)
    for strategy in ("ngram", "broadcast"):
        got = sorted((tuple(r) for r in VC.find_mappings(m, v, strategy).collect()), key=repr)
        assert got == expect, strategy


def _brute_greedy(stored, proposed):
    """Tool rule per row: stored spans kept; proposals in seq order, rejected on overlap."""
    acc = {}
    for (p, d, o, s, e) in sorted(stored, key=lambda r: r[2]):
        acc.setdefault((p, d), []).append((s, e))
    keep = {}
    for (p, d, seq, s, e) in sorted(proposed, key=lambda r: r[2]):
        lst = acc.setdefault((p, d), [])
        ok = all(a_e <= s or a_s >= e for a_s, a_e in lst)
        keep[(p, d, seq)] = ok
        if ok:
            lst.append((s, e))
    return keep


def test_greedy_add_large_and_small_islands_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    stored, proposed = [], []
    for d in range(6):
        n = 400 if d == 0 else 30          # row 0 is a hot row
        for o in range(n // 10):
            s = rnd.randint(0, 3000)
            stored.append(("p", d, o, s, s + rnd.randint(0, 15)))
        for q in range(n):
            s = rnd.randint(0, 3000 if d else 300)
            e = s + rnd.choice([0, 0, 1, 2, 5, 30])
            proposed.append(("p", d, q, s, e))
        proposed += [("p", d, 10_000 + i, *proposed[-1 - i][3:]) for i in range(5)]  # duplicates
    proposed += [("p", None, 20_000 + i, s, s + 3) for i, s in enumerate((0, 2, 5, 8, 9))]
    expect = _brute_greedy(stored, proposed)
    st = spark.createDataFrame([(p, d, o, f"s{o}", "L", s, e, {}) for p, d, o, s, e in stored], SPANS)
    pr = spark.createDataFrame([(p, d, q, f"t{q}", "L", s, e) for p, d, q, s, e in proposed],
                               "project string, doc_id bigint, seq bigint, text string, "
                               "label string, start bigint, end bigint")
    for limit, skew_safe in ((10 ** 9, False), (0, False), (20, True), (10 ** 9, True)):
        monkeypatch.setattr(S, "ISLAND_FOLD_MAX", limit)
        spans, out = S.add_spans(st, pr, skew_safe=skew_safe)
        got = {(r.project, r.doc_id, r.seq): r.accepted for r in out.collect()}
        assert got == expect, (limit, skew_safe)
        kept = spans.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("ord").alias("m")).collect()
        assert all(r.m == r.n - 1 for r in kept)
        assert spans.count() == len(stored) + sum(expect.values())


def test_ngram_anchors_across_small_chunks_equal_brute_force(spark, monkeypatch):
    """Tiny chunks put anchors and starts on different chunks; result = str.find."""
    rnd = random.Random(13)
    texts = [("p", i, "".join(rnd.choice("ab😀c") for _ in range(rnd.randint(0, 60))))
             for i in range(25)]
    terms = sorted({"".join(rnd.choice("ab😀c") for _ in range(rnd.randint(1, 9)))
                    for _ in range(60)} | {"aaab", "abab", "baba"})
    docs = spark.createDataFrame(texts, "project string, doc_id bigint, query string")
    tdf = spark.createDataFrame([(x,) for x in terms], "term string")
    want = sorted((d, t, q.find(t)) for _, d, q in texts for t in terms if t in q)
    for limit, chunk in ((200_000, 4), (0, 5), (200_000, 512)):  # broadcast anchors or not
        monkeypatch.setattr(M, "BROADCAST_MAX_TERMS", limit)
        got = M.hits_ngram(docs, ["project", "doc_id"], "query", tdf, chunk=chunk)
        assert sorted((r.doc_id, r.term, r.start) for r in got.collect()) == want, (limit, chunk)


def _linear_replay(edits):
    """The tool's per-click rules on a plain list: add checks every span, update does not."""
    anns, outs = [], []
    for op, o, s, e in edits:
        if op == "add":
            if any(not (e <= a[0] or s >= a[1]) for a in anns):
                outs.append("overlap")
            else:
                anns.append((s, e))
                outs.append("accepted")
        elif not 0 <= o < len(anns):
            outs.append("out_of_range")
        elif op == "remove":
            anns.pop(o)
            outs.append("accepted")
        else:
            anns[o] = (s, e)
            outs.append("accepted")
    return anns, outs


def test_span_list_index_equals_linear_check():
    rnd = random.Random(21)
    for _ in range(40):
        edits = []
        for _ in range(rnd.randint(1, 300)):
            op = rnd.choice(["add"] * 6 + ["remove", "update"])
            s = rnd.randint(-10, 400)
            e = s + rnd.choice([0, 1, 2, 5, 40, 130, -3])
            edits.append((op, rnd.randint(0, 12), s, e))
        want_anns, want_outs = _linear_replay(edits)
        sl = E.SpanList()
        outs = [E.apply_edit(sl, {"op": op, "ord": o, "start": s, "end": e, "text": "t", "label": "L"})
                for op, o, s, e in edits]
        assert outs == want_outs
        assert [(a["start"], a["end"]) for a in sl.anns] == want_anns

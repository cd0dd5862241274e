"""Skew-safe ordered scans equal plain per-group windows."""

from __future__ import annotations

import random
from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import ordered as O
from spanloom.operators import views as V
from spanloom.schema import SPANS


@contextmanager
def many_partitions(spark, n=16):
    """Keep every range partition (no AQE coalescing), so a hot group spans many."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_scan_equals_windows(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        g = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c", None])
        v = None if rnd.random() < 0.1 else rnd.randint(-50, 50)
        rows.append((g, i, rnd.randint(0, 40), v))
    df = spark.createDataFrame(rows, "g string, id bigint, o int, v int")
    specs = [("mb", "max_before", "v"), ("su", "sum_upto", "v"), ("lg", "lag", "v"),
             ("ld", "lead", "id"), ("ix", "index", None)]
    with many_partitions(spark):
        t = O.tag_order(df, ["g"], ["o", "id"])
        assert t.select("_part").distinct().count() > 4
        got = O.untag(O.scan(t, ["g"], specs))
        got = sorted(tuple(r) for r in got.select("id", "mb", "su", "lg", "ld", "ix").collect())
    w = Window.partitionBy("g").orderBy("o", "id")
    ref = df.select(
        "id", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mb"),
        F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("su"),
        F.lag("v").over(w).alias("lg"), F.lead("id").over(w).alias("ld"),
        (F.row_number().over(w) - 1).cast("bigint").alias("ix"))
    assert got == sorted(tuple(r) for r in ref.collect())


def test_second_scan_uses_first(spark):
    df = spark.range(0, 500).select(F.lit("k").alias("g"), F.col("id").alias("o"),
                                    (F.col("id") % 7 == 0).cast("int").alias("f"))
    with many_partitions(spark, 8):
        t = O.scan(O.tag_order(df, ["g"], ["o"]), ["g"], [("c", "sum_upto", "f")])
        t = O.scan(t, ["g"], [("pc", "lag", "c")])
        got = {r.o: (r.c, r.pc) for r in t.collect()}
    assert got[0] == (1, None) and got[7] == (2, 1) and got[499] == (72, 72)


def test_segments_and_positions_same_in_both_modes(spark):
    from spanloom.operators import ingest as I
    from spanloom.operators import views as V
    from spanloom.plans import bindings as B
    sf = "/root/testdata/sf0.001"
    docs, spans = B.short_docs(spark, sf), B.ann_spans(spark, sf)
    with many_partitions(spark):
        a = sorted(tuple(r) for r in V.segments(docs, spans, skew_safe=False).collect())
        b = sorted(tuple(r) for r in V.segments(docs, spans, skew_safe=True).collect())
        assert a == b and len(a) > 0
        p1 = I.position_within(spans, ["project"], ["doc_id", "ord"], skew_safe=False)
        p2 = I.position_within(spans, ["project"], ["doc_id", "ord"], skew_safe=True)
        cols = ["project", "doc_id", "ord", "pos"]
        assert sorted(p1.select(cols).collect()) == sorted(p2.select(cols).collect())


def test_segments_of_long_texts(spark, monkeypatch):
    """Gaps over one chunk, many chunks and chunk borders; a row with many spans; code points."""
    monkeypatch.setattr(V, "CHUNK", 7)
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab😀é ") for _ in range(n)) for n in (0, 5, 7, 14, 60, 300)]
    docs = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "project string, doc_id long, query string")
    rows, want = [], []
    for i, t in enumerate(texts):
        at, k = 0, 0
        cuts = sorted(rnd.sample(range(len(t) + 1), min(len(t) + 1, 2 * (i + 1)))) if i != 2 else []
        pieces, end = [], 0
        for a, b in zip(cuts[::2], cuts[1::2]):
            rows.append(("p", i, k, t[a:b], "l", a, b, {}))
            pieces += [("gap", t[end:a])] * (a > end) + [("span", t[a:b])]
            end, k = b, k + 1
        pieces += [("gap", t[end:])] * (end < len(t))
        want += [(i, n, *p) for n, p in enumerate(pieces)]
    spans = spark.createDataFrame(rows, SPANS)
    for skew_safe in (False, True):
        got = V.segments(docs, spans, skew_safe=skew_safe).collect()
        assert sorted((r.doc_id, r.piece, r.kind, r.text) for r in got) == sorted(want)

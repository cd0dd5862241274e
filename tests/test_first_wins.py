"""Parallel rounds of the greedy add against the sequential rule."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanloom.operators import first_wins as W
from spanloom.operators import spans as S
from spanloom.schema import SPANS
from tests.test_invariants import _brute_greedy


def _run(spark, stored, proposed):
    st = spark.createDataFrame([(p, d, o, f"s{o}", "L", s, e, {}) for p, d, o, s, e in stored], SPANS)
    pr = spark.createDataFrame([(p, d, q, f"t{q}", "L", s, e) for p, d, q, s, e in proposed],
                               "project string, doc_id bigint, seq bigint, text string, "
                               "label string, start bigint, end bigint")
    spans, out = S.add_spans(st, pr)
    assert spans.count() == len(stored) + out.where("accepted").count()
    return {(r.project, r.doc_id, r.seq): r.accepted for r in out.collect()}


def test_rounds_equal_the_sequential_rule(spark, monkeypatch):
    rnd = random.Random(17)
    stored, proposed = [], []
    for d in (1, 2, None):
        n = 300 if d == 1 else 60
        stored += [("p", d, o, s, s + rnd.choice([0, 3, 9])) for o, s in enumerate(rnd.sample(range(900), n // 12))]
        for q in range(n):
            s = rnd.randint(5, 900)
            proposed.append(("p", d, q, s, s + rnd.choice([0, 0, 1, 2, 5, 30, 200])))
    proposed += [("p", 9, i, 10 * (40 - i), 10 * (40 - i) + 11) for i in range(40)]  # a chain, in order of arrival
    proposed += [("p", 9, 100 + i, 10 * i, 10 * i + 11) for i in range(60, 80)]
    proposed += [("p", 10, i, *x) for i, x in enumerate([(5, 2), (0, 9), (3, 4), (9, 7), (1, 20), (6, 30)])]  # inverted
    want = _brute_greedy(stored, proposed)
    monkeypatch.setattr(S, "ISLAND_FOLD_MAX", 0)
    monkeypatch.setattr(S, "ROUNDS_MIN", 0)
    for rounds in (2, 50):
        monkeypatch.setattr(W, "MAX_ROUNDS", rounds)
        assert _run(spark, stored, proposed) == want, rounds


def test_nodes():
    """A position's path meets a cover exactly if it lies inside."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.range(24).select(F.col("id").alias("lo")).crossJoin(spark.range(1, 25).select(F.col("id").alias("hi")))
    df = df.where("lo < hi").withColumn("cover", W._cover(F.col("lo"), F.col("hi"), 5))
    at = spark.range(24).select(F.col("id").alias("at"), W._path(F.col("id"), 5).alias("path"))
    both = df.crossJoin(at).select((F.size(F.array_intersect("cover", "path"))).alias("n"),
                                   ((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).cast("int").alias("inside"))
    assert both.where("n <> inside").count() == 0


def test_a_large_island_is_shared_by_tasks(spark):
    """Random arrivals: few rounds decide nearly all of an island, and every lookup is dealt by node."""
    rnd = random.Random(3)
    rows = [(0, i, 1, i, s, s + rnd.randint(1, 40)) for i, s in enumerate(rnd.choices(range(20_000), k=6000))]
    df = spark.createDataFrame(rows, "gid long, rid long, kind int, seq long, start long, end long")
    decided, left = W.rounds(df, 12)
    got = {r.rid: r.keep for r in decided.collect()}
    want = _brute_greedy([], [("p", 1, i, s, e) for _, i, _, _, s, e in rows])
    assert left.count() == 0 and {("p", 1, k): v for k, v in got.items()} == want

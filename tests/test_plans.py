"""Plan shapes that keep the operators safe at scale (read from ``explain``)."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from spanloom.operators import match as M
from spanloom.operators import ordered as O
from spanloom.operators import spans as S
from spanloom.operators import views as V
from spanloom.plans import bindings as B
from spanloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def exchanges(p: str) -> int:
    return len(re.findall(r"^\(\d+\) Exchange\b", p, re.M))


def test_add_spans_single_exchange_by_row(spark):
    spans, _ = S.add_spans(None, B.edit_adds(spark, SF))
    p = plan(spans)
    assert exchanges(p) == 1, p
    assert "hashpartitioning(project" in p


def test_no_pairs_in_matching(spark):
    docs, vocab = B.corpus_docs(spark, SF), B.corpus_vocab(spark, SF)
    for df in (M.containment_hits(docs, vocab), M.containment_hits(docs, vocab, "ngram"),
               QUERIES["find_mappings"](spark, SF)):
        p = plan(df)
        assert not any(x in p for x in PAIRS), p


def test_export_one_pushes_filter_to_both_scans(spark):
    p = plan(QUERIES["export_one"](spark, SF))
    assert len(re.findall(r"PushedFilters: \[[^\]]*EqualTo\(p_partkey,0\)", p)) >= 2, p


def test_skew_safe_mode_has_no_window_by_row_alone(spark):
    """In skew-safe mode no window is partitioned by (project, doc_id) alone."""
    docs, spans = B.short_docs(spark, SF), B.ann_spans(spark, SF)
    seg = V.segments(docs, spans, skew_safe=True)
    added, _ = S.add_spans(None, B.edit_adds(spark, SF), skew_safe=True)
    for df in (seg, added):
        p = plan(df)
        specs = re.findall(r"windowspecdefinition\(([^,]+), ([^,]+), ([^,]+),", p)
        assert specs, p
        for first, second, third in specs:
            # Only the carry window, ordered by _part (one row per partition),
            # may be partitioned by the row key alone.
            by_row = first.startswith("project") and second.startswith("doc_id")
            assert not by_row or third.startswith("_part"), (first, second, third)


def test_position_within_checked_mode(spark, monkeypatch):
    from spanloom.operators.ingest import position_within
    df = spark.range(0, 300).select(F.lit("g").alias("grp"), F.col("id"))
    monkeypatch.setattr(O, "MAX_GROUP_ROWS", 100)
    p = plan(position_within(df, ["grp"], ["id"]))
    assert "_part" in p  # the largest group (300 rows) is above the bound: range scan
    monkeypatch.setattr(O, "MAX_GROUP_ROWS", 1000)
    p = plan(position_within(df, ["grp"], ["id"]))
    assert "_part" not in p  # under the bound: a plain window

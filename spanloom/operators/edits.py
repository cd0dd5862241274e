"""Replay an edit log (add / remove / update / set_mapping) into the span store.

Edits of one row depend on each other through list ordinals, so they are
applied in ``seq`` order, one row at a time; rows are independent. The log is
hash-partitioned by row and sorted by (row, seq) inside each partition, and a
``mapInArrow`` pass walks it once. Memory holds one row's current list, never
the row's whole edit history, so a row with a huge log streams through.
Of edits with one ``(project, doc_id, seq)`` the first by content is applied, however
they arrive. An edit without
``seq`` has no place in the order: it is not applied (outcome ``no_seq``; the
stream drops it). Rows travel as Arrow batches, so integers stay exact and
NULL keys stay NULL. The row's list is a :class:`~spanloom.operators.spanlist.SpanList`:
ordinals are found in log time and an ``add`` tests only spans near it.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.spanlist import CONTENT, SpanList, apply_edit
from spanloom.schema import MAPPING_TYPE
from spanloom.session import materialize

KEYS = ("project", "doc_id")

REPLAY_FIELDS = pa.schema([
    ("kind", pa.string()), ("project", pa.string()), ("doc_id", pa.int64()), ("seq", pa.int64()),
    ("op", pa.string()), ("outcome", pa.string()), ("ord", pa.int64()), ("text", pa.string()),
    ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("mapping", pa.string())])
REPLAY_OUT = ("kind string, project string, doc_id bigint, seq bigint, op string, "
              "outcome string, ord bigint, text string, label string, start bigint, "
              "`end` bigint, mapping string")


def _span_rows(project, doc_id, anns):
    for i, a in enumerate(anns):
        yield {"kind": "span", "project": project, "doc_id": doc_id, "seq": None, "op": None,
               "outcome": None, "ord": i, "text": a["text"], "label": a["label"],
               "start": a["start"], "end": a["end"],
               "mapping": json.dumps(a["mapped_value"], ensure_ascii=False)}


def _replay_partition(batches):
    """Rows arrive sorted by (project, doc_id, phase, seq, content)."""
    cur = None
    spans = SpanList()
    last_seq = None
    out: list = []
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["project"], r["doc_id"])
            if key != cur:
                if cur is not None:
                    out.extend(_span_rows(cur[0], cur[1], spans.anns))
                cur, spans, last_seq = key, SpanList(), None
            if r["phase"] == 0:  # stored span that seeds the list
                spans.append({"text": r["text"], "label": r["label"], "start": r["start"],
                              "end": r["end"], "mapped_value": json.loads(r["mapping"] or "{}")})
                continue
            seq = r["seq"]
            if seq is not None and seq == last_seq:
                continue  # replayed duplicate
            last_seq = seq
            outcome = "no_seq" if seq is None else apply_edit(spans, r)
            out.append({"kind": "outcome", "project": r["project"], "doc_id": r["doc_id"],
                        "seq": seq, "op": r["op"], "outcome": outcome, "ord": r["ord"]})
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=REPLAY_FIELDS)
                out = []
    if cur is not None:
        out.extend(_span_rows(cur[0], cur[1], spans.anns))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=REPLAY_FIELDS)


def _log(edits: DataFrame, initial: DataFrame | None) -> DataFrame:
    e = edits.select(
        *KEYS, F.lit(1).alias("phase"), F.col("seq").cast("bigint"), "op",
        F.col("ord").cast("bigint"), "text", "label", F.col("start").cast("bigint"),
        F.col("end").cast("bigint"), "category", F.col("values").cast("array<string>"),
        F.lit(None).cast("string").alias("mapping"))
    if initial is not None:
        s = initial.select(
            *KEYS, F.lit(0).alias("phase"), F.col("ord").cast("bigint").alias("seq"),
            F.lit(None).cast("string").alias("op"), F.col("ord").cast("bigint"), "text", "label",
            "start", "end", F.lit(None).cast("string").alias("category"),
            F.lit(None).cast("array<string>").alias("values"),
            F.to_json("mapped_value").alias("mapping"))
        e = s.unionByName(e)
    return e


def replay(edits: DataFrame, initial: DataFrame | None = None,
           partitions: int | None = None) -> DataFrame:
    """Raw replay output: ``kind`` = 'span' (final list) or 'outcome' (per edit).

    Without ``partitions`` the adaptive planner sizes the shuffle.
    """
    log = _log(edits, initial)
    dealt = log.repartition(partitions, *KEYS) if partitions else log.repartition(*KEYS)
    ordered = dealt.sortWithinPartitions(*KEYS, "phase", "seq", *CONTENT)
    return ordered.mapInArrow(_replay_partition, REPLAY_OUT)


def _state(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("kind") == "span").select(
        *KEYS, "ord", "text", "label", "start", "end",
        F.from_json("mapping", MAPPING_TYPE).alias("mapped_value"))


def _outcomes(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("kind") == "outcome").select(*KEYS, "seq", "op", "ord", "outcome")


def replay_all(edits: DataFrame, initial: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(final spans, outcomes) of one replay, written once and read by both."""
    raw = materialize(replay(edits, initial), "replay")
    return _state(raw), _outcomes(raw)


def replay_edits(edits: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Final flat span table after applying every edit in ``seq`` order."""
    return _state(replay(edits, initial))


def replay_outcomes(edits: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """One row per distinct edit: ``outcome`` in accepted / overlap /
    out_of_range / unchanged / bad_offset / unknown_op / no_seq."""
    return _outcomes(replay(edits, initial))

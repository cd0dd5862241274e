"""Views of annotated rows: text segments, preview line, JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ingest import empty_anns, nest_spans
from spanloom.operators.ordered import OrderedScan
from spanloom.session import materialize

KEYS = ("project", "doc_id")
#: Code points of a text chunk.
CHUNK = 1024


def segments(docs: DataFrame, spans: DataFrame, skew_safe: bool | None = None) -> DataFrame:
    """Cut each text into gap and span pieces, spans taken by ``start`` (stable).

    A gap ``query[last_end:start]`` is emitted only when ``start > last_end``,
    where ``last_end`` is the previous span's end (not a running max); a span
    piece shows the annotation's own text. After the last span the tail
    ``query[last_end:]`` follows when ``last_end < len(query)``. A row without
    spans is one gap holding the whole text (none if the text is empty).
    Returns KEYS, piece (0-based), kind (gap|span), text, label.

    The previous end, the last-span flag, the span's rank and the running
    count of gaps are ordered scans over (row; start, ord)
    (:class:`~spanloom.operators.ordered.OrderedScan`: plain windows under the
    checked row size, skew-safe range scans above it). A piece's number is
    then arithmetic: spans and gaps before it, plus one for the span after
    its gap and one more for the tail.

    No text is joined to span rows. A gap is a range of code points; it meets only the
    chunks of its row's text that it touches, in an equi-join on (row, chunk), and what it takes
    from several chunks is put together in order. So each text is shuffled once, whatever its spans.
    """
    d = docs.select(*KEYS, "query")
    s = spans.select(*KEYS, "ord", "start", "end", F.col("text").alias("stext"), "label")
    plan = OrderedScan(s, list(KEYS), ["start", "ord"], skew_safe=skew_safe)
    t = plan.scan(plan.frame, [("_pe", "lag", "end"), ("_nx", "lead", None), ("_i", "index", None)])
    t = (t.withColumn("last_end", F.when(F.col("_i") == 0, F.lit(0).cast("bigint"))
                      .otherwise(F.col("_pe")))
         .withColumn("is_last", F.col("_nx").isNull())
         .withColumn("_gf", F.coalesce((F.col("start") > F.col("last_end")).cast("int"), F.lit(0)))
         .drop("_pe", "_nx"))
    if plan.skew_safe:
        t = materialize(t, "segments")
    t = plan.finish(plan.scan(t, [("_g", "sum_upto", "_gf")]))
    j = t.join(d.select(*KEYS, F.length("query").cast("bigint").alias("n")), list(KEYS))
    span_piece = F.col("_i") + F.col("_g")

    def gap_range(piece, a, b):
        return F.struct(piece.alias("piece"), F.greatest(a, F.lit(0)).alias("a"), F.least(b, F.col("n")).alias("b"))

    gap = F.when(F.col("_gf") == 1, gap_range(span_piece - 1, F.col("last_end"), F.col("start")))
    tail = F.when(F.col("is_last") & (F.col("end") < F.col("n")), gap_range(span_piece + 1, F.col("end"), F.col("n")))
    shown = j.select(*KEYS, span_piece.cast("bigint").alias("piece"), F.lit("span").alias("kind"),
                     F.col("stext").alias("text"), "label")
    gaps = j.select(*KEYS, F.explode(F.filter(F.array(gap, tail), lambda x: x.isNotNull())).alias("g"))
    gaps = gaps.select(*KEYS, F.col("g.piece").cast("bigint").alias("piece"), "g.a", "g.b")
    pieces = shown.unionByName(_cut(d, gaps).select(
        *KEYS, "piece", F.lit("gap").alias("kind"), "text", F.lit(None).cast("string").alias("label")))
    bare = (d.join(s.select(*KEYS), list(KEYS), "left_anti")
            .where(F.length("query") > 0)
            .select(*KEYS, F.lit(0).cast("bigint").alias("piece"), F.lit("gap").alias("kind"),
                    F.col("query").alias("text"), F.lit(None).cast("string").alias("label")))
    return pieces.unionByName(bare)


def _cut(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """KEYS, piece, text: ``query[a:b]`` of each range (KEYS, piece, a, b; 0 <= a, b <= length; empty if a >= b)."""
    parts = docs.select(*KEYS, F.posexplode(F.regexp_extract_all(
        "query", F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))).alias("chunk", "part"))
    first, last = (F.col("a") / CHUNK).cast("int"), ((F.col("b") - 1) / CHUNK).cast("int")
    some = ranges.where("a < b")
    touched = some.select(*KEYS, "piece", "a", "b", (first == last).alias("one"),
                          F.explode(F.sequence(first, last)).alias("chunk"))
    at = F.col("chunk").cast("bigint") * CHUNK
    begin = F.greatest(F.col("a") - at, F.lit(0))
    text = F.substring("part", (begin + 1).cast("int"), (F.least(F.col("b") - at, F.lit(CHUNK)) - begin).cast("int"))
    found = touched.join(parts, [*KEYS, "chunk"]).select(*KEYS, "piece", "one", "chunk", text.alias("text"))
    long = found.where(~F.col("one")).groupBy(*KEYS, "piece").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
    return (found.where("one").select(*KEYS, "piece", "text")
            .unionByName(long.select(*KEYS, "piece", F.array_join("parts.text", "").alias("text")))
            .unionByName(ranges.where("a >= b").select(*KEYS, "piece", F.lit("").alias("text"))))


def preview(spans: DataFrame) -> DataFrame:
    """``text (label)`` of every span in list order, space separated."""
    item = F.struct("ord", F.concat(F.coalesce("text", F.lit("")), F.lit(" ("),
                                    F.coalesce("label", F.lit("")), F.lit(")")).alias("s"))
    return spans.groupBy(*KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), " ")
        .alias("preview"))


def export_annotations(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All dataset rows plus ``annotations`` as JSON text ([] when none).

    Real JSON (``to_json``), so an export can be read back by
    ``parse_annotations`` unchanged.
    """
    nested = nest_spans(spans)
    return (docs.join(nested, list(KEYS), "left")
            .withColumn("annotations", F.to_json(F.coalesce(F.col("anns"), empty_anns())))
            .drop("anns"))


def export_one(docs: DataFrame, spans: DataFrame, doc_id: int, project: str | None = None) -> DataFrame:
    """Export of a single row; the filter reaches the scans of both inputs."""
    cond = F.col("doc_id") == F.lit(doc_id)
    if project is not None:
        cond = cond & (F.col("project") == F.lit(project))
    return export_annotations(docs.where(cond), spans.where(cond))

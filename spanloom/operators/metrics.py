"""Progress and status: grouped aggregates with map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.mapping import is_mapped
from spanloom.schema import STATUS_DONE, STATUS_INCOMPLETE, STATUS_NOT_STARTED, STATUSES

KEYS = ("project", "doc_id")


def mapping_progress(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per project: spans, mapped spans, ratio (0 when there are no spans).

    Only spans of rows present in the dataset count (semi join). The ratio is
    a double; format it at display time.
    """
    live = spans.join(docs.select(*KEYS), list(KEYS), "left_semi")
    agg = live.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_spans"),
        F.count_if(is_mapped("mapped_value")).alias("mapped_spans"))
    return (docs.select("project").distinct().join(agg, "project", "left")
            .select("project",
                    F.coalesce("total_spans", F.lit(0)).cast("bigint").alias("total_spans"),
                    F.coalesce("mapped_spans", F.lit(0)).cast("bigint").alias("mapped_spans"))
            .withColumn("ratio", F.coalesce(
                F.try_divide(F.col("mapped_spans").cast("double"), F.col("total_spans")),
                F.lit(0.0))))


def _per_doc(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if(is_mapped("mapped_value")).alias("n_mapped"))


def doc_status(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per row: no spans -> not_started; all mapped -> done; else mapping_incomplete."""
    j = docs.select(*KEYS).join(_per_doc(spans), list(KEYS), "left")
    n = F.coalesce(F.col("n_spans"), F.lit(0)).cast("bigint")
    m = F.coalesce(F.col("n_mapped"), F.lit(0)).cast("bigint")
    status = (F.when(n == 0, F.lit(STATUS_NOT_STARTED))
              .when(m == n, F.lit(STATUS_DONE)).otherwise(F.lit(STATUS_INCOMPLETE)))
    return j.select(*KEYS, n.alias("n_spans"), m.alias("n_mapped"), status.alias("status"))


def span_counts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans per dataset row (0 for rows without spans)."""
    c = spans.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_spans"))
    return docs.select(*KEYS).join(c, list(KEYS), "left").select(
        *KEYS, F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"))


def annotated_docs(spans: DataFrame) -> DataFrame:
    """Rows with at least one span, counted over the store (not the dataset)."""
    return spans.groupBy("project").agg(F.countDistinct("doc_id").alias("annotated_rows"))


def status_summary(status: DataFrame) -> DataFrame:
    """Per project: number of rows in each status (pivot over the 3 fixed values)."""
    p = status.groupBy("project").pivot("status", STATUSES).agg(F.count(F.lit(1)))
    return p.select("project", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s)
                                 for s in STATUSES])

"""Span -> category values: candidates, normalisation, setting, orphan check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.mapping import normalize_value
from spanloom.operators.ingest import empty_map

KEYS = ("project", "doc_id")


def candidates(spans: DataFrame, label_map: DataFrame, vocab: DataFrame) -> DataFrame:
    """For each span: its label's categories, and each category's terms.

    label -> categories -> terms, two equi-joins. A label without categories
    or a category without vocabulary gives NULLs (never an error). Both small
    sides are left to Catalyst/AQE to broadcast when their measured size is
    under the broadcast threshold; otherwise the joins shuffle.
    """
    lm = label_map.select("project", "label", F.col("pos").alias("cat_pos"), "category")
    v = vocab.where(F.col("term").isNotNull()).select(
        "project", F.col("key").alias("category"), F.col("pos").alias("term_pos"), "term")
    return (spans.select(*KEYS, "ord", "label").join(lm, ["project", "label"], "left")
            .join(v, ["project", "category"], "left")
            .select(*KEYS, "ord", "label", "category", "cat_pos", "term", "term_pos"))


def candidates_by_label(spans: DataFrame, label_map: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates of :func:`candidates` without a copy for every span: (spans, lists).

    ``spans`` are KEYS, ord, label; a span's candidates are the rows of ``lists`` with its (project, label):
    one per category and term of each label in use. So the output grows with the spans plus the
    vocabulary under the labels in use, and not with their product.
    """
    own = spans.select(*KEYS, "ord", "label")
    used = own.select("project", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("ord"),
                      "label").distinct()
    return own, candidates(used, label_map, vocab).drop("doc_id", "ord")


def normalize_mapping(df: DataFrame, col: str = "mapped_value") -> DataFrame:
    """JSON text / VARIANT mapping -> ``map<string,array<string>>``.

    Not an object (missing, list, scalar) -> {}; per category a list stays a
    list, a falsy scalar -> [], any other scalar -> [scalar].
    """
    c = F.col(col)
    v = F.try_parse_json(c) if dict(df.dtypes)[col] == "string" else c
    m = F.try_variant_get(v, "$", "map<string,variant>")
    return df.withColumn(col, F.coalesce(F.transform_values(m, lambda k, x: normalize_value(x)),
                                         empty_map()))


def set_mapping(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the values of categories on spans.

    ``changes``: KEYS, ord, category, values, seq. Per (span, category) the
    last change by ``seq`` wins. Setting [] on a category the span does not
    have, with no non-empty change before it, is a no-op (the value already
    reads as []). An existing category keeps its place; new ones are appended.
    Unknown ordinals are ignored.
    """
    # Partial aggregates (map-side combine), so a span that receives a huge
    # number of changes is never gathered into one task. Ties on seq are broken
    # by the values themselves, so the result is deterministic.
    last = changes.groupBy(*KEYS, "ord", "category").agg(
        F.max_by("values", F.struct(F.col("seq"), F.col("values"))).alias("values"),
        F.max(F.size("values") > 0).alias("_any"))
    per_span = last.groupBy(*KEYS, "ord").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "values"))).alias("_ch"),
        F.collect_list(F.when(F.col("_any"), F.col("category"))).alias("_nonempty"))
    j = spans.join(per_span, [*KEYS, "ord"], "left")
    m = F.col("mapped_value")
    ch = F.map_filter(F.col("_ch"), lambda k, v: (F.size(v) > 0) | F.map_contains_key(m, k)
                      | F.array_contains(F.col("_nonempty"), k))
    merged = F.map_concat(
        F.transform_values(m, lambda k, v: F.coalesce(F.try_element_at(ch, k), v)),
        F.map_filter(ch, lambda k, v: ~F.map_contains_key(m, k)))
    return j.withColumn("mapped_value", F.when(F.col("_ch").isNull(), m).otherwise(merged)) \
            .drop("_ch", "_nonempty")


def orphan_mappings(spans: DataFrame, vocab: DataFrame) -> DataFrame:
    """Mapped values that are not candidates of their category (left anti join)."""
    vals = (spans.select(*KEYS, "ord", F.explode("mapped_value").alias("category", "vals"))
            .select(*KEYS, "ord", "category", F.posexplode("vals").alias("vpos", "value")))
    v = vocab.where(F.col("term").isNotNull()).select(
        "project", F.col("key").alias("category"), F.col("term").alias("value"))
    return vals.join(v, ["project", "category", "value"], "left_anti")

"""Expressions over ``mapped_value`` (category -> list of values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_mapped(mapping) -> Column:
    """A span is mapped when some category holds a non-empty value list."""
    m = _c(mapping)
    return F.coalesce(F.exists(F.map_values(m), lambda v: F.size(v) > 0), F.lit(False))


def mapping_text(mapping) -> Column:
    """Canonical flat text of a mapping: ``k1=v1|v2;k2=...``, keys sorted.

    Used wherever a result must be a plain column (oracle comparisons, CSV).
    """
    m = _c(mapping)
    entries = F.array_sort(F.map_entries(m))
    parts = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="),
                                                    F.array_join(e["value"], "|")))
    return F.coalesce(F.array_join(parts, ";"), F.lit(""))


def normalize_value(v) -> Column:
    """One category value (VARIANT) -> ``array<string>``.

    A list stays a list (elements as text, a null element stays null); JSON null -> []; a falsy scalar
    (``0``, ``0.0``, ``false``, ``""``) -> []; any other scalar -> [scalar].
    Strings keep their text (``"0"`` is not falsy); numbers keep JSON text.
    """
    v = _c(v)
    kind = F.schema_of_variant(v)
    as_text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")) \
        .otherwise(F.to_json(v))
    falsy = (
        (kind == "VOID")
        | ((kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit("")))
        | ((kind == "BOOLEAN") & ~F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False)))
        | ((kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"))
           & (F.try_variant_get(v, "$", "double") == F.lit(0.0)))
        | (kind.startswith("OBJECT") & (F.to_json(v) == F.lit("{}")))
    )
    as_list = F.coalesce(
        F.transform(F.try_variant_get(v, "$", "array<variant>"),
                    lambda x: F.when(x.isNull() | (F.schema_of_variant(x) == "VOID"),
                                     F.lit(None).cast("string"))
                    .when(F.schema_of_variant(x) == "STRING",
                                     F.try_variant_get(x, "$", "string"))
                    .otherwise(F.to_json(x))),
        F.array().cast("array<string>"))
    return (
        F.when(v.isNull(), F.array().cast("array<string>"))
        .when(kind.startswith("ARRAY"), as_list)
        .when(falsy, F.array().cast("array<string>"))
        .otherwise(F.array(as_text))
    )

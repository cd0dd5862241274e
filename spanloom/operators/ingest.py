"""Ingest: row identity, the ``annotations`` column, nested <-> flat spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.arrays import sort_by
from spanloom.functions.mapping import normalize_value
from spanloom.operators.ordered import OrderedScan
from spanloom.session import materialize, spread
from spanloom.schema import ANNOTATIONS_DDL, ANNOTATIONS_VARIANT_DDL, MAPPING_TYPE

def empty_anns():
    return F.array().cast(ANNOTATIONS_DDL)


def empty_map():
    return F.create_map().cast(MAPPING_TYPE)


class SchemaError(ValueError):
    """Raised before any action when a required column is missing."""


def require_query(df: DataFrame) -> DataFrame:
    """Every dataset needs a ``query`` column; it is always read as text."""
    if "query" not in df.columns:
        raise SchemaError("dataset must contain a 'query' column; found " + ", ".join(df.columns))
    return df.withColumn("query", F.col("query").cast("string"))


def with_doc_id(df: DataFrame, key: str | None = None,
                order_by: list[str] | None = None, name: str = "doc_id") -> DataFrame:
    """Attach a dense 0-based row identity.

    * ``key`` given: that column is the identity; a text that is not a plain
      integer (a leading zero, a blank) is an error.
    * ``order_by`` given: position in that total order.
    * neither: position in input order (file path, then position in file).

    Dense positions never go through one partition: the data is range-sorted,
    each partition's row count is taken (one small row per partition), a running
    sum of those counts gives each partition's offset, and offset + position
    inside the partition is the id.
    """
    if key is not None:
        value = F.col(key).cast("bigint")
        if dict(df.dtypes)[key] == "string":  # ``007`` and ``7`` must not become one row
            plain = F.col(key).rlike("^(0|-?[1-9][0-9]{0,18})$")
            value = F.when(F.col(key).isNull() | plain, F.expr(f"try_cast(`{key}` as bigint)")).otherwise(
                F.raise_error(F.concat(F.lit(f"key column {key} holds no plain integer: "), F.col(key)))
                .cast("bigint"))
        return df.withColumn(name, value)
    if order_by:
        ordered = df.sort(*order_by)
    else:
        ordered = (df.withColumn("_f", F.col("_metadata.file_path"))
                   .withColumn("_m", F.monotonically_increasing_id())
                   .sort("_f", "_m").drop("_f", "_m"))
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftright("_mid", 33)) \
                   .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    # Counts and ids must come from the same tags, so the tagged rows are
    # written once to the shared checkpoint dir (survives executor loss) and
    # read twice.
    tagged = materialize(tagged, "doc-id")
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: tiny, so a global window here is fine.
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_part", "left")
    return out.withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos")) \
              .drop("_mid", "_part", "_pos", "_off")


def position_within(df: DataFrame, group: list[str], order: list[str],
                    name: str = "pos", skew_safe: bool | None = None) -> DataFrame:
    """0-based position of each row inside its group, in the given order.

    ``row_number() over (partition by group order by order) - 1`` when the
    largest group is under the checked bound; otherwise a skew-safe ordered
    scan (:class:`~spanloom.operators.ordered.OrderedScan`) that spreads a
    group holding most of the rows over many tasks.
    """
    plan = OrderedScan(df, list(group), list(order), skew_safe=skew_safe)
    return plan.finish(plan.scan(plan.frame, [(name, "index", None)]))


def _raw_checks(raw: Column):
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    # The parser stops after the first value. Inside a list and inside an object
    # the text must still be exactly one value, so nothing can follow it.
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    nested = F.try_parse_json(F.concat(F.lit('{"a":'), raw, F.lit("}")))
    tail_ok = F.coalesce((F.size(listed) == 1) & nested.isNotNull(), F.lit(False))
    reason = (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(v.isNull(), F.lit("invalid_json"))
        .when(~kind.startswith("ARRAY"), F.lit("not_array"))
        .when(~tail_ok, F.lit("invalid_json"))
    )
    arr = F.when(reason.isNull() & raw.isNotNull(), F.try_variant_get(v, "$", ANNOTATIONS_VARIANT_DDL))
    return arr, reason


def _element_reason(x: Column) -> Column:
    return (
        F.when(x.isNull(), F.lit("not_object"))
        .when(x["start"].isNull() | x["end"].isNull() | (x["start"] < 0) | (x["end"] < 0),
              F.lit("bad_offset"))
    )


def _normalize_element(x: Column) -> Column:
    m = F.try_variant_get(x["mapped_value"], "$", "map<string,variant>")
    norm = F.coalesce(F.transform_values(m, lambda k, v: normalize_value(v)), empty_map())
    return F.struct(x["text"].alias("text"), x["label"].alias("label"),
                    x["start"].alias("start"), x["end"].alias("end"),
                    norm.alias("mapped_value"))


def parse_annotations(df: DataFrame, col: str = "annotations",
                      keys: tuple[str, ...] = ("project", "doc_id")) -> tuple[DataFrame, DataFrame]:
    """Parse a JSON ``annotations`` text column.

    Returns ``(docs, rejects)``. ``docs`` has ``anns`` (``array<annotation>``):
    NULL cell -> [] silently; text that is not a JSON array -> [] and a reject
    (``invalid_json`` / ``not_array``); array elements that are not objects or
    whose offsets are unusable are dropped with a reject (``not_object`` /
    ``bad_offset``). ``mapped_value`` is normalised (see ``normalize_value``).
    ``rejects`` = ``keys..., elem bigint (NULL = whole cell), reason``.
    """
    raw = F.col(col)
    arr, reason = _raw_checks(raw)
    # JSON parsing is the heavy per-row step: run it over the cluster's
    # parallelism even when the input came as a few files.
    staged = spread(df).withColumn("_arr", arr).withColumn("_reason", reason)
    kept = F.filter(F.col("_arr"), lambda x: _element_reason(x).isNull())
    docs = staged.withColumn(
        "anns", F.coalesce(F.transform(kept, _normalize_element), empty_anns())
    ).drop("_arr", "_reason", col)

    cell = staged.where(F.col("_reason").isNotNull()).select(
        *keys, F.lit(None).cast("bigint").alias("elem"), F.col("_reason").alias("reason"))
    elem = (staged.where(F.col("_arr").isNotNull())
            .select(*keys, F.posexplode("_arr").alias("elem", "x"))
            .select(*keys, F.col("elem").cast("bigint"), _element_reason(F.col("x")).alias("reason"))
            .where(F.col("reason").isNotNull()))
    return docs, cell.unionByName(elem)


def init_annotations(docs: DataFrame) -> DataFrame:
    """One empty annotation list per row."""
    return docs.withColumn("anns", empty_anns())


def explode_spans(docs: DataFrame, keys: tuple[str, ...] = ("project", "doc_id"),
                  outer: bool = False) -> DataFrame:
    """Nested ``anns`` -> one row per span with its list ordinal ``ord``.

    ``outer=True`` keeps rows without spans (``ord`` NULL).
    """
    pe = F.posexplode_outer if outer else F.posexplode
    return (docs.select(*keys, pe("anns").alias("ord", "a"))
            .select(*keys, F.col("ord").cast("bigint"), "a.text", "a.label", "a.start", "a.end",
                    "a.mapped_value"))


def nest_spans(spans: DataFrame, keys: tuple[str, ...] = ("project", "doc_id")) -> DataFrame:
    """Flat spans -> one list per row, ordered by ``ord`` (never by arrival)."""
    entry = F.struct("ord", "text", "label", "start", "end", "mapped_value")
    return (spans.groupBy(*keys).agg(sort_by(F.collect_list(entry), "ord").alias("_l"))
            .select(*keys, F.transform("_l", lambda e: F.struct(
                e["text"].alias("text"), e["label"].alias("label"), e["start"].alias("start"),
                e["end"].alias("end"), e["mapped_value"].alias("mapped_value"))).alias("anns")))


def get_annotations(docs: DataFrame, spans: DataFrame,
                    keys: tuple[str, ...] = ("project", "doc_id")) -> DataFrame:
    """Each dataset row with its list; rows without spans get []."""
    nested = nest_spans(spans, keys)
    return docs.join(nested, list(keys), "left").withColumn(
        "anns", F.coalesce(F.col("anns"), empty_anns()))

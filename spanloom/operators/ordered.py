"""Running values inside ordered groups without one task per group.

``Window.partitionBy(group).orderBy(order)`` puts a whole group in one task,
so a document holding a third of all spans would be scanned by one task.
Here the rows are range-sorted by ``(group, order)`` instead, so a large group
spans many partitions. Each row is tagged with its partition and its position
in it, and the tagged rows are written once as Parquet in the shared
``spark.checkpoint.dir`` (:func:`materialize`), so every later read sees the
same tags and the input is computed once.

:func:`scan` then computes each running value in two parts:

* inside one (partition, group) piece -- a window over at most one range
  partition's rows;
* the carry from the same group's rows in earlier partitions -- from a summary
  with one row per (partition, group), where a group has at most one row per
  partition, joined back on (partition, group).

Several scans can run over one tagged frame (the second may use the first's
output); only the first pays for the sort. A scan reads its input twice
(pieces and summary), so an input that is not a written table is written
first by the caller.

:class:`OrderedScan` picks this form only when the largest group is above a
row bound, and plain windows otherwise, the same way a broadcast is chosen
only under a checked size.

Kinds of running value (``spec = (name, kind, column)``):

* ``max_before`` -- max of the column over earlier rows of the group (NULL if none)
* ``sum_upto``   -- sum over earlier rows and this one (NULLs count as 0)
* ``lag`` / ``lead`` -- the column on the previous / next row (NULL if none)
* ``index``      -- 0-based position in the group (column ignored)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import materialize

TAGS = ("_part", "_pos")
_FIRST = Window.unboundedPreceding
_KINDS = ("max_before", "sum_upto", "lag", "lead", "index")


def tag_order(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """Range-sort by (group, order); add ``_part``, ``_pos`` and a unique ``_rid``.

    ``_rid`` identifies the row for later joins. The result is materialised.
    """
    mid = F.monotonically_increasing_id()
    tagged = (df.sort(*group, *order).withColumn("_rid", mid)
              .withColumn("_part", F.shiftright("_rid", 33))
              .withColumn("_pos", F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1))))
    return materialize(tagged, "ordered")


def untag(df: DataFrame, keep_rid: bool = False) -> DataFrame:
    return df.drop(*TAGS) if keep_rid else df.drop(*TAGS, "_rid")


def _col(c) -> Column:
    if c is None:
        return F.lit(1)
    return F.col(c) if isinstance(c, str) else c


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where NULL matches NULL (a NULL row key is still a key)."""
    r = right.select(*[F.col(k).alias(f"__r{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r{k}")) for k in keys])
    return left.join(r, cond, "left").drop(*[f"__r{k}" for k in keys])


def scan(tagged: DataFrame, group: list[str], specs: list[tuple]) -> DataFrame:
    """Add one column per ``(name, kind, column)`` spec (see module doc)."""
    g = list(group)
    for _, kind, _ in specs:
        if kind not in _KINDS:
            raise ValueError(f"unknown scan kind {kind!r}")
    wl = Window.partitionBy("_part", *g).orderBy("_pos")
    local = (tagged.withColumn("__rn", F.row_number().over(wl))
             .withColumn("__lastp", F.lead(F.lit(1)).over(wl).isNull()))
    summ = []
    for name, kind, c in specs:
        x = _col(c)
        if kind == "max_before":
            local = local.withColumn(f"__l{name}", F.max(x).over(wl.rowsBetween(_FIRST, -1)))
            summ.append(F.max(x).alias(f"__s{name}"))
        elif kind == "sum_upto":
            local = local.withColumn(f"__l{name}", F.sum(x).over(wl.rowsBetween(_FIRST, 0)))
            summ.append(F.sum(x).alias(f"__s{name}"))
        elif kind == "lag":
            local = local.withColumn(f"__l{name}", F.lag(x).over(wl))
            summ.append(F.max_by(F.struct(x.alias("v")), F.col("_pos")).alias(f"__s{name}"))
        elif kind == "lead":
            local = local.withColumn(f"__l{name}", F.lead(x).over(wl))
            summ.append(F.min_by(F.struct(x.alias("v")), F.col("_pos")).alias(f"__s{name}"))
        else:
            summ.append(F.count(F.lit(1)).alias(f"__s{name}"))
    # One row per (partition, group); a group has at most one row per partition,
    # so the carry window below is small even for the largest group.
    wg = Window.partitionBy(*g).orderBy("_part")
    carry = []
    for name, kind, _ in specs:
        s = F.col(f"__s{name}")
        if kind == "max_before":
            c = F.max(s).over(wg.rowsBetween(_FIRST, -1))
        elif kind in ("sum_upto", "index"):
            c = F.sum(s).over(wg.rowsBetween(_FIRST, -1))
        elif kind == "lag":
            c = F.lag(s).over(wg)["v"]
        else:
            c = F.lead(s).over(wg)["v"]
        carry.append(c.alias(f"__c{name}"))
    summary = tagged.groupBy("_part", *g).agg(*summ).select("_part", *g, *carry)
    j = null_safe_join(local, summary, ["_part", *g])
    for name, kind, _ in specs:
        lo, ca = F.col(f"__l{name}"), F.col(f"__c{name}")
        if kind == "max_before":
            v = F.greatest(lo, ca)
        elif kind == "sum_upto":
            v = F.coalesce(lo, F.lit(0)) + F.coalesce(ca, F.lit(0))
        elif kind == "index":
            v = (F.col("__rn") - 1 + F.coalesce(ca, F.lit(0))).cast("bigint")
        elif kind == "lag":
            v = F.when(F.col("__rn") == 1, ca).otherwise(lo)
        else:
            v = F.when(F.col("__lastp"), ca).otherwise(lo)
        j = j.withColumn(name, v)
    return j.drop("__rn", "__lastp", *[f"__l{n}" for n, _, _ in specs],
                  *[f"__c{n}" for n, _, _ in specs])


# A plain per-group window is used only when the largest group is proven to
# be at most this many rows (one task sorts and scans it); above it, the
# skew-safe range scan.
MAX_GROUP_ROWS = 2_000_000


def largest_group(df: DataFrame, group: list[str]) -> int:
    """Row count of the largest group (a partial aggregate, one number to the driver)."""
    row = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m")).first()
    return int(row["m"] or 0)


def _window_scan(df: DataFrame, group: list[str], order: list, specs: list[tuple]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    out = df
    for name, kind, c in specs:
        x = _col(c)
        if kind == "max_before":
            v = F.max(x).over(w.rowsBetween(_FIRST, -1))
        elif kind == "sum_upto":
            v = F.coalesce(F.sum(x).over(w.rowsBetween(_FIRST, 0)), F.lit(0))
        elif kind == "lag":
            v = F.lag(x).over(w)
        elif kind == "lead":
            v = F.lead(x).over(w)
        elif kind == "index":
            v = (F.row_number().over(w) - 1).cast("bigint")
        else:
            raise ValueError(f"unknown scan kind {kind!r}")
        out = out.withColumn(name, v)
    return out


class OrderedScan:
    """Running values in ``(group, order)`` with the physical form chosen by size.

    The largest group is measured once (:func:`largest_group`). Up to
    ``max_group_rows`` the scans are plain windows (one shuffle by group);
    above it every scan is the skew-safe range scan. Both give the same rows.
    ``frame`` is the input to scan (tagged in skew-safe mode); pass it, or a
    frame derived from it, to :meth:`scan`, and end with :meth:`finish`.
    ``skew_safe`` forces a mode (tests, or a caller that knows the sizes).
    """

    def __init__(self, df: DataFrame, group: list[str], order: list,
                 max_group_rows: int | None = None, skew_safe: bool | None = None):
        self.group, self.order = list(group), list(order)
        self.largest = None  # measured size of the largest group, if measured
        if skew_safe is None:
            limit = MAX_GROUP_ROWS if max_group_rows is None else max_group_rows
            self.largest = largest_group(df, self.group)
            skew_safe = self.largest > limit
        self.skew_safe = skew_safe
        self.frame = tag_order(df, self.group, self.order) if skew_safe else df

    def scan(self, frame: DataFrame, specs: list[tuple]) -> DataFrame:
        if self.skew_safe:
            return scan(frame, self.group, specs)
        return _window_scan(frame, self.group, self.order, specs)

    def finish(self, frame: DataFrame, keep_rid: bool = False) -> DataFrame:
        return untag(frame, keep_rid) if self.skew_safe else frame

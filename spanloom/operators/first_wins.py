"""First-wins over one large overlap island in parallel rounds.

A proposal is accepted if no span accepted before it (stored, or earlier by ``seq``)
overlaps it. In a round every live proposal that comes first among the live
ones it overlaps is accepted (nothing undecided can reject it), and what overlaps an
accepted one drops out. No pairs are formed: the island's positions are the leaves
of a binary tree, a span is the few nodes that make it up exactly, a position is the
path above it, and two spans overlap exactly if the start of one lies in the other, so if a path
meets a span's nodes. Per node the first proposal and the first start are
plain aggregates, and each proposal looks up its own nodes in equi-joins: log rows of it
in each direction. With arrivals in no order along the text the rounds are logarithmic; what is
still undecided after ``MAX_ROUNDS`` (a chain that only resolves link by link) is left to
the sequential fold.

Spans are half-open; an empty span meets the spans that contain its position strictly inside, and no
empty one. For that positions are doubled: ``[a, b)`` covers ``2a + 1 .. 2b - 1``, an empty span at
``p`` only ``2p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import materialize

MAX_ROUNDS = 12
#: Levels that a node's number can tell apart.
_TOP = 40


def _node(level: Column, index: Column) -> Column:
    return index + F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(_TOP) - level)


def _path(at: Column, levels: int) -> Column:
    """The nodes above a position."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: _node(k, F.call_function("shiftright", at, k)))


def _cover(lo: Column, hi: Column, levels: int) -> Column:
    """The nodes whose leaves are exactly the positions ``lo .. hi - 1``."""
    def at(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        left, right = F.call_function("shiftright", lo + width - 1, k), F.call_function("shiftright", hi, k)
        some = left < right
        return F.array(F.when(some & (left % 2 == 1), _node(k, left)),
                       F.when(some & (right % 2 == 1), _node(k, right - 1)))

    return F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))))


def _by_node(spans: DataFrame, column: str) -> DataFrame:
    """Per (gid, node): the first span of all, and of the non-empty ones."""
    each = spans.select("gid", F.explode(column).alias("node"), "rank", "empty")
    return each.groupBy("gid", "node").agg(
        F.min("rank").alias("any"), F.min(F.when(~F.col("empty"), F.col("rank"))).alias("full"))


def _first_met(live: DataFrame, others: DataFrame) -> DataFrame:
    """rid, met: the first of ``others`` (itself included, if it is one) that each live span overlaps."""
    ups, downs = _by_node(others, "cover"), _by_node(others, "path")
    look = (live.select("rid", "gid", "empty", F.explode("path").alias("node")).join(ups, ["gid", "node"])
            .unionByName(live.select("rid", "gid", "empty", F.explode("cover").alias("node"))
                         .join(downs, ["gid", "node"])))
    return look.groupBy("rid").agg(F.min(F.when(F.col("empty"), F.col("full")).otherwise(F.col("any"))).alias("met"))


def rounds(items: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rid, keep) of the decided items, and the rid of the undecided ones.

    ``items``: gid (island), rid, kind (0 stored and kept, 1 proposed), seq, start, end; ``start <= end``, nothing
    null. Undecided items overlap no accepted one.
    """
    max_rounds = MAX_ROUNDS if max_rounds is None else max_rounds
    low = items.groupBy("gid").agg(F.min("start").alias("low"))
    empty = F.col("start") == F.col("end")
    spans = items.join(low, "gid").select(
        "gid", "rid", "kind", F.struct("seq", "rid").alias("rank"), empty.alias("empty"),
        (2 * (F.col("start") - F.col("low")) + F.when(empty, 0).otherwise(1)).alias("lo"),
        (2 * (F.col("end") - F.col("low")) + F.when(empty, 1).otherwise(0)).alias("hi"))
    spans = materialize(spans, "rounds")
    levels = int(spans.agg(F.max("hi")).first()[0] or 0).bit_length()
    if levels >= _TOP:
        raise ValueError("an island too wide")
    spans = materialize(spans.withColumn("path", _path(F.col("lo"), levels)).withColumn(
        "cover", _cover(F.col("lo"), F.col("hi"), levels)), "rounds")
    stored, live = spans.where("kind = 0"), spans.where("kind = 1")
    decided = stored.select("rid", F.lit(True).alias("keep"))
    hit = _first_met(live, stored).where("met is not null").select("rid")
    hit = materialize(hit, "rejected")
    decided = decided.unionByName(hit.select("rid", F.lit(False).alias("keep")))
    live = materialize(live.join(hit, "rid", "left_anti"), "live")
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        met = _first_met(live, live)
        first = live.join(met, "rid", "left").where("met is null or met >= rank")
        first = materialize(first.drop("met"), "accepted")
        rest = live.join(first.select("rid"), "rid", "left_anti")
        out = materialize(_first_met(rest, first).where("met is not null").select("rid"), "rejected")
        decided = decided.unionByName(first.select("rid", F.lit(True).alias("keep"))).unionByName(
            out.select("rid", F.lit(False).alias("keep")))
        live = materialize(rest.join(out, "rid", "left_anti"), "live")
    return decided, live.select("rid")

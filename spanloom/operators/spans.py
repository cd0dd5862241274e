"""Spans: locate, check, overlap, greedy add, remove / update by ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrays import sort_by
from spanloom.functions.spans import found_in, locate0, span_slice, validate_reason
from spanloom.operators import first_wins
from spanloom.operators import ordered as O
from spanloom.session import materialize

KEYS = ("project", "doc_id")


# --------------------------------------------------------------------------- B1-B3
def locate_first(df: DataFrame, text_col: str = "text", query_col: str = "query",
                 start_col: str | None = None, end_col: str | None = None) -> DataFrame:
    """Auto-locate: first occurrence of the entity text in the query.

    Found -> ``start = find(text)``, ``end = start + len(text)``. Not found (or
    empty text) -> the caller's offsets (``start_col``/``end_col``), default 0.
    Adds ``found``, ``start``, ``end``.
    """
    hit = found_in(query_col, text_col)
    s0 = F.col(start_col).cast("bigint") if start_col else F.lit(0).cast("bigint")
    e0 = F.col(end_col).cast("bigint") if end_col else F.lit(0).cast("bigint")
    start = F.when(hit, locate0(query_col, text_col)).otherwise(s0)
    end = F.when(hit, locate0(query_col, text_col) + F.length(text_col)).otherwise(e0)
    return df.withColumn("found", hit).withColumn("start", start).withColumn("end", end)


def validate_span(df: DataFrame, query_col: str = "query") -> DataFrame:
    """Adds ``reason`` (NULL = valid) and ``valid``."""
    r = validate_reason(query_col, "text", "start", "end")
    return df.withColumn("reason", r).withColumn("valid", r.isNull())


def with_slice(df: DataFrame, query_col: str = "query") -> DataFrame:
    """Adds ``slice = query[start:end]`` and ``slice_matches`` (slice == text)."""
    sl = span_slice(query_col, "start", "end")
    return df.withColumn("slice", sl).withColumn(
        "slice_matches", F.coalesce(sl == F.col("text"), F.lit(False)))


# --------------------------------------------------------------------------- B4
#: Bins that a span may cover; a longer one is matched by its row alone.
MAX_BINS = 1024


def _binned(df: DataFrame, w) -> DataFrame:
    """Copy each span to the fixed-width bins it covers (an empty span: the bin of its start)."""
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return df.select(*KEYS, "ord", "start", "end",
                     F.explode(F.sequence(F.floor(F.col("start") / w), F.floor(last / w)))
                     .alias("bin"))


def overlap_pairs(spans: DataFrame, bin_width: int = 64) -> DataFrame:
    """All pairs of overlapping spans of the same row, ``a.ord < b.ord``.

    A range join, not an all-pairs join per row: each span is copied to the
    fixed-width bins it covers, pairs are joined on ``(project, doc_id, bin)``,
    and a pair is kept only in the bin holding ``max(a.start, b.start)`` so it
    is reported once. A span over more than ``MAX_BINS`` bins is not copied: it
    is joined with its row's spans directly (few such spans fit a text without
    overlapping, and overlapping ones are output). Empty spans
    (``start >= end``) never overlap each other, so they are joined only
    against non-empty spans: a pile of empty spans at one position forms no
    pairs.
    """
    w = F.lit(bin_width)
    base = spans.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(
        *KEYS, "ord", "start", "end")
    is_full = F.col("start") < F.col("end")
    is_long = F.col("end") - F.col("start") > bin_width * MAX_BINS
    long = base.where(is_long)
    short = base.where(~is_long)
    full, empty = _binned(short.where(is_full), w), _binned(short.where(~is_full), w)

    def pairs(x: DataFrame, y: DataFrame, ordered: bool, binned: bool) -> DataFrame:
        xa, yb = x.alias("a"), y.alias("b")
        cond = ((F.col("a.project") == F.col("b.project")) & (F.col("a.doc_id") == F.col("b.doc_id"))
                & ~((F.col("b.end") <= F.col("a.start")) | (F.col("b.start") >= F.col("a.end"))))
        if binned:
            cond = cond & (F.col("a.bin") == F.col("b.bin")) & (
                F.floor(F.greatest(F.col("a.start"), F.col("b.start")) / w) == F.col("a.bin"))
        if ordered:
            cond = cond & (F.col("a.ord") < F.col("b.ord"))
        j = xa.join(yb, cond)
        lo = F.col("a.ord") < F.col("b.ord")

        def pick(c):
            return F.when(lo, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))

        def other(c):
            return F.when(lo, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

        return j.select(
            F.col("a.project").alias("project"), F.col("a.doc_id").alias("doc_id"),
            pick("ord").alias("ord_a"), other("ord").alias("ord_b"),
            pick("start").alias("start_a"), pick("end").alias("end_a"),
            other("start").alias("start_b"), other("end").alias("end_b"))

    return (pairs(full, full, True, True).unionByName(pairs(empty, full, False, True))
            .unionByName(pairs(long, long, True, False)).unionByName(pairs(short, long, False, False)))


# --------------------------------------------------------------------------- B5
_ITEM = ("kind", "seq", "start", "end", "text", "label", "mapped_value")

# Islands up to this many items are folded JVM-side in one array (quadratic in
# the island, so kept small); larger ones stream through a sorted-interval fold.
ISLAND_FOLD_MAX = 1000
#: Items of an island above which many tasks share it, in rounds.
ROUNDS_MIN = 500_000


def _islands(items: DataFrame, skew_safe: bool | None = None,
             written: bool = False) -> tuple[DataFrame, O.OrderedScan]:
    """Tag items with ``island``, ``dup`` and a row id ``_rid``.

    Items of a row are ordered by (start, end, kind, seq); a new island starts
    where ``start`` reaches the max ``end`` of all earlier items. The running
    max, the previous item and the island count are ordered scans
    (:class:`~spanloom.operators.ordered.OrderedScan`): plain windows when
    the largest row is under the checked bound, else skew-safe range scans
    that spread a row holding most of the spans over many tasks. Items are
    written once first, so the size check and the scans do not recompute an
    expensive input (e.g. the containment join). Returns the staged items
    and the scan plan (mode and measured largest row).
    """
    if not written:  # ``written``: items already carry ``_rid`` and are a written table
        items = materialize(items.withColumn("_rid", F.monotonically_increasing_id()), "items")
    plan = O.OrderedScan(items, list(KEYS), ["start", "end", "kind", "seq"], skew_safe=skew_safe)
    t = plan.scan(plan.frame, [("_pe", "max_before", "end"), ("_ps", "lag", "start"),
                               ("_pe1", "lag", "end")])
    same_prev = (F.col("_ps") == F.col("start")) & (F.col("_pe1") == F.col("end"))
    t = (t.withColumn("dup", (F.col("kind") == 1) & (F.col("start") < F.col("end"))
                      & F.coalesce(same_prev, F.lit(False)))
         .withColumn("_new", F.when(F.col("_pe").isNull() | (F.col("start") >= F.col("_pe")), 1)
                     .otherwise(0))
         .drop("_pe", "_ps", "_pe1"))
    if plan.skew_safe:
        # A range scan reads its input twice (pieces and summary): write it once.
        t = materialize(t, "islands")
    t = plan.scan(t, [("island", "sum_upto", "_new")])
    staged = plan.finish(t, keep_rid=True).drop("_new")
    if plan.skew_safe:
        staged = materialize(staged, "islands")
    return staged, plan


def _fold_small(live: DataFrame) -> DataFrame:
    """JVM fold: one ``aggregate`` over each island's items sorted by (kind, seq)."""
    entry = F.struct("_rid", *[F.col(c) for c in _ITEM])
    grouped = live.groupBy(*KEYS, "island").agg(
        sort_by(F.collect_list(entry), "kind", "seq").alias("arr"))
    init = F.array().cast("array<struct<s:bigint,e:bigint,keep:boolean>>")

    def step(acc, x):
        hit = F.exists(acc, lambda a: a["keep"] & ~((x["end"] <= a["s"]) | (x["start"] >= a["e"])))
        keep = (x["kind"] == 0) | ~hit
        return F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"),
                                              keep.alias("keep"))))

    flags = F.aggregate("arr", init, step)
    return (grouped.select(*KEYS, "island",
                           F.explode(F.arrays_zip(F.col("arr").alias("x"), flags.alias("f")))
                           .alias("z"))
            .select(*KEYS, "island", F.col("z.x._rid").alias("_rid"),
                    *[F.col("z.x")[c].alias(c) for c in _ITEM], F.col("z.f.keep").alias("keep")))


def _island_stream(batches):
    """Greedy fold over rows sorted by (row, island, kind, stored start, seq).

    Stored spans (kind 0) come first, by start: a prefix max of their ends
    answers "does any stored span overlap [s, e)". Accepted non-empty
    proposals are disjoint, so a list sorted by start answers the same with
    one bisect. An accepted empty or inverted span ``[s, e)``, ``e <= s``, blocks
    spans that start before ``e`` and end after ``s``; among those by start the
    candidates lie inside the proposal. Memory is one island's stored and
    accepted spans.
    """
    import bisect

    import pandas as pd
    cur = None
    st_s: list = []
    st_m: list = []
    acc_s: list = []
    acc_e: list = []
    pts: list = []
    for pdf in batches:
        rid_out, keep_out = [], []
        cols = [pdf[c].tolist() for c in ("project", "doc_id", "island", "_rid", "kind", "start", "end")]
        for p, d, isl, rid, kind, s, e in zip(*cols):
            # NULL keys arrive as NaN (NaN != NaN): compare them as None.
            key = tuple(None if x is None or x != x else x for x in (p, d, isl))
            if key != cur:
                cur, st_s, st_m, acc_s, acc_e, pts = key, [], [], [], [], []  # pts: (start, end)
            s, e = int(s), int(e)
            if kind == 0:
                st_s.append(s)
                st_m.append(max(e, st_m[-1]) if st_m else e)
                keep = True
            else:
                j = bisect.bisect_left(st_s, e)
                hit = j > 0 and st_m[j - 1] > s
                if not hit:
                    j = bisect.bisect_left(acc_s, e)
                    hit = j > 0 and acc_e[j - 1] > s
                if not hit:
                    k = bisect.bisect_right(pts, (s, float("inf")))
                    while not hit and k < len(pts) and pts[k][0] < e:
                        hit = pts[k][1] > s
                        k += 1
                keep = not hit
                if keep:
                    if s < e:
                        j = bisect.bisect_left(acc_s, s)
                        acc_s.insert(j, s)
                        acc_e.insert(j, e)
                    else:
                        bisect.insort(pts, (s, e))
            rid_out.append(rid)
            keep_out.append(keep)
        yield pd.DataFrame({"_rid": pd.Series(rid_out, dtype="int64"),
                            "keep": pd.Series(keep_out, dtype=bool)})


def _fold_large(live: DataFrame) -> DataFrame:
    """Streaming fold for islands above ``ISLAND_FOLD_MAX`` (see :func:`_island_stream`).

    The greedy rule is order-dependent, so one island is one sequential pass;
    it streams in sorted order and never becomes one array or one group.
    """
    order = live.select(*KEYS, "island", "_rid", "kind", "start", "end",
                        F.when(F.col("kind") == 0, F.col("start")).alias("_sst"), "seq")
    flags = (order.repartition(*KEYS, "island")
             .sortWithinPartitions(*KEYS, "island", "kind", "_sst", "seq")
             .select(*KEYS, "island", "_rid", "kind", "start", "end")
             .mapInPandas(_island_stream, "_rid bigint, keep boolean"))
    return live.join(flags, "_rid").select(*KEYS, "island", "_rid", *_ITEM, "keep")


def _fold_rounds(live: DataFrame) -> DataFrame:
    """Islands above ``ROUNDS_MIN`` in parallel rounds (:mod:`spanloom.operators.first_wins`); what these leave
    undecided, and islands with inverted spans, by the streaming fold."""
    live = materialize(live, "huge-islands")
    ids = live.groupBy(*KEYS, "island").agg(F.bool_or(F.col("end") < F.col("start")).alias("_odd"))
    ids = materialize(ids.withColumn("gid", F.monotonically_increasing_id()), "island-ids")
    live = O.null_safe_join(live, ids, [*KEYS, "island"])
    plain = live.where(~F.col("_odd"))
    decided, left = first_wins.rounds(plain.select("gid", F.col("_rid").alias("rid"), "kind", "seq", "start", "end"))
    decided = plain.join(decided.withColumnRenamed("rid", "_rid"), "_rid")
    rest = plain.join(left.withColumnRenamed("rid", "_rid"), "_rid", "left_semi").unionByName(live.where("_odd"))
    cols = [*KEYS, "island", "_rid", *_ITEM]
    return decided.select(*cols, "keep").unionByName(_fold_large(rest.select(*cols)))


def _fold_islands(items: DataFrame, skew_safe: bool | None = None,
                  written: bool = False) -> tuple[DataFrame, bool]:
    """Greedy first-wins overlap check, one sequential fold per overlap island.

    ``items``: KEYS + kind (0 = already stored, always kept; 1 = proposed) +
    seq (ord for stored, arrival order for proposed) + span fields, offsets
    not NULL.

    Proposals only interact inside an *island*: a maximal run of spans, sorted
    by start, whose extents overlap, so a row with many spans is cut into many
    independent folds. Proposals identical to an earlier non-empty span are
    rejected without entering the fold (they always overlap it or what
    rejected it). Islands up to ``ISLAND_FOLD_MAX`` items fold JVM-side, larger
    ones stream, those above ``ROUNDS_MIN`` are decided in parallel rounds. Returns the items with ``keep`` and ``dup``, and the scan mode.
    """
    staged, plan = _islands(items, skew_safe, written)
    dups = staged.where("dup").withColumn("keep", F.lit(False))
    live = staged.where(~F.col("dup")).drop("dup")
    sizes = live.groupBy(*KEYS, "island").agg(F.count(F.lit(1)).alias("_n"))
    # An island is never larger than its row: when the largest row is known
    # to be small, no island needs the streaming fold and nothing is checked.
    small_rows = plan.largest is not None and plan.largest <= ISLAND_FOLD_MAX
    if small_rows or sizes.where(F.col("_n") > ISLAND_FOLD_MAX).limit(1).count() == 0:
        folded = _fold_small(live)
    else:
        live = O.null_safe_join(live, sizes, [*KEYS, "island"])
        small = _fold_small(live.where(F.col("_n") <= ISLAND_FOLD_MAX).drop("_n"))
        large = live.where((F.col("_n") > ISLAND_FOLD_MAX) & (F.col("_n") <= ROUNDS_MIN)).drop("_n")
        huge = live.where(F.col("_n") > ROUNDS_MIN).drop("_n")
        folded = small.unionByName(_fold_large(large))
        if sizes.where(F.col("_n") > ROUNDS_MIN).limit(1).count():
            folded = folded.unionByName(_fold_rounds(huge))
    folded = folded.withColumn("dup", F.lit(False))
    return folded.unionByName(dups.select(folded.columns)).drop("_rid"), plan.skew_safe


def _proposal_items(proposed: DataFrame) -> DataFrame:
    mv = "mapped_value" if "mapped_value" in proposed.columns else None
    return proposed.select(
        *KEYS, F.lit(1).alias("kind"), F.col("seq"),
        F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
        "text", "label",
        (F.col(mv) if mv else F.create_map().cast("map<string,array<string>>")).alias("mapped_value"))


def add_spans_flags(existing: DataFrame | None, proposed: DataFrame,
                    skew_safe: bool | None = None) -> tuple[DataFrame, bool]:
    """Per-item result of the greedy add (see :func:`add_spans`), and the scan mode.

    All items (stored and proposed, usable offsets or not) are written once,
    so neither the size check nor the split below recomputes the input.
    """
    items = _proposal_items(proposed)
    if existing is not None:
        stored = existing.select(
            *KEYS, F.lit(0).alias("kind"), F.col("ord").cast("bigint").alias("seq"),
            F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
            "text", "label", "mapped_value")
        items = stored.unionByName(items)
    items = materialize(items.withColumn("_rid", F.monotonically_increasing_id()), "items")
    usable = F.col("start").isNotNull() & F.col("end").isNotNull()
    folded, skew_safe = _fold_islands(items.where(usable), skew_safe, written=True)
    # A proposal without offsets is rejected; a stored span without offsets
    # is kept and overlaps nothing.
    # Without stored spans every unusable item is a rejected proposal; a
    # literal keeps the optimizer able to prune it from the kept spans (and
    # the renumbering then reuses the fold's partitioning).
    keep = F.col("kind") == 0 if existing is not None else F.lit(False)
    unusable = (items.where(~usable).drop("_rid")
                .withColumn("island", F.lit(None).cast("bigint"))
                .withColumn("keep", keep).withColumn("dup", F.lit(False)))
    return folded.unionByName(unusable.select(folded.columns)), skew_safe


def add_spans(existing: DataFrame | None, proposed: DataFrame,
              skew_safe: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Add proposed spans in ``seq`` order; a span overlapping an accepted one is rejected.

    ``existing``: flat spans (KEYS, ord, text, label, start, end, mapped_value)
    or None. ``proposed``: KEYS, seq, text, label, start, end[, mapped_value].
    Returns ``(spans, outcomes)``: the new flat span table (accepted spans
    appended after the stored ones, in ``seq`` order) and one row per proposal
    with ``accepted`` and ``reason`` (``overlap`` / ``bad_offset``).
    """
    flags, skew_safe = add_spans_flags(existing, proposed, skew_safe)
    props = flags.where(F.col("kind") == 1)
    outcomes = props.select(
        *KEYS, "seq", F.col("keep").alias("accepted"),
        F.when(F.col("keep"), F.lit(None).cast("string"))
        .when(F.col("start").isNull() | F.col("end").isNull(), F.lit("bad_offset"))
        .otherwise(F.lit("overlap")).alias("reason"))
    # Stored spans sort first (kind 0, by ord), so accepted proposals continue
    # the list in seq order; the list is renumbered densely from 0 by an
    # ordered scan in the mode already chosen (kept rows per row <= items per row).
    plan = O.OrderedScan(flags.where("keep"), list(KEYS), ["kind", "seq"], skew_safe=skew_safe)
    spans = plan.finish(plan.scan(plan.frame, [("ord", "index", None)]))
    return spans.select(*KEYS, "ord", "text", "label", "start", "end", "mapped_value"), outcomes


# --------------------------------------------------------------------------- B7, B8
# Requests are independent: every ordinal means the list as it is stored.
def remove_span(spans: DataFrame, requests: DataFrame) -> DataFrame:
    """Remove the spans at the requested ordinals of each row; later ordinals shift down.

    Any number of requests per row; a repeated one counts once and an ordinal
    out of range is a no-op. Dependent edits go through ``replay_edits``.
    """
    req = requests.select(*KEYS, F.col("ord").cast("bigint").alias("ord")).distinct().withColumn("_gone", F.lit(1))
    j = spans.join(req, [*KEYS, "ord"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(0)))
    # Removed ordinals up to each span: a running sum of the row (an ordered scan, no list of requests).
    skew_safe = O.largest_group(spans, list(KEYS)) > O.MAX_GROUP_ROWS
    plan = O.OrderedScan(j, list(KEYS), ["ord"], skew_safe=skew_safe)
    j = plan.finish(plan.scan(plan.frame, [("_before", "sum_upto", "_gone")]))
    return j.where("_gone = 0").select(*[
        (F.col("ord") - F.col("_before")).alias("ord") if c == "ord" else F.col(c) for c in spans.columns])


def update_span(spans: DataFrame, requests: DataFrame) -> DataFrame:
    """Replace the spans at the requested ordinals of each row (no overlap re-check).

    Out-of-range ordinals are no-ops; of several requests for one ordinal the
    last by ``seq`` counts. ``requests``: KEYS, ord, text, label, start,
    end[, mapped_value][, seq] (missing mapping -> {}).
    """
    mv = (F.col("mapped_value") if "mapped_value" in requests.columns
          else F.create_map().cast("map<string,array<string>>"))
    seq = F.col("seq") if "seq" in requests.columns else F.lit(0)
    new = F.struct(F.col("text").alias("text"), F.col("label").alias("label"),
                   F.col("start").cast("bigint").alias("start"),
                   F.col("end").cast("bigint").alias("end"), mv.alias("mapped_value"))
    rank = F.struct(seq.alias("seq"), F.col("start").alias("s"), F.col("end").alias("e"),
                    F.col("text").alias("t"), F.col("label").alias("l"))
    req = requests.groupBy(*KEYS, F.col("ord").cast("bigint").alias("ord")).agg(
        F.max_by(new, rank).alias("_new"))
    j = spans.join(req, [*KEYS, "ord"], "left")
    hit = F.col("_new").isNotNull()
    return j.select(*KEYS, "ord",
                    *[F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c)
                      for c in ("text", "label", "start", "end", "mapped_value")])

"""Incremental edit replay over a stream (B10) and live progress (M6).

The edit log arrives as a stream; files or partitions may arrive out of
order and may be replayed. Per row (``project, doc_id``) keyed state holds the
current annotation list, the next ``seq`` to apply and the edits that
arrived early; ``seq`` must be dense per row (0, 1, 2, ...). An edit is
applied only when every earlier one has been, so the final list equals the
batch :func:`spanloom.operators.edits.replay_edits` for any arrival order and
any split into micro-batches. ``seq`` below ``next_seq`` is a duplicate and is
dropped; of different edits with one ``seq`` the first by content is applied, among those that
have arrived by then.

The state is kept by ``transformWithState``: a value (counts, ``next_seq``) and maps
of list pages, rank nodes, bins and blocks of early edits
(:class:`~spanloom.operators.spanlist.SpanList` over views of them). A micro-batch
reads and writes the entries that its edits touch, never the whole list. Every read or write
is a call to the state store and takes longer than an edit itself, so early edits go by
blocks of ``BLOCK`` places, what the head shows to be empty is not asked for, and a list of one
page has no nodes and bins in the state: they are made of the page. It needs
the RocksDB state store, which :func:`run_replay_stream` sets for its query.

Each micro-batch emits, for every row it touched, a small snapshot:
``next_seq``, span and mapped-span counts and the number of early edits
(not the list). Snapshots are appended by ``foreachBatch`` (Parquet has no
upsert); readers take the snapshot with the largest ``next_seq`` per row, so
a replayed batch is harmless. The lists themselves are read from the
query's committed state with Spark's state data source
(:func:`state_spans`). State does not expire (the model has no event time).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from spanloom.operators.ingest import position_within
from spanloom.operators.spanlist import SpanList, apply_edit, content
from spanloom.schema import ANNOTATIONS_DDL

KEYS = ("project", "doc_id")

EDIT_COLS = ("seq", "op", "ord", "text", "label", "start", "end", "category", "values")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Places in the order whose early edits share an entry of the state.
BLOCK = 128

SNAPSHOT = ("project string, doc_id bigint, next_seq bigint, pending bigint, n_spans bigint, "
            "n_mapped bigint")


class Touched(MutableMapping):
    """A map state whose entries are read once and written back, if changed, by ``flush``.

    ``empty``: the state is known to have no entry, so none is asked for.
    """

    def __init__(self, state, numbers: bool = False, empty: bool = False):
        self.state, self.numbers, self.empty = state, numbers, empty
        self.seen: dict = {}
        self.changed: set = set()

    def __getitem__(self, key):
        if key not in self.seen:
            found = None if self.empty else self.state.getValue((key,))
            value = None if found is None else found[0]
            self.seen[key] = value if value is None or self.numbers else json.loads(value)
        if self.seen[key] is None:
            raise KeyError(key)
        return self.seen[key]

    def __setitem__(self, key, value):
        self.seen[key] = value
        self.changed.add(key)

    def __delitem__(self, key):
        self.__setitem__(key, None)

    def __iter__(self):
        raise TypeError("the state is not read as a whole")

    __len__ = __iter__

    def flush(self) -> None:
        for key in sorted(self.changed):
            value = self.seen[key]
            if value is not None:
                self.state.updateValue((key,), (value if self.numbers else json.dumps(value, ensure_ascii=False),))
            elif not self.empty:
                self.state.removeKey((key,))


class Early:
    """The edits that arrived early, by ``seq``, in blocks."""

    def __init__(self, blocks: Touched):
        self.blocks = blocks

    def get(self, seq: int) -> dict | None:
        return self.blocks.get(seq // BLOCK, {}).get(str(seq))

    def put(self, seq: int, edit: dict) -> None:
        block = self.blocks.get(seq // BLOCK, {})
        block[str(seq)] = edit
        self.blocks[seq // BLOCK] = block

    def drop(self, seq: int) -> None:
        block = self.blocks[seq // BLOCK]
        del block[str(seq)]
        self.blocks[seq // BLOCK] = block or None


def edit_of(row) -> dict:
    """An edit from its columns or, as the stream sends it, from one JSON text (a cell costs as much as an edit)."""
    e = json.loads(row["edit"]) if "edit" in row else row
    return {c: e.get(c) for c in EDIT_COLS} if isinstance(e, dict) else {c: e[c] for c in EDIT_COLS}


class ReplayProcessor(StatefulProcessor):
    """Applies a row's edits in ``seq`` order to its list in keyed state."""

    def init(self, handle) -> None:
        self.head = handle.getValueState(
            "head", "next_seq bigint, n_pages bigint, n_spans bigint, n_mapped bigint, pending bigint")
        self.pages = handle.getMapState("pages", "page bigint", "anns string")
        self.ranks = handle.getMapState("ranks", "node bigint", "n bigint")
        self.bins = handle.getMapState("bins", "bin bigint", "spans string")
        self.early = handle.getMapState("early", "block bigint", "edits string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        next_seq, n_pages, n, mapped, pending = self.head.get() or (0, 0, 0, 0, 0)
        arrived: dict[int, dict] = {}
        for r in rows:
            e = edit_of(r)
            e["values"] = None if e["values"] is None else list(e["values"])
            seq = e["seq"]
            if seq is None or seq < next_seq:
                continue  # no place in the order; delivered again
            if seq not in arrived or content(e) < content(arrived[seq]):
                arrived[seq] = e
        early = Early(Touched(self.early, empty=not pending))
        pages, paged = Touched(self.pages, empty=not n_pages), n_pages > 1
        ranks = Touched(self.ranks, numbers=True, empty=not paged)
        bins = Touched(self.bins, empty=not paged)
        spans = SpanList(None, pages, ranks if paged else {}, bins if paged else {}, n_pages, n, mapped)
        if n_pages == 1:
            spans.index_page()
        while next_seq in arrived or pending:
            e, stored = arrived.pop(next_seq, None), early.get(next_seq) if pending else None
            if stored is not None:
                early.drop(next_seq)
                pending -= 1
                e = stored if e is None or content(stored) < content(e) else e
            if e is None:
                break
            apply_edit(spans, e)
            next_seq += 1
        for seq, e in arrived.items():
            stored = early.get(seq)
            if stored is None or content(e) < content(stored):
                pending += stored is None
                early.put(seq, e)
        if not paged and spans.ranks.pages > 1:
            ranks.update(spans.ranks.nodes)
            bins.update(spans.bins)
        for state in (early.blocks, pages, ranks, bins):
            state.flush()
        self.head.update((next_seq, spans.ranks.pages, len(spans), spans.mapped, pending))
        yield Row(project=key[0], doc_id=key[1], next_seq=next_seq, pending=pending, n_spans=len(spans),
                  n_mapped=spans.mapped)

    def close(self) -> None:
        pass


def replay_edits_stream(edits: DataFrame) -> DataFrame:
    """Streaming DataFrame of per-row snapshots (see module doc); the session needs the RocksDB state store."""
    edit = F.to_json(F.struct(*EDIT_COLS)).alias("edit")
    return edits.select(*KEYS, edit).groupBy(*KEYS).transformWithState(
        ReplayProcessor(), SNAPSHOT, "update", "none")


def dense_seq(edits: DataFrame) -> DataFrame:
    """Renumber ``seq`` densely per row (0, 1, ...) keeping its order (batch step)."""
    return (position_within(edits.withColumnRenamed("seq", "_s"), list(KEYS), ["_s"], "seq")
            .drop("_s"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshot with the largest ``next_seq`` per row."""
    others = [c for c in snapshots.columns if c not in KEYS]
    latest = snapshots.groupBy(*KEYS).agg(
        F.max_by(F.struct(*others), F.col("next_seq")).alias("_s"))
    return latest.select(*KEYS, *[F.col("_s")[c].alias(c) for c in others])


def state_spans(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Flat spans of every row from the stream's committed state (latest batch).

    Reads the pages of the replay query's state through the ``statestore`` data source; a
    span's ordinal is its place in its page behind the sizes of the pages before.
    """
    pages = (spark.read.format("statestore").option("stateVarName", "pages").load(checkpoint)
             .select(F.col("key.project").alias("project"), F.col("key.doc_id").alias("doc_id"),
                     F.col("user_map_key.page").alias("page"),
                     F.from_json("user_map_value.anns", ANNOTATIONS_DDL).alias("anns")))
    earlier = Window.partitionBy(*KEYS).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("first", F.coalesce(F.sum(F.size("anns")).over(earlier), F.lit(0)))
    return (pages.select(*KEYS, "first", F.posexplode("anns").alias("at", "a"))
            .select(*KEYS, (F.col("first") + F.col("at")).cast("bigint").alias("ord"), "a.text", "a.label",
                    "a.start", "a.end", "a.mapped_value"))


def progress_from_snapshots(snapshots: DataFrame) -> DataFrame:
    """Live M1: per project spans, mapped spans and ratio over the latest snapshots."""
    latest = latest_snapshots(snapshots)
    agg = latest.groupBy("project").agg(F.sum("n_spans").alias("total_spans"),
                                        F.sum("n_mapped").alias("mapped_spans"))
    return agg.select("project", F.col("total_spans").cast("bigint"),
                      F.col("mapped_spans").cast("bigint"),
                      F.coalesce(F.try_divide(F.col("mapped_spans").cast("double"),
                                              F.col("total_spans")), F.lit(0.0)).alias("ratio"))


def run_replay_stream(spark: SparkSession, source_path: str, schema: str, sink_path: str,
                      checkpoint: str, files_per_trigger: int = 1) -> None:
    """Drive the stream over a directory of edit files until it is drained.

    ``availableNow`` processes everything present in micro-batches and stops;
    snapshots are appended to ``sink_path`` by ``foreachBatch``.
    """
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_path))

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.withColumn("epoch", F.lit(epoch_id)).write.mode("append").parquet(sink_path)

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        q = (replay_edits_stream(stream).writeStream.outputMode("update")
             .option("checkpointLocation", checkpoint).foreachBatch(sink)
             .trigger(availableNow=True).start())
    finally:  # the query has its own copy of the session's settings
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    q.awaitTermination()

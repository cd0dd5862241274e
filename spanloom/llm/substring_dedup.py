"""Substring dedup: fixed-block anchors, rolling probes, extension to exact repeats.

Any window of 50 words contains a block of 25 words that starts at a multiple
of 25, so two texts that share a window meet at such an anchor: the block of
one text and a rolling 25-word window of the other. Pass A files every rolling
window (probes and, flagged, the aligned blocks) under its hash and finds the
places where a block of one text meets a probe of another. Pass B extends the
hits: every 50-word window around a hit is compared by a 96-bit hash with the
same windows elsewhere, and its smallest document decides whether it is
removed. Runs of removed windows are the maximal repeats. Pass C rewrites the
texts. No pair of documents is ever formed.

Windows are packed. A task reduces the windows of a slice of texts to its
distinct ones and sends one binary row per (slice, hash bucket), so a passage
in a third of all documents costs each bucket one entry per slice. The number
of buckets follows the number of words (``BUCKET_ENTRIES`` a bucket), which bounds
a reducer's memory. Hits return as positions to their slice.

Defined results: a null or empty text has no words. A null id is larger than
every id, and equal ids are one document (nothing is removed because of an
equal id). Every input row gives one row; equal rows give equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import common

WINDOW = 50
#: Entries of one hash bucket, on average.
BUCKET_ENTRIES = 200_000
#: A table of positions is broadcast up to so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
NO_ID = np.iinfo(np.int64).max

SENT = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("entries", pa.binary()),
                  ("flags", pa.binary()), ("pos", pa.binary()), ("rows", pa.binary())])
SENT_DDL = "bucket long, slice long, entries binary, flags binary, pos binary, rows binary"
BACK = pa.schema([("slice", pa.int64()), ("pos", pa.binary()), ("rows", pa.binary())])
BACK_DDL = "slice long, pos binary, rows binary"
PLACES = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("runs", pa.binary())])
PLACES_DDL = "d long, h long, n long, runs binary"


def pack(pos: np.ndarray) -> bytes:
    """Ascending positions as differences, byte plane by byte plane (they compress well)."""
    step = np.diff(pos, prepend=0)
    kind = np.uint16 if not len(step) or step.max() < 1 << 16 else np.uint32
    planes = step.astype(kind).view(np.uint8).reshape(len(step), np.dtype(kind).itemsize).T
    return bytes([planes.shape[0]]) + planes.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    kind = np.uint16 if data[0] == 2 else np.uint32
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(kind).astype(np.int64))


def runs(starts: np.ndarray) -> np.ndarray:
    """Ascending distinct numbers as rows (first, last) of consecutive runs."""
    if not len(starts):
        return np.zeros((0, 2), np.int32)
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack((starts[np.concatenate(([0], cut + 1))],
                     starts[np.concatenate((cut, [len(starts) - 1]))]), axis=1).astype(np.int32)


def spread(lists: list[bytes | None], off: np.ndarray) -> np.ndarray:
    """Mask over flat positions: inside a run of its text."""
    d = np.zeros(off[-1] + 1, dtype=np.int32)
    for i, x in enumerate(lists):
        if x:
            r = np.frombuffer(x, np.int32).reshape(-1, 2) + off[i]
            d[r[:, 0]] += 1
            d[r[:, 1] + 1] -= 1
    return np.cumsum(d)[:-1] > 0


def send(bucket: np.ndarray, entries: np.ndarray, flags: np.ndarray | None, pos: np.ndarray,
         local: np.ndarray, n: int, rows: np.ndarray, number: int) -> pa.RecordBatch:
    """One row per bucket with entries, and one with the slice's own hits and its texts.

    ``number`` is the slice's place in its task; a repeated task counts the same way.
    """
    slice_id = TaskContext.get().partitionId() << 32 | number
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = [(slice_id % n, None, None, pack(np.sort(local)), rows.tobytes())]
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        i = order[a:b]
        out.append((int(bucket[a]), entries[i].tobytes(),
                    None if flags is None else np.packbits(flags[i]).tobytes(), pack(pos[i]), None))
    cols = list(zip(*out, strict=True))
    return common.record_batch(SENT, bucket=cols[0], slice=[slice_id] * len(out), entries=cols[1],
                               flags=cols[2], pos=cols[3], rows=cols[4])


def row_table(off: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """The texts of a slice: first flat position, id, text hash."""
    return np.stack((off[:-1], batch.column("d").to_numpy(), batch.column("h").to_numpy()), axis=1)


def answer(decide):
    """Bucket reducer: ``decide(rows) -> mask per row of entries``; own hits and texts pass through."""
    def run(table: pa.Table) -> pa.Table:
        entries = table.column("entries").to_pylist()
        pos, slices = table.column("pos").to_pylist(), table.column("slice").to_pylist()
        texts = table.column("rows").to_pylist()
        sent = [i for i, x in enumerate(entries) if x is not None]
        flags = table.column("flags").to_pylist()
        out = [(slices[i], pos[i], texts[i]) for i, x in enumerate(texts) if x is not None]
        if sent:
            for i, hit in zip(sent, decide([(entries[i], flags[i]) for i in sent]), strict=True):
                if hit.any():
                    out.append((slices[i], pack(unpack(pos[i])[hit]), None))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, BACK, strict=True)], schema=BACK)
    return run


def gather(grow: int):
    """Slice reducer: the hits of each text as runs of starts, each hit widened to ``grow`` starts before."""
    def run(table: pa.Table) -> pa.Table:
        rows = next(x for x in table.column("rows").to_pylist() if x is not None)
        rows = np.frombuffer(rows, np.int64).reshape(-1, 3)
        hits = np.unique(np.concatenate([unpack(p) for p in table.column("pos").to_pylist()]))
        # Empty texts share a start with the next one; the last of them has the words.
        text = np.searchsorted(rows[:, 0], hits, side="right") - 1
        out = []
        for i in np.unique(text):
            s = hits[text == i] - rows[i, 0]
            if grow:
                d = np.zeros(s[-1] + 2, dtype=np.int32)
                np.add.at(d, np.maximum(s - grow, 0), 1)
                np.add.at(d, s + 1, -1)
                s = np.flatnonzero(np.cumsum(d) > 0)
            out.append((rows[i, 1], rows[i, 2], len(s), runs(s).tobytes()))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, PLACES, strict=True)], schema=PLACES)
    return run


def places(sent: DataFrame, decide, grow: int) -> DataFrame:
    """Both reductions: (d, h, n, runs) of every text with hits, written once."""
    back = sent.groupBy("bucket").applyInArrow(answer(decide), BACK_DDL)
    back = back.groupBy("slice").applyInArrow(gather(grow), PLACES_DDL)
    return materialize(back.groupBy("d", "h").agg(F.first("n").alias("n"), F.first("runs").alias("runs")),
                       "repeats")


def small(df: DataFrame) -> DataFrame:
    """Broadcast a written table if its rows and bytes are few."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.length("runs")), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


# -- pass A ------------------------------------------------------------------

def anchors(n: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(common.slices(batches, "t")):
            words, off = common.split_words(common.text_bytes(batch.column("t")))
            h, start = common.windows(common.hash_words(words), off, block)
            code, distinct = pd.factorize(h)
            twice = np.bincount(code, minlength=len(distinct)) > 1
            first = np.zeros(len(distinct), dtype=np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            aligned = np.zeros(len(distinct), dtype=bool)
            aligned[code[(start - off[common.text_of(off, start)]) % block == 0]] = True
            yield send(((distinct >> np.uint64(32)) % np.uint64(n)).astype(np.int64),
                       distinct.astype(np.uint32), np.stack((aligned, twice), axis=1),
                       start[first], start[twice[code]], n, row_table(off, batch), number)
    return run


def meets(rows: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
    """Hits: an entry whose hash is a block somewhere and stands in another entry or twice in a slice."""
    parts = [np.frombuffer(e, np.uint32) for e, _ in rows]
    flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(p)).reshape(-1, 2)
                            for p, (_, f) in zip(parts, rows, strict=True)]).astype(bool)
    code, distinct = pd.factorize(np.concatenate(parts))
    block, twice = np.zeros(len(distinct), bool), np.bincount(code) > 1
    block[code[flags[:, 0]]] = True
    twice[code[flags[:, 1]]] = True
    hit = (block & twice)[code] & ~flags[:, 1]
    return np.split(hit, np.cumsum([len(p) for p in parts])[:-1])


# -- pass B ------------------------------------------------------------------

ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("d", "<i8")])


def identity(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each distinct (a, b)."""
    first, _ = pd.factorize(a)
    code, distinct = pd.factorize(first.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
    return code, len(distinct)


def extend(n: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(common.slices(batches, "t")):
            words, off = common.split_words(common.text_bytes(batch.column("t")))
            a, start = common.windows(common.hash_words(words, 0), off, size, 0)
            b, _ = common.windows(common.hash_words(words, 1), off, size, 1)
            near = spread(batch.column("runs").to_pylist(), off)[start] if len(start) else np.zeros(0, bool)
            a, b, start = a[near], b[near].astype(np.uint32), start[near]
            doc = batch.column("d").to_numpy()[common.text_of(off, start)]
            code, count = identity(a, b)
            least = np.full(count, NO_ID)
            np.minimum.at(least, code, doc)
            own = doc == least[code]
            entry = np.zeros(own.sum(), ENTRY)
            entry["a"], entry["b"], entry["d"] = a[own], b[own], doc[own]
            yield send(((a[own] >> np.uint64(32)) % np.uint64(n)).astype(np.int64), entry, None,
                       start[own], start[~own], n, row_table(off, batch), number)
    return run


def later(rows: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
    """Hits: a window that also starts in a document with a smaller id."""
    parts = [np.frombuffer(e, ENTRY) for e, _ in rows]
    every = np.concatenate(parts)
    code, count = identity(every["a"], every["b"])
    least = np.full(count, NO_ID)
    np.minimum.at(least, code, every["d"])
    return np.split(every["d"] > least[code], np.cumsum([len(p) for p in parts])[:-1])


# -- operator ------------------------------------------------------------------

def repeated_windows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(d, h, n, runs): runs of the window starts to remove, of every text that has any."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("d"),
                      F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    chars = src.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    block = size // 2
    n = max(1, chars // 6 // BUCKET_ENTRIES)
    hits = places(src.mapInArrow(anchors(n, block), SENT_DDL), meets, size - block)
    n = max(1, hits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BUCKET_ENTRIES)
    near = small(hits.drop("n").withColumnsRenamed({"d": "_d", "h": "_h"}))
    around = src.join(near, (F.col("d") == F.col("_d")) & (F.col("h") == F.col("_h")))
    around = around.select("d", "h", "t", "runs")
    return places(around.mapInArrow(extend(n, size), SENT_DDL), later, 0)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (runs of word positions), kept_text per input row."""
    common.small_batches(docs.sparkSession)
    gone = small(repeated_windows(docs, id_col, text_col, size).drop("n"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).cast("string").alias("t"))
    src = src.join(gone, (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("d"))
                   & (F.col("th") == F.col("h")), "left").select("doc_id", "t", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "t"):
            out = []
            for t, r in zip(common.text_bytes(batch.column("t")), batch.column("runs").to_pylist(),
                            strict=True):
                words = t.split()
                if not r:
                    kept, cut = words, []
                else:
                    r = np.frombuffer(r, np.int32).reshape(-1, 2) + np.array([0, size])
                    off = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(off, r[:, 0], 1)
                    np.add.at(off, r[:, 1], -1)
                    stay = np.cumsum(off)[:-1] == 0
                    kept = [w for w, s in zip(words, stay, strict=True) if s]
                    cut = [{"start": int(x), "end": int(y) + 1} for x, y in runs(np.flatnonzero(~stay))]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(),
                            cut, text.decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(cols[4], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])

    return src.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                               "removed array<struct<start:int,end:int>>, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_substring_dedup``: what every document keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).drop("removed", "kept_text")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS t
      FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
bad AS (SELECT r, i FROM w JOIN f USING (t) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, i + k AS i FROM bad, (SELECT unnest(range(0, 50)) AS k)),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
         FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

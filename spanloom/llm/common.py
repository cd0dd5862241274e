"""Shared pieces of the training-data operators.

Everything here works on one Arrow batch (or a slice of it) inside a task;
Spark does the partitioning and the shuffles.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text handled at once inside a task; bounds the Python memory of a worker.
SLICE_BYTES = 2 << 20
#: Bytes of a derived table, as JSON, up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, about, at most (a larger row stands alone).
BATCH_BYTES = 4 << 20

#: Odd multipliers of the rolling hashes and of the finaliser (arbitrary fixed odd numbers).
ROLL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
HASH_KEYS = ("spanloom-words-a", "spanloom-words-b")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A hint to broadcast ``df`` (a table, files or cheap to compute) if its rows, as JSON, have at most so many bytes."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def small_batches(spark) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` in this session: rows are whole texts.

    A batch stands in the JVM's direct memory and in the worker at once.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if re.fullmatch(r"-?\d+b?", now) and not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str | int,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice have about ``max_bytes`` (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        part = np.cumsum(lens) // max_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Give freed memory back to the system: Spark keeps idle workers for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one list, and the offsets of each text (n + 1).

    ``bytes.split()`` cuts at exactly the ASCII white space characters.
    """
    words: list[bytes] = []
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        words += t.split()
        off[i + 1] = len(words)
    return words, off


def hash_words(words: list, key: int = 0) -> np.ndarray:
    """64-bit SipHash of each word."""
    arr = np.empty(len(words), dtype=object)
    arr[:] = words
    if not len(arr):
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(arr, hash_key=HASH_KEYS[key], categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, off: np.ndarray, size: int, key: int = 0,
            ) -> tuple[np.ndarray, np.ndarray]:
    """Hash and flat start of every window of ``size`` words that lies inside one text.

    A polynomial of the word hashes modulo 2^64; ``size`` multiply-adds over
    the whole slice for short windows, doubling for long ones.
    """
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # h[k] covers 2^k words; combine the binary digits of `size`.
    p = ROLL[key]
    mask = (1 << 64) - 1
    acc, done, block, width = None, 0, hashes, 1
    left = size
    while left:
        if left & 1:
            m = n - done - width + 1
            piece = block[done:done + m]
            if acc is None:
                acc = piece.copy()
            else:
                acc = acc[:m] * np.uint64(pow(p, width, mask + 1)) + piece
            done += width
        left >>= 1
        if left:
            block = block[:-width] * np.uint64(pow(p, width, mask + 1)) + block[width:]
            width *= 2
    last = np.repeat(off[1:], np.diff(off))[:n - size + 1] - size
    start = np.arange(n - size + 1)
    ok = start <= last
    return mix(acc[ok]), start[ok]


def text_of(off: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Number of the text that each flat position lies in."""
    return np.searchsorted(off, flat, side="right") - 1


def cover(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Boolean mask over ``n`` positions: inside a window of ``size`` that starts at one of ``starts``."""
    d = np.zeros(n + size + 1, dtype=np.int32)
    d[starts] += 1
    d[starts + size] -= 1
    return np.cumsum(d)[:n] > 0


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if isinstance(columns[f.name], pa.Array)
         else pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def add_columns(docs, text_col: str, fields: list[tuple[str, str]], start,
                max_bytes: int = SLICE_BYTES):
    """All columns of ``docs`` plus columns computed from the text (an equal name is replaced).

    ``start()`` is called once per task and returns a function from the Arrow
    array of one slice's texts to the list of new Arrow arrays.
    """
    small_batches(docs.sparkSession)
    src = docs.drop(*[name for name, _ in fields])
    schema = StructType(list(src.schema.fields))
    at = src.columns.index(text_col)
    for name, kind in fields:
        schema = schema.add(StructType.fromDDL(f"`{name}` {kind}")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in slices(batches, at, max_bytes):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *fn(batch.column(at))],
                names=[*batch.schema.names, *[name for name, _ in fields]])

    return src.mapInArrow(run, schema)


class WordTable:
    """Slots of word hashes seen before in this worker; cleared when it has ``limit`` words."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index = pd.Index(np.zeros(0, dtype=np.uint64))

    def get(self, hashes: np.ndarray) -> np.ndarray:
        return self.index.get_indexer(hashes)

    def add(self, hashes: np.ndarray) -> None:
        self.index = self.index.append(pd.Index(hashes))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + size) one after the other."""
    total = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(start - total[:-1], size) + np.arange(total[-1])

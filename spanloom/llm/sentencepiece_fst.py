"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

``pieces.Transducer`` holds the machines and the search. This module applies
them to DataFrames: a task normalises and cuts the texts of a slice into
words, composes each distinct word once, and strings the paths together.
Words seen in earlier slices of the same worker are looked up (at most
``KEEP_WORDS``). Everything is a function of one row: no shuffle.

Defined results: a null or empty text has no ids, and a null or empty list of
ids decodes to an empty text. The visible space sign U+2581 in a text encodes
like a space, as the model's own normaliser has it, so it decodes to a space;
every other text round-trips exactly. Control pieces are never produced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from . import common
from .pieces import PieceModel, Transducer, read_model

#: Path of the model file; read by the driver only.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words whose ids a worker keeps.
KEEP_WORDS = 150_000
#: Characters of distinct words searched at once.
BLOCK_CHARS = 150_000
#: Bytes of text handled at once; a worker's lists of words take some twenty times as much.
SLICE_BYTES = 512 << 10


class Encoder:
    """Encodes lists of texts; keeps the ids of words between calls."""

    def __init__(self, model: PieceModel):
        self.fst = Transducer(model)
        self.table = common.WordTable(KEEP_WORDS)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.cumsum([len(w) for w in words], dtype=np.int64) // BLOCK_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), len(words)]
        flat, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids, off = self.fst.encode_words(words[a:b])
            flat.append(ids)
            count.append(np.diff(off))
        return np.concatenate(flat), np.concatenate(count)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each."""
        words: list[str] = []
        ends = []
        for t in texts:
            words += self.fst.chunks(t or "")
            ends.append(len(words))
        woff = np.array([0, *ends], dtype=np.int64)
        code, hashes = pd.factorize(common.hash_words(words))
        at = self.table.get(hashes)
        new = np.flatnonzero(at < 0)
        if len(self.start) + len(new) > KEEP_WORDS:
            self.table.clear()
            self.start, self.count, self.flat = self.start[:0], self.count[:0], self.flat[:0]
            at, new = np.full(len(hashes), -1), np.arange(len(hashes))
        if len(new):
            first = np.zeros(len(hashes), dtype=np.int64)
            first[code[::-1]] = np.arange(len(words) - 1, -1, -1)
            flat, count = self._search([words[i] for i in first[new]])
            at[new] = len(self.start) + np.arange(len(new))
            start = len(self.flat) + np.concatenate(([0], np.cumsum(count)))[:-1]
            self.start = np.concatenate((self.start, start))
            self.count = np.concatenate((self.count, count))
            self.flat = np.concatenate((self.flat, flat))
            self.table.add(hashes[new])
        slot = at[code] if len(code) else np.zeros(0, np.int64)
        size = self.count[slot]
        ids = self.flat[common.ragged(self.start[slot], size)]
        return ids, np.concatenate(([0], np.cumsum(size)))[woff]


_ENCODERS: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """This worker's encoder of a broadcast model, compiled once."""
    key = id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text",
           check: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``n_tokens`` and ``ids``; with ``check`` also ``round_trip``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    fields = [("n_tokens", "long"), ("ids", "array<int>")] + [("round_trip", "boolean")] * check

    def start():
        enc = encoder(shared)

        def run(texts: pa.Array) -> list[pa.Array]:
            values = texts.to_pylist()
            ids, off = enc.encode(values)
            out = [pa.array(np.diff(off), pa.int64()),
                   pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))]
            if check:
                seq = ids.tolist()
                out.append(pa.array([enc.fst.decode(seq[a:b]) == (t or "") for t, a, b in
                                     zip(values, off[:-1], off[1:], strict=True)], pa.bool_()))
            return out

        return run

    return common.add_columns(docs, text_col, fields, start, SLICE_BYTES)


def decode(rows: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """All columns of ``rows`` plus ``decoded``, the text of its ids."""
    shared = rows.sparkSession.sparkContext.broadcast(read_model(model))
    src = rows.drop("decoded")
    at = src.columns.index(ids_col)

    def run(batches):
        fst = encoder(shared).fst
        for batch in batches:
            text = [fst.decode([i for i in x or [] if i is not None])
                    for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())],
                                             names=[*batch.schema.names, "decoded"])

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField("decoded", StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_sentencepiece``: ids of every document and whether they decode to its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs.select("doc_id", "text"), check=True).drop("text")

"""Best-fit packing: tokenised documents into sequences of ``capacity`` tokens, online, with few open bins.

Each text's ids are followed by an end id. Documents longer than a sequence
are cut into pieces of ``capacity`` tokens; no other document is cut. The pieces
are written once. They are then placed as they stream by, each into the open bin
with the least free space that still holds it. Open bins are keyed by their free
space in a bitset (bit f: some open bin has f tokens free), so the best bin is the
lowest bit at or above the piece's length. At most ``open_bins`` bins are open:
when another is needed, the fullest one closes first, as it is the least likely to
be of use. A full bin closes at once.

The two steps need no shuffle. A packing task reads lengths only, of about
``PIECES_PER_TASK`` pieces; what it leaves open is a vanishing share of its
sequences. ``sequences`` gathers the ids of each sequence (one shuffle by it).

Defined results: a null or empty text is the end id alone. Repeated rows and
null ids are packed each for itself; ties between bins of equal free space go to
the one filled last. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import common, subwords

#: A tokenizer whose words end at white space; read by the driver only.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY = 4096
END = 1
OPEN_BINS = 256
#: Pieces that one task packs, about.
PIECES_PER_TASK = 1 << 17

#: No part of little-endian 32-bit ids under 65,536.
STOP = b"\xff" * 4

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


#: The words that the tokenizer merges, after lower-casing.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Composed letters and signs whose case and class no Unicode version changes; other units go through all steps.
PLAIN = "^[\x21-\x7e\xa1-\u024f]+$"
#: Distinct parts of words whose ids a worker holds at most.
PARTS = 4 * subwords.LIMIT
#: Bytes of text encoded at once.
SLICE_BYTES = 4 << 20


def read_vocabulary(path: str) -> str:
    """The tokenizer's description; it must be of the kind that ``Words`` takes apart."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    kind = json.loads(text)
    first, second = kind["pre_tokenizer"]["pretokenizers"]
    if (kind["normalizer"]["normalizers"] != STEPS or kind["post_processor"] or second["type"] != "ByteLevel"
            or second["add_prefix_space"] or second["use_regex"]
            or (first["type"], first["pattern"], first["behavior"], first["invert"])
            != ("Split", {"Regex": WORDS}, "Removed", True) or max(kind["model"]["vocab"].values()) >= 1 << 16
            or not all(t["content"].startswith("<") for t in kind["added_tokens"])):
        raise ValueError("another kind of tokenizer")
    return text


class Words:
    """The tokenizer in a worker: words between ASCII white space -> ids.

    Plain words are lower-cased and cut, and each distinct part is merged once. Any
    other word (and one with a special token's name) is given to the tokenizer whole.
    """

    def __init__(self, description: str):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(description)
        special = [t["content"] for t in json.loads(description)["added_tokens"]]
        self.named = "|".join(map(re.escape, special)) or r"[^\s\S]"
        self.cut = regex.compile(WORDS + r"|\n").findall
        self.letters = subwords.byte_letters()
        self.known = subwords.UnitCache(self.merged, PARTS)

    def merged(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of each part as little-endian 32-bit numbers."""
        merge = self.tokenizer.model.tokenize
        for part in parts:
            # ASCII letters stand for themselves.
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in merge(spelt)]
            yield struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the place and number of those of each word."""
        is_plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring_regex(words, self.named))
        plain, other = words.filter(is_plain), words.filter(pc.invert(is_plain)).to_pylist()
        # All plain words as one text, a line each; a line end is no part of a word.
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), "\n")[0].as_py()
        parts = self.cut(text.lower() + "\n") if len(plain) else []
        self.known.fill(parts)
        self.known["\n"] = STOP
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, parts)), dtype="<u4")]
        stops = np.flatnonzero(ids[0] == 0xFFFFFFFF)
        ids += [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4") for w in other]
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        mask = is_plain.to_numpy(zero_copy_only=False)
        start[mask] = np.concatenate(([0], stops + 1))[:-1]
        size[mask] = stops - start[mask]
        size[~mask] = [len(x) for x in ids[1:]]
        start[~mask] = len(ids[0]) + np.cumsum(size[~mask]) - size[~mask]
        return np.concatenate(ids), start, size


def encode_texts(texts: pa.Array, known: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by ``end``, and the offsets of each text (n + 1)."""
    units = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = units.flatten().dictionary_encode()
    ids, start, size = known.encode(flat.dictionary)
    at = flat.indices.to_numpy()
    ids = ids[common.ragged(start[at], size[at])]
    off = units.offsets.to_numpy()
    ends = np.concatenate(([0], np.cumsum(size[at])))[off - off[0]]
    return np.insert(ids, ends[1:], end), ends + np.arange(len(ends))


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
             capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and the ids (32 bits, little-endian)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    src = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = subwords.loaded(shared, Words)
        for batch in common.slices(batches, "t", SLICE_BYTES):
            ids, off = encode_texts(batch.column("t"), known, end)
            rows = []
            for doc, a, b in zip(batch.column("d").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                rows += [(doc, n, at - a, ids[at:min(at + capacity, b)].tobytes())
                         for n, at in enumerate(range(a, b, capacity))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([len(r[3]) // 4 for r in rows], pa.int64()),
                 pa.array([zlib.crc32(r[3]) for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return src.mapInArrow(run, PIECE)


class OpenBins:
    """At most ``limit`` bins with free space, keyed by it."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free = [[] for _ in range(capacity + 1)]  # numbers of the bins with so much free space
        self.mask = self.open = self.made = 0

    def take(self, space: int) -> int:
        """The bin with ``space`` free that was filled last; it is open no longer."""
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            self.mask ^= 1 << space
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self.take(space)
        else:
            if self.open == self.limit:
                self.take((self.mask & -self.mask).bit_length() - 1)
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.free[left].append(number)
            self.mask |= 1 << left
            self.open += 1
        return number, self.capacity - space


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         per_task: int = PIECES_PER_TASK) -> DataFrame:
    """The pieces (a table or files) with sequence_id and offset, gapless from 0 in each sequence."""
    parts = max(1, -(-pieces.count() // per_task))
    at = pieces.columns.index("length")
    names = [*pieces.columns, "sequence_id", "offset"]
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()),
                 pa.array([o for _, o in placed], pa.int64())], names=names)

    return pieces.coalesce(parts).mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, its ids (at most ``capacity``) and its pieces (doc_id, piece, offset, length) in order."""
    row = F.struct("offset", "doc_id", "piece", "length", "ids")
    rows = F.array_sort(F.collect_list(row))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id", F.expr("aggregate(r, X'', (a, x) -> concat(a, x.ids))").alias("ids"),
        F.expr("transform(r, x -> struct(x.doc_id, x.piece, x.offset, x.length))").alias("pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11_best_fit``: sequence and place of every piece of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = materialize(tokenise(docs), "pieces")
    return pack(pieces.drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

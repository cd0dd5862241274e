"""Training-order materialisation: tokens in fixed-stride binary shards, in a keyed random order.

Texts are tokenised, ended by an end token and strung together within their
input partition; the stream is cut into sequences of ``seq_len`` tokens (the
last one is filled up with end tokens). A first pass counts the sequences of
each partition, which numbers all sequences from 0 to N - 1. Either pass encodes each
distinct unit between spaces that a worker meets once (``subwords``) and the first only adds up their
sizes; tokens are stored nowhere but in the shuffle and the shards. A keyed Feistel
network over the next even power of two, walked until it falls below N, maps
each number to its slot: a permutation that needs no state and no sort. Slots
are split into ranges of ``per_shard``; each range becomes one file in which
slot ``s`` starts at byte ``(s % per_shard) * stride``. Reading on from any
slot is a seek.

A writer task writes a shard under a temporary name and moves it into place, so a
lost or repeated task leaves whole files. The manifest is written last. The
second pass must see the partitions of the first: pass a table or files, not a
query that shuffles (its tasks check this and fail otherwise).

Defined results: a null or empty text adds no tokens. Repeated rows are
tokenised each time. Without tokens there are no sequences and no shards.
Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from . import common, subwords

#: Ranks of a byte-level vocabulary; read by the driver only. Its size is the free id, our end token.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how that vocabulary cuts a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQ_LEN = 1024
PER_SHARD = 1024
KEY = 0x5EED
ROUNDS = 6

#: Bytes of text encoded at once, of several Arrow batches: each slice costs a walk through all units known.
SLICE_BYTES = 12 << 20
#: Shards that a writer task writes, on average.
TASK_SHARDS = 4


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Encoder:
    """The tokenizer in a worker; it encodes each distinct unit once."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken
        self.encode = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(len(ranks), dtype=bool)
        self.opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

        self.units = subwords.RecurringUnits(self.after_space)

    def after_space(self, units: pa.Array) -> tuple[subwords.Runs]:
        """The ids of a space and each unit."""
        odd = pc.match_substring_regex(units, subwords.RAGGED)
        plain, other = units.filter(pc.invert(odd)), units.filter(odd).to_pylist()
        # As one text: each unit begins with its only token that opens with a space, as it holds no other space.
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), " ")[0].as_py()
        ids = np.array(self.encode(" " + text) if len(plain) else [], dtype=np.uint16)
        start = np.flatnonzero(self.opens[ids])
        runs = subwords.Runs(ids, start, np.diff(np.append(start, len(ids))))
        if not other:
            return (runs,)
        order, mask = np.empty(len(units), dtype=np.int64), odd.to_numpy(zero_copy_only=False)
        order[~mask], order[mask] = np.arange(len(plain)), len(plain) + np.arange(len(other))
        return (runs.joined(subwords.Runs.of([self.encode(" " + u) for u in other], np.uint16)).pick(order),)

    def texts(self, texts: pa.Array) -> tuple[subwords.Runs, np.ndarray]:
        """The ids of all units of all texts in order, and the number of ids of each text."""
        units, counts = subwords.cut_units(texts)
        off = np.concatenate(([0], np.cumsum(counts)))
        first = off[:-1][counts > 0]
        coded, opening = units.dictionary_encode(), units.take(pa.array(first)).dictionary_encode()
        runs, = self.units.get(coded.dictionary)
        at = coded.indices.to_numpy().copy()
        at[first] = len(runs.size) + opening.indices.to_numpy()
        opened = subwords.Runs.of([self.encode(u) for u in opening.dictionary.to_pylist()], np.uint16)
        runs = runs.joined(opened).pick(at)
        return runs, common.sums(runs.size, off)


def permute(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Keyed permutation of 0 .. n - 1: balanced Feistel rounds, walked along the cycle into the range."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = common.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(common.ROLL[0])
                      + np.uint64(key))
    y = x.astype(np.uint64)
    out = np.zeros(len(x), dtype=np.int64)
    live = np.arange(len(x))
    while len(live):
        left, right = y >> half, y & low
        for k in keys:
            left, right = right, left ^ (common.mix(right ^ k) & low)
        y = left << half | right
        done = y < n
        out[live[done]] = y[done]
        live, y = live[~done], y[~done]
    return out


@dataclass
class Layout:
    """What a reader needs to know."""
    root: str
    n_sequences: int
    seq_len: int
    per_shard: int
    end_token: int
    key: int

    @property
    def stride(self) -> int:
        return 2 * self.seq_len

    def file(self, shard: int) -> str:
        return f"{self.root}/shard-{shard:08d}.bin"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or local path (``file:/x`` is taken as Spark writes it)."""
    if uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:").removeprefix("//")
    return fs.FileSystem.from_uri(uri)


def read_sequences(layout: Layout, first: int, count: int) -> Iterator[np.ndarray]:
    """The token ids of ``count`` slots from ``first`` on, read sequentially."""
    store, _ = filesystem(layout.root)
    slot, last = first, min(first + count, layout.n_sequences)
    while slot < last:
        shard, at = divmod(slot, layout.per_shard)
        n = min(layout.per_shard - at, last - slot)
        with store.open_input_file(filesystem(layout.file(shard))[1]) as f:
            f.seek(at * layout.stride)
            for _ in range(n):
                yield np.frombuffer(f.read(layout.stride), "<u2")
        slot += n


def load_layout(root: str) -> Layout:
    store, path = filesystem(f"{root}/manifest.json")
    with store.open_input_file(path) as f:
        return Layout(**json.loads(f.read()))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about ``SLICE_BYTES`` (a longer text stands alone), of several batches if they fit."""
    held, size = [], 0
    for batch in common.slices(batches, "t", SLICE_BYTES):
        n = pc.sum(pc.binary_length(batch.column("t"))).as_py() or 0
        if held and size + n > SLICE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.concat_batches(held)
    held.clear()
    common.release()


def stream(batches: Iterator[pa.RecordBatch], known: Encoder,
           end: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Per slice: ids of the texts with tokens, their sizes with the end token, all tokens."""
    for batch in gathered(batches):
        runs, sizes = known.texts(batch.column("t"))
        some = sizes > 0
        if some.any():
            tokens = np.insert(runs.flat(), np.cumsum(sizes[some]), end).astype(np.uint16)
            yield batch.column("d").filter(pa.array(some)).to_pylist(), sizes[some] + 1, tokens


def sequences(parts: Iterator, seq_len: int, end: int) -> Iterator[tuple[np.ndarray, list, int]]:
    """(tokens, ids of the texts in it, real tokens) of every sequence of a partition."""
    left, owners = np.zeros(0, np.uint16), []  # owners: (id, tokens) of what is left
    for ids, sizes, tokens in parts:
        left = np.concatenate((left, tokens))
        owners += list(zip(ids, sizes.tolist(), strict=True))
        at = 0
        first = 0
        while len(left) - at >= seq_len:
            room, inside = seq_len, []
            while room:
                doc, size = owners[first]
                inside.append(doc)
                if size > room:
                    owners[first] = (doc, size - room)
                    room = 0
                else:
                    room -= size
                    first += 1
            yield left[at:at + seq_len], inside, seq_len
            at += seq_len
        left, owners = left[at:], owners[first:]
    if len(left):
        fill = np.full(seq_len - len(left), end, dtype=np.uint16)
        yield np.concatenate((left, fill)), [d for d, _ in owners], len(left)


def write_shards(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD,
                 key: int = KEY) -> tuple[Layout, DataFrame]:
    """The layout and the (lazy) frame that writes the shards: slot, shard, byte_offset, n_tokens, crc32, doc_ids.

    The files exist once the frame has been run; ``finish`` then writes the manifest.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    ranks = read_ranks(vocabulary)
    end = len(ranks)
    if end >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    shared = spark.sparkContext.broadcast(ranks)
    src = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = subwords.loaded(shared, Encoder), 0
        for batch in gathered(batches):
            sizes = known.texts(batch.column("t"))[1]
            n += int(sizes.sum() + (sizes > 0).sum())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()],
                                          "n": [-(-n // seq_len)]})

    # One row per input partition comes to the driver.
    counts = {r["part"]: r["n"] for r in src.mapInArrow(count, "part long, n long").collect()}
    offsets, total = {}, 0
    for part in sorted(counts):
        offsets[part] = total
        total += counts[part]
    layout = Layout(root, total, seq_len, per_shard, end, key)
    store, path = filesystem(root)
    store.create_dir(path, recursive=True)
    placed = spark.sparkContext.broadcast((counts, offsets))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, offsets = placed.value
        part = TaskContext.get().partitionId()
        done, held = 0, []

        def flush() -> pa.RecordBatch:
            slot = permute(np.arange(done - len(held), done) + offsets[part], total, key)
            return pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // per_shard), pa.array([h[2] for h in held], pa.int64()),
                 pa.array([h[0].astype("<u2").tobytes() for h in held], pa.binary()),
                 pa.array([h[1] for h in held], pa.list_(pa.int64()))],
                names=["slot", "shard", "n_tokens", "record", "doc_ids"])

        known = subwords.loaded(shared, Encoder)
        for sequence in sequences(stream(batches, known, end), seq_len, end):
            held.append(sequence)
            done += 1
            if len(held) == 1024:
                yield flush()
                held.clear()
        if done != counts.get(part, 0):
            raise RuntimeError("the input's partitions changed between the two passes; write it first")
        if held:
            yield flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(layout.root)
        attempt = TaskContext.get().taskAttemptId()
        shard, out, name = None, None, None

        def close():
            if out is not None:
                out.close()
                store.move(name, filesystem(layout.file(shard))[1])

        for batch in batches:
            slots, shards = batch.column("slot").to_pylist(), batch.column("shard").to_pylist()
            crc = []
            for slot, own, record in zip(slots, shards, batch.column("record").to_pylist(), strict=True):
                if own != shard:
                    close()
                    shard, name = own, filesystem(layout.file(own))[1] + f".{attempt}"
                    out, place = store.open_output_stream(name), own * per_shard
                if slot != place:
                    raise RuntimeError("slots of a shard must be consecutive")
                out.write(record)
                crc.append(zlib.crc32(record))
                place += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("shard"),
                 pa.array([(s % per_shard) * layout.stride for s in slots], pa.int64()),
                 batch.column("n_tokens"), pa.array(crc, pa.int64()), batch.column("doc_ids")],
                names=["slot", "shard", "byte_offset", "n_tokens", "crc32", "doc_ids"])
        close()

    rows = src.mapInArrow(emit, "slot long, shard long, n_tokens long, record binary, doc_ids array<long>")
    n_tasks = max(1, -(-total // (per_shard * TASK_SHARDS)))
    spread = rows.repartition(min(n_tasks, 20_000), "shard").sortWithinPartitions("slot")
    return layout, spread.mapInArrow(write, "slot long, shard long, byte_offset long, n_tokens long, "
                                            "crc32 long, doc_ids array<long>")


def finish(layout: Layout) -> None:
    """Write the manifest: the shards are complete."""
    store, path = filesystem(f"{layout.root}/manifest.json")
    with store.open_output_stream(path) as f:
        f.write(json.dumps(asdict(layout)).encode())


def store(docs: DataFrame, root: str, **args) -> tuple[Layout, DataFrame]:
    """Write the shards of ``docs`` and their manifest; the layout and the written index (one row per slot)."""
    layout, rows = write_shards(docs, root, **args)
    index = materialize(rows, "shard-index")
    finish(layout)
    return layout, index


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_token_shards``: place and checksum of every sequence of the shards that it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return store(docs, scratch_path(spark, "token-shards"))[1]

"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which ids those are.

A text is encoded by a byte-level vocabulary (A, given a space before the text)
and by a piece vocabulary (B, which adds that space itself). Both token
sequences spell the same bytes, so each token has a byte range. Offsets where a
token of A and one of B both end cut the tokens into groups; the two tokens that
end at a cut are linked. All documents of a slice are merged in lockstep: a state
vector holds one A and one B pointer per lane; each step compares the two
ends of all lanes, emits the links and cuts where they are equal, moves on the
pointer that ends first (both, at a cut), and drops the lanes that have ended. A lane is a document, or
a run of about ``LANE`` tokens of a long one, cut at a single space between
two other characters: no token of either vocabulary reaches over one, so
both end there. Steps follow the longest lane and not the longest text.

Texts are encoded by the units between such spaces, each distinct unit of a slice
once; A's words recur and are kept by the worker (``subwords``). A first pass writes the links; their id pairs are counted
over the corpus (pre-aggregated by slice); a second pass looks the counts up. The
counts are broadcast up to ``BROADCAST_PAIRS`` pairs. Above that each slice's
distinct pairs are joined with the counts and brought back to the slice; a pair held by a third of
all links is one row of each slice, and no slice is larger than its texts.

Defined results: a null or empty text, or one whose tokens do not spell it (it
has a sign that the vocabulary turns into a space), has no tokens, zeros and empty
groups. Repeated rows are aligned, and counted, each for itself. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialize
from . import common, pieces, subwords

#: The two vocabularies; read by the driver only.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens of A in a lane, about.
LANE = 256
#: Id pairs up to which their counts are broadcast (three numbers each).
BROADCAST_PAIRS = 2_000_000
#: Fixed value: the words that A merges; the zero byte stands between units here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\0]+|\0"
#: Composed letters and signs whose class no Unicode version changes, without white space.
PLAIN = "^[\x21-\x7e\xa1-\u024f]+$"
#: Distinct words whose ids of A a worker holds at most.
PARTS = subwords.LIMIT
#: Distinct units whose ids a worker holds at most.
UNITS = subwords.LIMIT
#: Units given to B at once.
JOINED = 500
#: Bytes of text merged at once.
SLICE_BYTES = 3 << 19
#: No part of little-endian 32-bit ids under 65,536.
STOP = b"\xff" * 4

ALIGNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, groups string, "
           "link_a array<int>, link_b array<int>")


def read_vocabularies(byte_level: str = BYTE_LEVEL, piece_model: str = PIECES) -> tuple[str, bytes, list[bytes]]:
    """Both tokenizers as stored, and the bytes of every piece; neither may join words over a space."""
    with open(byte_level, encoding="utf-8") as f:
        text = f.read()
    kind = json.loads(text)
    first = kind["pre_tokenizer"]
    if kind["normalizer"] or kind["post_processor"] or first["type"] != "ByteLevel" or not first["use_regex"]:
        raise ValueError("not a byte-level vocabulary that cuts texts into words first")
    if max(kind["model"]["vocab"].values()) >= 1 << 16:
        raise ValueError("ids of A must fit 16 bits")
    model = pieces.read_model(piece_model)
    if not model.dummy_prefix or model.trim or any(pieces.SPACE in p.lstrip(pieces.SPACE) for p in model.pieces):
        raise ValueError("pieces that reach over a space, or a normaliser that changes spaces")
    surface = [bytes([int(p[3:5], 16)]) if t == pieces.BYTE else p.replace(pieces.SPACE, " ").encode()
               for p, t in zip(model.pieces, model.types, strict=True)]
    with open(piece_model, "rb") as f:
        return text, f.read(), surface


class Spelling:
    """The bytes of ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.size) - self.size
        self.tokens, self.bytes = tokens, np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def one(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def __len__(self) -> int:
        return len(self.size)

    def of(self, ids: np.ndarray) -> bytes:
        return self.bytes[common.ragged(self.start[ids], self.size[ids])].tobytes()


class Vocabularies:
    """Both tokenizers in a worker."""

    def __init__(self, stored: tuple[str, bytes, list[bytes]]):
        import regex
        import sentencepiece
        from tokenizers import Tokenizer
        description, model, b_bytes = stored
        self.a = Tokenizer.from_str(description)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = subwords.byte_letters()
        byte_of = {c: b for b, c in self.letters.items()}
        a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            a_bytes[i] = (bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode())
        self.a_bytes, self.b_bytes = Spelling(a_bytes), Spelling(b_bytes)
        # Decimal ids with what follows them: a comma inside a group, the end of A's or B's part, or nothing.
        self.written = pa.array([f"{i}{end}" for n, part in ((len(a_bytes), "|"), (len(b_bytes), ";"))
                                 for i in range(n) for end in (",", part, "")])
        self.cut = regex.compile(WORDS).findall
        self.words = subwords.UnitCache(self.merged, PARTS)
        self.opens = np.array([x.startswith(b" ") for x in b_bytes])
        self.units = subwords.UnitTable(self.encode, UNITS)

    def merged(self, words: list[str]) -> Iterator[bytes]:
        """A's ids of each word as little-endian 32-bit numbers."""
        merge = self.a.model.tokenize
        for word in words:
            ids = [t.id for t in merge(word.encode().decode("latin-1").translate(self.letters))]
            yield struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, units: pa.Array) -> tuple[subwords.Runs, subwords.Runs]:
        """A's and B's ids of every unit; none if they do not spell a space and the unit."""
        is_plain = pc.match_substring_regex(units, PLAIN)
        plain, other = units.filter(is_plain).to_pylist(), units.filter(pc.invert(is_plain)).to_pylist()
        # Plain units as one text for A, with a sign between them that is no part of a word.
        parts = self.cut("".join([f" {u}\0" for u in plain]))
        self.words.fill(parts)
        self.words["\0"] = STOP
        ids_a = np.frombuffer(b"".join(map(self.words.__getitem__, parts)), dtype="<u4")
        stops = np.flatnonzero(ids_a == 0xFFFFFFFF)
        start = np.concatenate(([0], stops + 1))[:-1]
        ones = [self.a.encode(" " + u, add_special_tokens=False).ids for u in other]
        runs_a = subwords.Runs(ids_a, start, stops - start).then(ones)
        # For B some hundred units as one text: each begins with its only token that opens with a space.
        texts = [" ".join(plain[i:i + JOINED]) for i in range(0, len(plain), JOINED)]
        ids_b = np.array(list(chain.from_iterable(self.b.encode(texts, num_threads=1))), dtype=np.int64)
        start = np.flatnonzero(self.opens[ids_b])
        runs_b = subwords.Runs(ids_b, start, np.diff(np.append(start, len(ids_b)))).then(self.b.encode(other, num_threads=1))
        order = np.empty(len(units), dtype=np.int64)
        mask = is_plain.to_numpy(zero_copy_only=False)
        order[mask], order[~mask] = np.arange(len(plain)), len(plain) + np.arange(len(other))
        bad = [len(plain) + k for k, (u, x, y) in enumerate(zip(other, ones, runs_b.lists(len(plain)), strict=True))
               if not self.a_bytes.one(x) == b" " + u.encode() == self.b_bytes.one(y)]
        runs_a.size[bad] = runs_b.size[bad] = 0
        if self.a_bytes.of(runs_a.flat(len(plain))) != self.b_bytes.of(runs_b.flat(len(plain))):
            raise RuntimeError("plain words that the vocabularies spell differently")
        return runs_a.pick(order), runs_b.pick(order)


def merge(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray,
          ) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of A and B that end together, in order.

    ``end_a`` and ``end_b`` are the byte ends of the flat token arrays; lane k has
    the tokens from ``first_a[k]`` to ``first_a[k + 1]``, both ending at its last.
    """
    a, b, last = first_a[:-1].copy(), first_b[:-1].copy(), first_a[1:]
    live = a < last
    a, b, last = a[live], b[live], last[live]
    links_a, links_b = [], []
    while len(a):
        x, y = end_a[a], end_b[b]
        ahead, behind = x <= y, y <= x
        cut = ahead & behind
        links_a.append(a[cut])
        links_b.append(b[cut])
        a = a + ahead
        b = b + behind
        live = a < last
        if not live.all():
            a, b, last = a[live], b[live], last[live]
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Positions rise from lane to lane, and with them from text to text.
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray,
                   text_a: np.ndarray, text_b: np.ndarray, known: Vocabularies) -> pa.Array:
    """Per text the written ids of its tokens, by group, A's before B's; ``text_*`` are the texts' offsets."""
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[cut_a] = 1
    last_b[cut_b] = 1
    code = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    before_b = np.concatenate(([0], cut_b + 1))
    code[np.arange(len(ids_a)) + before_b[np.cumsum(last_a) - last_a]] = 3 * ids_a + last_a
    at_b = np.arange(len(ids_b)) + (cut_a + 1)[np.cumsum(last_b) - last_b]
    last_b[text_b[1:][np.diff(text_b) > 0] - 1] = 2
    code[at_b] = 3 * (len(known.a_bytes) + ids_b) + last_b
    words = known.written.take(pa.array(code))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(text_a + text_b, pa.int32()), words), "")


def align_texts(texts: pa.Array, known: Vocabularies, lane: int = LANE):
    """Per text: numbers of tokens of A, of B, of cuts, the written groups; and the linked ids of all texts."""
    n = len(texts)
    units, counts = subwords.cut_units(texts)
    units = units.dictionary_encode()
    at, of = units.indices.to_numpy(), np.repeat(np.arange(n), counts)
    runs_a, runs_b = known.units.get(units.dictionary)
    live = (np.bincount(of, runs_a.size[at] == 0, n) == 0)[of]
    at, of = at[live], of[live]
    unit_a, unit_b = runs_a.size[at], runs_b.size[at]
    ids_a, ids_b = runs_a.pick(at).flat(), runs_b.pick(at).flat()
    off_a = np.concatenate(([0], np.cumsum(unit_a)))
    off_b = np.concatenate(([0], np.cumsum(unit_b)))
    text_a = np.concatenate(([0], np.cumsum(np.bincount(of, unit_a, n).astype(np.int64))))
    text_b = np.concatenate(([0], np.cumsum(np.bincount(of, unit_b, n).astype(np.int64))))
    run = (off_a[:-1] - text_a[of]) // lane
    starts = np.flatnonzero(np.diff(of, prepend=-1) | np.diff(run, prepend=-1))
    cut_a, cut_b = merge(np.cumsum(known.a_bytes.size[ids_a]), np.cumsum(known.b_bytes.size[ids_b]),
                         np.append(off_a[starts], len(ids_a)), np.append(off_b[starts], len(ids_b)))
    groups = written_groups(ids_a, ids_b, cut_a, cut_b, text_a, text_b, known)
    cuts = np.searchsorted(cut_a, text_a)
    return np.diff(text_a), np.diff(text_b), cuts, groups, ids_a[cut_a], ids_b[cut_b]


def digest(groups: pa.Array) -> pa.Array:
    """SHA-256 of each written text in hex; of an empty one nothing."""
    return pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups.cast(pa.binary()).to_pylist()])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL,
          piece_model: str = PIECES, digests: bool = False) -> DataFrame:
    """Per row: token numbers, ``groups`` (``a1,a2|b1;a3|b2``: ids of A and B by group) and the linked ids.

    ``block`` numbers the slice of rows that were merged together. With ``digests``, ``groups`` has the
    SHA-256 of that text (it is several times as long as the row's), taken where it is written.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabularies(byte_level, piece_model))
    src = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = subwords.loaded(shared, Vocabularies)
        block = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(common.slices(batches, "t", SLICE_BYTES)):
            n_a, n_b, cuts, groups, link_a, link_b = align_texts(batch.column("t"), known)
            cuts32 = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, block + number)), batch.column("d"), pa.array(n_a), pa.array(n_b),
                 pa.array(np.diff(cuts)), digest(groups) if digests else groups,
                 pa.ListArray.from_arrays(cuts32, pa.array(link_a, pa.int32())),
                 pa.ListArray.from_arrays(cuts32, pa.array(link_b, pa.int32()))],
                names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups", "link_a", "link_b"])

    return src.mapInArrow(run, ALIGNED)


def codes(batch) -> np.ndarray:
    """Every link of a batch as one number: A's id, then B's in the low 32 bits."""
    a, b = (batch.column(c) for c in ("link_a", "link_b"))
    if isinstance(a, pa.ChunkedArray):
        a, b = a.combine_chunks(), b.combine_chunks()
    return a.flatten().to_numpy().astype(np.int64) << 32 | b.flatten().to_numpy().astype(np.int64)


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair (an id of A << 32 | an id of B), n: links of the corpus; best: no other id of A has more with that B."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(codes(batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n, pa.int64())], names=["pair", "n"])

    each = aligned.select("link_a", "link_b").mapInArrow(run, "pair long, n long")
    counts = materialize(each.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def count_links(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The rows of ``aligned`` with n_links, n_best and count_sum for the links; both are tables or files."""
    keep = [c for c in aligned.columns if c not in ("link_a", "link_b")]
    added = ["n_links", "n_best", "count_sum"]
    schema = StructType([aligned.schema[c] for c in keep] + [StructField(c, LongType()) for c in added])

    def counted(batch, pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> list[pa.Array]:
        """The columns of the result; ``pair`` is sorted and has all links of the batch."""
        links = batch.column("link_a")
        links = links.combine_chunks() if isinstance(links, pa.ChunkedArray) else links
        off = links.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        at = np.searchsorted(pair, codes(batch))
        return [*[batch.column(c) for c in keep], pa.array(np.diff(off)),
                pa.array(common.sums(best[at], off)), pa.array(common.sums(n[at], off))]

    if counts.count() <= broadcast_pairs:
        table = counts.sort("pair").toArrow()
        shared = aligned.sparkSession.sparkContext.broadcast(
            (table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(counted(batch, *shared.value), names=keep + added)

        return aligned.mapInArrow(run, schema)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.repeat(batch.column("block").to_numpy(), np.diff(batch.column("link_a").offsets.to_numpy()))
            both = np.unique(np.stack((block, codes(batch))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["block", "pair"])

    links = aligned.select("block", "link_a", "link_b")
    held = links.mapInArrow(distinct, "block long, pair long").join(counts, "pair")

    def back(rows: pa.Table, found: pa.Table) -> pa.Table:
        pair, first = np.unique(found["pair"].to_numpy(), return_index=True)
        return pa.Table.from_arrays(counted(
            rows, pair, found["n"].to_numpy()[first], found["best"].to_numpy()[first]), names=keep + added)

    return aligned.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(back, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op13_alignment``: tokens, groups and links of every document."""
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
    found = materialize(found.withColumnRenamed("groups", "groups_sha256"), "aligned")
    counts = materialize(link_counts(found), "link-counts")
    return count_links(found, counts).drop("block")

"""The permutation, and an exact round trip through the files."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import subwords
from spanloom.llm import token_shards as op
from spanloom.session import materialize, scratch_path

tiktoken = pytest.importorskip("tiktoken")


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        x = np.arange(n)
        assert sorted(op.permute(x, n).tolist()) == x.tolist()
        assert op.permute(x, n).tolist() == np.concatenate([op.permute(x[i:i + 7], n) for i in range(0, n, 7)]).tolist()
    assert op.permute(np.arange(1000), 1000, 1).tolist() != op.permute(np.arange(1000), 1000, 2).tolist()


def round_trip(spark, rows, seq_len, per_shard):
    df = materialize(spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(4), "in")
    layout, out = op.write_shards(df, scratch_path(spark, "shards"), seq_len=seq_len, per_shard=per_shard)
    got = {r["slot"]: r for r in out.collect()}
    op.finish(layout)
    layout = op.load_layout(layout.root)
    seqs = list(op.read_sequences(layout, 0, layout.n_sequences))
    assert sorted(got) == list(range(layout.n_sequences)) and len(seqs) == len(got)
    for s, q in enumerate(seqs):
        assert got[s]["crc32"] == zlib.crc32(q.tobytes())
        assert (got[s]["shard"], got[s]["byte_offset"]) == (s // per_shard, s % per_shard * 2 * seq_len)
    part = list(op.read_sequences(layout, 3, 5))
    assert all((a == b).all() for a, b in zip(part, seqs[3:8], strict=False))
    enc = tiktoken.Encoding("t", pat_str=op.PATTERN, mergeable_ranks=op.read_ranks(op.VOCABULARY), special_tokens={})
    order = op.permute(np.arange(layout.n_sequences), layout.n_sequences)
    texts, cur = [], []
    for t in np.concatenate([seqs[s] for s in order]).tolist() if seqs else []:
        if t == layout.end_token:
            texts += [enc.decode(cur)] if cur else []
            cur = []
        else:
            cur.append(t)
    assert sorted(texts) == sorted(r[1] for r in rows if r[1])
    owners = {d for r in got.values() for d in r["doc_ids"]}
    assert owners == {r[0] for r in rows if r[1]}


def test_round_trip(spark, tiny_slices):
    rows = [(i, f"text number {i} " * (i % 17 + 1), 1) for i in range(120)]
    rows += [(500, None, 1), (501, "", 1), (3, rows[3][1], 1), (502, "é😀 " * 3000, 1)]
    round_trip(spark, rows, 16, 8)
    round_trip(spark, rows, 1000, 1024)


def test_empty(spark):
    round_trip(spark, [(1, None, 1)], 16, 8)


def test_tokens_of_units():
    """Units encoded alone spell the encoding of the whole text."""
    rnd = random.Random(5)
    enc = tiktoken.Encoding("t", pat_str=op.PATTERN, mergeable_ranks=op.read_ranks(op.VOCABULARY), special_tokens={})
    parts = ["a", "word", "don't", "É", "日本", "😀", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "12", "...", "'s"]
    known = op.Encoder(op.read_ranks(op.VOCABULARY))
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    texts += [None, "", " ", "\n", texts[0]]
    runs, sizes = known.texts(pa.array(texts))
    ids, end = runs.flat(), np.cumsum(sizes)
    for t, a, b in zip(texts, end - sizes, end, strict=True):
        assert ids[a:b].tolist() == enc.encode_ordinary(t or "")


def test_store_against_plain_packing(spark, tiny_slices):
    """The stored shards, byte for byte, from a loop over the rows in their order; the manifest opens them."""
    rows = [(i, f"text {i} of a few words " * (i % 9)) for i in range(60)] + [(None, "no id"), (7, None)]
    df = materialize(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "in")
    root = scratch_path(spark, "shards")
    _, index = op.store(df, root, seq_len=8, per_shard=16, key=99)
    layout = op.load_layout(root)
    enc = tiktoken.Encoding("t", pat_str=op.PATTERN, mergeable_ranks=op.read_ranks(op.VOCABULARY), special_tokens={})
    flat, owner = [], []
    for doc, text in [tuple(r) for r in df.collect()]:
        if text:
            ids = [*enc.encode_ordinary(text), layout.end_token]
            flat += ids
            owner += [doc] * len(ids)
    n = -(-len(flat) // 8)
    real = len(flat)
    flat += [layout.end_token] * (8 * n - len(flat))
    slots = op.permute(np.arange(n), n, 99).tolist()
    want = {slots[k]: flat[8 * k:8 * k + 8] for k in range(n)}
    assert layout.n_sequences == n
    assert [q.tolist() for q in op.read_sequences(layout, 0, n)] == [want[s] for s in range(n)]
    got = {r["slot"]: r for r in index.collect()}
    for k in range(n):
        r = got[slots[k]]
        inside = list(dict.fromkeys(owner[8 * k:8 * k + 8]))
        assert (r["doc_ids"], r["n_tokens"], r["shard"]) == (inside, min(8, real - 8 * k), slots[k] // 16)


def test_query_leaves_a_readable_store(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op, "scratch_path", lambda s, name: seen.append(scratch_path(s, name)) or seen[-1])
    rows = op.query(spark, "/root/testdata/sf0.001")
    layout = op.load_layout(seen[0])
    assert layout.n_sequences == rows.count() > 0
    crc = {r["slot"]: r["crc32"] for r in rows.select("slot", "crc32").collect()}
    assert [zlib.crc32(q.tobytes()) for q in op.read_sequences(layout, 0, 50)] == [crc[s] for s in range(50)]


def test_units_over_lines_are_encoded_together():
    """White space inside a unit does not make it a call of its own; at its ends or beside a space it does."""
    enc = tiktoken.Encoding("t", pat_str=op.PATTERN, mergeable_ranks=op.read_ranks(op.VOCABULARY), special_tokens={})
    known, calls = op.Encoder(op.read_ranks(op.VOCABULARY)), []
    known.encode = lambda text: calls.append(text) or enc.encode_ordinary(text)
    texts = [" ".join(f"end{i}{white}éstart{i}" for i in range(200)) for white in "\n\t\r  \x1c\x85"]
    runs, sizes = known.texts(pa.array(texts))
    assert len(calls) <= 1 + len(texts)
    assert runs.flat().tolist() == [i for t in texts for i in enc.encode_ordinary(t)]
    assert sizes.tolist() == [len(enc.encode_ordinary(t)) for t in texts]
    for t in ("a \n b\nc d\n", "\n x\ny z 　 w", "a\n\n\nb c\t\td ", " \x1c a\x1c\x1cb \x1c"):
        assert known.texts(pa.array([t]))[0].flat().tolist() == enc.encode_ordinary(t)


def test_full_table_keeps_recurring_units():
    """What is found again is encoded once however often the table fills; all lookups are right."""
    seen = []

    def encode(units):
        seen.extend(units.to_pylist())
        return (subwords.Runs.of([list(u.encode()) for u in units.to_pylist()], np.uint16),)

    table = subwords.RecurringUnits(encode, 60)
    for k in range(40):
        units = [f"often {i}" for i in range(20)] + [f"once {k} {i}" for i in range(k % 17)] + ["", "é"]
        runs, = table.get(pa.array(units))
        assert [bytes(x.tolist()).decode() for x in np.split(runs.flat(), np.cumsum(runs.size)[:-1])] == units
        assert len(table.units) <= 60 + len(units)
    assert max(map(seen.count, seen)) == 1
    table.get(pa.array([f"more {i}" for i in range(500)]))
    runs, = table.get(pa.array(["often 1", "more 3"]))
    assert bytes(runs.flat().tolist()) == b"often 1more 3"


def test_slices_of_several_batches(monkeypatch):
    """Small batches are encoded together up to the limit; no row is lost or moved."""
    monkeypatch.setattr(op, "SLICE_BYTES", 100)
    texts = ["x" * (7 * k % 40) for k in range(50)] + [None, "", "y" * 500, "z", None]
    batches = [pa.RecordBatch.from_pydict({"d": list(range(a, min(a + 3, 55))), "t": pa.array(texts[a:a + 3], pa.string())})
               for a in range(0, 55, 3)]
    got = list(op.gathered(iter(batches)))
    assert [t for b in got for t in b.column("t").to_pylist()] == texts
    assert [d for b in got for d in b.column("d").to_pylist()] == list(range(55))
    assert len(got) < len(batches)
    sizes = [[len(t or "") for t in b.column("t").to_pylist()] for b in got]
    assert all(sum(n) - max(n) <= 200 for n in sizes)
    assert list(op.gathered(iter([]))) == []

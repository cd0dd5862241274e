"""The rank tree and paged list against plain lists; ties by content; what a micro-batch reads and writes."""

from __future__ import annotations

import random
import time

import pytest

from spanloom.operators import edits as E
from spanloom.operators import spanlist as L
from spanloom.schema import EDITS
from spanloom.session import scratch_path
from spanloom.streaming import edits_stream as SE


def test_rank_tree_equals_a_list():
    rnd = random.Random(3)
    counts, tree = [], L.RankTree({})
    for _ in range(600):
        if not counts or rnd.random() < 0.3:
            counts.append(0)
            assert tree.grow() == len(counts)
        i = rnd.randrange(len(counts))
        d = rnd.choice([1, 1, 2, -1]) if counts[i] else 1
        counts[i] += d
        tree.add(i + 1, d)
        flat = [(p + 1, k) for p, n in enumerate(counts) for k in range(n)]
        for rank in {0, len(flat) // 2, len(flat) - 1} if flat else ():
            assert tree.find(rank) == flat[rank]


def test_list_operations_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(L, "PAGE", 4)
    rnd = random.Random(4)
    plain, paged = [], L.SpanList()
    for step in range(3000):
        a = {"text": str(step), "label": "l", "start": step, "end": step + 1,
             "mapped_value": {"c": ["x"]} if rnd.random() < 0.3 else {}}
        k = rnd.randrange(len(plain)) if plain else 0
        op = rnd.choice(["add", "add", "pop", "replace"]) if plain else "add"
        if op == "add":
            plain.append(a)
            paged.append(a)
        elif op == "pop":
            plain.pop(k)
            paged.pop(k)
        else:
            plain[k] = a
            paged.replace(k, a)
        if plain:
            assert paged.get(len(plain) // 3) == plain[len(plain) // 3]
    assert paged.anns == plain and len(paged) == len(plain)
    assert paged.mapped == sum(bool(x["mapped_value"]) for x in plain)


def test_a_million_removes_at_the_front():
    n = 1_000_000
    spans = L.SpanList()
    for i in range(n):
        spans.append({"text": "t", "label": "l", "start": 64 * i, "end": 64 * i + 1, "mapped_value": {}})
    began = time.process_time()
    for _ in range(n):
        spans.pop(0)
    assert len(spans) == 0 and not spans.bins
    assert time.process_time() - began < 60  # a list of pages, not a shift of the rest for each


def _log(spark, rows):
    return spark.createDataFrame([("p", d, s, op, o, t, "l", a, b, c, v) for d, s, op, o, t, a, b, c, v in rows], EDITS)


def test_one_place_is_decided_by_content(spark):
    """Two edits with one (row, seq): the same result in any arrival order, in batch and, arriving together, in the stream."""
    a = (1, 0, "add", None, "A", 0, 2, None, None)
    b = (1, 0, "add", None, "B", 0, 2, None, None)
    m = (1, 1, "set_mapping", 0, None, None, None, "c", ["x"])
    n = (1, 1, "set_mapping", 0, None, None, None, "c", None)
    for rows in ([a, b, m, n], [b, n, a, m], [n, m, b, a]):
        df = _log(spark, rows).coalesce(1)
        assert [(r.text, r.mapped_value) for r in E.replay_edits(df).collect()] == [("A", {})]
        src, sink, ckpt = (scratch_path(spark, x) for x in ("src", "sink", "ckpt"))
        df.write.parquet(src)
        SE.run_replay_stream(spark, src, df.schema, sink, ckpt)
        assert [(r.text, r.mapped_value) for r in SE.state_spans(spark, ckpt).collect()] == [("A", {})]


def test_batch_touches_only_what_its_edits_touch(monkeypatch):
    """Entries written by one edit of a long list do not grow with the list."""

    class State(dict):
        reads = writes = 0

        def getValue(self, key):
            State.reads += 1
            return self.get(key)

        def updateValue(self, key, value):
            State.writes += 1
            self[key] = value

        def removeKey(self, key):
            State.writes += 1
            self.pop(key, None)

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    p = SE.ReplayProcessor()
    p.head, p.pages, p.ranks, p.bins, p.early = Value(), State(), State(), State(), State()

    def edit(seq, op="add", ord=None, at=0):
        return {"seq": seq, "op": op, "ord": ord, "text": "t", "label": "l", "start": at, "end": at + 3,
                "category": None, "values": None}

    sizes, plain = {}, L.SpanList()
    seq = 0

    def both(edits):
        for e in sorted(edits, key=lambda e: e["seq"]):
            L.apply_edit(plain, e)
        return list(p.handleInputRows(("p", 1), edits, None))[0]

    for n in (500, 50_000):
        both([edit(s, at=10 * s) for s in range(seq, n)])
        seq = n
        State.reads = State.writes = 0
        batch = [edit(seq, "remove", 3), edit(seq + 1, at=10 * seq + 5), edit(seq + 2, "update", 100, 7)]
        assert both(batch)["n_spans"] == len(plain)
        seq += 3
        sizes[n] = (State.reads, State.writes)
    assert sizes[50_000][0] <= sizes[500][0] + 30 and sizes[50_000][1] <= sizes[500][1] + 30
    n = len(plain)
    out = list(p.handleInputRows(("p", 1), [edit(seq + 1, at=10**7), edit(seq - 1)], None))[0]
    assert (out["next_seq"], out["pending"], out["n_spans"]) == (seq, 1, n)
    out = list(p.handleInputRows(("p", 1), [edit(seq, at=10**8)], None))[0]
    assert (out["next_seq"], out["pending"], out["n_spans"]) == (seq + 2, 0, n + 2)


@pytest.mark.parametrize("files", [1, 4])
def test_stream_in_any_split_equals_batch(spark, files):
    rnd = random.Random(files)
    rows = []
    for d in (1, 2, None):
        for s in range(150):
            op = rnd.choice(["add"] * 4 + ["remove", "update", "set_mapping", "nonsense"])
            at = rnd.randint(0, 3000)
            rows.append((d, s, op, rnd.randint(-1, 60), f"t{s}", at, at + rnd.choice([0, 1, 5, 70]), "c",
                         rnd.choice([None, [], ["x"]])))
    df = _log(spark, rows)
    want = sorted(map(str, E.replay_edits(df).collect()))
    src, sink, ckpt = (scratch_path(spark, x) for x in ("src", "sink", "ckpt"))
    rnd.shuffle(rows)
    _log(spark, rows + rows[:40]).repartition(files).write.parquet(src)
    SE.run_replay_stream(spark, src, df.schema, sink, ckpt)
    assert sorted(map(str, SE.state_spans(spark, ckpt).collect())) == want
    latest = SE.latest_snapshots(spark.read.parquet(sink)).collect()
    assert all(r.next_seq == 150 and r.pending == 0 for r in latest) and sum(r.n_spans for r in latest) == len(want)


def test_short_rows_cost_few_state_calls():
    """A row's early edits share entries of the state, and a list of one page has no other entry."""

    class State(dict):
        calls = 0

        def getValue(self, key):
            State.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            State.calls += 1
            self[key] = value

        def removeKey(self, key):
            State.calls += 1
            self.pop(key, None)

    class Value:
        value = None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    rnd = random.Random(8)
    for n in (67, 600):
        p, plain, edits = SE.ReplayProcessor(), L.SpanList(), []
        p.head, p.pages, p.ranks, p.bins, p.early = Value(), State(), State(), State(), State()
        for seq in range(n):
            edits.append({"seq": seq, "op": rnd.choice(L.OPS + ("add",) * 3), "ord": rnd.randrange(5), "text": f"t{seq}",
                          "label": "l", "start": 20 * rnd.randrange(2 * n), "end": None, "category": "c", "values": [None]})
            edits[-1]["end"] = edits[-1]["start"] + 7
            L.apply_edit(plain, dict(edits[-1]))
        State.calls = 0
        order = sorted(edits, key=lambda e: (e["seq"] * 7 % 4 == 0, e["seq"]))  # the first edit comes last
        for k in range(4):
            out = list(p.handleInputRows(("p", 1), order[k * n // 4:(k + 1) * n // 4], None))[0]
        assert (out["next_seq"], out["pending"], out["n_spans"]) == (n, 0, len(plain)) and not p.early
        stored = [a for k in sorted(p.pages) for a in SE.json.loads(p.pages[k][0])]
        assert stored == plain.anns
        assert bool(p.bins) == bool(p.ranks) == (len(p.pages) > 1) == (n == 600)
        if n == 67:
            assert State.calls < 20

"""Piece vocabularies as finite-state transducers, walked over many words at once.

A SentencePiece model is compiled into three machines: a normaliser that maps
characters to characters (white space to the visible space sign, with the
dummy prefix), a trie whose final states emit pieces, and a byte fallback that
emits one piece per UTF-8 byte of a character no piece covers. Composed with
an input they give a lattice; its tropical-semiring shortest path is the
encoding. For unigram models an arc weighs minus its log score. For BPE models
the lattice is also intersected with the machine that accepts two neighbouring
pieces only if the merges of their joined text stop at exactly that pair;
of all paths exactly one survives, the merge result.

The lattice is built for the flat array of all distinct words of a slice, in
numpy: one trie step for all starts at a time, then one node of all segments
at a time. Words are cut into segments at nodes that no piece spans, so the
number of steps follows the longest segment and not the longest text.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd

SPACE = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Cost added to the lowest score for the byte fallback of one character.
FALLBACK = 10.0
_CHUNKS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _fields(buf: bytes) -> list[tuple[int, object]]:
    """(field number, value) pairs of one protocol-buffer message."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        v = shift = 0
        while True:
            b = buf[i]
            i += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value = buf[i:i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            value = buf[i:i + n]
            i += n
        out.append((tag >> 3, value))
    return out


@dataclass
class PieceModel:
    """Pieces with score and type, and the normaliser's settings."""
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    dummy_prefix: bool
    trim: bool


def read_model(path: str) -> PieceModel:
    """Read a SentencePiece model file (a serialized protocol buffer)."""
    with open(path, "rb") as f:
        top = _fields(f.read())
    pieces, scores, types = [], [], []
    trainer, norm = {}, {}
    for number, value in top:
        if number == 1:
            p = dict(_fields(value))
            pieces.append(p[1].decode())
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            types.append(p.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            norm = dict(_fields(value))
    if norm.get(2):
        raise ValueError("a model with a precompiled character map is not supported")
    return PieceModel(pieces, scores, types, trainer.get(3, UNIGRAM),
                      bool(norm.get(3, 1)), bool(norm.get(4, 1)))


class Table:
    """Map from integer keys to integers, looked up for whole arrays."""

    def __init__(self, keys, values):
        self.index = pd.Index(np.asarray(keys, dtype=np.int64))
        self.values = np.asarray(values, dtype=np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.index.get_indexer(keys)
        if not len(self.values):
            return np.full(len(keys), -1, dtype=np.int32)
        return np.where(at >= 0, self.values[at], -1)


class Transducer:
    """The compiled machines; ``oov`` is the internal id of a character without a piece."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.size = len(model.pieces)
        self.oov = self.size
        self.bytes = np.zeros(256, dtype=np.int32)
        for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)):
            if t == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True))
                    if t in (NORMAL, USER)}
        self.longest = max((len(p) for p in self.ids), default=1)
        low = min((model.scores[i] for i in self.ids.values()), default=0.0)
        self.cost = np.array([-s for s in model.scores] + [FALLBACK - low])
        self._trie()
        if model.kind == BPE:
            self._merges()
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE
                        else p.replace(SPACE, " ").encode() if t in (NORMAL, USER) else b""
                        for p, t in zip(model.pieces, model.types, strict=True)]
        self._pair_key = np.full(1 << 20, -1, dtype=np.int64)
        self._pair_ok = np.zeros(1 << 20, dtype=bool)

    # -- compile ---------------------------------------------------------

    def _trie(self) -> None:
        node, final, keys, to = {"": 0}, {}, [], []
        for p, i in self.ids.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in node:
                    node[p[:k]] = len(node)
                    keys.append(node[p[:k - 1]] << 21 | ord(p[k - 1]))
                    to.append(node[p[:k]])
            final[node[p]] = i
        self.step = Table(keys, to)
        self.final = np.full(len(node), -1, dtype=np.int32)
        for n, i in final.items():
            self.final[n] = i

    def _merges(self) -> None:
        """Ranks, the joins of two pieces, and each piece's last merge."""
        scores = sorted({self.model.scores[i] for p, i in self.ids.items() if len(p) > 1}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(self.size + 1, -1, dtype=np.int64)
        keys, joined = [], []
        for p, i in self.ids.items():
            if len(p) > 1:
                self.rank[i] = rank[self.model.scores[i]]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    joined.append(i)
        self.join = Table(keys, joined)
        self.left = np.arange(self.size + 1, dtype=np.int32)
        self.right = np.arange(self.size + 1, dtype=np.int32)
        self.whole = np.zeros(self.size + 1, dtype=bool)
        self.whole[self.oov] = True
        for p, i in self.ids.items():
            parts = self.merge(p)
            self.whole[i] = len(parts[0]) == 1
            if parts[1]:
                self.left[i], self.right[i] = self.ids[parts[1][0]], self.ids[parts[1][1]]

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merge loop over one short string: its pieces and the last merge."""
        part, last = list(text), None
        while True:
            best = None
            for k in range(len(part) - 1):
                i = self.ids.get(part[k] + part[k + 1])
                if i is not None and (best is None or self.model.scores[i] > best[0]):
                    best = (self.model.scores[i], k)
            if best is None:
                return part, last
            k = best[1]
            last = (part[k], part[k + 1])
            part[k:k + 2] = [part[k] + part[k + 1]]

    # -- compose and search ------------------------------------------------

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of the joined text of a and b stop at exactly (a, b)."""
        key = a.astype(np.int64) << 20 | b
        slot = (key * 0x9E3779B1 >> 7) & (len(self._pair_key) - 1)
        out = self._pair_ok[slot]
        new = np.flatnonzero(self._pair_key[slot] != key)
        if len(new):
            out[new] = self._neighbours(a[new], b[new])
            self._pair_key[slot[new]] = key[new]
            self._pair_ok[slot[new]] = out[new]
        return out

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later merge on either side of the cut; a join that would have come first forbids the pair."""
        a, b = a.astype(np.int32), b.astype(np.int32)
        ok = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            j = self.join.get(x.astype(np.int64) << 20 | y)
            bad = (j >= 0) & (self.rank[j] < limit[live])
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            limit[live] = np.where(first, rx, ry + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
        return ok

    def arcs(self, chars: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Piece (or -1) of every start and length, as [length - 1, start]."""
        n = len(chars)
        end = np.repeat(off[1:], np.diff(off))
        pid = np.full((self.longest, n), -1, dtype=np.int32)
        at = np.arange(n)
        node = np.zeros(n, dtype=np.int64)
        for k in range(self.longest):
            inside = at + k < end[at]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            node = self.step.get(node << 21 | chars[at + k])
            at, node = at[node >= 0], node[node >= 0].astype(np.int64)
            pid[k, at] = self.final[node]
        if self.model.kind == BPE:
            pid = np.where((pid >= 0) & self.whole[pid], pid, -1)
        pid[0] = np.where(pid[0] < 0, self.oov, pid[0])
        return pid

    def segments(self, pid: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Nodes that no arc spans (each text's end among them)."""
        n = pid.shape[1]
        d = np.zeros(n + 2, dtype=np.int64)
        for k in range(1, len(pid)):
            s = np.flatnonzero(pid[k] >= 0)
            np.add.at(d, s + 1, 1)
            np.add.at(d, s + k + 1, -1)
        return np.flatnonzero(np.cumsum(d)[:n + 1] == 0)

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best path of every word: flat internal ids and each word's offsets."""
        off = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars = chars.astype(np.int64)
        n = len(chars)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        pid = self.arcs(chars, off)
        cut = self.segments(pid, off)
        seg, length = cut[:-1], np.diff(cut)
        order = np.argsort(-length, kind="stable")
        seg, length = seg[order], length[order]
        is_cut = np.zeros(n + 1, dtype=bool)
        is_cut[cut] = True
        cost = np.full(n + 1, np.inf)
        cost[cut] = 0.0
        last = np.full(n + 1, -1, dtype=np.int32)
        back = np.zeros(n + 1, dtype=np.int32)
        for p in range(1, int(length[0]) + 1):
            e = seg[:np.searchsorted(-length, -p, side="right")] + p
            best = np.full(len(e), np.inf)
            for k in range(min(self.longest, p), 0, -1):
                s = e - k
                t = pid[k - 1, s]
                i = np.flatnonzero(t >= 0)
                if self.model.kind == BPE:  # one survivor per node: stop at the first
                    i = i[np.isinf(best[i]) & ((last[s[i]] >= 0) | is_cut[s[i]])]
                    if not len(i):
                        continue
                    free = is_cut[s[i]]
                    good = free.copy()
                    good[~free] = self.neighbours(last[s[i]][~free], t[i][~free])
                    i = i[good]
                    c = np.zeros(len(i))
                else:
                    c = np.where(is_cut[s[i]], 0.0, cost[s[i]]) + self.cost[t[i]]
                    i, c = i[c < best[i]], c[c < best[i]]
                best[i] = c
                last[e[i]], back[e[i]] = t[i], k
            cost[e] = best
        on = np.zeros(n + 1, dtype=bool)
        at = cut[1:]
        start = np.zeros(n + 1, dtype=np.int64)
        start[cut[1:]] = cut[:-1]
        low = cut[:-1]
        while len(at):
            on[at] = True
            at = at - back[at]
            more = at > low
            at, low = at[more], low[more]
        nodes = np.flatnonzero(on)
        return last[nodes], np.searchsorted(nodes, off, side="right")

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of every normalised word, byte fallback expanded, and their offsets."""
        path, off = self.paths(words)
        odd = np.flatnonzero(path == self.oov)
        if not len(odd):
            return path, off
        # The characters without a piece, in order: the same nodes of the input.
        chars = [c for w in words for c in w if c not in self.ids]
        code = [c.encode("utf-8", "surrogatepass") for c in chars]
        size = np.ones(len(path), dtype=np.int64)
        size[odd] = [len(c) for c in code]
        at = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(path, size)
        hole = np.repeat(path == self.oov, size)
        out[hole] = self.bytes[np.frombuffer(b"".join(code), dtype=np.uint8)]
        return out, at[off]

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut before every run of visible spaces (no piece spans such a cut)."""
        if self.model.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        if self.model.dummy_prefix:
            if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
                return [SPACE + w for w in text.split(" ")]
            text = " " + text
        return _CHUNKS.findall(text.replace(" ", SPACE))

    def decode(self, ids) -> str:
        """Text of a sequence of ids; control pieces are silent, invalid bytes become U+FFFD."""
        s = self.surface
        text = b"".join([s[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

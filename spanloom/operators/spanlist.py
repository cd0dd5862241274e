"""A row's annotation list for ordered replay: pages, a rank tree over them, and intervals by bin.

The list is cut into pages of up to ``PAGE`` spans in ordinal order. A binary-indexed
tree over the pages' sizes finds the page of an ordinal, and follows every change, in
log(pages) steps. For overlap tests each span's interval is kept under the fixed-width bins it
covers. All three are mappings, so they may be plain dicts (batch) or views of keyed state
(stream) that load and write back only what is touched.
"""

from __future__ import annotations

from collections.abc import MutableMapping

#: Spans of a page at most.
PAGE = 64
# Bin width of the overlap index (code points) and the bins a span may cover, as
# in ``spans.overlap_pairs``.
BIN = 64
MAX_BINS = 1024
#: The bin of the spans that cover more.
LONG = -(1 << 62)


class RankTree:
    """Counts of numbered pages (from 1): add to one, find the page of a rank; log steps each."""

    def __init__(self, nodes: MutableMapping, pages: int = 0):
        self.nodes, self.pages = nodes, pages

    def grow(self) -> int:
        """A new last page without entries; its number."""
        i = self.pages = self.pages + 1
        total, j, stop = 0, i - 1, i - (i & -i)
        while j > stop:
            total += self.nodes[j]
            j -= j & -j
        self.nodes[i] = total
        return i

    def add(self, i: int, n: int) -> None:
        while i <= self.pages:
            self.nodes[i] = self.nodes[i] + n
            i += i & -i

    def find(self, rank: int) -> tuple[int, int]:
        """The page of a 0-based rank, and the rank inside it."""
        at, step = 0, 1 << max(self.pages.bit_length() - 1, 0)
        while step:
            if at + step <= self.pages and self.nodes[at + step] <= rank:
                at += step
                rank -= self.nodes[at]
            step >>= 1
        return at + 1, rank


def is_mapped(a: dict) -> bool:
    m = a.get("mapped_value")
    return isinstance(m, dict) and any(bool(v) for v in m.values())


def bins_of(s, e):
    """Bins of a span (an empty or inverted one: the bin of its start)."""
    if s is None or e is None:
        return ()
    first, last = s // BIN, max(e - 1, s) // BIN
    return range(first, last + 1) if last - first < MAX_BINS else (LONG,)


class SpanList:
    """Spans (dicts) in ordinal order.

    A span without offsets is in no bin and overlaps nothing. A span over more than ``MAX_BINS``
    bins is tested by every add; adding such a span tests the whole list.
    """

    def __init__(self, anns: list | None = None, pages: MutableMapping | None = None,
                 nodes: MutableMapping | None = None, bins: MutableMapping | None = None,
                 n_pages: int = 0, n: int = 0, mapped: int = 0):
        self.pages = {} if pages is None else pages
        self.bins = {} if bins is None else bins
        self.ranks = RankTree({} if nodes is None else nodes, n_pages)
        self.n, self.mapped = n, mapped
        for a in anns or []:
            self.append(a)

    def __len__(self) -> int:
        return self.n

    @property
    def anns(self) -> list:
        """The whole list."""
        return [a for p in range(1, self.ranks.pages + 1) for a in self.pages[p]]

    def _index(self, a: dict) -> None:
        s, e = a["start"], a["end"]
        for b in bins_of(s, e):
            self.bins[b] = [*self.bins.get(b, ()), [s, e]]

    def index_page(self) -> None:
        """Make the rank tree and the bins of a list of one page."""
        self.ranks.nodes[1] = len(self.pages[1])
        for a in self.pages[1]:
            self._index(a)

    def _unindex(self, a: dict) -> None:
        s, e = a["start"], a["end"]
        for b in bins_of(s, e):
            left = list(self.bins[b])
            left.remove([s, e])
            if left:
                self.bins[b] = left
            else:
                del self.bins[b]

    def overlaps_any(self, s: int, e: int) -> bool:
        """``not (e <= a.start or s >= a.end)`` for some span ``a`` of the list."""
        bins = bins_of(s, e)
        if LONG in bins:
            near = ([a["start"], a["end"]] for a in self.anns if a["start"] is not None and a["end"] is not None)
        else:
            near = (x for b in (LONG, *bins) for x in self.bins.get(b, ()))
        return any(not (e <= x[0] or s >= x[1]) for x in near)

    def append(self, a: dict) -> None:
        last = self.ranks.pages
        if not last or len(self.pages[last]) >= PAGE:
            last = self.ranks.grow()
            self.pages[last] = []
        self.pages[last] = [*self.pages[last], a]
        self.ranks.add(last, 1)
        self.n += 1
        self.mapped += is_mapped(a)
        self._index(a)

    def get(self, k: int) -> dict:
        page, at = self.ranks.find(k)
        return self.pages[page][at]

    def pop(self, k: int) -> None:
        page, at = self.ranks.find(k)
        spans = list(self.pages[page])
        a = spans.pop(at)
        self.pages[page] = spans
        self.ranks.add(page, -1)
        self.n -= 1
        self.mapped -= is_mapped(a)
        self._unindex(a)

    def replace(self, k: int, a: dict) -> None:
        """Put ``a`` in place of a span."""
        page, at = self.ranks.find(k)
        spans = list(self.pages[page])
        old, spans[at] = spans[at], a
        self.pages[page] = spans
        self.mapped += is_mapped(a) - is_mapped(old)
        if (old["start"], old["end"]) != (a["start"], a["end"]):
            self._unindex(old)
            self._index(a)


OPS = ("add", "remove", "update", "set_mapping")


def apply_edit(spans: SpanList, e: dict) -> str:
    """Apply one edit to a row's list in place; return the outcome."""
    op = e.get("op")
    ordv = e.get("ord")
    if op == "add":
        s, t = e.get("start"), e.get("end")
        if s is None or t is None:
            return "bad_offset"
        if spans.overlaps_any(s, t):
            return "overlap"
        spans.append({"text": e.get("text"), "label": e.get("label"),
                      "start": s, "end": t, "mapped_value": {}})
        return "accepted"
    if ordv is None or not 0 <= ordv < len(spans):
        return "out_of_range" if op in OPS else "unknown_op"
    if op == "remove":
        spans.pop(ordv)
        return "accepted"
    if op == "update":
        spans.replace(ordv, {"text": e.get("text"), "label": e.get("label"),
                             "start": e.get("start"), "end": e.get("end"), "mapped_value": {}})
        return "accepted"
    if op == "set_mapping":
        cat, vals = e.get("category"), list(e.get("values") or [])
        a = spans.get(ordv)
        if a["mapped_value"].get(cat, []) == vals:
            return "unchanged"
        spans.replace(ordv, a | {"mapped_value": a["mapped_value"] | {cat: vals}})
        return "accepted"
    return "unknown_op"


#: What tells two edits with one place in the order apart; the first of them holds.
CONTENT = ("op", "ord", "text", "label", "start", "end", "category", "values")


def content(e: dict) -> list:
    """The order of edits with one place: by content, nulls first, as Spark sorts it."""
    def key(v):
        return (v is not None, [key(x) for x in v] if isinstance(v, list) else v)

    return [key(e.get(c)) for c in CONTENT]

"""Tokenising by cached units: texts are cut where no token can cross, and each distinct unit is encoded once.

Units recur from text to text, so a worker keeps the encodings of the units it has
seen. The cache holds ``LIMIT`` units at most and is emptied when it is full.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

LIMIT = 200_000
#: White space, and what other libraries take for it.
WHITE = "[\\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A space that no token reaches over.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: A unit that holds a space, or begins or ends with white space.
RAGGED = f"^{WHITE}| |{WHITE}$"
#: A space beside white space or the end of the text; without one, every space is such a one.
EDGE = f"(^ | $|{WHITE} | {WHITE})"


class UnitCache(dict):
    """unit -> encoding; ``fill`` encodes the unknown ones of a slice in one call."""

    def __init__(self, encode: Callable[[list], Iterable], limit: int = LIMIT):
        super().__init__()
        self.encode, self.limit = encode, limit

    def fill(self, units: Iterable) -> None:
        """Afterwards all ``units`` are known."""
        units = set(units)
        new = units.difference(self)
        if len(self) + len(new) > self.limit:
            self.clear()
            new = units
        new = list(new)
        self.update(zip(new, self.encode(new), strict=True))


_LOADED: dict[tuple, tuple] = {}


def loaded(shared, start: Callable):
    """What ``start`` makes of a broadcast value, once per worker for the last value."""
    key = (start.__module__, start.__qualname__, id(shared.value))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = (shared.value, start(shared.value))  # the value is held, so its id stays its own
    return _LOADED[key][1]


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies.

    Printable Latin-1 stands for itself, the other bytes for the letters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


@dataclass
class Runs:
    """Ids of numbered units: unit k has ``size[k]`` from ``start[k]`` on."""
    ids: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def then(self, more: list[list[int]]) -> Runs:
        """These units, then some more."""
        size = np.array([len(x) for x in more], dtype=np.int64)
        ids = np.array(list(chain.from_iterable(more)), dtype=np.int64)
        return Runs(np.concatenate((self.ids.astype(np.int64), ids)),
                    np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size)),
                    np.concatenate((self.size, size)))

    @classmethod
    def of(cls, lists: list[list[int]], dtype: type) -> Runs:
        size = np.array([len(x) for x in lists], dtype=np.int64)
        return cls(np.fromiter(chain.from_iterable(lists), dtype, size.sum()), np.cumsum(size) - size, size)

    def pick(self, units: np.ndarray) -> Runs:
        return Runs(self.ids, self.start[units], self.size[units])

    def only(self, units: np.ndarray) -> Runs:
        """Some units, without the ids of the others."""
        size = self.size[units]
        return Runs(self.pick(units).flat(), np.cumsum(size) - size, size)

    def flat(self, n: int | None = None) -> np.ndarray:
        """The ids of the first ``n`` units, one after the other."""
        return self.ids[common.ragged(self.start[:n], self.size[:n])]

    def joined(self, other: Runs) -> Runs:
        """These units, then the others."""
        return Runs(np.concatenate((self.ids, other.ids)),
                    np.concatenate((self.start, other.start + len(self.ids))),
                    np.concatenate((self.size, other.size)))

    def lists(self, first: int) -> Iterator[list[int]]:
        for a, n in zip(self.start[first:].tolist(), self.size[first:].tolist(), strict=True):
            yield self.ids[a:a + n].tolist()


class UnitTable:
    """The encodings of the units seen before in this worker, looked up for whole arrays.

    ``encode`` gives one or more ``Runs`` of an array of distinct units. The table holds at most ``limit``
    units beyond those of one slice; then it begins anew.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[Runs, ...]], limit: int = 3 * LIMIT):
        self.encode, self.limit = encode, limit
        self.units, self.runs = pa.array([], pa.string()), None

    def get(self, distinct: pa.Array) -> tuple[Runs, ...]:
        at = pc.index_in(distinct, value_set=self.units)
        new = distinct.filter(pc.is_null(at))
        if self.runs is None or len(self.units) + len(new) > self.limit:
            self.units, self.runs = distinct, self.encode(distinct)
            return self.runs
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if len(new):
            at[at < 0] = len(self.units) + np.arange(len(new))
            self.units = pa.concat_arrays([self.units, new])
            self.runs = tuple(a.joined(b) for a, b in zip(self.runs, self.encode(new), strict=True))
        return tuple(r.pick(at) for r in self.runs)


class RecurringUnits(UnitTable):
    """A table that, when it is full, keeps the units found again since it was last full.

    If these are more than half of the limit, it begins anew.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[Runs, ...]], limit: int = 2 * LIMIT):
        super().__init__(encode, limit)
        self.again = np.zeros(0, dtype=bool)

    def get(self, distinct: pa.Array) -> tuple[Runs, ...]:
        at = pc.index_in(distinct, value_set=self.units)
        self.again[at.drop_null().to_numpy()] = True
        if len(self.units) + at.null_count > self.limit:
            self.make_room()
            at = pc.index_in(distinct, value_set=self.units)
        new = distinct.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if len(new) or self.runs is None:
            at[at < 0] = len(self.units) + np.arange(len(new))
            self.units, runs = pa.concat_arrays([self.units, new]), self.encode(new)
            self.runs = runs if self.runs is None else tuple(a.joined(b) for a, b in zip(self.runs, runs, strict=True))
            self.again = np.append(self.again, np.zeros(len(new), dtype=bool))
        return tuple(r.pick(at) for r in self.runs)

    def make_room(self) -> None:
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > self.limit:
            kept = kept[:0]
        self.units, self.again = self.units.take(pa.array(kept)), np.zeros(len(kept), dtype=bool)
        self.runs = self.runs and tuple(r.only(kept) for r in self.runs)


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts in one array, and the number of each text's (null and empty texts: none)."""
    texts = pc.fill_null(texts, "")
    some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    odd = pc.match_substring_regex(texts, EDGE).to_numpy(zero_copy_only=False) & some
    units = pc.split_pattern(texts, " ")
    counts = np.where(some, np.diff(units.offsets.to_numpy()), 0)
    if not odd.any():
        return units.filter(pa.array(some)).flatten(), counts
    cut = {int(i): BETWEEN.split(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
    counts[list(cut)] = [len(u) for u in cut.values()]
    return pa.array(chain.from_iterable(
        cut[i] if odd[i] else units[i].as_py() for i in np.flatnonzero(some).tolist()), pa.string()), counts

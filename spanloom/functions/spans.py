"""Span expressions. Offsets are 0-based code points, spans are half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def found_in(query, text) -> Column:
    """``text and text in query``: empty or NULL text is never found."""
    q, t = _c(query), _c(text)
    return F.coalesce((t != F.lit("")) & q.contains(t), F.lit(False))


def locate0(query, text) -> Column:
    """0-based index of the first occurrence of ``text`` in ``query`` (-1 if absent).

    ``position`` counts code points (1-based), like Python ``str.find`` + 1.
    """
    return F.position(_c(text), _c(query)).cast("bigint") - F.lit(1)


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """``not (b.end <= a.start or b.start >= a.end)``; touching spans do not overlap."""
    return ~((_c(b_end) <= _c(a_start)) | (_c(b_start) >= _c(a_end)))


def validate_reason(query, text, start, end) -> Column:
    """First failed check, or NULL when the span is valid.

    Order: empty text, unusable offsets (NULL or negative), start >= end,
    end past the text length.
    """
    q, t, s, e = _c(query), _c(text), _c(start), _c(end)
    return (
        F.when(t.isNull() | (t == F.lit("")), F.lit("empty_text"))
        .when(s.isNull() | e.isNull() | (s < 0) | (e < 0), F.lit("bad_offset"))
        .when(s >= e, F.lit("start_ge_end"))
        .when(e > F.length(q), F.lit("end_past_text"))
    )


def span_slice(query, start, end) -> Column:
    """``query[start:end]`` when ``0 <= start < end <= len(query)``, else NULL."""
    q, s, e = _c(query), _c(start), _c(end)
    ok = (s >= 0) & (s < e) & (e <= F.length(q))
    return F.when(ok, F.substring(q, (s + 1).cast("int"), (e - s).cast("int")))

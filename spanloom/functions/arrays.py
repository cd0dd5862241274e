"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_by(arr, *fields: str) -> Column:
    """Sort an array of structs by the given fields (ascending, NULLs first).

    Needed when the struct holds a map, which has no natural order.
    """
    a = F.col(arr) if isinstance(arr, str) else arr

    def cmp(left, right):
        out = F.lit(0)
        for f in reversed(fields):
            lf, rf = left[f], right[f]
            out = (F.when(lf.isNull() & rf.isNotNull(), F.lit(-1))
                   .when(lf.isNotNull() & rf.isNull(), F.lit(1))
                   .when(lf < rf, F.lit(-1)).when(lf > rf, F.lit(1)).otherwise(out))
        return out

    return F.array_sort(a, cmp)

"""Every annotation query equals its DuckDB oracle (driver check, at sf0.001)."""

from __future__ import annotations

from spanloom.plans.catalog import QUERIES
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, sorted(QUERIES), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows_only")}
    assert not bad, bad
    assert sum(1 for v in res.values() if v[0] == "ok") >= 45


def test_entry_smoke(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    assert df.columns == ["project", "not_started", "mapping_incomplete", "done"]
    assert df.count() > 0

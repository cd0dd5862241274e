import pytest

from spanloom.llm import common


@pytest.fixture
def tiny_slices(monkeypatch):
    """Cut batches after a few bytes, so that small tables have many slices."""
    monkeypatch.setattr(common, "SLICE_BYTES", 300)
    monkeypatch.setattr(common.slices, "__defaults__", (300,))


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)

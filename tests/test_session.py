"""Session helpers: write-once stages in the shared dir, spreading few-split inputs."""

from __future__ import annotations

import pytest

from spanloom.session import ensure_checkpoint_dir, materialize, spread


def test_spread_only_inputs_of_few_files(spark):
    target = spark.sparkContext.defaultParallelism
    one = materialize(spark.range(0, 100, 1, 1), "one")
    assert spread(one).rdd.getNumPartitions() == target
    many = materialize(spark.range(0, 100, 1, target + 3), "many")
    assert spread(many) is many


def test_unset_folder_is_an_error_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_materialize_writes_under_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    df = materialize(spark.range(0, 10), "unit")
    files = df.inputFiles()
    assert files and all(base.rstrip("/").split(":")[-1] in f for f in files)
    assert sorted(r.id for r in df.collect()) == list(range(10))

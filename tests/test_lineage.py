"""Intermediate tables: where they may lie, and that they go."""

import os
from types import SimpleNamespace

import pytest

from pelorus.plans import lineage


def files(spark):
    folder = lineage._tables(spark).removeprefix("file:")
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: default))

    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            lineage.ensure_checkpoint_dir(session(master))
    assert "pelorus-checkpoint-" in lineage.ensure_checkpoint_dir(session("local[4]"))


def test_tables_go_after_use(spark):
    before = files(spark)
    with lineage.scratch(spark):
        kept = lineage.cut(spark.range(5))
        assert len(files(spark)) == len(before) + 1 and kept.count() == 5
    assert files(spark) == before
    lineage.cut(spark.range(3))
    lineage.drop_tables(spark)
    assert files(spark) == []


def test_tables_of_a_query_go_after_use(spark):
    from pelorus.operators.spikes import flag_implausible

    rows = spark.createDataFrame([(k, "a", None, float(k)) for k in range(3)], "i long, c string, t timestamp_ntz, v double")
    before = files(spark)
    with lineage.scratch(spark):
        flag_implausible(rows, id_col="i", source_col="c", time_col="t", value_col="v").collect()
        assert len(files(spark)) > len(before)
    assert files(spark) == before

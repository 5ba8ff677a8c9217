"""Scratch space: shared, and removed again."""

import os
from types import SimpleNamespace

import pytest

from lexweave import scratch


def session(master, folder=None):
    settings = {} if folder is None else {"spark.checkpoint.dir": folder}
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=settings.get, set=settings.__setitem__)), settings


def test_a_cluster_needs_the_setting(tmp_path):
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.scratch_dir(session(master)[0])
        assert scratch.scratch_dir(session(master, "hdfs://x/y/")[0]) == "hdfs://x/y"
    one, settings = session("local[4]")
    assert os.path.isdir(scratch.scratch_dir(one)) and settings["spark.checkpoint.dir"] == scratch.scratch_dir(one)
    os.rmdir(settings["spark.checkpoint.dir"])


def test_tables_are_released(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before, began = set(os.listdir(folder)), scratch.written_so_far()
    a, b, empty = (scratch.materialize(df) for df in (spark.range(5), spark.range(7), spark.range(0)))
    assert (a.count(), b.count(), empty.count(), scratch.written_so_far() - began) == (5, 7, 0, 3)
    scratch.release(spark, began, keep=[b, empty])
    assert (b.count(), empty.count(), len({f for f in set(os.listdir(folder)) - before if not f.startswith(".")})) == (7, 0, 2)
    scratch.release(spark, began)
    assert not {f for f in set(os.listdir(folder)) - before if not f.startswith(".")} and scratch.written_so_far() == began

"""The shared folder: named, unset on one machine, unset on a cluster."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tidemark.sources import shared

ROOT = Path(__file__).resolve().parents[1]


def session(master, folder=None, app="app"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_which_folder():
    assert shared.shared_dir(session("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master))
    one, two = shared.shared_dir(session("local[2]", app="x")), shared.shared_dir(session("local[2]", app="y"))
    assert one == shared.shared_dir(session("local[2]", app="x")) != two and Path(one.removeprefix("file://")).is_dir()


def test_tables_are_dropped(spark):
    path = shared.new_table(spark, "some")
    spark.range(3).write.parquet(path)
    shared.drop_table(spark, path)
    assert not Path(path.removeprefix("file:").replace("//", "/")).exists()
    with pytest.raises(ValueError, match="not a new table"):
        shared.drop_table(spark, path)
    spark.range(3).write.parquet(shared.new_table(spark, "other"))
    assert shared.release(spark) >= 1 and shared.release(spark) == 0


def test_unset_folder_on_a_plain_installation(tmp_path):
    """A session without any defaults: tables and checkpoints go to a temporary folder, the session's settings stay."""
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from tidemark.sources import shared
path = shared.new_table(spark, "t")
spark.range(5).write.parquet(path)
assert spark.read.parquet(path).count() == 5 and shared.cut_lineage(spark.range(7)).count() == 7
assert spark.conf.get("spark.checkpoint.dir", None) is None and shared.release(spark) == 1
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]

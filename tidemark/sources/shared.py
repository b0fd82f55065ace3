"""The folder that the driver and all executors share: new tables and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the temporary folder where no shared one is named, and the new tables so far.
_FOLDERS: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. On one machine, where it is unset as in tests, a temporary one of the application; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        found = _FOLDERS[app]
    return found.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that new_table() named. Nothing may read it afterwards."""
    known = _TABLES.get(spark.sparkContext.applicationId, [])
    if path not in known:
        raise ValueError(f"not a new table of this application: {path}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    known.remove(path)


def release(spark: SparkSession) -> int:
    """Delete all tables that operators of this application have written to the shared folder, and tell how many; results still to be read must be written first."""
    paths = list(_TABLES.get(spark.sparkContext.applicationId, []))
    for path in paths:
        drop_table(spark, path)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to a new table of the shared folder and read back: what comes after does not compute it again, and plans know its size."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that settled() has written; nothing may read them afterwards."""
    for table in tables:
        spark = table.sparkSession
        names = {f.rpartition("/")[0].rpartition("/")[2] for f in table.inputFiles()}
        for path in [p for p in _TABLES.get(spark.sparkContext.applicationId, []) if p.rpartition("/")[2] in names]:
            drop_table(spark, path)

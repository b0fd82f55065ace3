"""Tables that grow by deltas and are compacted: a commit record tells which folders make up the current version.

    path/delta-N             rows of delta N, written whole or again by the same number
    path/snapshot-N          what deltas up to N amount to
    path/_commits/N.json     written last, by a rename: readers take the highest one and the deltas after it

A reader that has looked at a commit finds its folders until the commit after the next: compaction deletes only what
the commit before its own had replaced already. One writer at a time compacts a path.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    return sorted(int(x.removeprefix(f"{kind}-")) for x in _names(spark, path) if x.startswith(f"{kind}-"))


def _finished(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def commits(spark: SparkSession, path: str) -> list[dict]:
    """All commit records, oldest first."""
    out = []
    for name in _names(spark, f"{path}/_commits"):
        if name.endswith(".json"):
            at, fs = _fs(spark, f"{path}/_commits/{name}")
            stream = fs.open(at)
            try:
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
    return sorted(out, key=lambda c: c["upto"])


def write_delta(rows: DataFrame, path: str, number: int) -> None:
    """Delta `number`; one that is written again replaces itself, and one that a snapshot holds already is left out."""
    done = commits(rows.sparkSession, path)
    if not done or number > done[-1]["upto"]:
        rows.write.mode("overwrite").parquet(f"{path}/delta-{number}")


def next_number(spark: SparkSession, path: str) -> int:
    done = commits(spark, path)
    return max([-1, *_numbers(spark, path, "delta"), *(c["upto"] for c in done)]) + 1


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the current snapshot and of the finished deltas after it; None if there is nothing yet."""
    done = commits(spark, path)
    upto = done[-1]["upto"] if done else -1
    folders = [f"{path}/snapshot-{upto}"] if done else []
    folders += [f"{path}/delta-{n}" for n in _numbers(spark, path, "delta") if n > upto and _finished(spark, f"{path}/delta-{n}")]
    return spark.read.parquet(*folders) if folders else None


def compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], files: int | None = None) -> int | None:
    """Make what is there one snapshot, merged; returns the last delta in it, None if nothing is new. Folders that the commit before had replaced go."""
    done = commits(spark, path)
    before = done[-1]["upto"] if done else -1
    fresh = [n for n in _numbers(spark, path, "delta") if n > before and _finished(spark, f"{path}/delta-{n}")]
    if not fresh:
        return None
    upto = fresh[-1]
    rows = merge(read_current(spark, path))
    (rows if files is None else rows.coalesce(files)).write.mode("overwrite").parquet(f"{path}/snapshot-{upto}")
    at, fs = _fs(spark, f"{path}/_commits/{upto}.tmp")
    stream = fs.create(at, True)
    stream.write(json.dumps({"upto": upto}).encode())
    stream.close()
    fs.rename(at, _fs(spark, f"{path}/_commits/{upto}.json")[0])
    for kind in ("delta", "snapshot"):
        for n in _numbers(spark, path, kind):
            if n < before or (kind == "delta" and n == before):
                fs.delete(_fs(spark, f"{path}/{kind}-{n}")[0], True)
    for c in done[:-1]:
        fs.delete(_fs(spark, f"{path}/_commits/{c['upto']}.json")[0], False)
    return upto

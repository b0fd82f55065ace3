"""Structured Streaming variants of clusters, bursts and feedback."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import versions
from ..sources.io import upsert_latest


def stream_clusters(events: DataFrame, gap_s: int = 3, watermark: str = "1 hour") -> DataFrame:
    """Clusters of events by a gap from the end of the events before, as session windows with a gap for each row.

    events: asset_id, start and end timestamps. A session ends before its limit, so a microsecond more takes in gaps
    of exactly the limit, as the batch clusters do.
    """
    length = F.expr("unix_micros(end) - unix_micros(start)") + gap_s * 1_000_000 + 1
    gap = F.concat(length.cast("string"), F.lit(" microseconds"))
    return events.withWatermark("start", watermark).groupBy("asset_id", F.session_window("start", gap).alias("w")).agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("last")).drop("w")


#: Parts of the keys of a stream of bursts: the state of a part holds its keys' samples and runs.
BURST_PARTS = 1024
#: For each key: the last sample that was taken, and the run that is open there (n = 0: none); and the samples that wait.
_OPEN = np.dtype([("k", "<i8"), ("t", "<i8"), ("start", "<i8"), ("n", "<i8"), ("peak", "<f8")])
_HELD = np.dtype([("k", "<i8"), ("t", "<i8"), ("v", "<f8")])


def _take(opened: np.ndarray, due: np.ndarray, threshold: float) -> tuple[np.ndarray, pd.DataFrame]:
    """What is open after samples, in order of key and time, that follow `opened`, and the runs that they end."""
    k, t = np.append(opened["k"], due["k"]), np.append(opened["t"], due["t"])
    hot = np.append(opened["n"] > 0, due["v"] >= threshold)
    n, v = np.append(opened["n"], np.ones(len(due), np.int64)), np.append(opened["peak"], due["v"])
    order = np.lexsort((np.arange(len(k)), k))  # a key's open sample, then its new ones as they stand
    k, t, hot, n, v = k[order], t[order], hot[order], n[order], v[order]
    same = np.append(False, k[1:] == k[:-1])
    start = np.where(same, np.roll(t, 1), t)
    start[order < len(opened)] = opened["start"][order[order < len(opened)]]
    head = np.flatnonzero(~same | np.append(True, hot[1:] != hot[:-1]))
    stop = np.append(head[1:], len(k))
    runs = {"k": k[head], "start": start[head], "n": np.where(hot[head], np.add.reduceat(n, head), 0), "peak": np.where(hot[head], np.maximum.reduceat(v, head), 0.0)}
    last = np.append(~same[head[1:]], True)
    after = np.zeros(int(last.sum()), _OPEN)
    for c, x in runs.items():
        after[c] = x[last]
    after["t"] = t[stop[last] - 1]
    ended = hot[head] & ~last
    return after, pd.DataFrame({c: x[ended] for c, x in runs.items()} | {"end": t[stop[ended]]})


def stream_bursts(series: DataFrame, threshold: float, by: str = "asset_id", watermark: str = "1 hour", idle_s: int = 3600) -> DataFrame:
    """Runs of samples at or over a fixed threshold, whatever the order in which samples arrive.

    series: by, t (timestamp), t_us, value. Samples are held until the watermark has passed them, and then taken in
    order of time; so what comes up to `watermark` late is in its place, and what comes later is dropped by Spark as
    late. The state of a key is what it holds, the open run and the sample before it. A key whose last sample lies
    `idle_s` behind the watermark gives its open run, ending at that sample, and its state goes. The keys of a part
    share one row of state, as Python's work is by row: a row for each key costs some ms a batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, held = (np.frombuffer(x, kind) for x, kind in zip(state.get, (_OPEN, _HELD), strict=True)) if state.exists else (np.zeros(0, _OPEN), np.zeros(0, _HELD))
        passed, new = state.getCurrentWatermarkMs() * 1000, [held]
        for pdf in batches:
            x = np.zeros(len(pdf), _HELD)
            x["k"], x["t"], x["v"] = 0 if key[0] < 0 else pdf[by], pdf["t_us"], pdf["value"]
            new.append(x)
        held = np.concatenate(new)
        held = held[np.lexsort((held["v"], held["t"], held["k"]))]
        due, held = held[held["t"] <= passed], held[held["t"] > passed]
        rows = []
        if len(due):
            opened, ended = _take(opened, due, threshold)
            rows.append(ended)
        idle = ~np.isin(opened["k"], held["k"])
        over = idle & (opened["t"] + idle_s * 1_000_000 <= passed)
        done = opened[over & (opened["n"] > 0)]
        rows.append(pd.DataFrame({c: done[c] for c in ("k", "start", "n", "peak")} | {"end": done["t"]}))
        wake = np.append(held["t"], opened["t"][idle & ~over] + idle_s * 1_000_000)
        opened = opened[~over]
        if len(wake):
            state.update((opened.tobytes(), held.tobytes()))
            state.setTimeoutTimestamp(max(int(wake.min()) // 1000, passed // 1000) + 1)
        elif state.exists:
            state.remove()
        out = pd.concat(rows)
        if len(out):
            k = pd.Series([None] * len(out), dtype="Int64") if key[0] < 0 else out["k"].to_numpy()
            yield pd.DataFrame({by: k, "start_us": out["start"].to_numpy(), "end_us": out["end"].to_numpy(), "n": out["n"].to_numpy(), "peak": out["peak"].to_numpy()})

    part = F.when(F.col(by).isNull(), -1).otherwise(F.pmod(F.xxhash64(by), F.lit(BURST_PARTS))).cast("long")
    keyed = series.withColumn("_part", part).withWatermark("t", watermark).groupBy("_part")
    return keyed.applyInPandasWithState(step, f"{by} long, start_us long, end_us long, n long, peak double", "opened binary, held binary", "append", GroupStateTimeout.EventTimeTimeout)


def _newest(rows: DataFrame) -> DataFrame:
    return upsert_latest(rows.limit(0), rows, ["clip_id"], "event_id")


def stream_feedback(log: DataFrame, path: str, checkpoint: str, compact_after: int = 16) -> None:
    """Keep the newest change of each clip, micro-batch by micro-batch.

    Each batch writes its own newest rows as a delta; a batch that runs again writes the same again, or nothing if a
    snapshot holds it. Every `compact_after` batches become one snapshot, so what readers take and what lies on disk
    follows the clips, not the batches.
    """

    def merge(batch: DataFrame, number: int) -> None:
        versions.write_delta(_newest(batch.select("clip_id", "event_id", "feedback_type")), path, number)
        if number % compact_after == compact_after - 1:
            versions.compact(batch.sparkSession, path, _newest)

    log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The newest change of each clip over the snapshot and the batches after it."""
    return _newest(versions.read_current(spark, path))

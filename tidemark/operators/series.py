"""Sampled series: bursts, flat runs, envelopes, lags and frame fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import r4
from ..schemas import SECOND
from ..sources.shared import settled
from .intervals import Keys
from .sequence import flag_runs


def burst_intervals(series: DataFrame, by: Keys, floor: float = 0.15, quiet: float = 0.05, least: int = 400_000) -> DataFrame:
    """Runs of value >= max(floor, median + 1.5 population deviations) and > quiet.

    A run starts at the sample before it and ends at the first quiet sample after it (the last one if none is).
    """
    level = series.groupBy(*by).agg(F.greatest(F.lit(floor), F.percentile("value", 0.5) + 1.5 * F.stddev_pop("value")).alias("threshold"))
    w = Window.partitionBy(*by).orderBy("t_us")
    s = series.join(level, by).withColumn("hot", (F.col("value") >= F.col("threshold")) & (F.col("value") > quiet)).withColumn("before", F.coalesce(F.lag("t_us").over(w), F.col("t_us"))).withColumn("after", F.coalesce(F.lead("t_us").over(w), F.col("t_us")))
    r = flag_runs(s, by, F.col("hot"), ["t_us"]).where("hot").groupBy(*by, "run", "threshold").agg(F.min("before").alias("start_us"), F.max("after").alias("end_us"), F.max("value").alias("peak"), F.count("*").alias("n"))
    r = r.where(F.col("end_us") - F.col("start_us") >= least)
    conf = F.least(F.lit(0.98), F.greatest(F.lit(0.70), 0.70 + 0.15 * F.least(F.lit(2.0), F.col("peak") / F.col("threshold") - 1)))
    return r.select(*by, "start_us", "end_us", "n", r4(conf).alias("confidence"))


def flat_runs(series: DataFrame, by: Keys, least: int = SECOND // 2) -> DataFrame:
    """Runs of equal consecutive samples that last `least`."""
    w = Window.partitionBy(*by).orderBy("t_us")
    s = series.withColumn("_c", F.when(F.coalesce(F.lag("value").over(w) != F.col("value"), F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = s.groupBy(*by, "run").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n"))
    return r.where(F.col("end_us") - F.col("start_us") >= least).drop("run")


def freeze_gaps(blocks: DataFrame, by: Keys) -> DataFrame:
    """Edit gaps over 0.5 s across which the source moves less than 0.2 s."""
    w = Window.partitionBy(*by).orderBy("edit_start_us", "block_id")
    b = blocks.withColumn("next_edit", F.lead("edit_start_us").over(w)).withColumn("next_source", F.lead("source_start_us").over(w))
    gap = F.col("next_edit") - F.col("edit_end_us")
    return b.where((gap > SECOND // 2) & (F.abs(F.col("next_source") - F.col("source_end_us")) < SECOND // 5)).select(*by, F.col("edit_end_us").alias("start_us"), F.col("next_edit").alias("end_us"), F.col("source_end_us").alias("source_us"))


def envelope(samples: DataFrame, by: Keys, rate_us: int = SECOND // 10, width: int = 3) -> DataFrame:
    """Mean absolute value of each bin, smoothed over `width` bins in a row."""
    b = samples.groupBy(*by, F.expr(f"t_us div {rate_us}").alias("bin")).agg(F.avg(F.abs("value")).alias("level"))
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(-(width // 2), width // 2)
    return b.select(*by, "bin", r4("level").alias("level"), r4(F.avg("level").over(w)).alias("smooth"))


def chunks_of(series: DataFrame, by: Keys, size: int = 12, stride: int = 6) -> DataFrame:
    """Chunks (chunk_id, levels) of each series (levels) from start to end, with ten times as much around them (context, context_at).

    A series shorter than a chunk is one chunk. context_at is the chunk's place in its context.
    """
    first = F.expr(f"sequence(0, greatest(0, size(levels) - {size}), {stride})")
    c = series.where("size(levels) > 0").select(*by, "levels", F.posexplode(first).alias("chunk_id", "_at")).withColumn("_from", F.greatest(F.lit(0), F.col("_at") - 5 * size))
    return c.select(*by, F.col("chunk_id").cast("long").alias("chunk_id"), F.expr(f"slice(levels, _at + 1, {size})").alias("levels"), F.expr(f"slice(levels, _from + 1, {10 * size})").alias("context"), (F.col("_at") - F.col("_from")).alias("context_at"))


#: Places of a block of a series that are searched in a task, and chunks that are searched for together.
PLACES, TOGETHER = 4096, 256


def _correlations(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Normalised correlation of each row of z (mean 0) with every part of y as long."""
    n = z.shape[1]
    if n > 64:
        size = 1 << (len(y) + n).bit_length()
        dots = np.fft.irfft(np.fft.rfft(y, size)[None] * np.conj(np.fft.rfft(z, size, axis=1)), size, axis=1)[:, : len(y) - n + 1]
    else:
        dots = z @ np.lib.stride_tricks.sliding_window_view(y, n).T
    y = y - y.mean()
    total, square = np.cumsum(np.append(0.0, y)), np.cumsum(np.append(0.0, y * y))
    dev = (square[n:] - square[:-n]) - (total[n:] - total[:-n]) ** 2 / n
    return dots / np.sqrt(np.maximum(dev, 1e-12)[None] * np.maximum((z * z).sum(axis=1), 1e-12)[:, None])


def _stretched(x: np.ndarray, speed: float) -> np.ndarray:
    n = max(2, round(len(x) * speed))
    z = np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)
    return z - z.mean()


def best_lag(chunks: DataFrame, source: DataFrame, by: Keys, speeds: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0), accept: float = 0.35, ambiguous: tuple[float, float] = (0.25, 0.45)) -> DataFrame:
    """For each chunk (chunk_id, levels) the place and speed in its key's source (levels) of highest normalised correlation.

    A source, at 10 values a second, is cut into blocks that overlap by the longest stretched chunk. A task meets one
    block with many chunks at once, by Fourier transform where chunks are long; the best places of all blocks are
    compared after it, the first on ties. Where chunks have a context (see chunks_of), an ambiguous score is tried
    again with the context near the first place, if it has over five times the chunk's length: the context's score
    and place count if it is accepted, else there is no match.
    """
    longest = chunks.agg(F.coalesce(F.max(F.size("levels")), F.lit(0))).first()[0]
    lap = max(2, round(longest * max(speeds)))
    at = F.posexplode(F.expr(f"sequence(0, greatest(0, size(levels) - 1), {PLACES})"))
    blocks = source.where("size(levels) > 0").select(*by, "levels", at.alias("_n", "_from")).select(*by, "_from", F.expr(f"slice(levels, _from + 1, {PLACES} + {lap} - 1)").alias("_block"))
    groups = chunks.where("size(levels) > 0").groupBy(*by, F.expr(f"chunk_id div {TOGETHER}").alias("_group"), F.size("levels").alias("_size")).agg(F.collect_list(F.struct("chunk_id", "levels")).alias("_chunks"))
    pairs = groups.join(blocks, by).select(*by, "_from", "_block", F.col("_chunks.chunk_id").alias("_ids"), F.flatten("_chunks.levels").alias("_levels"))
    kinds = dict(pairs.dtypes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda c: batch.column(c)[row].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                ids, y, first = value("_ids"), value("_block").astype(float), batch.column("_from")[row].as_py()
                x = value("_levels").astype(float).reshape(len(ids), -1)
                for speed in speeds:
                    z = np.stack([_stretched(c, speed) for c in x])
                    if z.shape[1] > len(y):
                        continue
                    found = np.round(_correlations(y, z)[:, :PLACES], 9)
                    place = found.argmax(axis=1)
                    keys = [batch.column(c).slice(row, 1).take(pa.array(np.zeros(len(ids), np.int64))) for c in by]
                    yield pa.record_batch([*keys, pa.array(ids), pa.array(np.full(len(ids), speed)), pa.array(found[np.arange(len(ids)), place]), pa.array(place + first, pa.int64())], names=[*by, "chunk_id", "speed", "raw", "at"])

    keyed = ", ".join(f"{c} {kinds[c]}" for c in by)
    tried = pairs.mapInArrow(search, f"{keyed}, chunk_id long, speed double, raw double, at long")
    tried = tried.groupBy(*by, "chunk_id", "speed").agg(F.max(F.struct("raw", (-F.col("at")).alias("at"))).alias("m"))
    best = tried.groupBy(*by, "chunk_id").agg(F.max(F.struct(r4("m.raw").alias("score"), F.col("m.at").alias("at"), "speed")).alias("m"))
    best = settled(best.select(*by, "chunk_id", (-F.col("m.at")).alias("lag"), "m.speed", "m.score"), "lags")
    sure = best.where(F.col("score") > accept)
    if "context" not in chunks.columns:
        return sure
    doubtful = best.where((F.col("score") >= ambiguous[0]) & (F.col("score") < ambiguous[1])).join(chunks, [*by, "chunk_id"]).where(F.size("context") > 5 * F.size("levels"))
    again = doubtful.withColumn("_before", F.round(F.col("context_at") * F.col("speed")).cast("long")).withColumn("_size", F.size("levels"))
    again = again.withColumn("_low", F.greatest(F.lit(0), F.col("lag") - F.col("_before") - 5 * F.col("_size"))).drop("levels")
    again = again.join(source.withColumnRenamed("levels", "_all"), by)
    again = again.select(*by, "chunk_id", "lag", "speed", "score", "context", "_before", "_low", F.expr("slice(_all, cast(_low + 1 as int), cast(round(size(context) * speed) as int) + 10 * _size)").alias("_near"))

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                z, y = _stretched(np.asarray(r["context"], float), r["speed"])[None], np.asarray(r["_near"], float)
                score, at = -1.0, 0
                if z.shape[1] <= len(y):
                    found = np.round(_correlations(y, z)[0], 9)
                    at = int(found.argmax())
                    score = round(float(found[at]), 4)
                if score >= accept:
                    out.append([*(r[c] for c in by), r["chunk_id"], r["_low"] + at + r["_before"], r["speed"], score])
                elif score == -1.0 and r["score"] > accept:  # the source holds less than the context
                    out.append([*(r[c] for c in by), r["chunk_id"], r["lag"], r["speed"], r["score"]])
            yield pd.DataFrame(out, columns=[*by, "chunk_id", "lag", "speed", "score"])

    confirmed = again.mapInPandas(confirm, f"{keyed}, chunk_id long, lag long, speed double, score double").where(F.col("score") > accept)
    return sure.join(again.select(*by, "chunk_id"), [*by, "chunk_id"], "left_anti").unionByName(confirmed)


#: Frames of the two sides that are compared in a task, and edit frames at a time.
EDIT_FRAMES, SOURCE_FRAMES, AT_A_TIME = 2048, 8192, 16


def _nearest(edit: np.ndarray, ids: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of edit, id, mean absolute difference) of the source rows that can be the nearest when rounded to 4 digits: ids ascending, each nearer than those before it.

    Differences are added in order of the values, as a plain loop does.
    """
    size, found = edit.shape[1], []
    across = np.ascontiguousarray(source.T)
    total, part = np.empty((AT_A_TIME, len(source))), np.empty((AT_A_TIME, len(source)))
    for low in range(0, len(edit), AT_A_TIME):
        e = edit[low : low + AT_A_TIME]
        t, p = total[: len(e)], part[: len(e)]
        t[:] = 0.0
        for k in range(size):
            np.subtract(e[:, k, None], across[k], out=p)
            np.abs(p, out=p)
            t += p
        t /= size
        row, at = np.nonzero(t <= t.min(axis=1, keepdims=True) + 1.001e-4)
        value = t[row, at]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        keep = np.concatenate([np.append(True, v[1:] < np.minimum.accumulate(v)[:-1]) for v in np.split(value, first[1:])])
        found.append((row[keep] + low, ids[at[keep]], value[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def fingerprint_match(edit: DataFrame, source: DataFrame, by: Keys, limit: float = 40.0) -> DataFrame:
    """For each edit frame the source frame of its key with the least mean absolute difference, under `limit`; the first on ties.

    Frames of one length are compared, all with all: both sides are dealt into blocks, and numpy meets two blocks in
    a task, so the work is the pairs and a task's memory the blocks. Frames that are or hold null are left out.
    """
    numbers = F.col("f").cast("array<double>")
    kept = lambda df, name: df.where("f is not null and size(f) > 0 and not exists(f, x -> x is null)").select(*by, F.col("frame_id").alias(name), numbers.alias(f"_{name}"), F.size("f").alias("_size"))
    e, s = kept(edit, "frame_id"), kept(source, "source_id")
    group = [*by, "_size"]
    count = lambda df, most, name: df.groupBy(*group).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    blocks = count(e, EDIT_FRAMES, "_edits").join(count(s, SOURCE_FRAMES, "_sources").hint("merge"), group)
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    e = e.join(blocks.hint("merge"), group).select(*group, "frame_id", "_frame_id", deal("frame_id", "_edits").alias("_e"), every("_sources").alias("_s"))
    s = s.join(blocks.hint("merge"), group).select(*[F.col(c).alias(f"_of_{c}") for c in group], "source_id", "_source_id", every("_edits").alias("_of_e"), deal("source_id", "_sources").alias("_of_s"))
    kinds = dict(e.dtypes) | dict(s.dtypes)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*by, "frame_id", "source_id", "_raw"]
        if not left.num_rows or not right.num_rows:
            return left.select([*by, "frame_id"]).slice(0, 0).append_column("source_id", pa.array([], right.schema.field("source_id").type)).append_column("_raw", pa.array([], pa.float64()))
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        right = right.sort_by("source_id")
        row, at, raw = _nearest(matrix(left, "_frame_id"), np.arange(right.num_rows), matrix(right, "_source_id"))
        out = left.select([*by, "frame_id"]).take(pa.array(row))
        return pa.table([*out.columns, right.column("source_id").take(pa.array(at)), pa.array(raw)], names=names)

    keyed = ", ".join(f"{c} {kinds[c]}" for c in [*by, "frame_id", "source_id"])
    near = e.groupBy(*group, "_e", "_s").cogroup(s.groupBy(*[f"_of_{c}" for c in group], "_of_e", "_of_s")).applyInArrow(meet, f"{keyed}, _raw double")
    best = near.groupBy(*by, "frame_id").agg(F.min(F.struct(r4("_raw").alias("difference"), "source_id")).alias("m"))
    return best.select(*by, "frame_id", F.col("m.source_id").alias("source_id"), F.col("m.difference").alias("difference")).where(F.col("difference") < limit)

"""Alignment of an edit with its source: accuracy, the chain of audio and visual blocks, freeze frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import share
from ..schemas import SECOND
from ..sources.shared import settled
from .intervals import Keys, asof_block, carry_last, gaps, overlap_join
from .sequence import continuity_filter


def _floor_div(a: Column, b: Column) -> Column:
    """Whole numbers, b > 0."""
    return F.call_function("div", a - F.pmod(a, b), b)


def _ceil_div(a: Column, b: Column) -> Column:
    return -_floor_div(-a, b)


def alignment_accuracy(truth: DataFrame, pred: DataFrame, by: Keys, step: int = SECOND // 100, limit: int = SECOND // 2) -> DataFrame:
    """Per key, at every `step` of the edit clock inside a true block: predicted source times under `limit` from the true one, others, and the sum of errors.

    Blocks: edit_start_us, edit_end_us (open), source_start_us, speed (whole numbers), not overlapping on a side. No
    time is sampled: inside the common part of two blocks the error is a line, so the samples on either side of the
    limits and their sum are counted by whole-number arithmetic, a row for each pair of blocks.
    """
    every = F.lit(step).cast("long")
    first, last = (lambda c: _ceil_div(F.col(c), every)), (lambda c: _ceil_div(F.col(c), every) - 1)
    cols = ["edit_start_us", "edit_end_us", "source_start_us", "speed"]
    t = truth.select(*by, F.col("edit_start_us").alias("start_us"), F.col("edit_end_us").alias("end_us"), *cols[2:])
    p = pred.select(*by, F.col("edit_start_us").alias("start_us"), F.col("edit_end_us").alias("end_us"), *cols[2:])
    samples = t.withColumn("n", last("end_us") - first("start_us") + 1).where("n > 0").groupBy(*by).agg(F.sum("n").alias("samples"))
    x = overlap_join(t, p, by).withColumn("k0", F.greatest(first("start_us"), first("r_start_us"))).withColumn("k1", F.least(last("end_us"), last("r_end_us"))).where("k1 >= k0")
    # the error at k * step is a + b * k; turned so that b >= 0
    x = x.withColumn("a", F.expr("source_start_us - start_us * speed - r_source_start_us + r_start_us * r_speed")).withColumn("b", (F.col("speed") - F.col("r_speed")).cast("long") * every)
    x = x.withColumn("a", F.when(F.col("b") < 0, -F.col("a")).otherwise(F.col("a"))).withColumn("b", F.abs("b"))
    n, a, b, k0, k1 = F.col("k1") - F.col("k0") + 1, F.col("a"), F.col("b"), F.col("k0"), F.col("k1")
    slope = F.greatest(b, F.lit(1))
    low, high = F.greatest(k0, _floor_div(-limit - a, slope) + 1), F.least(k1, _ceil_div(limit - a, slope) - 1)
    hits = F.when(b == 0, F.when(F.abs(a) < limit, n).otherwise(0)).otherwise(F.greatest(F.lit(0), high - low + 1))
    total = lambda u, v: F.when(v >= u, (v - u + 1) * a + b * F.call_function("div", (u + v) * (v - u + 1), F.lit(2))).otherwise(0)
    turn = F.greatest(k0, F.least(k1 + 1, _ceil_div(-a, slope)))
    error = F.when(b == 0, n * F.abs(a)).otherwise(total(turn, k1) - total(k0, turn - 1))
    g = x.select(*by, n.alias("n"), hits.cast("long").alias("hits"), error.cast("long").alias("error_us")).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("error_us").alias("error_us"))
    g = samples.join(g, by, "left").fillna(0, ["n", "hits"])
    return g.select(*by, "samples", "hits", (F.col("n") - F.col("hits")).alias("wrong"), "error_us", share("hits", "samples").alias("recall"))


def gap_samples(unmatched: DataFrame, by: Keys, least: int = 5 * SECOND, every: int = 30 * SECOND) -> DataFrame:
    """by, start_us, end_us, t_us: where a gap (start_us, end_us) is looked into: from 5 s on every 30 s, its middle if there is no such time; gaps under `least` are not."""
    g = unmatched.where(F.col("end_us") - F.col("start_us") >= least)
    inside = F.when(F.col("start_us") + least < F.col("end_us"), F.sequence(F.col("start_us") + least, F.col("end_us") - 1, F.lit(every).cast("long"))).otherwise(F.array(F.expr("start_us + (end_us - start_us) div 2")))
    return g.select(*by, "start_us", "end_us", F.explode(inside).alias("t_us"))


def alignment_build(audio: DataFrame, frames: DataFrame, by: Keys, horizon: DataFrame, most: float = 40.0) -> DataFrame:
    """position, block_id, edit and source interval, confidence, method of each key's blocks, in order of the edit clock.

    audio: block_id, edit_start_us, edit_end_us, source_start_us, source_end_us, confidence; runs of two or more that
    go on stay. frames: t_us (edit), source_us, difference, the best source frame of edit frames. What no audio block
    covers up to horizon_us (with a second of slack) is a gap; in gaps of five seconds and more the last frame by
    each sampled time stands for a block around it if its difference is under `most`.
    """
    kept = continuity_filter(audio, by)
    mapped = kept.select(*by, F.col("edit_start_us").alias("start_us"), F.col("edit_end_us").alias("end_us"))
    times = gap_samples(gaps(mapped, by, horizon, min_gap=0, eps=SECOND), by).withColumn("_ask", F.lit(1))
    marks = times.unionByName(frames.select(*by, "t_us", F.struct("t_us", "source_us", "difference").alias("_frame"), F.lit(0).alias("_ask")), allowMissingColumns=True)
    seen = carry_last(marks, by, "t_us", ["_ask", "_frame"], frame=F.col("_frame")).where("_ask = 1 and frame.t_us >= start_us").where(F.col("frame.difference") < most)
    at = lambda c, shift: (F.col(c) + shift).alias
    half, wide = 5 * SECOND // 2, 30 * SECOND
    visual = seen.select(*by, at("t_us", -half)("edit_start_us"), at("t_us", half)("edit_end_us"), at("frame.source_us", -wide)("source_start_us"), at("frame.source_us", wide)("source_end_us"), F.lit(0.7).alias("confidence"), F.lit("visual").alias("method"))
    cols = [*by, "edit_start_us", "edit_end_us", "source_start_us", "source_end_us", "confidence", "method"]
    every = kept.withColumn("method", F.lit("audio")).select(*cols, "block_id").unionByName(visual, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("edit_start_us", "method", "block_id", "edit_end_us")
    return every.withColumn("position", F.row_number().over(order))


def freeze_frames(series: DataFrame, blocks: DataFrame, by: Keys, least: int = SECOND // 2, at_end: int = SECOND // 10) -> DataFrame:
    """by, edit_start_us, edit_end_us, source_us: where samples (t_us, value) stay the same, up to the first that differs.

    A run lasts `least`, one at the end of the series `at_end`. source_us: of the run's start, inside a block by its
    speed; else the end of the last block before it, or of the last block of all for a run at the end; 0 without any.
    """
    s = carry_last(series, by, "t_us", [], before=(F.col("value"), "before"), before_us=(F.col("t_us"), "before"))
    s = s.withColumn("_same", F.coalesce(F.col("value") == F.col("before"), F.lit(False)))
    # a run begins with the sample before its first equal one, and ends at the first that differs
    s = carry_last(s, by, "t_us", [], was=(F.col("_same"), "before"))
    begins = F.when(F.col("_same") & ~F.coalesce("was", F.lit(False)), F.col("before_us")).when(~F.col("_same") & ~F.coalesce("was", F.lit(False)), F.lit(-1).cast("long"))
    s = settled(carry_last(s.withColumn("_begins", begins), by, "t_us", [], run_us=F.col("_begins")), "samples")
    over = s.where("not _same and was").select(*by, F.col("run_us").alias("edit_start_us"), F.col("t_us").alias("edit_end_us"), F.lit(False).alias("last")).where(F.col("edit_end_us") - F.col("edit_start_us") >= least)
    last = s.groupBy(*by).agg(F.max_by(F.struct("t_us", "run_us", "_same"), "t_us").alias("x")).where("x._same")
    last = last.select(*by, F.col("x.run_us").alias("edit_start_us"), F.col("x.t_us").alias("edit_end_us"), F.lit(True).alias("last")).where(F.col("edit_end_us") - F.col("edit_start_us") >= at_end)
    runs = asof_block(over.unionByName(last).withColumn("t_us", F.col("edit_start_us")), blocks, by)
    inside = overlap_join(runs.select(*by, "t_us", F.col("t_us").alias("start_us"), F.col("t_us").alias("end_us")), blocks.select(*by, F.col("edit_start_us").alias("start_us"), F.col("edit_end_us").alias("end_us")), by, kind="touch").select(*by, "t_us").distinct().withColumn("_in", F.lit(True))
    end = blocks.groupBy(*by).agg(F.max_by("source_end_us", "edit_start_us").alias("_end"))
    out = runs.join(inside, [*by, "t_us"], "left").join(end, by, "left")
    source = F.when(F.col("last") & F.col("_in").isNull(), F.col("_end")).otherwise(F.col("source_us"))
    return out.select(*by, "edit_start_us", "edit_end_us", F.coalesce(source, F.lit(0)).cast("long").alias("source_us"))

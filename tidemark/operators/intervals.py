"""Interval algebra on timelines: islands, gaps, overlap joins, as-of and nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SECOND

Keys = list[str]
#: Touching distance of merged intervals, and the length of a time chunk of the first level.
TOUCH, CHUNK = 100, 3_600 * SECOND


def islands(df: DataFrame, by: Keys, gap: int = TOUCH, chunk: int = CHUNK) -> DataFrame:
    """Maximal unions of intervals at most `gap` apart: by, start_us, end_us, n.

    Two levels: intervals of one time chunk are merged first, so that a long recording is not one task's work;
    then the few merged intervals of all chunks.
    """
    small = _merge(df.withColumn("_chunk", F.floor(F.col("start_us") / chunk)).withColumn("_n", F.lit(1)), [*by, "_chunk"], gap)
    return _merge(small.withColumn("_n", F.col("n")), by, gap)


def _merge(df: DataFrame, by: Keys, gap: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(reach.isNull() | (F.col("start_us") > reach + gap), 1).otherwise(0))
    numbered = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("_n").alias("n")).drop("_island")


def merge_intervals(df: DataFrame, by: Keys, eps: int = TOUCH) -> DataFrame:
    return islands(df, by, eps).select(*by, "start_us", "end_us")


def total_duration(df: DataFrame, by: Keys) -> DataFrame:
    return merge_intervals(df, by).groupBy(*by).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("duration_us"))


def carry_last(df: DataFrame, by: Keys, at: str, ties: Keys, back: bool = False, chunk: int = CHUNK, **values: Column | tuple[Column, str]) -> DataFrame:
    """df with a column for each of `values`: the last value that is not null up to each row, in order of `at` and `ties`; of a pair (value, "before") up to the row before it.

    Two levels: windows inside chunks of `at`, and the last values of each chunk, carried over by a table with a row
    for each chunk; so a key with all rows is the work of many tasks. back: the order of `at` runs backwards (ties do
    not). df is read twice; its windows have sorted it for the merge join.
    """
    pairs = {k: v if isinstance(v, tuple) else (v, "") for k, v in values.items()}
    c = df.withColumn("_chunk", F.floor(F.col(at) / chunk)).select("*", *[v.alias(f"_value_{k}") for k, (v, _) in pairs.items()])
    turn = (lambda x: F.desc(x)) if back else F.asc
    w = Window.partitionBy(*by, "_chunk").orderBy(turn(at), *ties)
    place = F.struct((-F.col(at) if back else F.col(at)).alias("at"), *ties)
    # max_by passes over rows whose order is null
    chunks = c.groupBy(*by, "_chunk").agg(*[F.max_by(f"_value_{k}", F.when(F.col(f"_value_{k}").isNotNull(), place)).alias(f"_value_{k}") for k in pairs])
    earlier = Window.partitionBy(*by).orderBy(turn("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*by, "_chunk", *[F.last(f"_value_{k}", ignorenulls=True).over(earlier).alias(f"_carried_{k}") for k in pairs])
    inside = {k: F.last(f"_value_{k}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1 if when else 0)) for k, (_, when) in pairs.items()}
    c = c.select("*", *[v.alias(f"_inside_{k}") for k, v in inside.items()]).join(chunks.hint("merge"), [*by, "_chunk"], "left")
    return c.select(*df.columns, *[F.coalesce(f"_inside_{k}", f"_carried_{k}").alias(k) for k in pairs])


def member_islands(df: DataFrame, by: Keys, gap: int) -> DataFrame:
    """Every row with the start of its island as `island`: islands do not overlap, so a row's is the last that starts by then."""
    marks = islands(df, by, gap).select(*by, "start_us", F.lit(0).alias("_row"))
    every = df.withColumn("_row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    return carry_last(every, by, "start_us", ["_row"], island=F.when(F.col("_row") == 0, F.col("start_us"))).where("_row = 1").drop("_row")


def gaps(df: DataFrame, by: Keys, horizon: DataFrame, min_gap: int = 100_000, eps: int = TOUCH) -> DataFrame:
    """The complement within [0, horizon_us] of each key of `horizon`, gaps longer than min_gap."""
    # one pass over the merged intervals: a union of three would take them thrice, in a third of the tasks each
    merged = horizon.select(*by, "horizon_us").join(merge_intervals(df, by, eps).hint("merge"), by, "left")
    w = Window.partitionBy(*by).orderBy("start_us")
    pair = lambda g0, g1: F.struct(g0.cast("long").alias("start_us"), g1.alias("end_us"))
    before = pair(F.coalesce(F.lag("end_us").over(w), F.lit(0)), F.least("start_us", "horizon_us"))
    after = F.when(F.lead("start_us").over(w).isNull(), pair(F.col("end_us"), F.col("horizon_us")))
    sides = merged.select(*by, before.alias("_before"), after.alias("_after"))
    return sides.select(*by, F.explode(F.array("_before", "_after")).alias("_g")).select(*by, "_g.*").where(F.col("end_us") - F.col("start_us") > min_gap)


def overlap_join(left: DataFrame, right: DataFrame, by: Keys, pad: int = 0, kind: str = "overlap", bucket: int = 60 * SECOND) -> DataFrame:
    """Pairs of left and right intervals of one key; right columns get the prefix r_.

    kind: "overlap" (open ends), "touch" (closed ends) or "contained" (right inside left). Each interval goes to
    the time buckets that it covers, so that the join is an equi-join on (by, bucket); a pair is kept only in its
    first common bucket.
    """
    lo, hi = F.col("start_us") - pad, F.col("end_us") + pad
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    a = left.withColumn("_b", spread(lo, hi))
    b = right.select(*[F.col(c).alias(c if c in by else f"r_{c}") for c in right.columns]).withColumn("_b", spread(F.col("r_start_us"), F.col("r_end_us")))
    less = (lambda x, y: x <= y) if kind != "overlap" else (lambda x, y: x < y)
    joined = a.join(b, [*by, "_b"]).where(less(lo, F.col("r_end_us")) & less(F.col("r_start_us"), hi))
    if kind == "contained":
        joined = joined.where((F.col("r_start_us") >= lo) & (F.col("r_end_us") <= hi))
    return joined.where(F.col("_b") == F.floor(F.greatest(lo, F.col("r_start_us")) / bucket)).drop("_b")


def overlap_us() -> Column:
    return F.least("end_us", "r_end_us") - F.greatest("start_us", "r_start_us")


def intersection_duration(a: DataFrame, b: DataFrame, by: Keys, tol: int = 0) -> DataFrame:
    """by, a_us, inter_us: merged a, and its overlap with merged b widened by tol (from 0 on), at most a_us."""
    a = merge_intervals(a, by)
    wide = b.withColumn("start_us", F.greatest(F.lit(0), F.col("start_us") - tol)).withColumn("end_us", F.col("end_us") + tol)
    b = merge_intervals(wide, by)
    inter = overlap_join(a, b, by).groupBy(*by).agg(F.sum(overlap_us()).alias("inter_us"))
    total = a.groupBy(*by).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("a_us"))
    return total.join(inter, by, "left").select(*by, "a_us", F.least(F.coalesce("inter_us", F.lit(0)), F.col("a_us")).alias("inter_us"))


def locate_point(points: DataFrame, intervals: DataFrame, by: Keys, point: str, key: Keys, order: Keys) -> DataFrame:
    """For each point the first interval, by start, that holds it (ends included); points without one are left out."""
    p = points.withColumn("start_us", F.col(point)).withColumn("end_us", F.col(point))
    joined = overlap_join(p, intervals, by, kind="touch")
    first = joined.groupBy(*by, *key).agg(F.min(F.struct("r_start_us", *[f"r_{c}" for c in order], "r_end_us")).alias("_f"))
    return first.select(*by, *key, F.col("_f.r_start_us").alias("in_start_us"), F.col("_f.r_end_us").alias("in_end_us"), *[F.col(f"_f.r_{c}").alias(f"in_{c}") for c in order])


def best_overlap(human: DataFrame, ai: DataFrame, by: Keys, least: int = 100_000) -> DataFrame:
    """For each human interval the AI interval that overlaps it longest, by more than `least`; the first by start on ties."""
    joined = overlap_join(human, ai, by).withColumn("overlap_us", overlap_us()).where(F.col("overlap_us") > least)
    w = Window.partitionBy(*by, "event_id").orderBy(F.desc("overlap_us"), "r_start_us", "r_event_id")
    return joined.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def nearest_within(a: DataFrame, b: DataFrame, by: Keys, limit: int = 2 * SECOND) -> DataFrame:
    """For each a-row the b-row whose onset is nearest, at most `limit` away; the first by start on ties."""
    onset = lambda df: df.withColumn("end_us", F.col("start_us"))
    joined = overlap_join(onset(a), onset(b), by, pad=limit, kind="touch").withColumn("distance_us", F.abs(F.col("start_us") - F.col("r_start_us")))
    w = Window.partitionBy(*by, "event_id").orderBy("distance_us", "r_start_us", "r_event_id")
    return joined.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def covered_us(nodes: DataFrame, intervals: DataFrame, by: Keys, key: Keys) -> DataFrame:
    """key, covered_us: length of each node that merged intervals cover."""
    joined = overlap_join(nodes, merge_intervals(intervals, by), by)
    inter = joined.groupBy(*by, *key).agg(F.sum(overlap_us()).alias("covered_us"))
    return nodes.join(inter, [*by, *key], "left").withColumn("covered_us", F.coalesce("covered_us", F.lit(0)).cast("long"))


def asof_block(times: DataFrame, blocks: DataFrame, by: Keys) -> DataFrame:
    """Source time of edit times t_us: inside a block by its speed; else the source end of the last block that ended before."""
    b = blocks.select(*by, F.col("edit_start_us").alias("t_us"), F.struct("edit_start_us", "edit_end_us", "source_start_us", "source_end_us", "speed").alias("_block"))
    marks = b.withColumn("_t", F.lit(0)).unionByName(times.withColumn("_t", F.lit(1)), allowMissingColumns=True)
    seen = carry_last(marks, by, "t_us", ["_t", "_block"], _at=F.col("_block")).where("_t = 1")
    inside = F.expr("_at.source_start_us + (t_us - _at.edit_start_us) * _at.speed")
    return seen.withColumn("source_us", F.when(F.expr("t_us <= _at.edit_end_us"), inside).otherwise(F.col("_at.source_end_us"))).drop("_at", "_block", "_t")


def cut_between(events: DataFrame, scenes: DataFrame, by: Keys) -> DataFrame:
    """Events with `cut`: whether a scene starts after the previous event's end and by this event's start."""
    scene = scenes.select(*by, F.col("start_us").alias("_scene"), F.col("start_us").alias("start_us"))
    every = events.withColumn("_e", F.lit(1)).unionByName(scene.withColumn("_e", F.lit(0)), allowMissingColumns=True)
    last = carry_last(every, by, "start_us", ["_e", "event_id"], _last=F.col("_scene"), prev_end_us=(F.col("end_us"), "before"))
    last = last.where("_e = 1").drop("_e", "_scene")
    return last.withColumn("cut", F.coalesce(F.col("_last") > F.col("prev_end_us"), F.lit(False))).drop("_last")


def bridge_gaps(clips: DataFrame, by: Keys, limit: int = 8 * SECOND) -> DataFrame:
    """Chains of clips, by start, while 0 <= start - previous end <= limit; the end is the last clip's."""
    chained = chain_starts(clips, by, limit)
    return chained.groupBy(*by, "_chain").agg(F.min("start_us").alias("start_us"), F.max_by("end_us", F.struct("start_us", "clip_id")).alias("end_us"), F.min("level").alias("level"), F.max("locked").alias("locked"), F.count("*").alias("n")).drop("_chain")


def chain_starts(clips: DataFrame, by: Keys, limit: int) -> DataFrame:
    """clips with `_chain`, the (start, id) of the clip that its chain begins with: one goes on while 0 <= start - previous end <= limit."""
    c = carry_last(clips, by, "start_us", ["clip_id"], _before=(F.col("end_us"), "before"))
    gap = F.col("start_us") - F.col("_before")
    begins = F.when(gap.between(0, limit), None).otherwise(F.struct("start_us", "clip_id"))
    return carry_last(c, by, "start_us", ["clip_id"], _chain=begins).drop("_before")

"""Sequence operators: clusters, windows, context, folds, chapters and features, per key and in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import r4
from ..functions.text import exclamation_density, tokens
from ..schemas import SECOND
from ..sources.shared import settled
from .fold import fold_heads
from .intervals import Keys, carry_last, islands, member_islands, overlap_join


def cluster_by_gap(events: DataFrame, by: Keys, gap: int = 3 * SECOND) -> DataFrame:
    return islands(events, by, gap)


def cluster_by_relation(related: DataFrame, events: DataFrame, by: Keys, least: float = 0.6) -> DataFrame:
    """events with `cluster`: a new one wherever the relation to the event before is weak."""
    link = related.where((F.col("relation") != "unrelated") & (F.col("relation_confidence") >= least)).select(*by, "event_id", "relation", "relation_confidence")
    e = events.join(link, [*by, "event_id"], "left")
    w = Window.partitionBy(*by).orderBy("start_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("cluster", F.sum(F.when(F.col("relation").isNull(), 1).otherwise(0)).over(w))


def build_windows(clustered: DataFrame, by: Keys, least: int = 8 * SECOND, most: int = 120 * SECOND) -> DataFrame:
    """A window for each cluster, with arrays of its signals (event types), evidence (event ids) and relations: short ones padded half on each side, long ones cut at the end."""
    sets = lambda c: F.array_sort(F.collect_set(c))
    g = clustered.groupBy(*by, "cluster").agg(F.min("start_us").alias("s"), F.max("end_us").alias("e"), F.count("*").alias("n"), sets("event_type").alias("signals"), sets("event_id").alias("evidence"), sets("relation").alias("relations"), F.coalesce(F.round(F.avg("relation_confidence") * 1000) / 1000, F.lit(1.0)).alias("confidence"))
    short, long_ = F.expr(f"e - s < {least}"), F.expr(f"e - s > {most}")
    g = g.withColumn("start_us", F.when(short, F.expr(f"greatest(0, s - ({least} - (e - s)) div 2)")).otherwise(F.col("s")))
    g = g.withColumn("end_us", F.when(short, F.col("start_us") + least).when(long_, F.col("s") + most).otherwise(F.col("e")))
    return g.drop("s", "e")


def _asof_scene(windows: DataFrame, scenes: DataFrame, by: Keys, at: str, out: str, back: bool) -> DataFrame:
    """The last scene start by `at`, or with back=False the first from `at` on."""
    marks = windows.withColumn("_t", F.col(at)).withColumn("_w", F.lit(1)).unionByName(scenes.select(*by, F.col("start_us").alias("_t"), F.col("start_us").alias("_s"), F.lit(0).alias("_w")), allowMissingColumns=True)
    return carry_last(marks, by, "_t", ["_w"], back=not back, **{out: F.col("_s")}).where("_w = 1").drop("_t", "_w", "_s")


def expand_context(windows: DataFrame, segments: DataFrame, scenes: DataFrame, by: Keys, key: Keys, reach: int = 3 * SECOND, roll: int = 5 * SECOND, legacy: bool = False, setup: int = 3 * SECOND // 2) -> DataFrame:
    """core_start_us, core_end_us: snapped to utterances, extended, clamped, stopped at scenes; start_us, end_us with pre- and postroll.

    legacy: no clamp and no forward side, and a shorter setup window.
    """
    pad, windows = setup if legacy else reach, settled(windows, "windows")
    j = overlap_join(windows.select(*by, *key, "start_us", "end_us"), segments.select(*by, "start_us", "end_us"), by, pad=pad, kind="touch")
    cs, ce, ss, se = F.col("start_us"), F.col("end_us"), F.col("r_start_us"), F.col("r_end_us")
    first = lambda cond, value: F.min(F.when(cond, F.struct(ss.alias("k"), value.alias("v"))))["v"]
    agg = j.groupBy(*by, *key).agg(
        first((ss <= cs) & (cs <= se), ss).alias("snap_s"), first((ss <= ce) & (ce <= se), se).alias("snap_e"), F.min(F.when((ss <= cs) & (cs - ss <= pad), ss)).alias("back"),
        F.array_sort(F.collect_list(F.when((se >= ce) & (se - ce <= pad), F.struct(ss.alias("k"), se.alias("v"))))).alias("ahead"),
    )
    x = windows.join(agg, [*by, *key], "left").withColumn("c0", cs).withColumn("c1", ce)
    x = x.withColumn("n0", F.coalesce("snap_s", "c0")).withColumn("n1", F.coalesce("snap_e", "c1"))
    x = x.withColumn("n0", F.when(F.col("back") < F.col("n0"), F.col("back")).otherwise(F.col("n0")))
    if not legacy:
        x = x.withColumn("n0", F.greatest("n0", F.greatest(F.lit(0), F.col("c0") - reach)))
        x = x.withColumn("n1", F.coalesce(F.expr("try_element_at(filter(ahead, a -> a.v > n1), 1).v"), F.col("n1")))
        x = x.withColumn("n1", F.least("n1", F.col("c1") + reach))
    x = _asof_scene(settled(x.drop("ahead", "snap_s", "snap_e", "back"), "expanded"), scenes, by, "c0", "s0", True)
    x = x.withColumn("n0", F.when(F.col("s0") > F.col("n0"), F.col("s0")).otherwise(F.col("n0")))
    if not legacy:
        x = _asof_scene(x, scenes, by, "c1", "s1", False)
        x = x.withColumn("n1", F.when(F.col("s1") < F.col("n1"), F.col("s1")).otherwise(F.col("n1"))).drop("s1")
    x = x.withColumn("core_start_us", F.col("n0")).withColumn("core_end_us", F.greatest("n0", "n1"))
    return x.withColumn("start_us", F.greatest(F.lit(0), F.col("core_start_us") - roll)).withColumn("end_us", F.col("core_end_us") + roll).drop("c0", "c1", "n0", "n1", "s0")


def merge_overlapping(windows: DataFrame, by: Keys, order: str = "event_id", unite: Keys = (), least: Keys = (), most: Keys = ()) -> DataFrame:
    """Windows that overlap the accumulated one by more than half of the shorter are joined; the others start anew.

    start_us, end_us, confidence (the least) and n of each; `unite`: columns of arrays that are united, sorted and
    without repeats; `least`, `most`: columns whose least and largest value stays. Rows run in order inside islands of
    touching windows.
    """

    def step(state: tuple, x: tuple) -> tuple | None:
        (s, e), (a, b) = state, x
        return (s, max(e, b)) if 2 * (min(e, b) - a) > min(e - s, b - a) else None

    w = member_islands(windows.select(*dict.fromkeys([*by, "start_us", "end_us", order, "confidence", *unite, *least, *most])), by, 0)
    g = fold_heads(w, [*by, "island"], ["start_us", "end_us", order], ["start_us", "end_us"], step).groupBy(*by, "island", "run")
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unite]
    out = g.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min("confidence").alias("confidence"), F.count("*").alias("n"), *sets, *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])
    return out.drop("island", "run")


def continuity_filter(blocks: DataFrame, by: Keys) -> DataFrame:
    """Blocks of sequences of two or more whose source and edit clocks run alike (ratio of steps 0.5 to 1.5)."""
    w = Window.partitionBy(*by).orderBy("edit_start_us", "block_id")
    de, ds = F.col("edit_start_us") - F.lag("edit_start_us").over(w), F.col("source_start_us") - F.lag("source_start_us").over(w)
    b = blocks.withColumn("_new", F.when((de > 0) & (2 * ds >= de) & (2 * ds <= 3 * de), 0).otherwise(1))
    b = b.withColumn("sequence", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return b.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "sequence"))).where("_n >= 2").drop("_n")


def contiguous_runs(blocks: DataFrame, by: Keys) -> DataFrame:
    """Runs while |edit gap| < 1.5 s and -0.5 s <= source gap < 3 s, both against the run's largest ends."""
    w = Window.partitionBy(*by).orderBy("edit_start_us", "block_id")
    reach = F.max("edit_end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = blocks.withColumn("_i", F.sum(F.when(reach.isNull() | (F.col("edit_start_us") - reach >= 1_500_000), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def step(state: tuple, x: tuple) -> tuple | None:
        (edit_end, source_end), (edit, edit_to, source, source_to) = state, x
        return (max(edit_end, edit_to), max(source_end, source_to)) if abs(edit - edit_end) < 1_500_000 and -500_000 <= source - source_end < 3_000_000 else None

    order = ["edit_start_us", "block_id"]
    runs = fold_heads(cut, [*by, "_i"], order, ["edit_start_us", "edit_end_us", "source_start_us", "source_end_us"], step, first=lambda x: (x[1], x[3]))
    out = runs.groupBy(*by, "_i", "run").agg(F.min("edit_start_us").alias("edit_start_us"), F.max("edit_end_us").alias("edit_end_us"), F.min_by("source_start_us", F.struct(*order)).alias("source_start_us"), F.max("source_end_us").alias("source_end_us"), F.count("*").alias("n"))
    return out.drop("_i", "run")


def _next_blocks(segments: DataFrame, by: Keys, limit: int) -> DataFrame:
    """by, at, next of each segment (start_us, sequence): where a block that begins there ends, the first later segment that ends more than `limit` after its start."""
    at = F.struct("start_us", "sequence")
    s = segments.select(*by, "start_us", "end_us", "sequence", at.alias("at"))
    reach = s.select(*by, "at", F.col("end_us").alias("_own"), "start_us", (F.col("start_us") + limit).alias("end_us"))
    points = s.select(*by, "start_us", F.col("start_us").alias("end_us"), F.col("at").alias("next"), F.col("end_us").alias("until"))
    near = overlap_join(reach, points, by, kind="touch").where((F.col("r_next") > F.col("at")) & (F.col("r_until") > F.col("end_us"))).groupBy(*by, "at").agg(F.min("r_next").alias("near"))
    # beyond the reach: the first segment that starts after it
    marks = reach.select(*by, "at", F.col("end_us").alias("_t"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"))
    marks = marks.unionByName(s.select(*by, F.col("start_us").alias("_t"), F.lit(1).alias("_kind"), (-F.col("sequence")).cast("long").alias("_tie"), F.col("at").alias("_seg")), allowMissingColumns=True)
    far = carry_last(marks, by, "_t", ["_kind", "_tie"], back=True, far=F.col("_seg")).where("_kind = 0").select(*by, "at", "far")
    return s.select(*by, "at").join(near, [*by, "at"], "left").join(far, [*by, "at"], "left").select(*by, "at", F.coalesce("near", "far").alias("next"))


def chunk_utterances(segments: DataFrame, by: Keys, limit: int = 45 * SECOND) -> DataFrame:
    """Greedy blocks: a new one when a segment ends more than `limit` after the block's start; texts joined by spaces.

    Every segment knows where a block that began with it would end; the blocks are what the first segment leads to.
    Each round doubles the reach of these pointers, so a recording of any length takes few rounds, and no task holds
    more of it than a block's texts.
    """
    segments = settled(segments.select(*by, "start_us", "end_us", "sequence", "text"), "segments")
    jump = settled(_next_blocks(segments, by, limit).where("next is not null"), "jump")
    heads = settled(segments.groupBy(*by).agg(F.min(F.struct("start_us", "sequence")).alias("at")), "heads")
    while jump.limit(1).count():
        heads = settled(heads.unionByName(heads.join(jump, [*by, "at"]).select(*by, F.col("next").alias("at"))), "heads")
        ahead = jump.select(*by, F.col("at").alias("next"), F.col("next").alias("after"))
        jump = settled(jump.join(ahead, [*by, "next"]).select(*by, "at", F.col("after").alias("next")), "jump")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("at")) - 1
    heads = heads.select(*by, F.col("at.start_us").alias("start_us"), F.col("at.sequence").alias("sequence"), number.alias("_block"))
    x = carry_last(segments.join(heads, [*by, "start_us", "sequence"], "left"), by, "start_us", ["sequence"], block=F.col("_block"))
    order = F.struct("start_us", "sequence")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "sequence", "text"))), lambda t: t["text"]), " ")
    return x.groupBy(*by, "block").agg(F.min("start_us").alias("start_us"), F.max_by("end_us", order).alias("end_us"), F.count("*").alias("n"), text.alias("text"))


def fold_matches(matches: DataFrame, by: Keys, max_gap: int = SECOND // 2, max_speed: float = 0.2) -> DataFrame:
    """Blocks of matches (source_us, edit_us): one goes on while the step's source gap is under max_gap and its speed near the block's."""
    w = Window.partitionBy(*by).orderBy("edit_us", "source_us")
    gap = F.col("source_us") - F.lag("source_us").over(w)
    cut = matches.withColumn("_i", F.sum(F.when((gap >= 0) & (gap < max_gap), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def step(state: tuple, x: tuple) -> tuple | None:
        (e0, s0, e1, s1), (edit, source) = state, x
        if edit <= e1 or (e1 != e0 and abs((s1 - s0) / (e1 - e0) - (source - s1) / (edit - e1)) >= max_speed):
            return None
        return e0, s0, edit, source

    runs = fold_heads(cut, [*by, "_i"], ["edit_us", "source_us"], ["edit_us", "source_us"], step, first=lambda x: (*x, *x))
    b = runs.groupBy(*by, "_i", "run").agg(F.min("edit_us").alias("edit_start_us"), F.max("edit_us").alias("edit_end_us"), F.min_by("source_us", "edit_us").alias("source_start_us"), F.max_by("source_us", "edit_us").alias("source_end_us"), F.count("*").alias("n")).where("n >= 2")
    return b.drop("_i", "run").withColumn("speed_ratio", r4(F.expr("(source_end_us - source_start_us) / (edit_end_us - edit_start_us)")))


def chapters(candidates: DataFrame, by: Keys, width: int = 600 * SECOND) -> DataFrame:
    """Bins of time after the key's first start; empty bins keep their number but give no row."""
    c = candidates.join(candidates.groupBy(*by).agg(F.min("start_us").alias("_first")), by)
    return c.groupBy(*by, F.expr(f"(start_us - _first) div {width}").alias("chapter")).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"))


def chapters_by_window(candidates: DataFrame, windows: DataFrame, by: Keys) -> DataFrame:
    """Candidates by given windows [start, end); those from the last window's end on form one more chapter, others are left out."""
    c = candidates.withColumn("end_us", F.col("start_us"))
    inside = overlap_join(c, windows, by, kind="touch").where("start_us < r_end_us").select(*by, "event_id", F.col("r_start_us").alias("chapter_start_us"))
    last = windows.groupBy(*by).agg(F.max("end_us").alias("chapter_start_us"))
    after = candidates.join(last, by).where("start_us >= chapter_start_us").select(*by, "event_id", "chapter_start_us")
    return inside.unionByName(after).groupBy(*by, "chapter_start_us").agg(F.count("*").alias("n"))


def summary_windows(segments: DataFrame, by: Keys, width: int = 600 * SECOND, group: int = 3) -> DataFrame:
    """Tumbling windows with the ordered texts of all segments that overlap them; `chapter` counts groups of windows."""
    s = segments.where("end_us > start_us").withColumn("window", F.explode(F.expr(f"sequence(start_us div {width}, (end_us - 1) div {width})")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "sequence", "text"))), lambda x: x["text"]), " ")
    return s.groupBy(*by, "window").agg(F.count("*").alias("n"), text.alias("text")).withColumn("chapter", F.expr(f"window div {group}"))


def reordered(blocks: DataFrame, by: Keys, limit: int = 5 * SECOND) -> DataFrame:
    """Blocks that follow in the edit but lie more than `limit` back in the source: count and time."""
    w = Window.partitionBy(*by).orderBy("edit_start_us", "block_id")
    back = F.lag("source_start_us").over(w) - F.col("source_start_us")
    return blocks.withColumn("_b", back).where(F.col("_b") > limit).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("source_end_us") - F.col("source_start_us")).alias("moved_us"))


def speaker_turns(segments: DataFrame, by: Keys) -> DataFrame:
    """Changes of speaker, the first speaker included, and by minute of the spanned time (0.1 s at least)."""
    w = Window.partitionBy(*by).orderBy("start_us", "sequence")
    turn = F.when(F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(True)), 1).otherwise(0)
    g = segments.withColumn("_t", turn).groupBy(*by).agg(F.sum("_t").alias("turns"), (F.max("end_us") - F.min("start_us")).alias("span_us"))
    return g.withColumn("turns_per_min", r4(F.col("turns") / (F.greatest(F.col("span_us"), F.lit(SECOND // 10)) / (60.0 * SECOND))))


#: Event types of the window features, by what they count as; a caller names its own.
FEATURE_TYPES = {"speech": ["speech"], "silence": ["silence"], "peak": ["gameplay_clutch"], "scene": ["silence"], "reaction": ["face_reaction"]}


def window_features(windows: DataFrame, events: DataFrame, by: Keys, key: Keys, types: dict[str, list[str]] = FEATURE_TYPES) -> DataFrame:
    """Of each window: speech density, silence share, peaks, scene rate and reaction count, from overlapping events of the given types."""
    j = overlap_join(windows.select(*by, *key, "start_us", "end_us"), events.select(*by, "start_us", "end_us", "event_type"), by)
    part = F.least("end_us", "r_end_us") - F.greatest("start_us", "r_start_us")
    of = lambda k: F.col("r_event_type").isin(types[k])
    total = lambda k: F.coalesce(F.sum(F.when(of(k), part)), F.lit(0))
    g = j.groupBy(*by, *key).agg(total("speech").alias("speech_us"), total("silence").alias("silence_us"), F.count_if(of("peak")).alias("peaks"), F.count_if(of("scene")).alias("scenes"), F.count_if(of("reaction")).alias("reactions"))
    x = windows.join(g, [*by, *key], "left").fillna(0, ["speech_us", "silence_us", "peaks", "scenes", "reactions"])
    length = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(SECOND // 10))
    return x.withColumn("speech_density", r4(F.col("speech_us") / length)).withColumn("silence_ratio", r4(F.col("silence_us") / length)).withColumn("scene_rate", r4(F.col("scenes") / (length / (60.0 * SECOND))))


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    t = tokens(F.col(text))
    return df.withColumn("text_length", F.length(text)).withColumn("exclamations", r4(exclamation_density(F.col(text)))).withColumn("unique_ratio", F.when(F.size(t) > 0, r4(F.size(F.array_distinct(t)) / F.size(t))).otherwise(0.0))


def pair_markers(log: DataFrame, by: Keys, start: str = r"silence_start: (\d+)", end: str = r"silence_end: (\d+)") -> DataFrame:
    """Intervals out of a log of start and end lines: an end closes the last start before it that is not closed."""
    at = lambda p: F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1).cast("long"))
    w = Window.partitionBy(*by).orderBy("line_no")
    x = log.withColumn("_s", at(start)).withColumn("_e", at(end)).where("_s is not null or _e is not null").withColumn("_ps", F.lag("_s").over(w))
    return x.where("_e is not null and _ps is not null").select(*by, F.col("_ps").alias("start_us"), F.col("_e").alias("end_us"))


def flag_runs(series: DataFrame, by: Keys, flag: Column, order: Keys) -> DataFrame:
    """series with `run`, the number of changes of flag so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.coalesce(F.lag(flag).over(w) != flag, F.lit(True)), 1).otherwise(0)
    return series.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")

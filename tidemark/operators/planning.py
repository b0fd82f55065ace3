"""Edit plans: budgets, anchors, output clocks, revisions, feedback and compiled timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import r4
from ..schemas import SECOND
from ..sources.shared import settled
from .intervals import Keys, chain_starts, gaps, overlap_join


def repack_output(clips: DataFrame, plan: Keys, keep: Column | None = None) -> DataFrame:
    """output_start_us, output_end_us: running sums of durations in position order; rejected clips are left out."""
    kept = clips if keep is None else clips.where(keep)
    w = Window.partitionBy(*plan).orderBy("position", "clip_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("duration_us").over(w), F.lit(0)).cast("long")
    return kept.withColumn("output_start_us", start).withColumn("output_end_us", F.col("output_start_us") + F.col("duration_us"))


def prune_to_budget(clips: DataFrame, plan: Keys, budget: DataFrame) -> DataFrame:
    """Drop clips from context_only up to high, least confident first, until the plan fits; locked and essential ones stay.

    A clip goes if what is left after the clips before it in that order is still over the budget.
    """
    c = clips.join(budget, plan).withColumn("_free", ~F.col("locked") & (F.col("level") > 1))
    total = F.sum("duration_us").over(Window.partitionBy(*plan))
    w = Window.partitionBy(*plan, "_free").orderBy(F.desc("level"), F.coalesce("confidence", F.lit(0)), "position", "clip_id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_total", total).withColumn("_before", F.coalesce(F.sum("duration_us").over(w), F.lit(0)))
    return c.where(~(F.col("_free") & (F.col("_total") - F.col("_before") > F.col("budget_us")))).drop("_free", "_total", "_before")


def tag_anchors(clips: DataFrame, plan: Keys) -> DataFrame:
    """greeting: the first clip by 180 s; game_start: the first other one in 120-480 s; outro: in the last 300 s of plans over 600 s."""
    w = Window.partitionBy(*plan).orderBy("start_us", "clip_id")
    end = F.max("end_us").over(Window.partitionBy(*plan))
    c = clips.withColumn("_end", end).withColumn("_first", F.row_number().over(w) == 1).withColumn("greeting", F.col("_first") & (F.col("start_us") <= 180 * SECOND))
    fits = ~F.col("greeting") & F.col("start_us").between(120 * SECOND, 480 * SECOND)
    c = c.withColumn("_fits", fits).withColumn("_k", F.sum(F.col("_fits").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    game = F.col("_fits") & (F.col("_k") == 1)
    outro = (F.col("_end") > 600 * SECOND) & (F.col("start_us") >= F.col("_end") - 300 * SECOND)
    return c.withColumn("anchor", F.when(F.col("greeting"), "greeting").when(game, "game_start").when(outro, "outro")).drop("_end", "_first", "greeting", "_fits", "_k")


def plan_diff(parent: DataFrame, child: DataFrame, plan: Keys) -> DataFrame:
    """Clips added, newly rejected, with changed bounds, newly locked; clips of the child alone skip the other checks."""
    p = parent.select(*plan, "clip_id", F.struct("start_us", "end_us", "locked", "rejected").alias("p"))
    j = child.join(p, [*plan, "clip_id"], "left")
    both = F.col("p").isNotNull()
    g = j.groupBy(*plan).agg(
        F.count_if(~both).alias("added"), F.count_if(both & F.col("rejected") & ~F.col("p.rejected")).alias("rejected"),
        F.count_if(both & ((F.col("start_us") != F.col("p.start_us")) | (F.col("end_us") != F.col("p.end_us")))).alias("modified"),
        F.count_if(both & F.col("locked") & ~F.col("p.locked")).alias("locked"), F.sum(F.col("end_us") - F.col("start_us")).alias("after_us"),
    )
    return g.join(parent.groupBy(*plan).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("before_us")), plan)


def latest_completed(runs: DataFrame, by: Keys) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("finished"), F.desc("run_id"))
    return runs.where("status = 'completed'").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def active_rows(rows: DataFrame, key: str, replaces: str) -> DataFrame:
    """Rows that no other row replaces."""
    gone = rows.where(F.col(replaces).isNotNull()).select(F.col(replaces).alias(key)).distinct()
    return rows.join(gone, key, "left_anti")


def compile_timeline(clips: DataFrame, effects: DataFrame, plan: Keys) -> DataFrame:
    """Clips on the output clock (empty ones left out), each with the parts of effects inside it, on output time."""
    c = repack_output(clips.where("start_us < end_us").withColumn("duration_us", F.col("end_us") - F.col("start_us")), plan)
    j = overlap_join(c, effects, plan)
    shift = F.col("output_start_us") - F.col("start_us")
    part = j.withColumn("part_start_us", F.greatest("start_us", "r_start_us") + shift).withColumn("part_end_us", F.least("end_us", "r_end_us") + shift)
    return part.select(*plan, "clip_id", F.col("r_effect_id").alias("effect_id"), "output_start_us", "output_end_us", "part_start_us", "part_end_us")


def revise_plan(clips: DataFrame, plan: str) -> DataFrame:
    """A copy with new ids, the next revision and a link to the parent."""
    return clips.withColumn("parent_plan_id", F.col(plan)).withColumn("revision", F.col("revision") + 1).withColumn("new_plan_id", F.sha2(F.concat_ws(":", plan, F.col("revision")), 256)).withColumn("new_clip_id", F.sha2(F.concat_ws(":", "clip_id", F.col("revision")), 256))


def fold_feedback(log: DataFrame, key: str = "clip_id") -> DataFrame:
    """The state of each clip after its change log: the last value of each kind of change."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = lambda cond, value: F.last(F.when(cond, value), ignorenulls=True).over(w)
    kind = F.col("feedback_type")
    s = log.withColumn("accepted", last(kind.isin("accept", "reject"), kind == "accept")).withColumn("start_shift", last(kind == "modify_start", F.col("value"))).withColumn("end_shift", last(kind == "modify_end", F.col("value"))).withColumn("locked", last(kind == "lock", F.lit(True)))
    return s.select(key, "accepted", "start_shift", "end_shift", F.coalesce("locked", F.lit(False)).alias("locked")).distinct()


def feedback_stats(log: DataFrame, by: Keys) -> DataFrame:
    """Per key: distinct clips, counts of kinds of feedback (feedback_type), the mean shift of starts (value, 0 without any), and a map of reasons with their counts."""
    k = F.col("feedback_type")
    shift = r4(F.sum(F.when(k == "modify_start", F.round(F.col("value") * 100).cast("long"))) / (100 * F.count_if(k == "modify_start")))
    g = log.groupBy(*by).agg(F.count_distinct("clip_id").alias("clips"), F.count_if(k == "accept").alias("accepted"), F.count_if(k == "reject").alias("rejected"), F.count_if(k.startswith("modify_")).alias("modified"), F.coalesce(shift, F.lit(0.0)).alias("mean_start_shift"))
    reasons = log.where("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("reasons"))
    return g.join(reasons, by, "left").withColumn("reasons", F.coalesce("reasons", F.create_map().cast("map<string,bigint>")))


def transition_audit(clips: DataFrame, plan: Keys) -> DataFrame:
    """Skips between consecutive clips: count, those forward, their total, largest and mean."""
    w = Window.partitionBy(*plan).orderBy("position", "clip_id")
    c = clips.withColumn("skip_us", F.lead("start_us").over(w) - F.col("end_us")).where("skip_us is not null")
    up = F.when(F.col("skip_us") > 0, F.col("skip_us"))
    return c.groupBy(*plan).agg(F.count("*").alias("n"), F.count(up).alias("forward"), F.coalesce(F.sum(up), F.lit(0)).alias("total_us"), F.coalesce(F.max(up), F.lit(0)).alias("max_us"), r4(F.coalesce(F.avg(up), F.lit(0)) / SECOND).alias("mean_s"))


def plan_breadth(clips: DataFrame, plan: Keys, width: int = 900 * SECOND) -> DataFrame:
    """Distinct bins of clip starts, their sorted list, the span in hours, anchors that are there, and the share of setups (is_setup) that are not rejected (1 without any)."""
    b = F.expr(f"start_us div {width}")
    has = lambda a: F.max(F.coalesce((F.col("anchor") == a), F.lit(False)))
    g = clips.groupBy(*plan).agg(F.count_distinct(b).alias("bins"), F.array_join(F.array_sort(F.collect_set(b)), ",").alias("bin_list"), (F.max("end_us") - F.min("start_us")).alias("span_us"), has("greeting").alias("greeting"), has("game_start").alias("game_start"), has("outro").alias("outro"), F.count_if("is_setup").alias("_s"), F.count_if(F.expr("is_setup and not rejected")).alias("_k"))
    g = g.withColumn("setup_share", F.when(F.col("_s") > 0, r4(F.col("_k") / F.col("_s"))).otherwise(1.0)).drop("_s", "_k")
    return g.withColumn("span_h", r4(F.col("span_us") / (3600.0 * SECOND))).drop("span_us")


def resolve_dependencies(clips: DataFrame, catalogue: DataFrame, deps: DataFrame, rounds: int = 3) -> DataFrame:
    """Selected clips with the prerequisites they need (new ones marked with the round), without those that cannot have one.

    deps: dependent, prerequisite. A prerequisite is essential if a dependent is, and locked if one is; the dependent
    of the smallest (round, start, id) decides.
    """
    cur = settled(clips.select("clip_id", "start_us", "end_us", "priority", "locked", F.lit(0).alias("round")), "resolved")
    for k in range(1, rounds + 1):
        need = cur.join(deps, cur.clip_id == deps.dependent).select(F.col("prerequisite").alias("clip_id"), F.struct("round", "start_us", cur.clip_id.alias("id"), "priority", "locked").alias("d"))
        new = need.join(cur.select("clip_id"), "clip_id", "left_anti").groupBy("clip_id").agg(F.min("d").alias("d")).join(catalogue.select("clip_id", "start_us", "end_us"), "clip_id")
        cur = settled(cur.unionByName(new.select("clip_id", "start_us", "end_us", F.when(F.col("d.priority") == "essential", "essential").otherwise("context_only").alias("priority"), F.col("d.locked").alias("locked"), F.lit(k).alias("round"))), "resolved")
    missing = deps.join(catalogue.select(F.col("clip_id").alias("prerequisite")), "prerequisite", "left_anti").select(F.col("dependent").alias("clip_id")).distinct()
    return cur.join(missing, "clip_id", "left_anti")


def link_continuity(clips: DataFrame, plan: Keys, limit: int = 8 * SECOND) -> DataFrame:
    """Chains of clips, by start, while 0 <= start - previous end <= limit, as one clip: the first one's, up to the last one's end, essential if any is."""
    w = Window.partitionBy(*plan).orderBy("start_us", "clip_id")
    c = chain_starts(clips, plan, limit)
    at = F.struct("start_us", "clip_id")
    first = lambda x: F.min_by(x, at)
    g = c.groupBy(*plan, "_chain").agg(F.max_by("end_us", at).alias("end_us"), first("start_us").alias("start_us"), first("clip_id").alias("clip_id"), F.when(F.min("level") == 1, 1).otherwise(first("level")).alias("level"), first("locked").alias("locked"), first("confidence").alias("confidence"), F.count("*").alias("n"))
    return g.drop("_chain").withColumn("duration_us", F.col("end_us") - F.col("start_us")).withColumn("position", F.row_number().over(w))


def build_plan(selected: DataFrame, catalogue: DataFrame, deps: DataFrame, plan: Keys, budget: DataFrame) -> DataFrame:
    """A plan's clips on the output clock, with the plan's totals.

    selected and catalogue (all candidates): plan, clip_id, start_us, end_us, importance, story_value, locked; deps:
    dependent, prerequisite. Clips are high, anchors essential; prerequisites are added, tight clips bridged, the plan
    pruned to its budget by confidence (importance and story value), and packed.
    """
    score = (F.coalesce("importance", F.lit(0.0)) + F.coalesce("story_value", F.lit(0.0))).alias("confidence")
    c = tag_anchors(selected, plan).withColumn("priority", F.when(F.col("anchor").isNotNull(), "essential").otherwise("high"))
    r = resolve_dependencies(c, catalogue, deps).join(catalogue.select(*plan, "clip_id", score), "clip_id")
    r = r.withColumn("level", F.when(F.col("priority") == "essential", 1).when(F.col("priority") == "high", 2).otherwise(5))
    r = settled(r, "resolved")
    packed = settled(repack_output(prune_to_budget(link_continuity(r, plan), plan, budget), plan), "packed")
    length = F.col("end_us") - F.col("start_us")
    original = catalogue.groupBy(*plan).agg(F.sum(length).alias("original_us"))
    totals = packed.groupBy(*plan).agg(F.sum("duration_us").alias("selected_us"), F.count("*").alias("clip_count")).join(original, plan)
    totals = totals.withColumn("compression", F.when(F.col("original_us") > 0, r4(F.col("selected_us") / F.col("original_us"))).otherwise(1.0))
    return packed.join(totals, plan).select(*plan, "clip_id", "level", "start_us", "end_us", "output_start_us", "output_end_us", "original_us", "selected_us", "clip_count", "compression")


def human_timeline(blocks: DataFrame, by: Keys, horizon: DataFrame) -> DataFrame:
    """block_id, kind, source_start_us, source_end_us, confidence of each block and each removed interval, with mean_confidence of the key.

    Blocks (source_start_us, source_end_us, speed; is_external, is_transformed, combined_confidence, confidence) are
    external (before the recording or marked), transformed (another speed or marked) or retained, clamped at 0; a
    confidence that is null or 0 gives way to the next, and to 1. Removed (no block_id, confidence 1): gaps of over
    0.1 s in what is not external, up to horizon_us. The mean is over all blocks that are not external, 1 without any.
    """
    kind = F.when((F.col("source_start_us") < 0) | F.col("is_external"), "external").when((F.col("speed") != 1) | F.col("is_transformed"), "transformed").otherwise("retained")
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    b = blocks.select(*by, "block_id", kind.alias("kind"), F.greatest(F.lit(0), F.col("source_start_us")).cast("long").alias("source_start_us"), F.greatest(F.lit(0), F.col("source_end_us")).cast("long").alias("source_end_us"), F.coalesce(some("combined_confidence"), some("confidence"), F.lit(1.0)).alias("confidence"))
    kept = b.where("kind <> 'external'").select(*by, F.col("source_start_us").alias("start_us"), F.col("source_end_us").alias("end_us"))
    known = horizon.join(kept.select(*by).distinct(), by, "left_semi")
    removed = gaps(kept, by, known).select(*by, F.lit("removed").alias("kind"), F.col("start_us").alias("source_start_us"), F.col("end_us").alias("source_end_us"), F.lit(1.0).alias("confidence"))
    mean = b.groupBy(*by).agg(F.coalesce(r4(F.avg(F.when(F.col("kind") != "external", F.col("confidence")))), F.lit(1.0)).alias("mean_confidence"))
    return b.unionByName(removed, allowMissingColumns=True).join(mean, by)


def blind_assign(pairs: DataFrame, key: str, seed: int) -> DataFrame:
    """A side for each pair, the same for the same seed."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return pairs.withColumn("swapped", F.substring(digest, 1, 1) >= "8")


def eval_split(cases: DataFrame) -> DataFrame:
    """Cases to evaluate: never REFERENCE; consumed TEST cases count as VALIDATION."""
    return cases.where("split <> 'REFERENCE'").withColumn("split", F.when((F.col("split") == "TEST") & F.col("consumed"), "VALIDATION").otherwise(F.col("split")))

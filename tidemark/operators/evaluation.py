"""Whole evaluation of cases: overlap, context, narrative, pacing, effects, support, failures and their causes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SECOND
from ..sources.shared import settled
from . import metrics as mt
from .intervals import Keys, overlap_join


@dataclass
class Layers:
    """What each step of the pipeline made of the recordings: intervals with their key, and the verdicts on AI intervals.

    verdicts: key, event_id, valid (the AI's choice is as good), reason (text, or null).
    """

    events: DataFrame
    candidates: DataFrame
    nodes: DataFrame
    visual: DataFrame
    verdicts: DataFrame


# The step at fault and the reason, of missed human intervals in this order, and of AI intervals
NO_EVENT, NO_VISUAL, NO_CANDIDATE, NO_NODE, NO_ROOM = ("M2", "MISSED_IMPORTANT_EVENT"), ("M3", "MISSING_VISUAL_EVENT"), ("M3", "LOW_SCORE"), ("M4", "DEPENDENCY_FAILURE"), ("M5", "BUDGET_EXCLUSION")
ALTERNATIVE, QUIET, AGAIN, LITTLE = ("M5", "VALID_ALTERNATIVE"), ("M5", "DEAD_AIR"), ("M5", "REPETITIVE"), ("M5", "LOW_INFORMATION")


def rule_verdicts(segments: DataFrame, by: Keys, least: int = SECOND // 2) -> DataFrame:
    """by, event_id, valid, reason by rule: not valid if shorter than `least` or with a reason that tells of silence."""
    reason = F.coalesce(F.col("reason"), F.lit(""))
    return segments.select(*by, "event_id", ((F.col("end_us") - F.col("start_us") >= least) & ~F.lower(reason).contains("silence")).alias("valid"), "reason")


def _cause(*steps: tuple) -> Column:
    """stage and reason of the first step whose condition holds; the last step has none."""
    struct = lambda x: F.struct(F.lit(x[0]).alias("stage"), F.lit(x[1]).alias("reason"))
    out = F.when(steps[0][0], struct(steps[0][1]))
    for condition, what in steps[1:-1]:
        out = out.when(condition, struct(what))
    return out.otherwise(struct(steps[-1]))


def missed_causes(missed: DataFrame, layers: Layers, by: Keys) -> DataFrame:
    """by, event_id, stage, reason: the earliest step without a row that overlaps a missed human interval.

    Where no candidate overlaps it, a visual event there that was not made one decides the reason. One join finds
    what all steps have.
    """
    steps = {"events": layers.events, "candidates": layers.candidates, "nodes": layers.nodes, "visual": layers.visual}
    every = reduce(DataFrame.unionByName, [df.select(*by, "start_us", "end_us", F.lit(name).alias("step")) for name, df in steps.items()])
    hit = overlap_join(missed.select(*by, "event_id", "start_us", "end_us"), every, by).groupBy(*by, "event_id").agg(*[F.max(F.col("r_step") == name).alias(name) for name in steps])
    out = missed.select(*by, "event_id").join(hit, [*by, "event_id"], "left").fillna(False, list(steps))
    no = lambda c: ~F.col(c)
    cause = _cause((no("events"), NO_EVENT), (no("candidates") & F.col("visual"), NO_VISUAL), (no("candidates"), NO_CANDIDATE), (no("nodes"), NO_NODE), NO_ROOM)
    return out.select(*by, "event_id", cause.alias("c")).select(*by, "event_id", "c.*")


def extra_causes(extra: DataFrame, layers: Layers, by: Keys) -> DataFrame:
    """by, event_id, stage, reason of AI intervals that no human one supports, by their verdict; one without a verdict tells little."""
    out = extra.select(*by, "event_id").join(layers.verdicts, [*by, "event_id"], "left")
    says = lambda *words: reduce(lambda a, b: a | b, [F.coalesce(F.upper("reason").contains(w), F.lit(False)) for w in words])
    cause = _cause((F.coalesce("valid", F.lit(False)), ALTERNATIVE), (says("DEAD_AIR", "SILENCE"), QUIET), (says("REPETITIVE"), AGAIN), LITTLE)
    return out.select(*by, "event_id", cause.alias("c")).select(*by, "event_id", "c.*")


def supports(ai: DataFrame, human: DataFrame, by: Keys) -> DataFrame:
    """by, event_id, start_us, end_us, side, verdict of all intervals of both sides, written once."""
    sides = [(human, ai, "human"), (ai, human, "ai")]
    return settled(reduce(DataFrame.unionByName, [a.select(*by, "event_id", "start_us", "end_us").join(mt.segment_support(a, b, by).select(*by, "event_id", "verdict"), [*by, "event_id"]).withColumn("side", F.lit(side)) for a, b, side in sides]), "supports")


def failures(ai: DataFrame, human: DataFrame, layers: Layers, by: Keys, supported: DataFrame | None = None) -> DataFrame:
    """by, event_id, side, stage, reason: missed human intervals with the step at fault, and AI intervals without support with what is wrong with them."""
    missed = (supports(ai, human, by) if supported is None else supported).where("verdict = 'missed'")
    lost = missed_causes(missed.where("side = 'human'"), layers, by).withColumn("side", F.lit("human"))
    return lost.unionByName(extra_causes(missed.where("side = 'ai'"), layers, by).withColumn("side", F.lit("ai"))).select(*by, "event_id", "side", "stage", "reason")


def evaluate_cases(ai: DataFrame, human: DataFrame, events: DataFrame, layers: Layers, ai_effects: DataFrame, human_effects: DataFrame, by: Keys, story: DataFrame | None = None) -> DataFrame:
    """A row for each case with intervals on either side; external inserts of the human side (a column `external`) are left out.

    story: nodes as narrative_metrics takes them; without it, and without a `thread` of the AI's intervals, the case
    has no nodes and threads.
    """
    human = human.where("not external") if "external" in human.columns else human
    ai = ai if "thread" in ai.columns else ai.withColumn("thread", F.lit(None).cast("string"))
    if story is None:
        story = ai.where("false").select(*by, F.col("event_id").alias("node"), "start_us", "end_us", "thread", F.lit(False).alias("is_setup"), F.col("event_id").alias("payoff"), F.lit(False).alias("is_callback"))
    m = mt.overlap_metrics(ai, human, by, [SECOND // 2, SECOND, 2 * SECOND])
    at = lambda c, tol, name: F.max(F.when(F.col("tol_us") == tol, F.col(c))).alias(f"{c}_{name}")
    overlap = m.groupBy(*by).agg(*[at(c, tol, name) for c in ("precision", "recall", "f1") for tol, name in ((SECOND // 2, "500ms"), (SECOND, "1s"), (2 * SECOND, "2s"))])
    supported = supports(ai, human, by)
    is_ = lambda side, verdict: F.count_if((F.col("side") == side) & (F.col("verdict") == verdict))
    failed = failures(ai, human, layers, by, supported).groupBy(*by, F.concat_ws(":", "stage", "reason").alias("cause")).agg(F.count("*").alias("n"))
    parts = [
        supported.groupBy(*by).agg(is_("human", "matched").alias("matched"), is_("human", "partial").alias("partial"), is_("human", "missed").alias("missed"), is_("ai", "missed").alias("ai_only")),
        mt.context_metrics(ai, human, by).select(*by, "too_short", "too_long", "good", "mean_pre_s", "mean_post_s"),
        mt.narrative_metrics(ai, human, story, by),
        mt.pacing_metrics(ai, by).select(*by, "cuts_per_min", "mean_clip_s", "mean_gap_s"),
        mt.dead_air(ai, events, by).select(*by, "quiet_us", "quiet_share"),
        mt.effect_metrics(ai_effects, human_effects, by).select(*by, F.col("matched").alias("effects_matched"), "human_only", F.col("ai_only").alias("ai_effects_only"), "agreement"),
        failed.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "cause", "n"))), ",").alias("causes"), F.coalesce(F.sum(F.when(F.col("cause") == ":".join(ALTERNATIVE), F.col("n"))), F.lit(0)).alias("valid_alternatives")),
    ]
    out = reduce(lambda a, b: a.join(b, by, "left"), parts, overlap)
    return out.fillna(0, ["matched", "partial", "missed", "ai_only", "too_short", "too_long", "good", "valid_alternatives"]).fillna("", ["causes"])

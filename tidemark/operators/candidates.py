"""Candidate segments: features, transcript text, rule scores and rank of given windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import r4
from ..schemas import SECOND
from ..sources.shared import settled
from . import rules as ru
from .intervals import Keys, overlap_join
from .sequence import FEATURE_TYPES, text_features, window_features
from .similarity import repetition_global, repetition_prefix


def window_texts(windows: DataFrame, segments: DataFrame, by: Keys) -> DataFrame:
    """by, candidate, text, turns: the texts of the segments (start_us, end_us, sequence, text, speaker) that overlap a window, in time order, and its changes of speaker.

    The first speaker counts; a segment without a speaker changes nothing.
    """
    said = overlap_join(windows.select(*by, "candidate", "start_us", "end_us"), segments.select(*by, "start_us", "end_us", "sequence", "text", "speaker"), by)
    before = Window.partitionBy(*by, "candidate").orderBy("r_start_us", "r_sequence").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.col("r_speaker").isNotNull() & ~F.col("r_speaker").eqNullSafe(F.last("r_speaker", ignorenulls=True).over(before))
    parts = F.array_sort(F.collect_list(F.struct("r_start_us", "r_sequence", "r_text")))
    return said.withColumn("_turn", turn).groupBy(*by, "candidate").agg(F.array_join(F.transform(parts, lambda x: x["r_text"]), " ").alias("text"), F.count_if("_turn").alias("turns"))


def score_candidates(windows: DataFrame, events: DataFrame, segments: DataFrame, by: Keys, profile: str = "balanced", types: dict[str, list[str]] = FEATURE_TYPES, prefix: bool = False) -> DataFrame:
    """Windows of different starts with features of events and text, text, the scores of the first keyword rule that the
    text meets, repetition (the rule's, or else of the text with those of earlier windows), reaction boosts, rank, label
    and signature (with the evidence, if windows have an array of it).

    Features: those of window_features, speaker turns a minute, length of the text, exclamations by sentence, share of
    distinct words. Label and escalation go by the rule's confidence, rank by the profile's weights. prefix:
    repetition weighs words by the windows so far, not by all of the recording; meant for short recordings.
    """
    w = settled(windows.withColumn("candidate", F.col("start_us")), "windows")
    f = window_features(w, events, by, ["candidate"], types).withColumn("reaction_n", F.col("reactions"))
    f = f.join(window_texts(w, segments, by), [*by, "candidate"], "left").withColumn("text", F.coalesce("text", F.lit(""))).fillna(0, ["turns"])
    length = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(SECOND // 10))
    f = text_features(f).withColumn("turns_per_min", r4(F.col("turns") / (length / (60.0 * SECOND))))
    f = settled(ru.keyword_score(f).withColumnRenamed("repetition", "_rule"), "scored")
    again = (repetition_prefix if prefix else repetition_global)(f.select(*by, "candidate", "text"), by, "candidate").withColumnRenamed("repetition", "text_repetition")
    f = f.join(again, [*by, "candidate"]).withColumn("repetition", F.coalesce("_rule", "text_repetition")).drop("_rule")
    f = ru.elevate_scores(f).withColumn("rank", ru.weighted_rank(profile))
    evidence = [F.array_join("evidence", ",")] if "evidence" in windows.columns else []
    return ru.triage(f, "score_confidence", "score_confidence").withColumn("signature", ru.signature(*[F.col(k) for k in by], F.col("start_us"), F.col("end_us"), *evidence))

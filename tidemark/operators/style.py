"""Style of an edit: profiles, policies, critiques, and what a policy changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import r4, share
from ..schemas import SECOND
from .intervals import Keys
from .rules import confidence_ramp

# Signal, stage, base strength, weight that evidence must pass, base confidence
REACTIONS, CUTS, EFFECTS = ("reaction_retention", "M5", 0.5, 0.3, 0.5), ("rapid_cut_affinity", "M5", 0.4, 0.4, 0.6), ("effect_density", "M8", 0.3, 0.4, 0.5)
#: Cuts a minute over which cuts are to be more, and zooms that are too many in a plan.
FAST, MOST_ZOOMS = 10, 10


def style_profile(decisions: DataFrame, effects: DataFrame, by: Keys) -> DataFrame:
    """Per key: decisions, mean edit length of those RETAINED, share of the source that they keep, counts of effects by type that are no false positives.

    decisions: decision, edit_start_us, edit_end_us, source_start_us, source_end_us; effects: effect_type,
    is_false_positive. A key without effects has an empty map.
    """
    kept = F.col("decision") == "RETAINED"
    length = F.when(kept, F.col("edit_end_us") - F.col("edit_start_us"))
    d = decisions.groupBy(*by).agg(F.count("*").alias("evidence_count"), r4(F.coalesce(F.avg(length) / SECOND, F.lit(0.0))).alias("mean_kept_s"), share(F.sum(F.when(kept, F.col("source_end_us") - F.col("source_start_us"))), F.max("source_end_us")).alias("retention"))
    e = effects.where("not is_false_positive").groupBy(*by, "effect_type").agg(F.count("*").alias("n"))
    e = e.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("effect_type", "n")))).alias("effects"))
    return d.join(e, by, "left").withColumn("effects", F.coalesce("effects", F.create_map().cast("map<string,bigint>")))


def compile_policy(profiles: DataFrame, by: Keys) -> DataFrame:
    """signal, stage, direction, strength, confidence, sample_size of each key, as far as evidence supports them.

    profiles: reaction_count, cut_count, cuts_per_min, effect_count, transformed_count. Each signal has a count of its
    own; transformed source is weaker evidence of effects and counts half.
    """
    n = {REACTIONS: F.col("reaction_count"), CUTS: F.col("cut_count"), EFFECTS: F.col("effect_count") + F.expr("transformed_count div 2")}
    way = {CUTS: F.when(F.col("cuts_per_min") > FAST, "increase").otherwise("decrease")}
    rows = []
    for signal, count in n.items():
        name, stage, strength, least, base = signal
        weight = confidence_ramp(count, F.lit(base))
        row = F.struct(F.lit(name).alias("signal"), F.lit(stage).alias("stage"), way.get(signal, F.lit("increase")).alias("direction"), r4(strength * weight).alias("strength"), r4(weight).alias("confidence"), count.cast("long").alias("sample_size"))
        rows.append(F.when(weight > least, row))
    return profiles.select(*by, F.explode(F.array_compact(F.array(*rows))).alias("s")).select(*by, "s.*")


def effect_critique(instructions: DataFrame, plan: Keys, most: int = MOST_ZOOMS) -> DataFrame:
    """Plans with more than `most` zooms (effect_type that begins with zoom): an issue row with their number."""
    zooms = instructions.where(F.col("effect_type").startswith("zoom")).groupBy(*plan).agg(F.count("*").alias("zooms"))
    return zooms.where(F.col("zooms") > most).withColumn("issue", F.lit("too_many_zooms"))


def style_impact(base: DataFrame, styled: DataFrame, plan: Keys) -> DataFrame:
    """Per plan: selected time, mean clip and cuts a minute of two runs, and the share of the base's reactions that stays. Runs: duration_us, is_reaction."""

    def totals(df: DataFrame, name: str) -> DataFrame:
        g = df.groupBy(*plan).agg(F.sum("duration_us").alias("us"), F.count("*").alias("n"), F.count_if("is_reaction").alias(f"{name}_r"))
        rate = F.when(F.col("us") > 0, r4((F.col("n") - 1) / (F.col("us") / (60.0 * SECOND)))).otherwise(0.0)
        return g.select(*plan, F.col("us").alias(f"{name}_us"), r4(F.col("us") / F.col("n") / SECOND).alias(f"{name}_mean_s"), rate.alias(f"{name}_cuts_per_min"), f"{name}_r")

    j = totals(base, "base").join(totals(styled, "styled"), plan)
    return j.withColumn("reaction_retention", share("styled_r", "base_r")).drop("base_r", "styled_r")

"""Projections, filters and scalar rules as column expressions and small broadcast tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import r4
from ..schemas import SECOND
from .intervals import Keys

# Scores of the keyword rules, weights of the ranking profiles, and event type groups
SCORES = ["humor", "reaction", "importance", "visual_interest", "chat_relevance", "novelty", "emotional_intensity", "story_value", "repetition"]
LAUGHTER, WEIGHT_WORDS = ["funny", "haha"], ["important", "crucial"]
RULE_SCORES = {
    "laughter": ([0.8, 0.7, 0.4, 0.5, 0.6, 0.5, 0.6, 0.5, 0.0], 0.9),
    "importance": ([0.1, 0.2, 0.9, 0.5, 0.3, 0.6, 0.5, 0.8, 0.0], 0.85),
    "short": ([0.1] * 9, 0.2),
    "neutral": ([0.5, 0.5, 0.5, 0.5, None, 0.5, 0.5, 0.5, 0.5], 0.5),
}
PROFILES = {
    "balanced": {"humor": 0.15, "reaction": 0.15, "importance": 0.15, "visual_interest": 0.10, "novelty": 0.10, "emotional_intensity": 0.10, "story_value": 0.15, "repetition": -0.10},
    "humor-biased": {"humor": 0.35, "reaction": 0.25, "importance": 0.10, "visual_interest": 0.05, "novelty": 0.10, "emotional_intensity": 0.10, "story_value": 0.05, "repetition": -0.10},
    "story-biased": {"humor": 0.05, "reaction": 0.10, "importance": 0.20, "visual_interest": 0.10, "novelty": 0.15, "emotional_intensity": 0.10, "story_value": 0.30, "repetition": -0.10},
}
TRIGGERS = ["game_event", "gameplay", "gameplay_clutch", "visual_event", "action"]
REACTIONS = ["face_reaction", "laughter", "shout", "pause_with_reaction", "reaction"]
CHATS = ["chat_message", "chat_read"]
#: Bounds of effect parameters: (effect type, parameter, least, most).
EFFECT_BOUNDS = [
    ("zoom_region", "scale", 1.0, 3.0), ("zoom_face", "scale", 1.2, 2.0), ("zoom_face", "duration_seconds", 0.5, 5.0), ("zoom_chat", "scale", 1.2, 1.6),
    ("grayscale", "intensity", 0.0, 1.0), ("freeze_frame", "duration_seconds", 0.5, 3.0), ("slow_motion", "speed", 0.25, 0.75), ("speed_up", "speed", 1.25, 4.0), ("audio_gain", "gain_db", -20.0, 20.0),
]
#: Effects of focus targets: (scenario, target, effect, scale).
EFFECT_RULES = [("screen_to_face", "screen_region", "zoom_region", 1.5), ("screen_to_face", "facecam", "zoom_face", 1.3), ("chat_to_face", "chat", "zoom_chat", 2.0)]
TARGETS = {"facecam": "facecam", "chat": "chat", "screen_region": "screen_region", "game_region": "screen_region"}


def normalize_timeline(sources: dict[str, tuple[DataFrame, str]], min_conf: float = 0.70, visual: bool = True) -> DataFrame:
    """One event schema out of sources name -> (rows, event type); visual rows need coalesce(confidence, 1) >= min_conf."""
    parts = []
    for name, (df, kind) in sources.items():
        if name == "visual":
            if not visual:
                continue
            df = df.where(F.coalesce("confidence", F.lit(1.0)) >= min_conf)
        parts.append(df.select("asset_id", "event_id", "start_us", "end_us", F.lit(kind).alias("event_type"), F.lit(name).alias("producer"), F.lit("1").alias("version"), "confidence"))
    return reduce(DataFrame.unionByName, parts)


def keyword_score(df: DataFrame, text: str = "text") -> DataFrame:
    """Nine scores, confidence and rule of the first rule that a text meets."""
    low = F.lower(F.col(text))
    has = lambda ws: reduce(lambda a, b: a | b, [low.contains(w) for w in ws])
    rule = F.when(has(LAUGHTER), "laughter").when(has(WEIGHT_WORDS), "importance").when(F.length(text) < 10, "short").otherwise("neutral")
    out = df.withColumn("rule", rule)
    pick = lambda values: reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(values[r]).cast("double")), RULE_SCORES, F)
    for i, name in enumerate(SCORES):
        out = out.withColumn(name, pick({r: v[0][i] for r, v in RULE_SCORES.items()}))
    return out.withColumn("score_confidence", pick({r: v[1] for r, v in RULE_SCORES.items()}))


def weighted_rank(profile: str = "balanced") -> Column:
    """sum(w * s) over sum(|w|) of the scores that are there; null if none is, 0 if the weights sum to 0."""
    w = PROFILES[profile]
    top = reduce(lambda a, b: a + b, [F.coalesce(F.col(k) * v, F.lit(0.0)) for k, v in w.items()])
    low = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), abs(v)).otherwise(0.0) for k, v in w.items()])
    some = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in w])
    return F.when(some, F.when(low > 0, r4(top / low)).otherwise(0.0))


def elevate_scores(df: DataFrame, reactions: str = "reaction_n", scene_rate: str = "scene_rate") -> DataFrame:
    n = F.coalesce(F.col(reactions), F.lit(0))
    visual = F.coalesce("visual_interest", r4(F.least(F.lit(1.0), F.col(scene_rate) / 2)))
    return df.withColumn("visual_interest", F.when(n > 0, F.least(F.lit(1.0), F.greatest(visual, 0.60 + 0.15 * n))).otherwise(visual)).withColumn("reaction", F.when(n > 0, F.greatest(F.coalesce("reaction", F.lit(0.0)), F.lit(0.75))).otherwise(F.col("reaction"))).withColumn("humor", F.when((n > 0) & F.col("humor").isNotNull() & (F.col("humor") < 0.6), 0.75).otherwise(F.col("humor")))


def triage(df: DataFrame, score: str, confidence: str) -> DataFrame:
    label = F.when(F.col(score) >= 0.70, "interesting").when(F.col(score) >= 0.40, "uncertain").otherwise("low_signal")
    return df.withColumn("escalation", F.when(F.col(confidence) < 0.55, "eligible").otherwise("none")).withColumn("label", label)


def signature(*parts: Column) -> Column:
    """sha256 of the parts, joined; the same inputs give the same signature."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256)


def upstream_signature(rows: DataFrame, by: Keys, part: Column) -> DataFrame:
    """One signature for all rows of a key, whatever their order and partitions.

    A tree of digests: rows go to leaves by the first four digits of their own sha256, leaves to nodes by the first
    two. A leaf's digest is that of its rows' sorted digests, a node's that of its leaves', the key's that of its
    nodes'. So no task sorts all rows of a key, and a changed row changes one leaf.
    """
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    x = rows.select(*by, F.sha2(part, 256).alias("_d"))
    x = x.groupBy(*by, F.left("_d", F.lit(4)).alias("_leaf")).agg(digest("_d").alias("_d"))
    x = x.groupBy(*by, F.left("_leaf", F.lit(2)).alias("_node")).agg(digest(F.concat_ws(":", "_leaf", "_d")).alias("_d"))
    return x.groupBy(*by).agg(digest(F.concat_ws(":", "_node", "_d")).alias("signature"))


def classified_relations(events: DataFrame, by: Keys) -> DataFrame:
    """Each event with relation and confidence to the event before it; needs `cut` and `prev_end_us`."""
    w = Window.partitionBy(*by).orderBy("start_us", "event_id")
    e = events.withColumn("ta", F.lag("event_type").over(w)).withColumn("prev_id", F.lag("event_id").over(w)).withColumn("same", F.coalesce(F.lag("speaker").over(w) == F.col("speaker"), F.lit(True)))
    gap = F.greatest(F.lit(0), F.col("start_us") - F.col("prev_end_us"))
    e = e.withColumn("gap_us", gap).where("prev_id is not null")
    g, ta, tb = F.col("gap_us"), F.col("ta"), F.col("event_type")
    near, talk = g <= 2 * SECOND, ta == "speech"
    rules = [
        (g > 4 * SECOND, "unrelated", 0.0), (F.col("cut"), "unrelated", 0.0),
        (ta.isin(TRIGGERS) & tb.isin(REACTIONS) & near, "event_to_reaction", 0.95), (talk & tb.isin(REACTIONS) & near, "setup_to_payoff", 0.92),
        (talk & tb.isin(TRIGGERS), "setup_to_event", 0.88), (ta.isin(CHATS) & ((tb == "speech") | tb.isin(REACTIONS)) & near, "chat_to_reaction", 0.86),
        (ta.isin(REACTIONS) & tb.isin(REACTIONS) & near, "reaction_continuation", 0.90),
        (talk & (tb == "speech") & F.col("same") & (g <= 3 * SECOND // 2), "same_beat", 0.82), (talk & (tb == "speech"), "unrelated", 0.20),
    ]
    pick = lambda k, last: reduce(lambda c, r: c.when(r[0], r[k]), rules, F).otherwise(last)
    return e.withColumn("relation", pick(1, "unknown")).withColumn("relation_confidence", pick(2, 0.40).cast("double")).drop("ta")


def decision_category(start_s: Column, edit_s: Column) -> Column:
    """Kept categories by fixed bands of the recording's time, then by edit length."""
    return (
        F.when(start_s < 330, "RETAINED_CONTEXT").when(start_s < 900, "RETAINED_GAMEPLAY").when(start_s.between(14750, 15150), "RETAINED_REACTION")
        .when(start_s > 18000, "RETAINED_TRANSITION").when(edit_s < 2, "RETAINED_HUMOR").when(edit_s < 5, "RETAINED_GAMEPLAY").otherwise("RETAINED_CONVERSATION")
    )


def confidence_ramp(n: Column, base: Column, low: int = 5, high: int = 50) -> Column:
    return F.when(n < low, 0.0).when(n >= high, base).otherwise(base * (n - low) / (high - low))


#: Rows of a rule table that is sent to every task.
MOST_SIGNALS = 10_000


def style_influence(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """Candidates (duration_us, reaction) under policy signals of stages M3 and M5; signals is a rule table of at most MOST_SIGNALS rows, and a larger one is refused."""
    few = signals.where(F.col("stage").isin("M3", "M5"))
    if few.limit(MOST_SIGNALS + 1).count() > MOST_SIGNALS:
        raise ValueError(f"more than {MOST_SIGNALS} policy signals")
    p = candidates.crossJoin(F.broadcast(few))
    fast, slow = (F.col("duration_us") < 3 * SECOND) & (F.col("direction") == "increase"), (F.col("duration_us") > 10 * SECOND) & (F.col("direction") == "decrease")
    keep = (F.col("reaction") > 0.5) & (F.col("direction") == "increase")
    cut = F.col("name") == "rapid_cut_affinity"
    strength = F.when(cut & fast, F.col("strength") * 1.5).when(cut & slow, F.col("strength") * 0.5).when((F.col("name") == "reaction_retention") & keep, F.col("strength"))
    return p.withColumn("influence", r4(strength)).where("influence is not null").withColumn("dimension", F.when(cut, "pacing").otherwise("narrative_role"))


def effect_modifier(signals: DataFrame, by: Keys) -> DataFrame:
    """Density modifier and preferred effects of each policy, from its first effect_density signal of stage M8."""
    s = signals.where((F.col("stage") == "M8") & (F.col("name") == "effect_density"))
    first = s.groupBy(*by).agg(F.min_by(F.struct("direction", "strength"), "position").alias("f"), F.max(F.when(F.col("direction") == "increase", 1).otherwise(0)).alias("up"))
    mod = F.expr("case f.direction when 'increase' then 1 + f.strength when 'decrease' then greatest(0.1d, 1 - f.strength) else 1.0d end")
    every = signals.select(*by).distinct().join(first, by, "left")
    return every.select(*by, r4(F.coalesce(mod, F.lit(1.0))).alias("density"), F.when(F.col("up") == 1, F.lit("zoom,sound_effect")).otherwise("").alias("preferred"))


def plan_effects(targets: DataFrame, scenario: str) -> DataFrame:
    """Focus targets that a scenario gives an effect, with its scale."""
    spark = targets.sparkSession
    rules = spark.createDataFrame([r for r in EFFECT_RULES if r[0] == scenario], "scenario string, target string, effect_type string, scale double")
    kind = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    return targets.withColumn("target", F.coalesce(kind[F.col("focus")], F.lit("unknown"))).join(F.broadcast(rules), "target")


def marker_links(nodes: DataFrame, by: Keys) -> DataFrame:
    """setup_X with payoff_X, joke_X with callback_X of one key; ids with false_sim are rejected."""
    n = nodes.where(~F.col("node").contains("false_sim")).withColumn("kind", F.regexp_extract("node", "^(setup|payoff|joke|callback)_(.+)$", 1)).withColumn("mark", F.regexp_extract("node", "^(setup|payoff|joke|callback)_(.+)$", 2)).where("kind <> ''")
    first = n.where("kind in ('setup', 'joke')").select(*by, "mark", F.col("kind").alias("k"), F.col("node").alias("target"))
    then = n.where("kind in ('payoff', 'callback')").select(*by, "mark", F.when(F.col("kind") == "payoff", "setup").otherwise("joke").alias("k"), F.col("node").alias("source"))
    return then.join(first, [*by, "mark", "k"]).select(*by, "source", "target", F.when(F.col("k") == "setup", "payoff_of").otherwise("callback_to").alias("relation"))


def speed_effects(blocks: DataFrame, ratio: Column) -> DataFrame:
    return blocks.withColumn("effect_type", F.when(ratio > 1.5, "speed_up").when((ratio > 0) & (ratio < 0.8), "slow_motion")).where("effect_type is not null")

"""Queries of scalar rules and constraint checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import BLOCKS, CLIPS, SEGMENTS, TE
from ..functions import text as tx
from ..functions.scalar import r4
from ..operators import intervals as iv
from ..operators import quality as dq
from ..operators import rules as ru

BY = ["asset_id"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {TE} SELECT asset_id, event_id, start_us, end_us, CASE event_type WHEN 'silence' THEN 'scene_change' WHEN 'face_reaction' THEN 'face_reaction' WHEN 'gameplay_clutch' THEN 'laughter' ELSE 'speech' END AS event_type,
 CASE event_type WHEN 'silence' THEN 'scenes' WHEN 'face_reaction' THEN 'visual' WHEN 'gameplay_clutch' THEN 'audio' ELSE 'speech' END AS producer, '1' AS version, confidence FROM te WHERE event_type <> 'chat_message' AND (event_type <> 'face_reaction' OR coalesce(confidence, 1) >= 0.7)""")
def normalize_timeline(spark, sf):
    e = fx.timeline_events(spark, sf)
    of = lambda k: fx.of_types(e, k)
    return ru.normalize_timeline({"speech": (of("speech"), "speech"), "scenes": (of("silence"), "scene_change"), "audio": (of("gameplay_clutch"), "laughter"), "visual": (of("face_reaction"), "face_reaction")})


RULE = "CASE WHEN contains(lower(text), 'funny') OR contains(lower(text), 'haha') THEN 'laughter' WHEN contains(lower(text), 'important') OR contains(lower(text), 'crucial') THEN 'importance' WHEN length(text) < 10 THEN 'short' ELSE 'neutral' END"


def _scored_sql(source: str = "documents") -> str:
    cases = lambda k: "CASE rule " + " ".join(f"WHEN '{r}' THEN {'NULL' if v[0][k] is None else v[0][k]}::DOUBLE" for r, v in ru.RULE_SCORES.items()) + " END"
    conf = "CASE rule " + " ".join(f"WHEN '{r}' THEN {v[1]}::DOUBLE" for r, v in ru.RULE_SCORES.items()) + " END"
    return f"r AS (SELECT *, {RULE} AS rule FROM {source}), s AS (SELECT *, {', '.join(f'{cases(i)} AS {n}' for i, n in enumerate(ru.SCORES))}, {conf} AS score_confidence FROM r)"


@query(f"WITH {_scored_sql()} SELECT doc_id, rule, {', '.join(ru.SCORES)}, score_confidence FROM s")
def keyword_score(spark, sf):
    return ru.keyword_score(fx.table(spark, sf, "documents")).select("doc_id", "rule", *ru.SCORES, "score_confidence")


def _rank_sql(profile: str) -> str:
    w = ru.PROFILES[profile]
    top = " + ".join(f"coalesce({k} * ({v})::DOUBLE, 0)" for k, v in w.items())
    low = " + ".join(f"(CASE WHEN {k} IS NOT NULL THEN {abs(v)}::DOUBLE ELSE 0 END)" for k, v in w.items())
    return f"round(({top}) / ({low}), 4)"


@query(f"WITH {_scored_sql()} SELECT doc_id, {_rank_sql('balanced')} AS balanced, {_rank_sql('humor-biased')} AS humor_biased, {_rank_sql('story-biased')} AS story_biased FROM s")
def weighted_rank(spark, sf):
    s = ru.keyword_score(fx.table(spark, sf, "documents"))
    return s.select("doc_id", *[ru.weighted_rank(p).alias(p.replace("-", "_")) for p in ru.PROFILES])


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 200 END AS visual_interest, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 150 END AS humor, value / 180 AS reaction, event_id % 3 AS n, value / 50 AS rate FROM events), v AS (SELECT *, coalesce(visual_interest, round(least(1, rate / 2), 4)) AS v FROM e)
 SELECT event_id, round(CASE WHEN n > 0 THEN least(1, greatest(v, 0.60 + 0.15 * n)) ELSE v END, 6) AS visual_interest, round(CASE WHEN n > 0 THEN greatest(reaction, 0.75) ELSE reaction END, 6) AS reaction, round(CASE WHEN n > 0 AND humor < 0.6 THEN 0.75 ELSE humor END, 6) AS humor FROM v""")
def elevate_scores(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.expr("case when event_id % 4 = 0 then null else value / 200 end").alias("visual_interest"), F.expr("case when event_id % 5 = 0 then null else value / 150 end").alias("humor"), (F.col("value") / 180).alias("reaction"), (F.col("event_id") % 3).alias("reaction_n"), (F.col("value") / 50).alias("scene_rate"))
    return ru.elevate_scores(e).select("event_id", *[F.round(c, 6).alias(c) for c in ("visual_interest", "reaction", "humor")])


@query(f"WITH {_scored_sql()}, k AS (SELECT doc_id, {_rank_sql('balanced')} AS score, score_confidence FROM s) SELECT doc_id, score, CASE WHEN score_confidence < 0.55 THEN 'eligible' ELSE 'none' END AS escalation, CASE WHEN score >= 0.7 THEN 'interesting' WHEN score >= 0.4 THEN 'uncertain' ELSE 'low_signal' END AS label FROM k")
def triage_labels(spark, sf):
    s = ru.keyword_score(fx.table(spark, sf, "documents")).withColumn("score", ru.weighted_rank())
    return ru.triage(s, "score", "score_confidence").select("doc_id", "score", "escalation", "label")


@query(f"WITH {TE} SELECT event_id, sha256(concat_ws('|', CAST(asset_id AS VARCHAR), CAST(start_us AS VARCHAR), CAST(end_us AS VARCHAR), event_type, 'v1')) AS signature FROM te")
def row_signature(spark, sf):
    return fx.timeline_events(spark, sf).select("event_id", ru.signature(F.col("asset_id"), F.col("start_us"), F.col("end_us"), F.col("event_type"), F.lit("v1")).alias("signature"))


_TREE = "sha256(array_to_string(list_sort(list({})), ','))"


@query(f"WITH {TE}, r AS (SELECT asset_id, sha256(event_id || ':' || start_us || ':' || end_us) AS d FROM te), lf AS (SELECT asset_id, d[1:4] AS l, {_TREE.format('d')} AS d FROM r GROUP BY 1, 2), nd AS (SELECT asset_id, l[1:2] AS n, {_TREE.format("l || ':' || d")} AS d FROM lf GROUP BY 1, 2) SELECT asset_id, {_TREE.format("n || ':' || d")} AS signature FROM nd GROUP BY 1")
def upstream_signature(spark, sf):
    return ru.upstream_signature(fx.timeline_events(spark, sf), BY, F.concat_ws(":", "event_id", "start_us", "end_us"))


@query(r"WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations) SELECT conv_id, turn, len(w)::BIGINT AS n, len(list_filter(w, lambda x: length(x) >= 2))::BIGINT AS n2, len(list_distinct(w))::BIGINT AS n_distinct FROM t")
def token_counts(spark, sf):
    t = fx.table(spark, sf, "conversations")
    return t.select("conv_id", "turn", F.size(tx.tokens(F.col("text"))).cast("long").alias("n"), F.size(tx.tokens(F.col("text"), 2)).cast("long").alias("n2"), F.size(F.array_distinct(tx.tokens(F.col("text")))).cast("long").alias("n_distinct"))


@query("WITH t AS (SELECT conv_id, turn, replace(text, ',', '!') AS text FROM conversations), p AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')) AS n FROM t) SELECT conv_id, turn, CASE WHEN n > 0 THEN round((length(text) - length(replace(text, '!', ''))) / n, 4) ELSE 0 END AS density FROM p")
def exclamation_density(spark, sf):
    t = fx.table(spark, sf, "conversations").withColumn("text", F.replace("text", F.lit(","), F.lit("!")))
    return t.select("conv_id", "turn", r4(tx.exclamation_density(F.col("text"))).alias("density"))


REL = """sc AS (SELECT asset_id, start_us AS s FROM te WHERE event_type = 'silence'),
 l0 AS (SELECT *, lag(event_id) OVER w AS prev_id, lag(event_type) OVER w AS ta, lag(end_us) OVER w AS prev_end_us, lag(speaker) OVER w AS sp FROM te WHERE event_type <> 'silence' WINDOW w AS (PARTITION BY asset_id ORDER BY start_us, event_id)),
 l1 AS (SELECT *, greatest(0, start_us - prev_end_us) AS gap_us, coalesce(sp = speaker, true) AS same, EXISTS (SELECT 1 FROM sc WHERE sc.asset_id = l0.asset_id AND s > prev_end_us AND s <= start_us) AS cut FROM l0 WHERE prev_id IS NOT NULL),
 l2 AS (SELECT *, CASE WHEN gap_us > 4000000 OR cut THEN 'unrelated:0.0' WHEN ta = 'gameplay_clutch' AND event_type = 'face_reaction' AND gap_us <= 2000000 THEN 'event_to_reaction:0.95' WHEN ta = 'speech' AND event_type = 'face_reaction' AND gap_us <= 2000000 THEN 'setup_to_payoff:0.92'
 WHEN ta = 'speech' AND event_type = 'gameplay_clutch' THEN 'setup_to_event:0.88' WHEN ta = 'chat_message' AND event_type IN ('speech', 'face_reaction') AND gap_us <= 2000000 THEN 'chat_to_reaction:0.86' WHEN ta = 'face_reaction' AND event_type = 'face_reaction' AND gap_us <= 2000000 THEN 'reaction_continuation:0.9'
 WHEN ta = 'speech' AND event_type = 'speech' AND same AND gap_us <= 1500000 THEN 'same_beat:0.82' WHEN ta = 'speech' AND event_type = 'speech' THEN 'unrelated:0.2' ELSE 'unknown:0.4' END AS rc FROM l1),
 rel AS (SELECT asset_id, event_id, prev_id, start_us, end_us, event_type, gap_us, same, cut, split_part(rc, ':', 1) AS relation, CAST(split_part(rc, ':', 2) AS DOUBLE) AS relation_confidence FROM l2)"""


def relations(spark, sf):
    e = fx.timeline_events(spark, sf)
    return ru.classified_relations(iv.cut_between(e.where("event_type <> 'silence'"), fx.of_types(e, "silence"), BY), BY)


@query(f"WITH {TE}, {REL} SELECT asset_id, event_id, prev_id, gap_us, relation, relation_confidence FROM rel")
def classify_relation(spark, sf):
    return relations(spark, sf).select("asset_id", "event_id", "prev_id", "gap_us", "relation", "relation_confidence")


CATEGORY = "CASE WHEN s < 330 THEN 'RETAINED_CONTEXT' WHEN s < 900 THEN 'RETAINED_GAMEPLAY' WHEN s BETWEEN 14750 AND 15150 THEN 'RETAINED_REACTION' WHEN s > 18000 THEN 'RETAINED_TRANSITION' WHEN e < 2 THEN 'RETAINED_HUMOR' WHEN e < 5 THEN 'RETAINED_GAMEPLAY' ELSE 'RETAINED_CONVERSATION' END"


@query(f"WITH {TE}, {BLOCKS}, c AS (SELECT *, source_start_us * 20 / 1000000 AS s, (edit_end_us - edit_start_us) / 1000000 AS e FROM blocks) SELECT block_id, {CATEGORY} AS category FROM c")
def decision_category(spark, sf):
    b = fx.blocks(spark, sf)
    return b.select("block_id", ru.decision_category(F.col("source_start_us") * 20 / 1_000_000, (F.col("edit_end_us") - F.col("edit_start_us")) / 1_000_000).alias("category"))


@query(f"WITH {TE}, g AS (SELECT asset_id, count(*) AS n, 0.8::DOUBLE AS base FROM te GROUP BY 1) SELECT asset_id, n, round(CASE WHEN n < 5 THEN 0 WHEN n >= 50 THEN base ELSE base * (n - 5) / 45 END, 4) AS confidence FROM g")
def confidence_ramp(spark, sf):
    g = fx.timeline_events(spark, sf).groupBy("asset_id").agg(F.count("*").alias("n"))
    return g.select("asset_id", "n", r4(ru.confidence_ramp(F.col("n"), F.lit(0.8))).alias("confidence"))


_SIGNALS = [("rapid_cut_affinity", "M3", "increase", 0.4), ("rapid_cut_affinity", "M5", "decrease", 0.3), ("reaction_retention", "M5", "increase", 0.5), ("effect_density", "M8", "increase", 0.2)]
_SIGNALS_SQL = "sig(name, stage, direction, strength) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in _SIGNALS) + ")"


@query(f"""WITH {TE}, {_SIGNALS_SQL}, p AS (SELECT te.*, sig.*, end_us - start_us AS d FROM te, sig WHERE stage IN ('M3', 'M5')),
 i AS (SELECT event_id, name, stage, direction, CASE WHEN name = 'rapid_cut_affinity' AND d < 3000000 AND direction = 'increase' THEN strength * 1.5 WHEN name = 'rapid_cut_affinity' AND d > 10000000 AND direction = 'decrease' THEN strength * 0.5 WHEN name = 'reaction_retention' AND confidence > 0.5 AND direction = 'increase' THEN strength END AS x FROM p)
 SELECT event_id, name, stage, direction, round(x, 4) AS influence, CASE WHEN name = 'rapid_cut_affinity' THEN 'pacing' ELSE 'narrative_role' END AS dimension FROM i WHERE x IS NOT NULL""")
def style_influence(spark, sf):
    sig = spark.createDataFrame(_SIGNALS, "name string, stage string, direction string, strength double")
    c = fx.timeline_events(spark, sf).select("event_id", (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("confidence").alias("reaction"))
    return ru.style_influence(c, sig).select("event_id", "name", "stage", "direction", "influence", "dimension")


@query("""WITH s AS (SELECT o_custkey AS policy_id, o_orderkey AS position, CASE WHEN o_orderkey % 3 = 0 THEN 'effect_density' ELSE 'pacing' END AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'M8' ELSE 'M5' END AS stage, CASE o_orderkey % 5 WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' WHEN 2 THEN 'decrease' ELSE 'keep' END AS direction, (o_orderkey % 100) / 80.0::DOUBLE AS strength FROM orders),
 e AS (SELECT policy_id, arg_min(direction, position) AS d, arg_min(strength, position) AS x, bool_or(direction = 'increase') AS up FROM s WHERE stage = 'M8' AND name = 'effect_density' GROUP BY 1), a AS (SELECT DISTINCT policy_id FROM s)
 SELECT policy_id, round(CASE d WHEN 'increase' THEN 1 + x WHEN 'decrease' THEN greatest(0.1, 1 - x) ELSE 1 END, 4) AS density, CASE WHEN up THEN 'zoom,sound_effect' ELSE '' END AS preferred FROM a LEFT JOIN e USING (policy_id)""")
def effect_modifier(spark, sf):
    s = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("policy_id"), F.col("o_orderkey").alias("position"), F.expr("case when o_orderkey % 3 = 0 then 'effect_density' else 'pacing' end").alias("name"), F.expr("case when o_orderkey % 2 = 0 then 'M8' else 'M5' end").alias("stage"), F.expr("case o_orderkey % 5 when 0 then 'increase' when 1 then 'decrease' when 2 then 'decrease' else 'keep' end").alias("direction"), F.expr("o_orderkey % 100 / 80.0d").alias("strength"))
    return ru.effect_modifier(s, ["policy_id"])


_FOCUS = "list_extract(['facecam', 'chat', 'screen_region', 'game_region', 'sky'], CAST(event_id % 5 + 1 AS INTEGER))"


@query(f"WITH {TE}, f AS (SELECT *, {_FOCUS} AS focus FROM te) SELECT event_id, CASE focus WHEN 'facecam' THEN 'zoom_face' ELSE 'zoom_region' END AS effect_type, CASE focus WHEN 'facecam' THEN 1.3 ELSE 1.5 END::DOUBLE AS scale FROM f WHERE focus IN ('facecam', 'screen_region', 'game_region')")
def plan_effects(spark, sf):
    f = fx.timeline_events(spark, sf).withColumn("focus", F.element_at(F.array(*[F.lit(x) for x in ("facecam", "chat", "screen_region", "game_region", "sky")]), F.expr("cast(event_id % 5 + 1 as int)")))
    return ru.plan_effects(f, "screen_to_face").select("event_id", "effect_type", "scale")


@query(f"""WITH {TE}, n AS (SELECT asset_id, event_id, list_extract(['setup_', 'payoff_', 'joke_', 'callback_', 'false_sim_'], CAST(event_id % 5 + 1 AS INTEGER)) || (start_us // 60000000) || '_' || event_id // 5 % 2 AS node FROM te),
 m AS (SELECT DISTINCT asset_id, node, regexp_extract(node, '^(setup|payoff|joke|callback)_(.+)$', 1) AS kind, regexp_extract(node, '^(setup|payoff|joke|callback)_(.+)$', 2) AS mark FROM n WHERE NOT contains(node, 'false_sim'))
 SELECT b.asset_id, b.node AS source, a.node AS target, CASE a.kind WHEN 'setup' THEN 'payoff_of' ELSE 'callback_to' END AS relation FROM m b JOIN m a ON a.asset_id = b.asset_id AND a.mark = b.mark AND ((a.kind = 'setup' AND b.kind = 'payoff') OR (a.kind = 'joke' AND b.kind = 'callback'))""")
def marker_links(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("setup_", "payoff_", "joke_", "callback_", "false_sim_")]), F.expr("cast(event_id % 5 + 1 as int)"))
    n = fx.timeline_events(spark, sf).select("asset_id", F.concat(kind, F.expr("cast(start_us div 60000000 as string)"), F.lit("_"), F.expr("cast(event_id div 5 % 2 as string)")).alias("node")).distinct()
    return ru.marker_links(n, BY)


@query(f"WITH {TE}, {BLOCKS} SELECT asset_id, block_id, 'speed_up' AS effect_type FROM blocks WHERE speed > 1.5")
def speed_effects(spark, sf):
    return ru.speed_effects(fx.blocks(spark, sf), F.col("speed").cast("double")).select("asset_id", "block_id", "effect_type")


_BAD = """v AS (SELECT plan_id, clip_id, CASE WHEN clip_id % 50 = 0 THEN -start_us ELSE start_us END AS start_us, CASE WHEN clip_id % 31 = 0 THEN start_us - 5 ELSE end_us + CASE WHEN clip_id % 13 = 0 THEN 90000000 ELSE 0 END END AS end_us, CASE WHEN clip_id % 23 = 0 THEN position - 2 ELSE position END AS output_position, 1500000000 AS original_us FROM clips)"""


@query(f"""WITH {CLIPS}, {_BAD}, c AS (SELECT *, lag(start_us) OVER w AS p, lag(end_us) OVER w AS e FROM v WINDOW w AS (PARTITION BY plan_id ORDER BY output_position, clip_id)),
 x AS (SELECT plan_id, clip_id, 'negative_start' AS violation FROM c WHERE start_us < 0 UNION ALL SELECT plan_id, clip_id, 'empty' FROM c WHERE end_us <= start_us UNION ALL SELECT plan_id, clip_id, 'beyond_end' FROM c WHERE end_us > original_us + 1000 UNION ALL SELECT plan_id, clip_id, 'order' FROM c WHERE start_us < p UNION ALL SELECT plan_id, clip_id, 'overlap' FROM c WHERE e - start_us > 1000)
 SELECT * FROM x""")
def clip_violations(spark, sf):
    v = fx.clips(spark, sf).selectExpr("plan_id", "clip_id", "case when clip_id % 50 = 0 then -start_us else start_us end as start_us", "case when clip_id % 31 = 0 then start_us - 5 else end_us + case when clip_id % 13 = 0 then 90000000 else 0 end end as end_us", "case when clip_id % 23 = 0 then position - 2 else position end as output_position", "1500000000L as original_us")
    return dq.clip_violations(v, ["plan_id"])


@query(f"""WITH {CLIPS}, v AS (SELECT plan_id, clip_id, start_us AS s, end_us + CASE WHEN clip_id % 13 = 0 THEN 90000000 ELSE 0 END AS e FROM clips), c AS (SELECT *, lag(e) OVER (PARTITION BY plan_id ORDER BY s, clip_id) AS p FROM v) SELECT plan_id, clip_id, s AS output_start_us, p AS previous_end_us FROM c WHERE s < p - 1000""")
def output_overlap(spark, sf):
    v = fx.clips(spark, sf).selectExpr("plan_id", "clip_id", "start_us as output_start_us", "end_us + case when clip_id % 13 = 0 then 90000000 else 0 end as output_end_us")
    return dq.output_overlap(v, ["plan_id"])


@query(f"""WITH {TE}, p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'zoom_face' WHEN 1 THEN 'speed_up' ELSE 'grayscale' END AS effect_type, confidence FROM te), x AS (SELECT event_id, effect_type, 'scale' AS parameter, confidence * 3 AS value FROM p WHERE effect_type = 'zoom_face' UNION ALL SELECT event_id, effect_type, 'duration_seconds', confidence * 6 FROM p WHERE effect_type = 'zoom_face' UNION ALL SELECT event_id, effect_type, 'speed', confidence * 6 FROM p WHERE effect_type = 'speed_up' UNION ALL SELECT event_id, effect_type, 'intensity', confidence * 3 FROM p WHERE effect_type = 'grayscale')
 SELECT * FROM x WHERE (effect_type = 'zoom_face' AND parameter = 'scale' AND (value < 1.2 OR value > 2.0)) OR (parameter = 'duration_seconds' AND (value < 0.5 OR value > 5)) OR (effect_type = 'speed_up' AND (value < 1.25 OR value > 4)) OR (effect_type = 'grayscale' AND (value < 0 OR value > 1))""")
def effect_param_violations(spark, sf):
    c = F.col("confidence")
    e = fx.timeline_events(spark, sf).withColumn("effect_type", F.expr("case event_id % 3 when 0 then 'zoom_face' when 1 then 'speed_up' else 'grayscale' end"))
    params = F.when(F.col("effect_type") == "zoom_face", F.create_map(F.lit("scale"), c * 3, F.lit("duration_seconds"), c * 6)).when(F.col("effect_type") == "speed_up", F.create_map(F.lit("speed"), c * 6)).otherwise(F.create_map(F.lit("intensity"), c * 3))
    return dq.effect_param_violations(e.withColumn("params", params), ["event_id"])


@query(f"""WITH {TE}, b AS (SELECT event_id, (event_id % 13 - 1) / 10.0::DOUBLE AS x, (event_id % 7) / 5.0::DOUBLE AS y, (event_id % 11) / 8.0::DOUBLE AS w, (event_id % 5) / 4.0::DOUBLE AS h FROM te), v AS (SELECT event_id, 'x' AS violation FROM b WHERE x < 0 OR x > 1 UNION ALL SELECT event_id, 'y' FROM b WHERE y < 0 OR y > 1 UNION ALL SELECT event_id, 'width' FROM b WHERE w <= 0 OR w > 1 UNION ALL SELECT event_id, 'height' FROM b WHERE h <= 0 OR h > 1 UNION ALL SELECT event_id, 'right' FROM b WHERE x + w > 1 UNION ALL SELECT event_id, 'bottom' FROM b WHERE y + h > 1) SELECT * FROM v""")
def box_violations(spark, sf):
    e = fx.timeline_events(spark, sf).selectExpr("event_id", "named_struct('x', (event_id % 13 - 1) / 10.0d, 'y', event_id % 7 / 5.0d, 'width', event_id % 11 / 8.0d, 'height', event_id % 5 / 4.0d) as box")
    return dq.box_violations(e, ["event_id"])

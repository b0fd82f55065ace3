"""Queries of alignment, style and experiments, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import AI, BLOCKS, CLIPS, HUMAN, TE, merged_sql
from ..functions.scalar import STATS_SQL
from ..operators import alignment as al
from ..operators import experiments as ex
from ..operators import metrics as mt
from ..operators import planning as pl
from ..operators import sequence as sq
from ..operators import style as st
from .intervals import EFFECTS, METRICS, effects
from .planning import FEEDBACK, PLAN, PRUNED, budget, feedback
from .sequence import WINDOWS, clusters

BY = ["asset_id"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Alignment


def _accuracy_sql(step: int) -> str:
    return f"""WITH {TE}, {BLOCKS}, tr AS (SELECT * FROM blocks), pr AS (SELECT * REPLACE (source_start_us + CASE WHEN block_id % 9 = 0 THEN 700000 WHEN block_id % 7 = 0 THEN -400000 ELSE 100000 END AS source_start_us, CASE WHEN block_id % 4 = 0 THEN 3 - speed ELSE speed END AS speed) FROM blocks WHERE block_id % 10 <> 0), t AS (SELECT asset_id, unnest(range((edit_start_us + {step - 1}) // {step} * {step}, edit_end_us, {step})) AS t_us, edit_start_us, source_start_us, speed FROM tr),
 x AS (SELECT t.asset_id, t.t_us, t.source_start_us + (t.t_us - t.edit_start_us) * t.speed AS truth, p.source_start_us + (t.t_us - p.edit_start_us) * p.speed AS pred FROM t LEFT JOIN pr p ON p.asset_id = t.asset_id AND p.edit_start_us <= t.t_us AND t.t_us < p.edit_end_us),
 g AS (SELECT asset_id, count(*) AS samples, count_if(abs(truth - pred) < 500000)::BIGINT AS hits, count_if(pred IS NOT NULL AND abs(truth - pred) >= 500000)::BIGINT AS wrong, sum(abs(truth - pred))::BIGINT AS error_us FROM x GROUP BY 1) SELECT *, round(hits / samples, 4) AS recall FROM g"""


def _accuracy(spark, sf, step):
    b = fx.blocks(spark, sf)
    shift = F.expr("case when block_id % 9 = 0 then 700000 when block_id % 7 = 0 then -400000 else 100000 end")
    pred = b.where("block_id % 10 <> 0").withColumn("source_start_us", F.col("source_start_us") + shift).withColumn("speed", F.expr("case when block_id % 4 = 0 then 3 - speed else speed end"))
    return al.alignment_accuracy(b, pred, BY, step)


@query(_accuracy_sql(500_000))
def alignment_accuracy(spark, sf):
    """The edit clock at every half second: where the predicted source time is within 0.5 s of the true one."""
    return _accuracy(spark, sf, 500_000)


@query(_accuracy_sql(10_000))
def alignment_accuracy_10ms(spark, sf):
    """The same at every 10 ms."""
    return _accuracy(spark, sf, 10_000)


_TEN = "edit_start_us * 10 AS edit_start_us, edit_end_us * 10 AS edit_end_us, source_start_us * 10 AS source_start_us, source_end_us * 10 AS source_end_us"


@query(f"""WITH {TE}, {BLOCKS}, au AS (SELECT asset_id, block_id, {_TEN}, block_id % 10 / 10.0::DOUBLE AS confidence FROM blocks WHERE block_id % 3 = 1), fr AS (SELECT asset_id, edit_start_us * 10 AS t_us, source_start_us * 10 AS source_us, (block_id % 60)::DOUBLE AS difference FROM blocks WHERE block_id % 3 = 0), hz AS (SELECT asset_id, max(edit_end_us) * 10 AS horizon_us FROM blocks GROUP BY 1),
 d AS (SELECT *, edit_start_us - lag(edit_start_us) OVER w AS de, source_start_us - lag(source_start_us) OVER w AS ds FROM au WINDOW w AS (PARTITION BY asset_id ORDER BY edit_start_us, block_id)), q AS (SELECT *, sum(CASE WHEN de > 0 AND 2 * ds >= de AND 2 * ds <= 3 * de THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY edit_start_us, block_id ROWS UNBOUNDED PRECEDING) AS sq FROM d), kept AS (SELECT * FROM q QUALIFY count(*) OVER (PARTITION BY asset_id, sq) >= 2),
 mp AS (SELECT asset_id, edit_start_us AS start_us, edit_end_us AS end_us FROM kept), {merged_sql('mp', 'mm', 1_000_000)},
 gp AS (SELECT mm.asset_id, coalesce(lag(end_us) OVER (PARTITION BY mm.asset_id ORDER BY start_us), 0) AS g0, least(start_us, horizon_us) AS g1 FROM mm JOIN hz USING (asset_id) UNION ALL SELECT mm.asset_id, max(end_us), max(horizon_us) FROM mm JOIN hz USING (asset_id) GROUP BY 1 UNION ALL SELECT asset_id, 0, horizon_us FROM hz WHERE asset_id NOT IN (SELECT asset_id FROM mm)),
 lg AS (SELECT * FROM gp WHERE g1 - g0 >= 5000000), tm AS (SELECT asset_id, g0, unnest(CASE WHEN g0 + 5000000 < g1 THEN range(g0 + 5000000, g1, 30000000) ELSE [g0 + (g1 - g0) // 2] END) AS t_us FROM lg),
 sn AS (SELECT tm.asset_id, tm.g0, tm.t_us, f.t_us AS f_us, f.source_us, f.difference FROM tm ASOF JOIN fr f ON tm.asset_id = f.asset_id AND tm.t_us >= f.t_us),
 u AS (SELECT asset_id, edit_start_us, edit_end_us, source_start_us, source_end_us, confidence, 'audio' AS method, block_id FROM kept UNION ALL SELECT asset_id, t_us - 2500000, t_us + 2500000, source_us - 30000000, source_us + 30000000, 0.7::DOUBLE, 'visual', NULL FROM sn WHERE f_us >= g0 AND difference < 40)
 SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY edit_start_us, method, block_id NULLS FIRST, edit_end_us)::INTEGER AS position FROM u""")
def alignment_build(spark, sf):
    """Audio blocks that run on, visual blocks in gaps of five seconds and more, in order of the edit."""
    b = fx.blocks(spark, sf)
    ten = b.selectExpr("asset_id", "block_id", *[f"{c} * 10 as {c}" for c in ("edit_start_us", "edit_end_us", "source_start_us", "source_end_us")], "block_id % 10 / 10.0d as confidence")
    frames = ten.where("block_id % 3 = 0").select("asset_id", F.col("edit_start_us").alias("t_us"), F.col("source_start_us").alias("source_us"), F.expr("cast(block_id % 60 as double)").alias("difference"))
    horizon = ten.groupBy("asset_id").agg(F.max("edit_end_us").alias("horizon_us"))
    return al.alignment_build(ten.where("block_id % 3 = 1"), frames, BY, horizon)


@query(f"""WITH {TE}, {BLOCKS}, s AS (SELECT DISTINCT ON (asset_id, t_us) asset_id, t_us, value FROM (SELECT asset_id, edit_start_us // 2 AS t_us, min(block_id % 10 // 4) AS value FROM blocks GROUP BY 1, 2)), c AS (SELECT *, CASE WHEN lag(value) OVER w = value THEN 0 ELSE 1 END AS ch, lead(t_us) OVER w AS nx FROM s WINDOW w AS (PARTITION BY asset_id ORDER BY t_us)), r AS (SELECT *, sum(ch) OVER (PARTITION BY asset_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS run FROM c),
 g AS (SELECT asset_id, min(t_us) AS edit_start_us, coalesce(arg_max(nx, t_us), max(t_us)) AS e, max(t_us) AS m, bool_or(nx IS NULL) AS last, count(*) AS n FROM r GROUP BY asset_id, run), f AS (SELECT asset_id, edit_start_us, CASE WHEN last THEN m ELSE e END AS edit_end_us, last FROM g WHERE n > 1 AND ((NOT last AND e - edit_start_us >= 500000) OR (last AND m - edit_start_us >= 100000))),
 h AS (SELECT * REPLACE (CASE WHEN block_id % 6 = 0 THEN edit_end_us - (edit_end_us - edit_start_us) // 2 ELSE edit_end_us END AS edit_end_us) FROM blocks WHERE block_id % 5 > 0), le AS (SELECT asset_id, arg_max(source_end_us, edit_start_us) AS le FROM h GROUP BY 1)
 SELECT f.asset_id, f.edit_start_us, f.edit_end_us, coalesce(CASE WHEN f.edit_start_us <= h.edit_end_us THEN h.source_start_us + (f.edit_start_us - h.edit_start_us) * h.speed WHEN last THEN le ELSE h.source_end_us END, CASE WHEN last THEN le END, 0)::BIGINT AS source_us FROM f ASOF LEFT JOIN h ON f.asset_id = h.asset_id AND f.edit_start_us >= h.edit_start_us LEFT JOIN le ON le.asset_id = f.asset_id""")
def freeze_frames(spark, sf):
    """Samples that stay the same, with the source time that they show."""
    b = fx.blocks(spark, sf)
    series = b.groupBy("asset_id", F.expr("edit_start_us div 2").alias("t_us")).agg(F.min(F.expr("block_id % 10 div 4")).alias("value"))
    blocks = b.where("block_id % 5 > 0").withColumn("edit_end_us", F.expr("case when block_id % 6 = 0 then edit_end_us - (edit_end_us - edit_start_us) div 2 else edit_end_us end"))
    return al.freeze_frames(series, blocks, BY)


@query(f"""WITH {TE}, {BLOCKS}, b AS (SELECT *, source_start_us - CASE WHEN block_id % 7 = 0 THEN 900000000 ELSE 0 END AS s, source_end_us - CASE WHEN block_id % 7 = 0 THEN 900000000 ELSE 0 END AS e, CASE WHEN block_id % 4 = 0 THEN 0 WHEN block_id % 4 = 1 THEN NULL ELSE 0.5 END AS combined, CASE WHEN block_id % 8 < 5 THEN block_id % 8 / 8.0::DOUBLE END AS own FROM blocks),
 k AS (SELECT asset_id, block_id, CASE WHEN s < 0 OR block_id % 31 = 0 THEN 'external' WHEN speed <> 1 OR block_id % 13 = 0 THEN 'transformed' ELSE 'retained' END AS kind, greatest(0, s) AS source_start_us, greatest(0, e) AS source_end_us, CASE WHEN combined <> 0 THEN combined WHEN own <> 0 THEN own ELSE 1 END::DOUBLE AS confidence FROM b),
 rt AS (SELECT asset_id, source_start_us AS start_us, source_end_us AS end_us FROM k WHERE kind <> 'external'), {merged_sql('rt', 'rm')}, hz AS (SELECT asset_id, max(end_us) AS horizon_us FROM te WHERE asset_id IN (SELECT asset_id FROM rt) GROUP BY 1),
 g AS (SELECT rm.asset_id, coalesce(lag(end_us) OVER (PARTITION BY rm.asset_id ORDER BY start_us), 0) AS g0, least(start_us, horizon_us) AS g1 FROM rm JOIN hz USING (asset_id) UNION ALL SELECT rm.asset_id, max(end_us), max(horizon_us) FROM rm JOIN hz USING (asset_id) GROUP BY 1),
 u AS (SELECT * FROM k UNION ALL SELECT asset_id, NULL, 'removed', g0, g1, 1 FROM g WHERE g1 - g0 > 100000), m AS (SELECT asset_id, round(avg(confidence) FILTER (kind <> 'external'), 4) AS mean_confidence FROM k GROUP BY 1) SELECT u.*, coalesce(mean_confidence, 1) AS mean_confidence FROM u JOIN m USING (asset_id)""")
def human_timeline(spark, sf):
    """Blocks as retained, transformed or external, and what is removed between them."""
    e = fx.timeline_events(spark, sf)
    back = F.when(F.expr("block_id % 7 = 0"), 900_000_000).otherwise(0)
    b = fx.blocks(spark, sf).withColumn("source_start_us", F.col("source_start_us") - back).withColumn("source_end_us", F.col("source_end_us") - back)
    b = b.withColumns({"is_external": F.expr("block_id % 31 = 0"), "is_transformed": F.expr("block_id % 13 = 0"), "combined_confidence": F.expr("case block_id % 4 when 0 then 0.0d when 1 then null else 0.5d end"), "confidence": F.expr("case when block_id % 8 < 5 then block_id % 8 / 8.0d end")})
    return pl.human_timeline(b, BY, e.groupBy("asset_id").agg(F.max("end_us").alias("horizon_us")))


# Style

_STYLE = f"""{BLOCKS}, dec AS (SELECT asset_id, CASE WHEN block_id % 8 = 0 THEN 'OMITTED' ELSE 'RETAINED' END AS decision, edit_start_us, edit_end_us, source_start_us, source_end_us FROM blocks), {EFFECTS}, fe AS (SELECT asset_id, effect_type, count(*) AS n FROM eff WHERE event_id % 11 <> 0 GROUP BY 1, 2),
 prf AS (SELECT asset_id, count(*) AS evidence_count, round(coalesce(avg(edit_end_us - edit_start_us) FILTER (decision = 'RETAINED') / 1000000, 0), 4) AS mean_kept_s, coalesce(round(least(coalesce(sum(source_end_us - source_start_us) FILTER (decision = 'RETAINED'), 0) / max(source_end_us), 1), 4), 0) AS retention FROM dec GROUP BY 1)"""


def _decisions(spark, sf):
    return fx.blocks(spark, sf).withColumn("decision", F.expr("case when block_id % 8 = 0 then 'OMITTED' else 'RETAINED' end"))


@query(f"WITH {TE}, {_STYLE} SELECT prf.*, coalesce((SELECT string_agg(effect_type || ':' || n, ',' ORDER BY effect_type) FROM fe WHERE fe.asset_id = prf.asset_id), '') AS effects FROM prf")
def style_profile(spark, sf):
    """Mean kept length, retained share and effects by type of each recording's edit."""
    p = st.style_profile(_decisions(spark, sf), effects(spark, sf).withColumn("is_false_positive", F.expr("event_id % 11 = 0")), BY)
    return p.withColumn("effects", F.array_join(F.transform(F.array_sort(F.map_entries("effects")), lambda x: F.concat_ws(":", x["key"], x["value"])), ","))


def _ramp(n: str, base: float) -> str:
    return f"CASE WHEN {n} < 5 THEN 0 WHEN {n} >= 50 THEN {base} ELSE {base}::DOUBLE * ({n} - 5) / 45 END::DOUBLE"


@query(f"""WITH {TE}, n AS (SELECT asset_id, count_if(event_type = 'face_reaction')::BIGINT AS r, count(*) AS c, (asset_id % 21)::BIGINT AS rate, count_if(event_type = 'speech')::BIGINT AS f, count_if(event_type = 'silence')::BIGINT AS t FROM te GROUP BY 1),
 w AS (SELECT asset_id, 'reaction_retention' AS signal, 'M5' AS stage, 'increase' AS direction, 0.5::DOUBLE AS base, {_ramp('r', 0.5)} AS w, r AS sample_size, 0.3 AS least FROM n UNION ALL SELECT asset_id, 'rapid_cut_affinity', 'M5', CASE WHEN rate > 10 THEN 'increase' ELSE 'decrease' END, 0.4, {_ramp('c', 0.6)}, c, 0.4 FROM n UNION ALL SELECT asset_id, 'effect_density', 'M8', 'increase', 0.3, {_ramp('(f + t // 2)', 0.5)}, f + t // 2, 0.4 FROM n)
 SELECT asset_id, signal, stage, direction, round(base * w, 4) AS strength, round(w, 4) AS confidence, sample_size FROM w WHERE w > least""")
def compile_policy(spark, sf):
    """Signals that a profile's evidence supports, each with its own count."""
    has = lambda k: F.count_if(F.col("event_type") == k)
    p = fx.timeline_events(spark, sf).groupBy("asset_id").agg(has("face_reaction").alias("reaction_count"), F.count("*").alias("cut_count"), has("speech").alias("effect_count"), has("silence").alias("transformed_count"))
    return st.compile_policy(p.withColumn("cuts_per_min", F.col("asset_id") % 21), BY)


@query(f"WITH {TE}, {EFFECTS} SELECT asset_id, count(*) AS zooms, 'too_many_zooms' AS issue FROM eff WHERE starts_with(effect_type, 'zoom') GROUP BY 1 HAVING count(*) > 10")
def effect_critique(spark, sf):
    """Plans with more than ten zooms."""
    return st.effect_critique(effects(spark, sf), BY)


def _run_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT plan_id, sum(duration_us)::BIGINT AS {name}_us, round(sum(duration_us) / count(*) / 1000000, 4) AS {name}_mean_s, round((count(*) - 1) / (sum(duration_us) / 60000000.0::DOUBLE), 4) AS {name}_cuts_per_min, count_if(confidence > 50)::BIGINT AS {name}_r FROM {source} GROUP BY 1)"


@query(f"WITH {CLIPS}, {PRUNED}, {_run_sql('base', 'clips')}, {_run_sql('styled', 'pruned')} SELECT plan_id, base_us, base_mean_s, base_cuts_per_min, styled_us, styled_mean_s, styled_cuts_per_min, CASE WHEN base_r > 0 THEN round(least(styled_r / base_r, 1), 4) ELSE 0 END AS reaction_retention FROM base JOIN styled USING (plan_id)")
def style_impact(spark, sf):
    """Selected time, mean clip, cuts a minute and kept reactions of two runs."""
    c = fx.clips(spark, sf).withColumn("is_reaction", F.col("confidence") > 50)
    return st.style_impact(c, pl.prune_to_budget(c, PLAN, budget(c)), PLAN)


# Review


@query(f"""WITH {FEEDBACK}, why AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN list_extract(['pacing', 'content', 'length'], CAST(event_id % 7 % 3 + 1 AS INTEGER)) END AS reason FROM fb), rs AS (SELECT user_id, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons FROM (SELECT user_id, reason, count(*) AS n FROM why WHERE reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
 SELECT user_id, count(DISTINCT clip_id) AS clips, count_if(feedback_type = 'accept')::BIGINT AS accepted, count_if(feedback_type = 'reject')::BIGINT AS rejected, count_if(starts_with(feedback_type, 'modify_'))::BIGINT AS modified, coalesce(round(sum(CAST(round(value * 100) AS BIGINT)) FILTER (feedback_type = 'modify_start') / (100 * count_if(feedback_type = 'modify_start')), 4), 0) AS mean_start_shift, coalesce(any_value(reasons), '') AS reasons FROM fb LEFT JOIN rs USING (user_id) GROUP BY user_id""")
def feedback_stats(spark, sf):
    """Reviewed clips, kinds of feedback, mean shift of starts and reasons."""
    reason = F.when(F.expr("event_id % 3 > 0"), F.element_at(F.array(*[F.lit(x) for x in ("pacing", "content", "length")]), F.expr("cast(event_id % 7 % 3 + 1 as int)")))
    s = pl.feedback_stats(feedback(spark, sf).withColumn("reason", reason), ["user_id"])
    return s.withColumn("reasons", F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda x: F.concat_ws(":", x["key"], x["value"])), ","))


# Experiments


@query(f"WITH {TE}, {AI}, {HUMAN}, {METRICS}, c AS (SELECT b.asset_id, round(v.f1 - b.f1, 4) AS f1_delta, round(v.recall - b.recall, 4) AS recall_delta FROM om b JOIN om v USING (asset_id) WHERE b.tol_us = 0 AND v.tol_us = 2000000) SELECT *, f1_delta >= 0 AND recall_delta >= -0.02 AS passed FROM c")
def compare_runs(spark, sf):
    """Two runs joined by case: deltas and a gate."""
    m = mt.overlap_metrics(fx.ai_intervals(spark, sf), fx.human_intervals(spark, sf), BY, [0, 2_000_000])
    return ex.compare_runs(m.where("tol_us = 0"), m.where("tol_us = 2000000"), BY)


_CASES = "SELECT asset_id, recall, precision, f1, (asset_id % 50 <> 0)::INTEGER::DOUBLE AS completeness, {} AS median_pre_s FROM om WHERE tol_us = {}"


@query(f"""WITH {TE}, {AI}, {HUMAN}, {METRICS}, b AS ({_CASES.format("(asset_id % 13 - 6) / 2.0::DOUBLE", 500000)}), v AS ({_CASES.format("(asset_id % 13 - 6) / 5.0::DOUBLE", 2000000)}),
 m AS (SELECT count(*) AS cases, avg(b.recall) AS br, avg(b.precision) AS bp, avg(b.f1) AS bf, avg(v.recall) AS vr, avg(v.precision) AS vp, avg(v.f1) AS vf, avg(v.completeness) AS vc, avg(abs(b.median_pre_s)) AS b0, avg(abs(v.median_pre_s)) AS v0 FROM b JOIN v USING (asset_id)), x AS (SELECT *, CASE WHEN b0 > 0 THEN (b0 - v0) / b0 ELSE 0 END AS rd, vr > 0.8 AS g1, vp >= 0.75 AS g2, vc >= 0.999 AS g3 FROM m)
 SELECT cases, round(br, 4) AS base_recall, round(bp, 4) AS base_precision, round(bf, 4) AS base_f1, round(vr, 4) AS variant_recall, round(vp, 4) AS variant_precision, round(vf, 4) AS variant_f1, round(vc, 4) AS variant_completeness, round(b0, 4) AS base_pre, round(v0, 4) AS variant_pre, round(rd, 4) AS reduction, round(vr - br, 4) AS delta_recall, round(vp - bp, 4) AS delta_precision, round(vf - bf, 4) AS delta_f1, g1 AS pass_recall, g2 AS pass_precision, g3 AS pass_completeness, rd >= 0.5 AS pass_pre_context, g1 AND g2 AND g3 AND rd >= 0.5 AS passed FROM x""")
def experiment_verdict(spark, sf):
    """Means of two runs, what changed, and four gates."""
    m = mt.overlap_metrics(fx.ai_intervals(spark, sf), fx.human_intervals(spark, sf), BY, [500_000, 2_000_000]).withColumn("completeness", F.expr("cast(asset_id % 50 <> 0 as double)"))
    run = lambda tol, part: m.where(f"tol_us = {tol}").withColumn("median_pre_s", F.expr(f"(asset_id % 13 - 6) / {part}d"))
    return ex.experiment_verdict(run(500_000, 2.0), run(2_000_000, 5.0), BY)


@query(f"""WITH {TE}, {HUMAN}, {AI}, {WINDOWS}, b AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER w BETWEEN 0 AND 4000000 THEN 0 ELSE 1 END AS new FROM human WINDOW w AS (PARTITION BY asset_id ORDER BY start_us, event_id)), k AS (SELECT *, sum(new) OVER (PARTITION BY asset_id ORDER BY start_us, event_id ROWS UNBOUNDED PRECEDING) AS beat FROM b),
 g AS (SELECT asset_id, beat, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) > 1), c AS (SELECT g.asset_id, g.beat, g.n, count(a.event_id) AS clips FROM g LEFT JOIN ai a ON a.asset_id = g.asset_id AND a.start_us < g.end_us AND g.start_us < a.end_us GROUP BY ALL), ob AS (SELECT asset_id, count(*) AS beats, sum(n - 1)::BIGINT AS required_merges, count_if(clips > 1)::BIGINT AS fragmented FROM c GROUP BY 1),
 mg AS (SELECT asset_id, cluster, start_us, end_us FROM win WHERE contains(signals, ',')), rb AS (SELECT m.asset_id, m.cluster FROM mg m JOIN k ON k.asset_id = m.asset_id AND m.start_us < k.end_us AND k.start_us < m.end_us JOIN g ON g.asset_id = k.asset_id AND g.beat = k.beat GROUP BY m.asset_id, m.cluster, k.beat HAVING count(*) > 1), rm AS (SELECT DISTINCT * FROM rb),
 om2 AS (SELECT asset_id, count(*) AS merges, count_if((asset_id, cluster) IN (SELECT (asset_id, cluster) FROM rm))::BIGINT AS valid_merges FROM mg GROUP BY 1), cd AS (SELECT asset_id, CASE WHEN sum(end_us - start_us) > 0 THEN round(count(*) / (sum(end_us - start_us) / 60000000.0::DOUBLE), 4) END AS cut_density FROM ai GROUP BY 1),
 j AS (SELECT asset_id, coalesce(beats, 0) AS beats, coalesce(required_merges, 0) AS required_merges, coalesce(fragmented, 0) AS fragmented, coalesce(merges, 0) AS merges, coalesce(valid_merges, 0) AS valid_merges, cut_density FROM ob FULL JOIN om2 USING (asset_id) FULL JOIN cd USING (asset_id))
 SELECT *, CASE WHEN beats > 0 THEN round(least(fragmented / beats, 1), 4) ELSE 0 END AS fragmented_share, CASE WHEN merges > 0 THEN round(valid_merges / merges, 4) END AS merge_precision, CASE WHEN required_merges > 0 THEN round(valid_merges / required_merges, 4) END AS merge_recall, CASE WHEN merges > 0 THEN round((merges - valid_merges) / merges, 4) END AS over_merge FROM j""")
def fragmentation(spark, sf):
    """Beats of several reference blocks, the clips that they are cut into, and how well candidates merge them."""
    w = sq.build_windows(clusters(spark, sf), BY).withColumnRenamed("cluster", "candidate")
    return ex.fragmentation(fx.human_intervals(spark, sf), fx.ai_intervals(spark, sf), w, BY)


def _pairs_sql() -> str:
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return " ".join(f"WHEN event_type IN ({quoted(a)}) AND nt IN ({quoted(b)}) THEN '{name}'" for name, a, b in ex.PAIR_CLASSES)


@query(f"""WITH {TE}, {WINDOWS}, e AS (SELECT event_type, lead(event_type) OVER w AS nt, greatest(0, lead(start_us) OVER w - end_us) AS g FROM te WINDOW w AS (PARTITION BY asset_id ORDER BY start_us, event_id)), c AS (SELECT lead(start_us) OVER (PARTITION BY asset_id ORDER BY start_us, end_us) - end_us AS g FROM win),
 a AS (SELECT CASE {_pairs_sql()} END AS gap_class, g / 1000000 AS x FROM e WHERE nt IS NOT NULL UNION ALL SELECT 'inter_candidate_gaps', g / 1000000 FROM c WHERE g > 0) SELECT gap_class, count(*) AS n, {STATS_SQL} FROM a WHERE gap_class IS NOT NULL GROUP BY 1""")
def gap_classes(spark, sf):
    """Gaps between neighbours by class of their types, and between candidates."""
    return ex.gap_classes(fx.timeline_events(spark, sf), sq.build_windows(clusters(spark, sf), BY), BY)

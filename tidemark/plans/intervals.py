"""Queries of interval algebra and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import AI, BLOCKS, HUMAN, TE, merged_sql
from ..functions.scalar import STATS_SQL, r4
from ..operators import intervals as iv
from ..operators import metrics as mt
from ..operators import reports as rp

BY = ["asset_id"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


HORIZON = "horizon AS (SELECT asset_id, max(end_us) AS horizon_us FROM te GROUP BY asset_id)"


def horizon(events):  # noqa: ANN001, ANN201
    return events.groupBy("asset_id").agg(F.max("end_us").alias("horizon_us"))


@query(f"WITH {TE}, {merged_sql('te', 'm')} SELECT * FROM m")
def merge_intervals(spark, sf):
    return iv.merge_intervals(fx.timeline_events(spark, sf), BY)


@query(f"WITH {TE}, {merged_sql('te', 'm')} SELECT asset_id, sum(end_us - start_us)::BIGINT AS duration_us FROM m GROUP BY asset_id")
def total_duration(spark, sf):
    return iv.total_duration(fx.timeline_events(spark, sf), BY)


@query(f"""WITH {TE}, {HORIZON}, {merged_sql('te', 'm')},
 g AS (SELECT m.asset_id, coalesce(lag(end_us) OVER (PARTITION BY m.asset_id ORDER BY start_us), 0) AS g0, start_us AS g1 FROM m
 UNION ALL SELECT m.asset_id, max(end_us), max(horizon_us) FROM m JOIN horizon USING (asset_id) GROUP BY m.asset_id)
 SELECT asset_id, g0 AS start_us, g1 AS end_us FROM g WHERE g1 - g0 > 100000""")
def removed_intervals(spark, sf):
    e = fx.timeline_events(spark, sf)
    return iv.gaps(e, BY, horizon(e))


OVERLAP = "SELECT a.asset_id, a.event_id, a.start_us, b.event_id AS r_event_id, b.start_us AS r_start_us FROM te a JOIN te b ON a.asset_id = b.asset_id AND a.event_id <> b.event_id AND "


def _pairs(joined):
    return joined.where("event_id <> r_event_id").select("asset_id", "event_id", "start_us", "r_event_id", "r_start_us")


@query(f"WITH {TE} {OVERLAP} a.start_us < b.end_us AND b.start_us < a.end_us")
def overlap_join(spark, sf):
    e = fx.timeline_events(spark, sf)
    return _pairs(iv.overlap_join(e, e, BY))


@query(f"WITH {TE} {OVERLAP} b.start_us >= a.start_us AND b.end_us <= a.end_us")
def contained_join(spark, sf):
    e = fx.timeline_events(spark, sf)
    return _pairs(iv.overlap_join(e, e, BY, kind="contained"))


@query(f"WITH {TE} {OVERLAP} a.event_type = 'gameplay_clutch' AND b.event_type = 'speech' AND a.start_us - 30000000 < b.end_us AND b.start_us < a.end_us + 30000000")
def nearby_join(spark, sf):
    e = fx.timeline_events(spark, sf)
    return _pairs(iv.overlap_join(fx.of_types(e, "gameplay_clutch"), fx.of_types(e, "speech"), BY, pad=30_000_000))


@query(f"""WITH {TE}, p AS (SELECT *, (start_us + end_us) // 2 AS t FROM te WHERE event_type = 'chat_message'),
 j AS (SELECT p.asset_id, p.event_id, i.start_us, i.end_us, i.event_id AS i_id, row_number() OVER (PARTITION BY p.asset_id, p.event_id ORDER BY i.start_us, i.event_id) AS k
 FROM p JOIN te i ON p.asset_id = i.asset_id AND i.event_type = 'speech' AND i.start_us <= t AND t <= i.end_us)
 SELECT asset_id, event_id, start_us AS in_start_us, end_us AS in_end_us, i_id AS in_event_id FROM j WHERE k = 1""")
def locate_point(spark, sf):
    e = fx.timeline_events(spark, sf)
    p = fx.of_types(e, "chat_message").withColumn("t", F.expr("(start_us + end_us) div 2"))
    return iv.locate_point(p, fx.of_types(e, "speech"), BY, "t", ["event_id"], ["event_id"])


@query(f"""WITH {TE}, {BLOCKS}, t AS (SELECT asset_id, block_id, edit_start_us + 700000 AS t_us FROM blocks)
 SELECT t.asset_id, t.block_id AS time_id, t.t_us, CASE WHEN t.t_us <= b.edit_end_us THEN b.source_start_us + (t.t_us - b.edit_start_us) * b.speed ELSE b.source_end_us END AS source_us
 FROM t ASOF JOIN blocks b ON t.asset_id = b.asset_id AND t.t_us >= b.edit_start_us""")
def asof_block(spark, sf):
    """A time of every block."""
    b = fx.blocks(spark, sf)
    return iv.asof_block(b.select("asset_id", F.col("block_id").alias("time_id"), (F.col("edit_start_us") + 700_000).alias("t_us")), b, BY)


QUERIES["asof_every_block"], SQL["asof_every_block"] = asof_block, SQL["asof_block"]  # its name before


BEST = """best AS (SELECT * FROM (SELECT h.asset_id, h.event_id, h.start_us, h.end_us, a.event_id AS r_event_id, a.start_us AS r_start_us, a.end_us AS r_end_us,
 least(h.end_us, a.end_us) - greatest(h.start_us, a.start_us) AS overlap_us,
 row_number() OVER (PARTITION BY h.asset_id, h.event_id ORDER BY least(h.end_us, a.end_us) - greatest(h.start_us, a.start_us) DESC, a.start_us, a.event_id) AS k
 FROM human h JOIN ai a ON h.asset_id = a.asset_id AND least(h.end_us, a.end_us) - greatest(h.start_us, a.start_us) > 100000) WHERE k = 1)"""


@query(f"WITH {TE}, {AI}, {HUMAN}, {BEST} SELECT asset_id, event_id, r_event_id, overlap_us FROM best")
def best_overlap(spark, sf):
    return iv.best_overlap(fx.human_intervals(spark, sf), fx.ai_intervals(spark, sf), BY).select("asset_id", "event_id", "r_event_id", "overlap_us")


NEAREST = """near AS (SELECT * FROM (SELECT h.asset_id, h.event_id, a.event_id AS r_event_id, abs(h.start_us - a.start_us) AS distance_us, h.effect_type, a.effect_type AS r_effect_type,
 row_number() OVER (PARTITION BY h.asset_id, h.event_id ORDER BY abs(h.start_us - a.start_us), a.start_us, a.event_id) AS k
 FROM heff h JOIN aeff a ON h.asset_id = a.asset_id AND abs(h.start_us - a.start_us) <= 2000000) WHERE k = 1)"""
EFFECTS = """eff AS (SELECT *, list_extract(['zoom_face', 'zoom_region', 'speed_up', 'grayscale'], CAST(event_id // 2 % 4 + 1 AS INTEGER)) AS effect_type FROM te),
 heff AS (SELECT * FROM eff WHERE event_id % 2 = 0), aeff AS (SELECT * FROM eff WHERE event_id % 2 = 1)"""


def effects(spark, sf):
    names = F.array(*[F.lit(x) for x in ("zoom_face", "zoom_region", "speed_up", "grayscale")])
    return fx.timeline_events(spark, sf).withColumn("effect_type", F.element_at(names, F.expr("cast(event_id div 2 % 4 + 1 as int)")))


@query(f"WITH {TE}, {EFFECTS}, {NEAREST} SELECT asset_id, event_id, r_event_id, distance_us FROM near")
def nearest_within(spark, sf):
    e = effects(spark, sf)
    return iv.nearest_within(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), BY).select("asset_id", "event_id", "r_event_id", "distance_us")


@query(f"""WITH {TE}, {EFFECTS}, {NEAREST}, n AS (SELECT *, CASE WHEN effect_type = r_effect_type THEN 'same' WHEN regexp_extract(effect_type, '(zoom|speed|text)', 1) <> '' AND regexp_extract(effect_type, '(zoom|speed|text)', 1) = regexp_extract(r_effect_type, '(zoom|speed|text)', 1) THEN 'similar' ELSE 'different' END AS kind FROM near),
 g AS (SELECT asset_id, count(*) AS matched, count_if(kind = 'same')::BIGINT AS same, count_if(kind = 'similar')::BIGINT AS "similar", count_if(kind = 'different')::BIGINT AS different, count(DISTINCT r_event_id) AS ai_used FROM n GROUP BY 1),
 h AS (SELECT asset_id, count(*) AS human_n FROM heff GROUP BY 1), a AS (SELECT asset_id, count(*) AS ai_n FROM aeff GROUP BY 1)
 SELECT asset_id, coalesce(human_n, 0) AS human_n, coalesce(ai_n, 0) AS ai_n, coalesce(matched, 0) AS matched, coalesce(same, 0) AS same, coalesce("similar", 0) AS "similar", coalesce(different, 0) AS different, coalesce(ai_used, 0) AS ai_used,
 coalesce(human_n, 0) - coalesce(matched, 0) AS human_only, coalesce(ai_n, 0) - coalesce(ai_used, 0) AS ai_only,
 CASE WHEN matched > 0 THEN round((same + "similar") / matched, 4) ELSE 0 END AS agreement FROM h FULL JOIN a USING (asset_id) LEFT JOIN g USING (asset_id)""")
def effect_metrics(spark, sf):
    e = effects(spark, sf)
    return mt.effect_metrics(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), BY)


@query(f"""WITH {TE}, {AI}, nodes AS (SELECT * FROM te WHERE event_type = 'face_reaction'), {merged_sql('ai', 'm')},
 j AS (SELECT n.asset_id, n.event_id, sum(least(n.end_us, m.end_us) - greatest(n.start_us, m.start_us)) AS c FROM nodes n JOIN m ON n.asset_id = m.asset_id AND n.start_us < m.end_us AND m.start_us < n.end_us GROUP BY 1, 2)
 SELECT asset_id, event_id, c::BIGINT AS covered_us FROM nodes JOIN j USING (asset_id, event_id) WHERE c * 2 > end_us - start_us""")
def covered_majority(spark, sf):
    e = fx.timeline_events(spark, sf)
    return mt.covered_majority(fx.of_types(e, "face_reaction"), fx.ai_intervals(spark, sf), BY, ["event_id"]).select("asset_id", "event_id", "covered_us")


@query(f"""WITH {TE}, e AS (SELECT *, lag(end_us) OVER (PARTITION BY asset_id ORDER BY start_us, event_id) AS prev_end_us FROM te WHERE event_type <> 'silence')
 SELECT asset_id, event_id, prev_end_us, coalesce(EXISTS (SELECT 1 FROM te s WHERE s.event_type = 'silence' AND s.asset_id = e.asset_id AND s.start_us > e.prev_end_us AND s.start_us <= e.start_us), false) AS cut FROM e""")
def cut_between(spark, sf):
    e = fx.timeline_events(spark, sf)
    return iv.cut_between(e.where("event_type <> 'silence'"), fx.of_types(e, "silence"), BY).select("asset_id", "event_id", "prev_end_us", "cut")


CHAINS = "SELECT *, CASE WHEN start_us - lag(end_us) OVER w BETWEEN 0 AND 8000000 THEN 0 ELSE 1 END AS new FROM clips WINDOW w AS (PARTITION BY plan_id ORDER BY start_us, clip_id)"


@query(f"""WITH {fx.CLIPS}, f AS ({CHAINS}), g AS (SELECT *, sum(new) OVER (PARTITION BY plan_id ORDER BY start_us, clip_id) AS chain FROM f)
 SELECT plan_id, min(start_us) AS start_us, arg_max(end_us, position) AS end_us, min(level) AS level, bool_or(locked) AS locked, count(*) AS n FROM g GROUP BY plan_id, chain""")
def bridge_gaps(spark, sf):
    return iv.bridge_gaps(fx.clips(spark, sf), ["plan_id"])


@query(f"""WITH {TE}, {BLOCKS}, b AS (SELECT asset_id, edit_start_us AS start_us, edit_end_us AS end_us FROM blocks WHERE block_id % 3 <> 0), {merged_sql('b', 'm', 1_000_000)}, h AS (SELECT asset_id, max(edit_end_us) AS horizon_us FROM blocks GROUP BY 1),
 g AS (SELECT m.asset_id, coalesce(lag(end_us) OVER (PARTITION BY m.asset_id ORDER BY start_us), 0) AS g0, start_us AS g1 FROM m UNION ALL SELECT m.asset_id, max(end_us), max(horizon_us) FROM m JOIN h USING (asset_id) GROUP BY m.asset_id)
 SELECT asset_id, g0 AS start_us, g1 AS end_us FROM g WHERE g1 > g0""")
def unmatched_intervals(spark, sf):
    b = fx.blocks(spark, sf)
    mapped = b.where("block_id % 3 <> 0").select("asset_id", F.col("edit_start_us").alias("start_us"), F.col("edit_end_us").alias("end_us"))
    return iv.gaps(mapped, BY, b.groupBy("asset_id").agg(F.max("edit_end_us").alias("horizon_us")).join(mapped.select("asset_id").distinct(), "asset_id", "left_semi"), min_gap=0, eps=1_000_000)


@query(f"WITH x AS (SELECT event_type, value AS x FROM events) SELECT event_type, {STATS_SQL} FROM x GROUP BY event_type")
def quantile_stats(spark, sf):
    return mt.quantile_stats(fx.table(spark, sf, "events"), "value", ["event_type"])


TOL = """t AS (SELECT unnest([0, 500000, 1000000, 2000000])::BIGINT AS tol_us), hw AS (SELECT asset_id * 4 + CASE tol_us WHEN 0 THEN 0 WHEN 500000 THEN 1 WHEN 1000000 THEN 2 ELSE 3 END AS asset_id, greatest(0, start_us - tol_us) AS start_us, end_us + tol_us AS end_us FROM human, t)"""
METRICS = f"""{TOL}, {merged_sql('ai', 'am')}, {merged_sql('human', 'hm')}, {merged_sql('hw', 'wm')},
 inter AS (SELECT a.asset_id, list_extract([0, 500000, 1000000, 2000000], CAST(w.asset_id % 4 + 1 AS INTEGER))::BIGINT AS tol_us, sum(least(a.end_us, w.end_us) - greatest(a.start_us, w.start_us))::BIGINT AS i FROM am a JOIN wm w ON a.asset_id = w.asset_id // 4 AND a.start_us < w.end_us AND w.start_us < a.end_us GROUP BY 1, 2),
 tot AS (SELECT asset_id, sum(end_us - start_us)::BIGINT AS ai_us FROM am GROUP BY 1), ht AS (SELECT asset_id, sum(end_us - start_us)::BIGINT AS human_us FROM hm GROUP BY 1),
 d AS (SELECT asset_id, tol_us, coalesce(ai_us, 0) AS ai_us, coalesce(human_us, 0) AS human_us, least(coalesce(i, 0), coalesce(ai_us, 0)) AS inter_us FROM (tot FULL JOIN ht USING (asset_id)) CROSS JOIN t LEFT JOIN inter USING (asset_id, tol_us)),
 pr AS (SELECT *, CASE WHEN ai_us > 0 THEN round(least(inter_us / ai_us, 1), 4) ELSE 0 END AS precision, CASE WHEN human_us > 0 THEN round(least(inter_us / human_us, 1), 4) ELSE 0 END AS recall FROM d),
 om AS (SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) ELSE 0 END AS f1 FROM pr)"""


@query(f"WITH {TE}, {AI}, {HUMAN}, {METRICS} SELECT * FROM om")
def overlap_metrics(spark, sf):
    return mt.overlap_metrics(fx.ai_intervals(spark, sf), fx.human_intervals(spark, sf), BY)


@query(f"WITH {TE}, {AI}, {HUMAN}, {METRICS} SELECT asset_id, ai_us AS a_us, inter_us FROM om WHERE tol_us = 1000000 AND ai_us > 0")
def intersection_duration(spark, sf):
    return iv.intersection_duration(fx.ai_intervals(spark, sf), fx.human_intervals(spark, sf), BY, 1_000_000)


@query(f"""WITH {TE}, {AI}, {HUMAN}, {METRICS}, mm AS (SELECT tol_us, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(least(sum(inter_us) / sum(ai_us), 1), 4) AS micro_precision, round(least(sum(inter_us) / sum(human_us), 1), 4) AS micro_recall FROM om GROUP BY tol_us)
 SELECT *, round(2 * micro_precision * micro_recall / (micro_precision + micro_recall), 4) AS micro_f1 FROM mm""")
def macro_micro(spark, sf):
    return mt.macro_micro(overlap_metrics(spark, sf))


@query(f"""WITH {TE}, {AI}, {HUMAN}, {METRICS} SELECT asset_id, (ai_us - inter_us)::BIGINT AS ai_only_us, greatest(human_us - inter_us, 0)::BIGINT AS human_only_us, CASE WHEN human_us > 0 THEN round(ai_us / human_us, 4) ELSE 0 END AS ratio FROM om WHERE tol_us = 0""")
def over_selection(spark, sf):
    return rp.over_selection(fx.ai_intervals(spark, sf), fx.human_intervals(spark, sf), BY)


@query(f"""WITH {TE}, {AI}, {HUMAN}, {BEST}, m AS (SELECT asset_id, r_start_us - start_us AS pre, r_end_us - end_us AS post FROM best), v AS (SELECT *, CASE WHEN pre > 1000000 OR post < -1000000 THEN 'short' WHEN pre < -2000000 OR post > 2000000 THEN 'long' ELSE 'good' END AS verdict FROM m)
 SELECT asset_id, count(*) AS matched, count_if(verdict = 'short')::BIGINT AS too_short, count_if(verdict = 'long')::BIGINT AS too_long, count_if(verdict = 'good')::BIGINT AS good, round(avg(pre / 1000000), 4) AS mean_pre_s, round(avg(post / 1000000), 4) AS mean_post_s, round(quantile_cont(pre / 1000000, 0.5), 4) AS median_pre_s FROM v GROUP BY asset_id""")
def context_metrics(spark, sf):
    return mt.context_metrics(fx.ai_intervals(spark, sf), fx.human_intervals(spark, sf), BY)


@query(f"WITH {TE}, {AI}, {HUMAN}, {BEST}, o AS (SELECT asset_id, 'pre' AS edge, (r_start_us - start_us) / 1000000 AS x FROM best UNION ALL SELECT asset_id, 'post', (r_end_us - end_us) / 1000000 FROM best) SELECT asset_id, edge, count(*) AS n, {STATS_SQL} FROM o GROUP BY 1, 2")
def context_offsets(spark, sf):
    return mt.context_offsets(fx.ai_intervals(spark, sf), fx.human_intervals(spark, sf), BY)


@query(f"""WITH {TE}, {AI}, h AS (SELECT asset_id, max(end_us) AS horizon_us FROM te GROUP BY 1), t AS (SELECT asset_id, sum(end_us - start_us)::BIGINT AS total_us FROM ai GROUP BY 1), i AS (SELECT asset_id, count(*) AS contained FROM te e WHERE EXISTS (SELECT 1 FROM ai a WHERE a.asset_id = e.asset_id AND a.start_us <= e.start_us AND e.end_us <= a.end_us) GROUP BY 1)
 SELECT asset_id, total_us, horizon_us, coalesce(contained, 0) AS contained, CASE WHEN horizon_us > 0 THEN round(total_us / horizon_us, 4) ELSE 0 END AS compression, CASE WHEN total_us > 0 THEN round(coalesce(contained, 0) / (total_us / 60000000.0::DOUBLE), 4) ELSE 0 END AS contained_per_min FROM t JOIN h USING (asset_id) LEFT JOIN i USING (asset_id)""")
def content_density(spark, sf):
    e = fx.timeline_events(spark, sf)
    return mt.content_density(fx.ai_intervals(spark, sf), e, BY, e.groupBy("asset_id").agg(F.max("end_us").alias("horizon_us")))


@query(f"""WITH {TE}, {AI}, {EFFECTS}, t AS (SELECT asset_id, sum(end_us - start_us)::BIGINT AS total_us FROM ai GROUP BY 1), a AS (SELECT asset_id, count(*) AS ai_n FROM aeff GROUP BY 1), h AS (SELECT asset_id, count(*) AS human_n FROM heff GROUP BY 1),
 r AS (SELECT asset_id, total_us, coalesce(ai_n, 0) AS ai_n, coalesce(human_n, 0) AS human_n, CASE WHEN total_us > 0 THEN coalesce(ai_n, 0) / (total_us / 60000000.0::DOUBLE) ELSE 0 END AS rate FROM t LEFT JOIN a USING (asset_id) LEFT JOIN h USING (asset_id)) SELECT asset_id, total_us, ai_n, human_n, round(rate, 4) AS per_min, rate > 12 AS over_effected, rate < 0.5 AND human_n > 3 AS under_effected FROM r""")
def effect_rate(spark, sf):
    e = effects(spark, sf)
    return mt.effect_rate(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), fx.ai_intervals(spark, sf), BY)


@query(f"""WITH {TE}, {AI}, c AS (SELECT *, end_us - start_us AS len_us, greatest(0, start_us - lag(end_us) OVER (PARTITION BY asset_id ORDER BY start_us, end_us, event_id)) AS g, lag(end_us) OVER (PARTITION BY asset_id ORDER BY start_us, end_us, event_id) AS p FROM ai),
 a AS (SELECT asset_id, count(*) AS n, sum(len_us)::BIGINT AS total_us, round(avg(len_us) / 1000000, 4) AS mean_clip_s, round(quantile_cont(len_us, 0.5) / 1000000, 4) AS median_clip_s, round(avg(g) / 1000000, 4) AS mean_gap_s FROM (SELECT * REPLACE (CASE WHEN p IS NULL AND n_row = 1 THEN 0 ELSE g END AS g) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start_us, end_us, event_id) AS n_row FROM c)) GROUP BY asset_id)
 SELECT *, CASE WHEN total_us > 10000000 THEN round((n - 1) / (total_us / 60000000.0), 4) ELSE 0 END AS cuts_per_min FROM a""")
def pacing_metrics(spark, sf):
    return mt.pacing_metrics(fx.ai_intervals(spark, sf), BY)


@query(f"""WITH {TE}, {HUMAN}, q AS (SELECT h.asset_id, count(*) AS quiet_n, sum(s.end_us - s.start_us)::BIGINT AS quiet_us FROM human h JOIN te s ON s.event_type = 'silence' AND s.asset_id = h.asset_id AND s.start_us >= h.start_us AND s.end_us <= h.end_us GROUP BY 1), t AS (SELECT asset_id, sum(end_us - start_us)::BIGINT AS total_us FROM human GROUP BY 1)
 SELECT asset_id, total_us, coalesce(quiet_n, 0) AS quiet_n, coalesce(quiet_us, 0) AS quiet_us, round(least(coalesce(quiet_us, 0) / total_us, 1), 4) AS quiet_share FROM t LEFT JOIN q USING (asset_id)""")
def dead_air(spark, sf):
    return mt.dead_air(fx.human_intervals(spark, sf), fx.timeline_events(spark, sf), BY)


@query(f"""WITH {TE}, {AI}, {HUMAN}, s AS (SELECT h.asset_id, h.event_id, h.end_us - h.start_us AS len, coalesce(sum(CASE WHEN a.event_id IS NOT NULL THEN least(h.end_us, a.end_us) - greatest(h.start_us, a.start_us) END), 0)::BIGINT AS support_us FROM human h LEFT JOIN ai a ON h.asset_id = a.asset_id AND h.start_us < a.end_us AND a.start_us < h.end_us GROUP BY ALL),
 v AS (SELECT *, CASE WHEN support_us * 10 >= len * 7 OR len - support_us <= 1000000 THEN 'matched' WHEN support_us > 0 THEN 'partial' ELSE 'missed' END AS verdict FROM s)
 SELECT asset_id, event_id, support_us, verdict, support_us = 0 AND verdict = 'matched' AS zero_overlap FROM v""")
def segment_support(spark, sf):
    return mt.segment_support(fx.human_intervals(spark, sf), fx.ai_intervals(spark, sf), BY)


def _has(kind: str) -> str:
    return f"EXISTS (SELECT 1 FROM te b WHERE b.event_type = '{kind}' AND b.asset_id = h.asset_id AND h.start_us < b.end_us AND b.start_us < h.end_us)"


@query(f"""WITH {TE}, {HUMAN} SELECT asset_id, event_id, CASE WHEN NOT {_has('speech')} THEN 'MISSED_IMPORTANT_EVENT' WHEN NOT {_has('gameplay_clutch')} THEN 'LOW_SCORE' WHEN NOT {_has('silence')} THEN 'DEPENDENCY_FAILURE' ELSE 'BUDGET_EXCLUSION' END AS reason FROM human h""")
def trace_root_cause(spark, sf):
    e = fx.timeline_events(spark, sf)
    layers = [("MISSED_IMPORTANT_EVENT", fx.of_types(e, "speech")), ("LOW_SCORE", fx.of_types(e, "gameplay_clutch")), ("DEPENDENCY_FAILURE", fx.of_types(e, "silence"))]
    return mt.trace_root_cause(fx.human_intervals(spark, sf), layers, BY)


@query(f"""WITH {TE}, e AS (SELECT event_type, lead(event_type) OVER w AS next_type, (lead(start_us) OVER w - end_us) / 1000000 AS x FROM te WINDOW w AS (PARTITION BY asset_id ORDER BY start_us, event_id))
 SELECT event_type, next_type, count(*) AS n, {STATS_SQL} FROM e WHERE x > 0 GROUP BY 1, 2""")
def gap_distribution(spark, sf):
    return mt.gap_distribution(fx.timeline_events(spark, sf), BY)


@query(f"""WITH {TE}, {AI}, {HUMAN}, {HORIZON}, s AS (SELECT asset_id, 'events' AS stage, start_us, end_us FROM te UNION ALL SELECT asset_id, 'ai', start_us, end_us FROM ai UNION ALL SELECT asset_id, 'human', start_us, end_us FROM human),
 g AS (SELECT asset_id, stage, count(*) AS n, min(start_us) AS first_us, max(end_us) AS last_us FROM s GROUP BY 1, 2)
 SELECT g.*, horizon_us, CASE WHEN horizon_us > 0 THEN round(least((last_us - first_us) / horizon_us, 1), 4) ELSE 0 END AS span_share, greatest(0, horizon_us - last_us) AS tail_us FROM g JOIN horizon USING (asset_id)""")
def coverage_audit(spark, sf):
    e = fx.timeline_events(spark, sf)
    return mt.coverage_audit({"events": e, "ai": fx.ai_intervals(spark, sf), "human": fx.human_intervals(spark, sf)}, BY, horizon(e))


@query(f"WITH {TE}, {BLOCKS} SELECT asset_id, (source_start_us + source_end_us) // 2 // 900000000 AS bin, sum(source_end_us - source_start_us)::BIGINT AS kept_us, round(sum(source_end_us - source_start_us) / 900000000, 4) AS bin_share FROM blocks GROUP BY 1, 2")
def bin_coverage(spark, sf):
    return mt.bin_coverage(fx.blocks(spark, sf), BY)


@query(f"""WITH {TE}, {AI}, w AS (SELECT *, event_id % 3 = 0 AS truth FROM te WHERE event_type = 'face_reaction'), f AS (SELECT truth, EXISTS (SELECT 1 FROM ai b WHERE b.asset_id = w.asset_id AND w.start_us < b.end_us AND b.start_us < w.end_us) AS p FROM w),
 c AS (SELECT count_if(p AND truth)::BIGINT AS tp, count_if(p AND NOT truth)::BIGINT AS fp, count_if(NOT p AND NOT truth)::BIGINT AS tn, count_if(NOT p AND truth)::BIGINT AS fn FROM f), r AS (SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(tn / (tn + fp), 4) AS specificity FROM c)
 SELECT *, round(2 * precision * recall / (precision + recall), 4) AS f1 FROM r""")
def confusion(spark, sf):
    e = fx.timeline_events(spark, sf)
    return mt.confusion(fx.ai_intervals(spark, sf), fx.of_types(e, "face_reaction").withColumn("truth", F.expr("event_id % 3 = 0")), BY)

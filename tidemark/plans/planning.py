"""Queries of plans, review and experiments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import AI, BLOCKS, CLIPS, TE, merged_sql
from ..functions.scalar import r4, share
from ..operators import intervals as iv
from ..operators import planning as pl
from ..operators import reports as rp

BY, PLAN = ["asset_id"], ["plan_id"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {CLIPS}, k AS (SELECT * FROM clips WHERE clip_id % 9 <> 0) SELECT plan_id, clip_id, coalesce(sum(duration_us) OVER w, 0)::BIGINT AS output_start_us, (coalesce(sum(duration_us) OVER w, 0) + duration_us)::BIGINT AS output_end_us FROM k WINDOW w AS (PARTITION BY plan_id ORDER BY position, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def repack_output(spark, sf):
    return pl.repack_output(fx.clips(spark, sf), PLAN, F.expr("clip_id % 9 <> 0")).select("plan_id", "clip_id", "output_start_us", "output_end_us")


BUDGET = "bud AS (SELECT plan_id, sum(duration_us)::BIGINT * 6 // 10 AS budget_us FROM clips GROUP BY 1)"
PRUNED = f"""{BUDGET}, pr0 AS (SELECT *, NOT locked AND level > 1 AS free, sum(duration_us) OVER (PARTITION BY plan_id) AS total FROM clips JOIN bud USING (plan_id)),
 pr1 AS (SELECT *, coalesce(sum(duration_us) OVER (PARTITION BY plan_id, free ORDER BY level DESC, confidence, position, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr0), pruned AS (SELECT * FROM pr1 WHERE NOT (free AND total - before > budget_us))"""


def budget(clips):
    return clips.groupBy("plan_id").agg(F.expr("sum(duration_us) * 6 div 10").alias("budget_us"))


@query(f"WITH {CLIPS}, {PRUNED} SELECT plan_id, clip_id, priority, duration_us FROM pruned")
def prune_to_budget(spark, sf):
    c = fx.clips(spark, sf)
    return pl.prune_to_budget(c, PLAN, budget(c)).select("plan_id", "clip_id", "priority", "duration_us")


ANCHORS = """a0 AS (SELECT *, max(end_us) OVER (PARTITION BY plan_id) AS last, row_number() OVER (PARTITION BY plan_id ORDER BY start_us, clip_id) = 1 AND start_us <= 180000000 AS greeting FROM clips),
 a1 AS (SELECT *, NOT greeting AND start_us BETWEEN 120000000 AND 480000000 AS fits FROM a0), a2 AS (SELECT *, sum(CAST(fits AS INTEGER)) OVER (PARTITION BY plan_id ORDER BY start_us, clip_id ROWS UNBOUNDED PRECEDING) AS k FROM a1),
 anchored AS (SELECT *, CASE WHEN greeting THEN 'greeting' WHEN fits AND k = 1 THEN 'game_start' WHEN last > 600000000 AND start_us >= last - 300000000 THEN 'outro' END AS anchor FROM a2)"""


@query(f"WITH {CLIPS}, {ANCHORS} SELECT plan_id, clip_id, anchor FROM anchored WHERE anchor IS NOT NULL")
def tag_anchors(spark, sf):
    return pl.tag_anchors(fx.clips(spark, sf), PLAN).where("anchor is not null").select("plan_id", "clip_id", "anchor")


CHILD = "par AS (SELECT *, clip_id % 8 = 0 AS rejected FROM clips WHERE clip_id % 11 <> 0), chi AS (SELECT plan_id, clip_id, start_us, end_us - CASE WHEN clip_id % 6 = 0 THEN 1000 ELSE 0 END AS end_us, clip_id % 17 = 0 OR clip_id % 10 = 0 AS locked, clip_id % 4 = 0 AS rejected FROM clips WHERE clip_id % 12 <> 0)"


@query(f"""WITH {CLIPS}, {CHILD}, j AS (SELECT c.*, p.clip_id IS NOT NULL AS b, p.rejected AS pr, p.locked AS plk, p.start_us AS ps, p.end_us AS pe FROM chi c LEFT JOIN par p USING (plan_id, clip_id)),
 g AS (SELECT plan_id, count_if(NOT b)::BIGINT AS added, count_if(b AND rejected AND NOT pr)::BIGINT AS rejected, count_if(b AND (start_us <> ps OR end_us <> pe))::BIGINT AS modified, count_if(b AND locked AND NOT plk)::BIGINT AS locked, sum(end_us - start_us)::BIGINT AS after_us FROM j GROUP BY 1)
 SELECT g.*, before_us FROM g JOIN (SELECT plan_id, sum(end_us - start_us)::BIGINT AS before_us FROM par GROUP BY 1) USING (plan_id)""")
def plan_diff(spark, sf):
    c = fx.clips(spark, sf)
    parent = c.where("clip_id % 11 <> 0").withColumn("rejected", F.expr("clip_id % 8 = 0"))
    child = c.where("clip_id % 12 <> 0").selectExpr("plan_id", "clip_id", "start_us", "end_us - if(clip_id % 6 = 0, 1000, 0) as end_us", "clip_id % 17 = 0 or clip_id % 10 = 0 as locked", "clip_id % 4 = 0 as rejected")
    return pl.plan_diff(parent, child, PLAN)


@query("SELECT o_custkey, o_orderkey AS run_id, o_orderdate AS finished FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_completed(spark, sf):
    runs = fx.table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey as run_id", "o_orderdate as finished", "if(o_orderstatus = 'F', 'completed', 'open') as status")
    return pl.latest_completed(runs, ["o_custkey"]).drop("status")


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS n FROM conversations WHERE turn % 2 = 0) SELECT c.conv_id, c.turn, count(w.word) AS n_words, coalesce(string_agg(w.word, '/' ORDER BY n), '') AS words FROM conversations c LEFT JOIN w USING (conv_id, turn) GROUP BY 1, 2""")
def nest_words(spark, sf):
    """Segments with their words as an ordered array; segments without words keep an empty one."""
    c = fx.table(spark, sf, "conversations")
    words = c.where("turn % 2 = 0").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("position", "word"))
    full = rp.nest_words(c.select("conv_id", "turn"), words, ["conv_id", "turn"])
    return full.select("conv_id", "turn", F.size("words").cast("long").alias("n_words"), F.array_join("words", "/").alias("words"))


@query("WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 1 AND event_id > 3 THEN event_id - 3 END AS replaces_id, value FROM events) SELECT event_id, value FROM r WHERE event_id NOT IN (SELECT replaces_id FROM r WHERE replaces_id IS NOT NULL)")
def active_rows(spark, sf):
    r = fx.table(spark, sf, "events").selectExpr("event_id", "case when event_id % 4 = 1 and event_id > 3 then event_id - 3 end as replaces_id", "value")
    return pl.active_rows(r, "event_id", "replaces_id").select("event_id", "value")


@query(f"WITH {TE}, {merged_sql('te', 'm', 3_000_000)}, c AS (SELECT asset_id, island, min(start_us) AS candidate_us, list(event_id) AS ids FROM m_2 GROUP BY 1, 2), l AS (SELECT asset_id, candidate_us, unnest(ids) AS event_id FROM c) SELECT l.asset_id, candidate_us, l.event_id, event_type FROM l JOIN te USING (event_id)")
def evidence_links(spark, sf):
    """A row for each evidence id of each candidate, joined back to its event."""
    e = fx.timeline_events(spark, sf)
    c = iv.member_islands(e, BY, 3_000_000).groupBy("asset_id", F.col("island").alias("candidate_us")).agg(F.collect_set("event_id").alias("evidence"))
    return rp.evidence_links(c, e.select("asset_id", "event_id", "event_type"), BY, ["candidate_us"])


@query(f"""WITH {CLIPS}, {PRUNED}, rp AS (SELECT plan_id, clip_id, start_us, end_us, coalesce(sum(duration_us) OVER (PARTITION BY plan_id ORDER BY position, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM pruned WHERE start_us < end_us),
 fx AS (SELECT plan_id, clip_id AS effect_id, end_us - 3000000 AS s, end_us + 9000000 AS e FROM clips WHERE clip_id % 3 = 0)
 SELECT plan_id, clip_id, effect_id, o AS output_start_us, o + end_us - start_us AS output_end_us, greatest(start_us, s) - start_us + o AS part_start_us, least(end_us, e) - start_us + o AS part_end_us FROM rp JOIN fx USING (plan_id) WHERE start_us < e AND s < end_us""")
def compile_timeline(spark, sf):
    c = fx.clips(spark, sf)
    effects = c.where("clip_id % 3 = 0").selectExpr("plan_id", "clip_id as effect_id", "end_us - 3000000 as start_us", "end_us + 9000000 as end_us")
    return pl.compile_timeline(pl.prune_to_budget(c, PLAN, budget(c)), effects, PLAN)


@query(f"WITH {CLIPS} SELECT plan_id AS parent_plan_id, clip_id, 2 AS revision, sha256(plan_id || ':2') AS new_plan_id, sha256(clip_id || ':2') AS new_clip_id FROM clips")
def revise_plan(spark, sf):
    return pl.revise_plan(fx.clips(spark, sf).withColumn("revision", F.lit(1)), "plan_id").select("parent_plan_id", "clip_id", "revision", "new_plan_id", "new_clip_id")


FEEDBACK = "fb AS (SELECT event_id, event_id % 1000 AS clip_id, user_id, ts, value, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'modify_start' WHEN 'purchase' THEN 'lock' WHEN 'error' THEN 'reject' ELSE 'modify_end' END AS feedback_type FROM events)"


def feedback(spark, sf):
    return fx.table(spark, sf, "events").selectExpr("event_id", "event_id % 1000 as clip_id", "user_id", "ts", "value", "case event_type when 'click' then 'accept' when 'view' then 'modify_start' when 'purchase' then 'lock' when 'error' then 'reject' else 'modify_end' end as feedback_type")


@query(f"""WITH {FEEDBACK} SELECT clip_id, arg_max(feedback_type = 'accept', (ts, event_id)) FILTER (feedback_type IN ('accept', 'reject')) AS accepted, arg_max(value, (ts, event_id)) FILTER (feedback_type = 'modify_start') AS start_shift, arg_max(value, (ts, event_id)) FILTER (feedback_type = 'modify_end') AS end_shift, coalesce(bool_or(feedback_type = 'lock'), false) AS locked FROM fb GROUP BY clip_id""")
def apply_feedback(spark, sf):
    return pl.fold_feedback(feedback(spark, sf))


@query(f"WITH {FEEDBACK} SELECT event_id, clip_id, feedback_type FROM fb WHERE feedback_type = 'reject' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_feedback(spark, sf):
    """The newest 100 rows of one kind."""
    return rp.page(feedback(spark, sf), [F.desc("ts"), F.desc("event_id")], 0, 100, F.col("feedback_type") == "reject").select("event_id", "clip_id", "feedback_type")


@query(SQL["recent_feedback"].replace("= 'reject'", "<> 'lock'"))
def recent_feedback_all(spark, sf):
    """The newest 100 rows of all kinds but one."""
    return rp.page(feedback(spark, sf), [F.desc("ts"), F.desc("event_id")], 0, 100, F.col("feedback_type") != "lock").select("event_id", "clip_id", "feedback_type")


@query(f"WITH {TE} SELECT asset_id, event_id, confidence FROM te WHERE confidence >= 0.5 AND event_type = 'speech' ORDER BY confidence DESC, event_id LIMIT 50 OFFSET 100")
def list_candidates(spark, sf):
    """One page of a filtered and sorted listing."""
    e = fx.timeline_events(spark, sf)
    wanted = (F.col("confidence") >= 0.5) & (F.col("event_type") == "speech")
    return rp.page(e, [F.desc("confidence"), F.col("event_id")], 2, 50, wanted).select("asset_id", "event_id", "confidence")


@query(f"WITH {CLIPS}, t AS (SELECT *, lead(start_us) OVER (PARTITION BY plan_id ORDER BY position, clip_id) - end_us AS s FROM clips) SELECT plan_id, count(*) AS n, count_if(s > 0)::BIGINT AS forward, coalesce(sum(s) FILTER (s > 0), 0)::BIGINT AS total_us, coalesce(max(s) FILTER (s > 0), 0) AS max_us, round(coalesce(avg(s) FILTER (s > 0), 0) / 1000000, 4) AS mean_s FROM t WHERE s IS NOT NULL GROUP BY 1")
def transition_audit(spark, sf):
    return pl.transition_audit(fx.clips(spark, sf), PLAN)


@query(f"WITH {CLIPS}, {PRUNED}, a AS (SELECT plan_id, count(*) AS n, max(budget_us) AS budget_us FROM pr0 GROUP BY 1), b AS (SELECT plan_id, count(*) AS k, sum(duration_us)::BIGINT AS selected_us FROM pruned GROUP BY 1) SELECT plan_id, coalesce(selected_us, 0) AS selected_us, n - coalesce(k, 0) AS dropped, CASE WHEN budget_us > 0 THEN round(coalesce(selected_us, 0) / budget_us, 4) ELSE 0 END AS pressure FROM a LEFT JOIN b USING (plan_id)")
def budget_pressure(spark, sf):
    """Selected time over the target, and candidates that were not selected."""
    c = fx.clips(spark, sf)
    return rp.budget_pressure(c, PLAN, budget(c))


@query(f"WITH {CLIPS}, {ANCHORS} SELECT plan_id, count(DISTINCT start_us // 900000000) AS bins, array_to_string(list_sort(list(DISTINCT start_us // 900000000)), ',') AS bin_list, bool_or(coalesce(anchor = 'greeting', false)) AS greeting, bool_or(coalesce(anchor = 'game_start', false)) AS game_start, bool_or(coalesce(anchor = 'outro', false)) AS outro, CASE WHEN count_if(clip_id % 4 = 0) > 0 THEN round(count_if(clip_id % 4 = 0 AND clip_id % 6 <> 0) / count_if(clip_id % 4 = 0), 4) ELSE 1 END AS setup_share, round((max(end_us) - min(start_us)) / 3600000000, 4) AS span_h FROM anchored GROUP BY 1")
def plan_breadth(spark, sf):
    c = fx.clips(spark, sf).withColumns({"is_setup": F.expr("clip_id % 4 = 0"), "rejected": F.expr("clip_id % 6 = 0")})
    return pl.plan_breadth(pl.tag_anchors(c, PLAN), PLAN)


@query(f"WITH {TE}, g AS (SELECT asset_id, count(*) AS n, sum(end_us - start_us)::BIGINT AS us, max(end_us) AS d FROM te GROUP BY 1), h AS (SELECT asset_id, round(n * 3600000000 / d, 4) AS per_hour, round(us * 3600.0::DOUBLE / d, 4) AS seconds_per_hour FROM g WHERE d > 0) SELECT count(*) AS n, round(avg(per_hour), 4) AS mean_per_hour, round(quantile_cont(per_hour, 0.95), 4) AS p95_per_hour, round(avg(seconds_per_hour), 4) AS mean_seconds FROM h")
def density_per_hour(spark, sf):
    """Events and event seconds by hour of recording: mean and 95th percentile over recordings."""
    e = fx.timeline_events(spark, sf)
    return rp.density_per_hour(e, BY, e.groupBy("asset_id").agg(F.max("end_us").alias("horizon_us")))


DEPS = "deps AS (SELECT o_orderkey AS dependent, CASE WHEN o_orderkey % 41 = 0 THEN -o_orderkey ELSE o_orderkey + 3 END AS prerequisite FROM orders WHERE o_orderkey % 5 = 0)"


def _round(k: int) -> str:
    return f"""n{k} AS (SELECT d.prerequisite AS clip_id, arg_min(c.priority, (c.round, c.start_us, c.clip_id)) AS dp, arg_min(c.locked, (c.round, c.start_us, c.clip_id)) AS dl FROM r{k - 1} c JOIN deps d ON d.dependent = c.clip_id WHERE d.prerequisite NOT IN (SELECT clip_id FROM r{k - 1}) GROUP BY 1),
 r{k} AS (SELECT * FROM r{k - 1} UNION ALL SELECT n.clip_id, c.start_us, c.end_us, CASE WHEN dp = 'essential' THEN 'essential' ELSE 'context_only' END, dl, {k} FROM n{k} n JOIN clips c USING (clip_id))"""


@query(f"WITH {CLIPS}, {DEPS}, r0 AS (SELECT clip_id, start_us, end_us, priority, locked, 0 AS round FROM clips WHERE clip_id % 2 = 0), {_round(1)}, {_round(2)}, {_round(3)} SELECT * FROM r3 WHERE clip_id NOT IN (SELECT dependent FROM deps WHERE prerequisite NOT IN (SELECT clip_id FROM clips))")
def resolve_dependencies(spark, sf):
    c = fx.clips(spark, sf)
    deps = c.where("clip_id % 5 = 0").selectExpr("clip_id as dependent", "case when clip_id % 41 = 0 then -clip_id else clip_id + 3 end as prerequisite")
    return pl.resolve_dependencies(c.where("clip_id % 2 = 0"), c, deps)


_AT = "(start_us, clip_id)"


@query(f"""WITH {CLIPS}, sc AS (SELECT *, confidence / 100.0::DOUBLE + clip_id % 7 / 10.0::DOUBLE AS score FROM clips), sel AS (SELECT * FROM clips WHERE clip_id % 2 = 0), {ANCHORS.replace("FROM clips", "FROM sel")}, {DEPS},
 r0 AS (SELECT clip_id, start_us, end_us, CASE WHEN anchor IS NOT NULL THEN 'essential' ELSE 'high' END AS priority, locked, 0 AS round FROM anchored), {_round(1)}, {_round(2)}, {_round(3)}, res AS (SELECT * FROM r3 WHERE clip_id NOT IN (SELECT dependent FROM deps WHERE prerequisite NOT IN (SELECT clip_id FROM clips))),
 whole AS (SELECT s.plan_id, res.clip_id, res.start_us, res.end_us, CASE res.priority WHEN 'essential' THEN 1 WHEN 'high' THEN 2 ELSE 5 END AS level, res.locked, score FROM res JOIN sc s USING (clip_id)),
 f AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER w BETWEEN 0 AND 8000000 THEN 0 ELSE 1 END AS new FROM whole WINDOW w AS (PARTITION BY plan_id ORDER BY start_us, clip_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY plan_id ORDER BY start_us, clip_id ROWS UNBOUNDED PRECEDING) AS chain FROM f),
 ch AS (SELECT plan_id, arg_max(end_us, {_AT}) AS end_us, min(start_us) AS start_us, arg_min(clip_id, {_AT}) AS clip_id, CASE WHEN min(level) = 1 THEN 1 ELSE arg_min(level, {_AT}) END AS level, arg_min(locked, {_AT}) AS locked, arg_min(score, {_AT}) AS confidence FROM g GROUP BY plan_id, chain),
 cl2 AS (SELECT *, end_us - start_us AS duration_us, row_number() OVER (PARTITION BY plan_id ORDER BY start_us, clip_id) AS position FROM ch), {PRUNED.replace("FROM clips JOIN bud", "FROM cl2 JOIN bud")},
 pk AS (SELECT *, coalesce(sum(duration_us) OVER w, 0)::BIGINT AS output_start_us, (coalesce(sum(duration_us) OVER w, 0) + duration_us)::BIGINT AS output_end_us FROM pruned WINDOW w AS (PARTITION BY plan_id ORDER BY position, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 tt AS (SELECT plan_id, sum(duration_us)::BIGINT AS selected_us, count(*) AS clip_count FROM pk GROUP BY 1), og AS (SELECT plan_id, sum(end_us - start_us)::BIGINT AS original_us FROM clips GROUP BY 1)
 SELECT plan_id, clip_id, level, start_us, end_us, output_start_us, output_end_us, original_us, selected_us, clip_count, CASE WHEN original_us > 0 THEN round(selected_us / original_us, 4) ELSE 1 END AS compression FROM pk JOIN tt USING (plan_id) JOIN og USING (plan_id)""")
def build_plan(spark, sf):
    """Scores, anchors, prerequisites, bridges, pruning and the output clock of plans of every second candidate, with totals."""
    c = fx.clips(spark, sf)
    scored = c.withColumn("importance", F.col("confidence") / 100.0).withColumn("story_value", F.col("clip_id") % 7 / 10.0)
    deps = c.where("clip_id % 5 = 0").selectExpr("clip_id as dependent", "case when clip_id % 41 = 0 then -clip_id else clip_id + 3 end as prerequisite")
    return pl.build_plan(scored.where("clip_id % 2 = 0"), scored, deps, PLAN, budget(c))


@query(f"WITH {TE}, {AI}, {merged_sql('ai', 'm')}, t AS (SELECT asset_id, sum(end_us - start_us)::BIGINT AS total_us FROM m GROUP BY 1) SELECT asset_id, event_id, row_number() OVER (PARTITION BY asset_id ORDER BY start_us, event_id) AS position, total_us FROM ai JOIN t USING (asset_id)")
def ai_timeline(spark, sf):
    """Clips in source order with the merged total of their recording."""
    return rp.ai_timeline(fx.ai_intervals(spark, sf), BY).select("asset_id", "event_id", "position", "total_us")


@query(f"WITH {CLIPS} SELECT plan_id, clip_id, substr(md5(concat_ws('|', CAST(clip_id AS VARCHAR), '7')), 1, 1) >= '8' AS swapped FROM clips")
def blind_assign(spark, sf):
    return pl.blind_assign(fx.clips(spark, sf).select("plan_id", "clip_id"), "clip_id", 7)


@query("WITH c AS (SELECT DISTINCT user_id AS case_id, list_extract(['REFERENCE', 'VALIDATION', 'TEST'], CAST(user_id % 3 + 1 AS INTEGER)) AS split, user_id % 2 = 0 AS consumed FROM events) SELECT case_id, CASE WHEN split = 'TEST' AND consumed THEN 'VALIDATION' ELSE split END AS split, consumed FROM c WHERE split <> 'REFERENCE'")
def eval_split(spark, sf):
    c = fx.table(spark, sf, "events").select("user_id").distinct().selectExpr("user_id as case_id", "element_at(array('REFERENCE', 'VALIDATION', 'TEST'), cast(user_id % 3 + 1 as int)) as split", "user_id % 2 = 0 as consumed")
    return pl.eval_split(c)


@query(f"""WITH {TE}, {BLOCKS}, r AS (SELECT asset_id, 'RETAINED' AS decision, source_start_us AS start_us, source_end_us AS end_us FROM blocks), {merged_sql('r', 'm')}, g AS (SELECT asset_id, coalesce(lag(end_us) OVER (PARTITION BY asset_id ORDER BY start_us), 0) AS g0, start_us AS g1 FROM m)
 SELECT * FROM r UNION ALL SELECT asset_id, 'OMITTED', g0, g1 FROM g WHERE g1 - g0 > 100000""")
def infer_decisions(spark, sf):
    """A RETAINED decision for each block, an OMITTED one for each gap up to the last block."""
    return rp.infer_decisions(fx.blocks(spark, sf), BY)


@query("SELECT conv_id, turn, CASE WHEN length(text) * 0.06 < 2 OR contains(lower(text), 'silence') THEN 'invalid' ELSE 'valid' END AS verdict FROM conversations")
def verdict_rule(spark, sf):
    """Invalid if short or about silence, else valid."""
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", F.when((F.length("text") * 0.06 < 2) | F.lower("text").contains("silence"), "invalid").otherwise("valid").alias("verdict"))



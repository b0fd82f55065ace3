"""Queries of sources, series, streams, experiments and composites, with their SQL."""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import AI, BLOCKS, HUMAN, SEGMENTS, TE, merged_sql
from ..functions.scalar import f1, r4, share
from ..functions.udf import score_with
from ..operators import candidates as ca
from ..operators import evaluation as ev
from ..operators import intervals as iv
from ..operators import metrics as mt
from ..operators import planning as pl
from ..operators import reports as rp
from ..operators import rules as ru
from ..operators import sequence as sq
from ..operators import series as se
from ..sources import io
from ..sources.shared import new_table as scratch
from ..sources.shared import settled
from ..streaming import jobs
from .intervals import METRICS
from .intervals import SQL as INTERVALS_SQL
from .planning import FEEDBACK, feedback
from .rules import CATEGORY, _rank_sql, _scored_sql
from .sequence import SQL as SEQUENCE_SQL
from .sequence import expand_ctes, expanded

BY = ["asset_id"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Sources and sinks


@query(f"WITH {SEGMENTS} SELECT speaker AS text, count(*) AS n, min(start_us) AS first_us, max(end_us) AS last_us FROM segments GROUP BY 1")
def src_words(spark, sf):
    """Words of conversations written as JSON arrays, one a line, and read back."""
    path = scratch(spark, "words")
    c = fx.transcript_segments(spark, sf)
    words = c.select("asset_id", F.col("speaker").alias("text"), (F.col("start_us") / 1_000_000).alias("start"), (F.col("end_us") / 1_000_000).alias("end"))
    words.groupBy("asset_id").agg(F.to_json(F.collect_list(F.struct("text", "start", "end"))).alias("value")).select("value").write.text(path)
    return io.read_words(spark, path, lines=True).groupBy("text").agg(F.count("*").alias("n"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))


@query(f"WITH {TE}, {BLOCKS} SELECT count(*) AS n, count_if(asset_id % 3 <> 0)::BIGINT AS with_edit, sum(source_end_us - source_start_us)::BIGINT AS source_us FROM blocks")
def src_blocks(spark, sf):
    """Ground truth records, some with blocks, some a bare list of blocks and some with retained intervals alone."""
    path = scratch(spark, "truth")
    b = fx.blocks(spark, sf)
    s = lambda c: (F.col(c) / 1_000_000).alias(c[:-3])
    g = b.groupBy("asset_id").agg(F.collect_list(F.struct(s("source_start_us"), s("source_end_us"), s("edit_start_us"), s("edit_end_us"), F.col("speed").cast("double").alias("speed_ratio"))).alias("all"))
    kept = F.expr("case when asset_id % 3 <> 0 then all end")
    bare = F.expr("case when asset_id % 3 = 0 then transform(all, x -> named_struct('source_start', x.source_start, 'source_end', x.source_end)) end")
    record = F.to_json(F.struct(kept.alias("blocks"), bare.alias("retained_intervals")))
    g.select(F.when(F.expr("asset_id % 3 = 1"), F.to_json("all")).otherwise(record).alias("value")).write.text(path)
    t = io.truth_blocks(io.read_truth(spark, path, lines=True))
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    return t.agg(F.count("*").alias("n"), F.count("edit_start").alias("with_edit"), F.sum(us("source_end") - us("source_start")).alias("source_us"))


@query(f"WITH {TE} SELECT event_id, event_type, start_us, end_us FROM te WHERE asset_id = 7")
def scan_asset(spark, sf):
    """One recording's rows in time order; the filter reaches the scan."""
    return rp.scan_asset(fx.timeline_events(spark, sf), "asset_id", 7).select("event_id", "event_type", "start_us", "end_us")


@query(f"WITH {TE} SELECT DISTINCT sha256(concat_ws('|', CAST(asset_id AS VARCHAR), event_type)) AS signature, asset_id, event_type FROM te")
def idempotent_append(spark, sf):
    """Two appends of the same derived rows store them once."""
    path = scratch(spark, "signed")
    e = fx.timeline_events(spark, sf)
    rows = e.select(ru.signature(F.col("asset_id"), F.col("event_type")).alias("signature"), "asset_id", "event_type").distinct()
    io.write_idempotent(rows.where("asset_id % 2 = 0"), path, "signature")
    return io.write_idempotent(rows, path, "signature")


@query(f"WITH {TE}, r AS (SELECT DISTINCT asset_id FROM te WHERE asset_id % 2 = 1 AND event_id % 2 = 0) SELECT asset_id, event_id, CASE WHEN r.asset_id IS NULL THEN 1 ELSE 2 END AS version FROM te LEFT JOIN r USING (asset_id) WHERE r.asset_id IS NULL OR event_id % 2 = 0")
def replace_asset(spark, sf):
    """New rows for odd recordings replace theirs and leave the others."""
    path = scratch(spark, "assets")
    e = fx.timeline_events(spark, sf).select("asset_id", "event_id", F.lit(1).alias("version"))
    io.replace_asset(e, path, "asset_id")
    out = io.replace_asset(e.where("asset_id % 2 = 1 and event_id % 2 = 0").withColumn("version", F.lit(2)), path, "asset_id")
    return out.select(F.col("asset_id").cast("long").alias("asset_id"), "event_id", "version")


@query("WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, 0 AS s, o_orderkey % 4 AS v, 0 AS n FROM orders WHERE o_orderkey % 3 <> 0), w AS (SELECT o_orderkey AS k, o_custkey + 1 AS c, 1 AS s, o_orderkey % 5 AS v, 1 AS n FROM orders WHERE o_orderkey % 2 = 0), u AS (SELECT * FROM o UNION ALL SELECT * FROM w) SELECT k, c, s, v FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC, n DESC) = 1")
def upsert_latest(spark, sf):
    o = fx.table(spark, sf, "orders")
    old = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey as k", "o_custkey as c", "0 as s", "o_orderkey % 4 as v")
    new = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey as k", "o_custkey + 1 as c", "1 as s", "o_orderkey % 5 as v")
    return io.upsert_latest(old, new, ["k"], "v")


_SYNC = """c AS (SELECT c_custkey AS k, c_custkey % 5 AS v FROM customer WHERE c_custkey % 7 <> 0), o AS (SELECT o_orderkey AS k, o_custkey AS p, o_orderkey % 3 + 1 AS v FROM orders), held AS (SELECT k FROM c UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)"""


@query(f"""WITH {_SYNC}, cs AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 AND (c_custkey % 7 = 0 OR c_custkey % 5 <= 2) THEN 2 ELSE c_custkey % 5 END AS v FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 7 <> 0), os AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 2 = 0 THEN CASE WHEN o_custkey IN (SELECT k FROM cs) AND o_orderkey % 3 + 1 > 2 THEN 3 ELSE 2 END ELSE o_orderkey % 3 + 1 END AS v FROM orders WHERE o_custkey IN (SELECT k FROM cs)) SELECT 'customers' AS name, k, v FROM cs UNION ALL SELECT 'orders', k, v FROM os""")
def sync_tables(spark, sf):
    """Customers and their orders brought into a store that holds a part of both; orders of missing customers stay out."""
    c, o, path = fx.table(spark, sf, "customer"), fx.table(spark, sf, "orders"), scratch(spark, "store")
    keys, parents = {"customers": ["k"], "orders": ["k"]}, {"orders": [("customers", ["p"])]}
    first = {"customers": c.where("c_custkey % 2 = 0").selectExpr("c_custkey as k", "2L as v"), "orders": o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey as k", "o_custkey as p", "2L as v")}
    io.sync_tables(first, path, keys, parents, "v")
    then = {"orders": o.selectExpr("o_orderkey as k", "o_custkey as p", "o_orderkey % 3 + 1 as v"), "customers": c.where("c_custkey % 7 <> 0").selectExpr("c_custkey as k", "c_custkey % 5 as v")}
    out = io.sync_tables(then, path, keys, parents, "v")
    return out["customers"].selectExpr("'customers' as name", "k", "v").unionByName(out["orders"].selectExpr("'orders' as name", "k", "v"))


@query(f"SELECT asset_id, n, cuts_per_min FROM ({INTERVALS_SQL['pacing_metrics']})")
def report_json(spark, sf):
    """A nested report for each recording, written as JSON and read back."""
    path = scratch(spark, "report")
    g = mt.pacing_metrics(fx.ai_intervals(spark, sf), BY)
    io.write_report(g.select("asset_id", F.struct("n", "cuts_per_min").alias("pacing")), path)
    return spark.read.schema("asset_id long, pacing struct<n:long,cuts_per_min:double>").json(path).select("asset_id", "pacing.*")


@query("WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT DISTINCT sha256(text) AS key, length(text) AS result FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, result, c.key IS NOT NULL AS hit FROM k LEFT JOIN c USING (key)")
def result_cache_lookup(spark, sf):
    d = fx.table(spark, sf, "documents")
    cache = d.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("key"), F.length("text").alias("result")).distinct()
    return io.cached_results(d.select("doc_id", F.sha2("text", 256).alias("key")), cache, "key").select("doc_id", "result", "hit")


# Series

SERIES = "ser AS (SELECT asset_id, start_us AS t_us, (event_id * 37 % 100) / 100.0::DOUBLE AS value FROM te)"


def series(spark, sf):
    return fx.timeline_events(spark, sf).selectExpr("asset_id", "start_us as t_us", "event_id * 37 % 100 / 100.0d as value")


@query(f"""WITH {TE}, {SERIES}, l AS (SELECT asset_id, greatest(0.15, quantile_cont(value, 0.5) + 1.5 * stddev_pop(value)) AS threshold FROM ser GROUP BY 1), s AS (SELECT ser.*, threshold, value >= threshold AND value > 0.05 AS hot, coalesce(lag(t_us) OVER w, t_us) AS before, coalesce(lead(t_us) OVER w, t_us) AS after FROM ser JOIN l USING (asset_id) WINDOW w AS (PARTITION BY asset_id ORDER BY t_us)),
 c AS (SELECT *, CASE WHEN lag(hot) OVER (PARTITION BY asset_id ORDER BY t_us) = hot THEN 0 ELSE 1 END AS ch FROM s), r AS (SELECT *, sum(ch) OVER (PARTITION BY asset_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS run FROM c), g AS (SELECT asset_id, run, threshold, min(before) AS start_us, max(after) AS end_us, max(value) AS peak, count(*) AS n FROM r WHERE hot GROUP BY 1, 2, 3)
 SELECT asset_id, start_us, end_us, n, round(least(0.98, greatest(0.70, 0.70 + 0.15 * least(2, peak / threshold - 1))), 4) AS confidence FROM g WHERE end_us - start_us >= 400000""")
def burst_intervals(spark, sf):
    return se.burst_intervals(series(spark, sf), BY)


@query(f"""WITH {TE}, s AS (SELECT asset_id, start_us AS t_us, event_id % 10 // 7 AS value FROM te), c AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY asset_id ORDER BY t_us) = value THEN 0 ELSE 1 END AS ch FROM s), r AS (SELECT *, sum(ch) OVER (PARTITION BY asset_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS run FROM c)
 SELECT asset_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n FROM r GROUP BY asset_id, run HAVING max(t_us) - min(t_us) >= 500000""")
def flat_runs(spark, sf):
    return se.flat_runs(fx.timeline_events(spark, sf).selectExpr("asset_id", "start_us as t_us", "event_id % 10 div 7 as value"), BY)


_SHIFT = "CASE WHEN block_id % 4 = 0 THEN 700000 ELSE 0 END"


@query(f"WITH {TE}, {BLOCKS}, s AS (SELECT asset_id, block_id, edit_start_us, edit_end_us - {_SHIFT} AS edit_end_us, edit_start_us AS source_start_us, edit_end_us + 100000 AS source_end_us FROM blocks), l AS (SELECT *, lead(edit_start_us) OVER w AS ne, lead(source_start_us) OVER w AS ns FROM s WINDOW w AS (PARTITION BY asset_id ORDER BY edit_start_us, block_id)) SELECT asset_id, edit_end_us AS start_us, ne AS end_us, source_end_us AS source_us FROM l WHERE ne - edit_end_us > 500000 AND abs(ns - source_end_us) < 200000")
def freeze_gaps(spark, sf):
    b = fx.blocks(spark, sf).selectExpr("asset_id", "block_id", "edit_start_us", f"edit_end_us - {_SHIFT} as edit_end_us", "edit_start_us as source_start_us", "edit_end_us + 100000 as source_end_us")
    return se.freeze_gaps(b, BY)


@query(f"WITH {TE}, {SERIES}, b AS (SELECT asset_id, t_us // 10000000 AS bin, sum(CAST(round(value * 100) AS BIGINT)) / (100.0::DOUBLE * count(*)) AS level FROM ser GROUP BY 1, 2) SELECT asset_id, bin, round(level, 4) AS level, round(avg(level) OVER (PARTITION BY asset_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth FROM b")
def envelope(spark, sf):
    return se.envelope(series(spark, sf), BY, rate_us=10_000_000)


@query()
def best_lag(spark, sf):
    """Overlapping chunks over each recording's whole level series, found again in the series."""
    s = series(spark, sf).groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_us", "value"))), lambda x: x["value"]).alias("levels"))
    return se.best_lag(se.chunks_of(s, BY), s, BY)


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 5 = 0), s AS (SELECT vec_id AS source_id, label, embedding AS g FROM embeddings WHERE vec_id % 5 <> 0), p AS (SELECT e.label, vec_id AS frame_id, source_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - g[i]::DOUBLE))) / 64, 4) AS difference FROM e JOIN s USING (label))
 SELECT label, frame_id, source_id, difference FROM p WHERE difference < 40 QUALIFY row_number() OVER (PARTITION BY label, frame_id ORDER BY difference, source_id) = 1""")
def fingerprint_match(spark, sf):
    v = fx.table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("frame_id"), F.col("embedding").alias("f"))
    return se.fingerprint_match(v.where("frame_id % 5 = 0"), v.where("frame_id % 5 <> 0"), ["label"])


# Evaluation over cases and experiments

LAYERS = ["speech", "gameplay_clutch", "silence"]
_SUPPORTED = """hs AS (SELECT h.asset_id, h.event_id, h.end_us - h.start_us AS len, coalesce(sum(CASE WHEN a.event_id IS NOT NULL THEN least(h.end_us, a.end_us) - greatest(h.start_us, a.start_us) END), 0)::BIGINT AS s FROM human h LEFT JOIN ai a ON h.asset_id = a.asset_id AND h.start_us < a.end_us AND a.start_us < h.end_us GROUP BY ALL),
 ais AS (SELECT a.asset_id, a.event_id, a.end_us - a.start_us AS len, coalesce(sum(CASE WHEN h.event_id IS NOT NULL THEN least(h.end_us, a.end_us) - greatest(h.start_us, a.start_us) END), 0)::BIGINT AS s FROM ai a LEFT JOIN human h ON h.asset_id = a.asset_id AND h.start_us < a.end_us AND a.start_us < h.end_us GROUP BY ALL),
 hv AS (SELECT *, CASE WHEN s * 10 >= len * 7 OR len - s <= 1000000 THEN 'matched' WHEN s > 0 THEN 'partial' ELSE 'missed' END AS verdict FROM hs), av AS (SELECT *, CASE WHEN s * 10 >= len * 7 OR len - s <= 1000000 THEN 'matched' WHEN s > 0 THEN 'partial' ELSE 'missed' END AS verdict FROM ais)"""
_SEEN = "visual AS (SELECT * FROM te WHERE event_type = 'face_reaction' AND confidence >= 0.5), said AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'only Silence' WHEN 1 THEN 'a repetitive beat' WHEN 2 THEN 'dead_air' END AS why FROM ai), vd AS (SELECT asset_id, event_id, end_us - start_us >= 500000 AND event_id % 5 > 1 AND NOT contains(lower(coalesce(why, '')), 'silence') AS valid, why FROM said WHERE event_id % 7 <> 0)"


def _at(layer: str) -> str:
    return f"EXISTS (SELECT 1 FROM {layer} b WHERE b.asset_id = h.asset_id AND h.start_us < b.end_us AND b.start_us < h.end_us)"


_FAILED = f"""{_SUPPORTED}, {_SEEN}, es AS (SELECT * FROM te WHERE event_type = 'speech'), cs0 AS (SELECT * FROM te WHERE event_type = 'gameplay_clutch'), ns AS (SELECT * FROM te WHERE event_type = 'silence'),
 fl AS (SELECT h.asset_id, h.event_id, 'human' AS side, CASE WHEN NOT {_at('es')} THEN 'M2:MISSED_IMPORTANT_EVENT' WHEN NOT {_at('cs0')} AND {_at('visual')} THEN 'M3:MISSING_VISUAL_EVENT' WHEN NOT {_at('cs0')} THEN 'M3:LOW_SCORE' WHEN NOT {_at('ns')} THEN 'M4:DEPENDENCY_FAILURE' ELSE 'M5:BUDGET_EXCLUSION' END AS cause FROM human h JOIN hv USING (asset_id, event_id) WHERE verdict = 'missed'
 UNION ALL SELECT asset_id, event_id, 'ai', CASE WHEN coalesce(valid, FALSE) THEN 'M5:VALID_ALTERNATIVE' WHEN contains(upper(why), 'DEAD_AIR') OR contains(upper(why), 'SILENCE') THEN 'M5:DEAD_AIR' WHEN contains(upper(why), 'REPETITIVE') THEN 'M5:REPETITIVE' ELSE 'M5:LOW_INFORMATION' END FROM av LEFT JOIN vd USING (asset_id, event_id) WHERE verdict = 'missed')"""


def _layers(spark, sf):
    e = fx.timeline_events(spark, sf)
    said = fx.ai_intervals(spark, sf).withColumn("reason", F.expr("case event_id % 5 when 0 then 'only Silence' when 1 then 'a repetitive beat' when 2 then 'dead_air' end"))
    verdicts = ev.rule_verdicts(said, BY).withColumn("valid", F.col("valid") & F.expr("event_id % 5 > 1")).where("event_id % 7 <> 0")
    return ev.Layers(*[fx.of_types(e, kind) for kind in LAYERS], fx.of_types(e, "face_reaction").where("confidence >= 0.5"), verdicts)


@query(f"WITH {TE}, {AI}, {HUMAN}, {_FAILED} SELECT asset_id, event_id, side, split_part(cause, ':', 1) AS stage, split_part(cause, ':', 2) AS reason FROM fl")
def failure_table(spark, sf):
    """Every human interval without support and the step at fault, and every AI interval without and what is wrong with it."""
    return ev.failures(fx.ai_intervals(spark, sf), fx.human_intervals(spark, sf), _layers(spark, sf), BY)


_STORY = f"""story AS (SELECT asset_id, event_id AS node, start_us, end_us, CASE WHEN event_id % 4 < 3 THEN 't' || (event_id % 7) END AS thread, event_id % 3 = 0 AS is_setup, CASE WHEN event_id % 25 = 0 THEN -1 ELSE lead(event_id) OVER (PARTITION BY asset_id ORDER BY start_us, event_id) END AS payoff, event_id % 6 = 0 AS is_callback FROM te WHERE asset_id % 5 <> 0),
 ath AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN 't' || (event_id % 7) END AS thread FROM ai), {merged_sql('ai', 'nam')}, {merged_sql('human', 'nhm')},
 na AS (SELECT node FROM story n JOIN nam m ON n.asset_id = m.asset_id AND n.start_us < m.end_us AND m.start_us < n.end_us GROUP BY node, n.start_us, n.end_us HAVING 2 * sum(least(n.end_us, m.end_us) - greatest(n.start_us, m.start_us)) > n.end_us - n.start_us),
 nh AS (SELECT node FROM story n JOIN nhm m ON n.asset_id = m.asset_id AND n.start_us < m.end_us AND m.start_us < n.end_us GROUP BY node, n.start_us, n.end_us HAVING 2 * sum(least(n.end_us, m.end_us) - greatest(n.start_us, m.start_us)) > n.end_us - n.start_us),
 nk AS (SELECT s.*, s.node IN (SELECT node FROM na) AS a, s.node IN (SELECT node FROM nh) AS h, p.node IS NOT NULL AND p.node IN (SELECT node FROM na) AS pa, p.node IS NOT NULL AND p.node IN (SELECT node FROM nh) AS ph FROM story s LEFT JOIN story p ON p.asset_id = s.asset_id AND p.node = s.payoff),
 ng AS (SELECT asset_id, count(*) AS story_nodes, count_if(is_setup AND payoff IS NOT NULL)::BIGINT AS pairs, count_if(is_setup AND payoff IS NOT NULL AND a AND pa AND (NOT h OR ph))::BIGINT AS pairs_intact, count_if(is_callback)::BIGINT AS callbacks, count_if(is_callback AND a)::BIGINT AS callbacks_kept, coalesce(list_sort(list(DISTINCT thread) FILTER (h AND thread IS NOT NULL)), []) AS hl FROM nk GROUP BY 1),
 nt AS (SELECT asset_id, list_sort(list(thread)) AS al, string_agg(thread || ':' || us, ',' ORDER BY thread) AS thread_time FROM (SELECT asset_id, thread, sum(end_us - start_us)::BIGINT AS us FROM ath WHERE thread IS NOT NULL GROUP BY 1, 2) GROUP BY 1), nc AS (SELECT asset_id FROM ai UNION SELECT asset_id FROM human UNION SELECT asset_id FROM story),
 nf AS (SELECT asset_id, coalesce(story_nodes, 0) AS story_nodes, coalesce(pairs, 0) AS pairs, coalesce(pairs_intact, 0) AS pairs_intact, coalesce(callbacks, 0) AS callbacks, coalesce(callbacks_kept, 0) AS callbacks_kept, coalesce(al, []) AS al, coalesce(hl, []) AS hl, coalesce(thread_time, '') AS thread_time FROM nc LEFT JOIN ng USING (asset_id) LEFT JOIN nt USING (asset_id)),
 nm AS (SELECT asset_id, story_nodes, pairs, pairs_intact, CASE WHEN pairs > 0 THEN round(pairs_intact / pairs, 4) ELSE 1 END AS completeness, callbacks, callbacks_kept, CASE WHEN callbacks > 0 THEN round(callbacks_kept / callbacks, 4) ELSE 1 END AS callback_rate,
  array_to_string(list_filter(al, lambda x: list_contains(hl, x)), ',') AS shared_threads, array_to_string(list_filter(al, lambda x: NOT list_contains(hl, x)), ',') AS ai_threads, array_to_string(list_filter(hl, lambda x: NOT list_contains(al, x)), ',') AS human_threads, thread_time FROM nf)"""


def _story(spark, sf):
    e = fx.timeline_events(spark, sf).where("asset_id % 5 <> 0")
    after = F.lead("event_id").over(Window.partitionBy("asset_id").orderBy("start_us", "event_id"))
    return e.select("asset_id", F.col("event_id").alias("node"), "start_us", "end_us", F.expr("case when event_id % 4 < 3 then concat('t', event_id % 7) end").alias("thread"), F.expr("event_id % 3 = 0").alias("is_setup"), F.when(F.expr("event_id % 25 = 0"), -1).otherwise(after).alias("payoff"), F.expr("event_id % 6 = 0").alias("is_callback"))


def _threaded(spark, sf):
    return fx.ai_intervals(spark, sf).withColumn("thread", F.expr("case when event_id % 3 > 0 then concat('t', event_id % 7) end"))


@query(f"WITH {TE}, {AI}, {HUMAN}, {_STORY} SELECT * FROM nm")
def narrative_metrics(spark, sf):
    """Setups and payoffs, callbacks and threads of each case."""
    return mt.narrative_metrics(_threaded(spark, sf), fx.human_intervals(spark, sf), _story(spark, sf), BY)


_TOLS = ", ".join(f"max(CASE WHEN tol_us = {t} THEN {c} END) AS {c}_{n}" for c in ("precision", "recall", "f1") for t, n in ((500000, "500ms"), (1000000, "1s"), (2000000, "2s")))


@query(f"""WITH {TE}, {AI}, {HUMAN}, {METRICS}, {_FAILED}, {_STORY}, o AS (SELECT asset_id, {_TOLS} FROM om GROUP BY 1), hc AS (SELECT asset_id, count_if(verdict = 'matched')::BIGINT AS matched, count_if(verdict = 'partial')::BIGINT AS partial, count_if(verdict = 'missed')::BIGINT AS missed FROM hv GROUP BY 1),
 ac AS (SELECT asset_id, count_if(verdict = 'missed')::BIGINT AS ai_only FROM av GROUP BY 1), rs AS (SELECT asset_id, cause || ':' || count(*) AS x, CASE WHEN cause = 'M5:VALID_ALTERNATIVE' THEN count(*) ELSE 0 END AS ok FROM fl GROUP BY asset_id, cause), cs AS (SELECT asset_id, string_agg(x, ',' ORDER BY x) AS causes, sum(ok)::BIGINT AS valid_alternatives FROM rs GROUP BY 1),
 qs AS (SELECT a.asset_id, sum(s.end_us - s.start_us)::BIGINT AS q FROM ai a JOIN te s ON s.event_type = 'silence' AND s.asset_id = a.asset_id AND s.start_us >= a.start_us AND s.end_us <= a.end_us GROUP BY 1), qt AS (SELECT asset_id, sum(end_us - start_us)::BIGINT AS total FROM ai GROUP BY 1), qa AS (SELECT asset_id, coalesce(q, 0) AS quiet_us, CASE WHEN total > 0 THEN round(least(coalesce(q, 0) / total, 1), 4) ELSE 0 END AS quiet_share FROM qt LEFT JOIN qs USING (asset_id))
 SELECT o.*, list_extract(['REFERENCE', 'VALIDATION', 'TEST'], CAST(asset_id % 3 + 1 AS INTEGER)) AS split, coalesce(matched, 0) AS matched, coalesce(partial, 0) AS partial, coalesce(missed, 0) AS missed, coalesce(ai_only, 0) AS ai_only, coalesce(too_short, 0) AS too_short, coalesce(too_long, 0) AS too_long, coalesce(good, 0) AS good, mean_pre_s, mean_post_s, cuts_per_min, mean_clip_s, mean_gap_s, quiet_us, quiet_share, effects_matched, human_only, ai_effects_only, agreement, coalesce(causes, '') AS causes, coalesce(valid_alternatives, 0) AS valid_alternatives, story_nodes, pairs, pairs_intact, completeness, callbacks, callbacks_kept, callback_rate, shared_threads, ai_threads, human_threads, thread_time
 FROM o LEFT JOIN hc USING (asset_id) LEFT JOIN ac USING (asset_id) LEFT JOIN (SELECT asset_id, too_short, too_long, good, mean_pre_s, mean_post_s FROM ({INTERVALS_SQL["context_metrics"]})) USING (asset_id) LEFT JOIN (SELECT asset_id, cuts_per_min, mean_clip_s, mean_gap_s FROM ({INTERVALS_SQL["pacing_metrics"]})) USING (asset_id)
 LEFT JOIN qa USING (asset_id) LEFT JOIN (SELECT asset_id, matched AS effects_matched, human_only, ai_only AS ai_effects_only, agreement FROM ({INTERVALS_SQL["effect_metrics"]})) USING (asset_id) LEFT JOIN cs USING (asset_id) LEFT JOIN nm USING (asset_id) WHERE asset_id % 3 <> 0""")
def evaluate_cases(spark, sf):
    """One row for each case that may be evaluated: overlap at three tolerances, context, narrative, pacing, dead air, effects, support both ways and root causes."""
    from .intervals import effects

    e, fx_e = fx.timeline_events(spark, sf), effects(spark, sf)
    cases = ev.evaluate_cases(_threaded(spark, sf), fx.human_intervals(spark, sf), e, _layers(spark, sf), fx_e.where("event_id % 2 = 1"), fx_e.where("event_id % 2 = 0"), BY, _story(spark, sf))
    cases = cases.withColumn("split", F.expr("element_at(array('REFERENCE', 'VALIDATION', 'TEST'), cast(asset_id % 3 + 1 as int))")).withColumn("consumed", F.lit(False))
    return pl.eval_split(cases).drop("consumed")


@query(f"WITH {TE}, {BLOCKS}, c AS (SELECT *, source_start_us * 20 / 1000000 AS s, (edit_end_us - edit_start_us) / 1000000 AS e FROM blocks), k AS (SELECT *, {CATEGORY} AS category FROM c), g AS (SELECT category, count(*) AS n, sum(source_end_us - source_start_us)::BIGINT AS source_us, sum(edit_end_us - edit_start_us)::BIGINT AS edit_us FROM k GROUP BY 1) SELECT *, round(edit_us / sum(edit_us) OVER (), 4) AS edit_share FROM g")
def decision_map(spark, sf):
    """Source and edit time of each decision category, and its share of the edit."""
    return rp.decision_map(fx.blocks(spark, sf), F.col("source_start_us") * 20 / 1_000_000, (F.col("edit_end_us") - F.col("edit_start_us")) / 1_000_000)


@query(f"WITH {TE}, d AS (SELECT asset_id, start_us // 60000000 AS region, end_us - start_us AS us, CASE event_type WHEN 'speech' THEN 'KEEP' WHEN 'face_reaction' THEN 'KEEP_AS_PAYOFF' WHEN 'gameplay_clutch' THEN 'KEEP_AS_CONTEXT' ELSE 'DROP' END AS decision FROM te), g AS (SELECT asset_id, region, sum(CASE WHEN starts_with(decision, 'KEEP') THEN us ELSE 0 END)::BIGINT AS kept_us, sum(us)::BIGINT AS all_us FROM d GROUP BY 1, 2) SELECT asset_id, region, kept_us, CASE WHEN all_us > 0 THEN round(least(kept_us / all_us, 1), 4) ELSE 0 END AS kept_share FROM g")
def retention_by_region(spark, sf):
    """Kept time of each region by its decisions."""
    kind = F.expr("case event_type when 'speech' then 'KEEP' when 'face_reaction' then 'KEEP_AS_PAYOFF' when 'gameplay_clutch' then 'KEEP_AS_CONTEXT' else 'DROP' end")
    return rp.retention_by_region(fx.timeline_events(spark, sf).withColumn("decision", kind), BY)


@query(f"""WITH {TE}, e AS (SELECT *, list_extract(['zoom_face', 'zoom_region', 'speed_up', 'grayscale'], CAST(event_id // 2 % 4 + 1 AS INTEGER)) AS k FROM te), t AS (SELECT * FROM e WHERE event_id % 2 = 0), p AS (SELECT asset_id, event_id, k, start_us, end_us FROM e WHERE event_id % 2 = 1 UNION ALL SELECT asset_id, event_id, k, start_us + 300000, end_us FROM t WHERE event_id % 6 <> 0),
 m AS (SELECT t.event_id, t.k, p.event_id AS pid, row_number() OVER (PARTITION BY t.event_id ORDER BY abs(t.start_us - p.start_us) + abs(t.end_us - p.end_us), p.event_id) AS n FROM t JOIN p ON t.asset_id = p.asset_id AND t.k = p.k AND abs(t.start_us - p.start_us) + abs(t.end_us - p.end_us) < 1000000),
 c AS (SELECT k, count(*) AS tp, count(DISTINCT pid) AS used FROM m WHERE n = 1 GROUP BY 1), a AS (SELECT k, count(*) AS truths FROM t GROUP BY 1), b AS (SELECT k, count(*) AS preds FROM p GROUP BY 1), r AS (SELECT k AS effect_type, tp, truths - tp AS fn, preds - used AS fp, round(least(tp / (tp + preds - used), 1), 4) AS precision, round(least(tp / truths, 1), 4) AS recall FROM c JOIN a USING (k) JOIN b USING (k)) SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) ELSE 0 END AS f1 FROM r""")
def effect_detection_score(spark, sf):
    """By type: true effects with the nearest predicted one (start and end together within 1 s), and what is left over."""
    from .intervals import effects

    e = effects(spark, sf)
    t = e.where("event_id % 2 = 0")
    p = e.where("event_id % 2 = 1").unionByName(t.where("event_id % 6 <> 0").withColumn("start_us", F.col("start_us") + 300_000))
    return rp.effect_detection_score(t, p.withColumnRenamed("event_id", "found_id"), BY)


_SAME = "2 * (least(f.e, m.end_us) - m.start_us) > least(f.e - f.s, m.end_us - m.start_us)"


#: The largest cosine of each candidate's text with an earlier one's of its recording.
_REPEATED = r"""tw AS (SELECT asset_id, start_us, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM jt), tc AS (SELECT asset_id, start_us, term, count(*) AS n FROM tw GROUP BY ALL), td AS (SELECT asset_id, term, count(*) AS df FROM tc GROUP BY ALL), ti AS (SELECT asset_id, count(*) AS items FROM jt GROUP BY 1),
 t0 AS (SELECT tc.*, n * (ln((items + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1) AS v FROM tc JOIN td USING (asset_id, term) JOIN ti USING (asset_id)), tv AS (SELECT asset_id, start_us, term, v / sqrt(sum(v * v) OVER (PARTITION BY asset_id, start_us)) AS v FROM t0),
 sim AS (SELECT a.asset_id, a.start_us, b.start_us AS e, sum(a.v * b.v) AS s FROM tv a JOIN tv b ON a.asset_id = b.asset_id AND a.term = b.term AND b.start_us < a.start_us GROUP BY 1, 2, 3), top AS (SELECT asset_id, start_us, max(s) AS s FROM sim GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {TE}, {SEGMENTS}, {expand_ctes(False)}, m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start_us, end_us, cluster) AS rn FROM expanded),
 f AS (SELECT asset_id, rn, start_us AS s, end_us AS e, 1 AS grp FROM m WHERE rn = 1 UNION ALL SELECT m.asset_id, m.rn, CASE WHEN {_SAME} THEN f.s ELSE m.start_us END, CASE WHEN {_SAME} THEN greatest(f.e, m.end_us) ELSE m.end_us END, f.grp + CASE WHEN {_SAME} THEN 0 ELSE 1 END FROM f JOIN m ON m.asset_id = f.asset_id AND m.rn = f.rn + 1),
 cand AS MATERIALIZED (SELECT f.asset_id, min(s) AS start_us, max(e) AS end_us, array_to_string(list_sort(list(DISTINCT cl.event_id)), ',') AS evidence, array_to_string(list_sort(list(DISTINCT cl.event_type)), ',') AS signals FROM f JOIN m ON m.asset_id = f.asset_id AND m.rn = f.rn JOIN cl ON cl.asset_id = m.asset_id AND cl.cluster = m.cluster GROUP BY f.asset_id, f.grp), j AS (SELECT c.asset_id, c.start_us, c.end_us, c.evidence, c.signals, coalesce(sum(least(c.end_us, t.end_us) - greatest(c.start_us, t.start_us)) FILTER (t.event_type = 'speech'), 0) AS speech, count_if(t.event_type = 'face_reaction')::BIGINT AS reactions FROM cand c LEFT JOIN te t ON t.asset_id = c.asset_id AND c.start_us < t.end_us AND t.start_us < c.end_us GROUP BY ALL),
 sg AS (SELECT c.asset_id, c.start_us, g.text, g.start_us AS gs, g.sequence AS gq, CASE WHEN lag(g.speaker) OVER (PARTITION BY c.asset_id, c.start_us ORDER BY g.start_us, g.sequence) IS DISTINCT FROM g.speaker THEN 1 ELSE 0 END AS turn FROM cand c JOIN segments g ON g.asset_id = c.asset_id AND c.start_us < g.end_us AND g.start_us < c.end_us),
 tx AS (SELECT asset_id, start_us, string_agg(text, ' ' ORDER BY gs, gq) AS text, sum(turn)::BIGINT AS turns FROM sg GROUP BY 1, 2), jt AS MATERIALIZED (SELECT j.*, coalesce(text, '') AS text, round(coalesce(turns, 0) / (greatest(end_us - start_us, 100000) / 60000000.0::DOUBLE), 4) AS turns_per_min FROM j LEFT JOIN tx USING (asset_id, start_us)),
 {_REPEATED}, {_scored_sql('jt').replace("r AS (", "ruled AS (").replace(", s AS (", ", scored AS (").replace("FROM r)", "FROM ruled)")}, x AS (SELECT * REPLACE (CASE WHEN reactions > 0 THEN least(1, greatest(visual_interest, 0.60::DOUBLE + 0.15::DOUBLE * reactions)) ELSE visual_interest END AS visual_interest, CASE WHEN reactions > 0 THEN greatest(reaction, 0.75::DOUBLE) ELSE reaction END AS reaction, CASE WHEN reactions > 0 AND humor < 0.6 THEN 0.75::DOUBLE ELSE humor END AS humor) FROM scored), k AS (SELECT *, {_rank_sql('balanced')} AS rank FROM x)
 SELECT asset_id, start_us, end_us, round(speech / greatest(end_us - start_us, 100000), 4) AS speech_density, reactions, evidence, signals, turns_per_min, length(text) AS n_chars, coalesce(round((length(text) - length(replace(text, '!', ''))) / nullif(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')), 0), 4), 0) AS exclamations, coalesce(round(len(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) / nullif(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), 0), 4), 0) AS unique_ratio, rule, round(coalesce(top.s, 0), 4) AS text_repetition, rank, CASE WHEN score_confidence >= 0.7 THEN 'interesting' WHEN score_confidence >= 0.4 THEN 'uncertain' ELSE 'low_signal' END AS label, CASE WHEN score_confidence < 0.55 THEN 'eligible' ELSE 'none' END AS escalation, sha256(concat_ws('|', CAST(asset_id AS VARCHAR), CAST(start_us AS VARCHAR), CAST(end_us AS VARCHAR), evidence)) AS signature FROM k LEFT JOIN top USING (asset_id, start_us)""")
def generate_candidates(spark, sf):
    """Events to relational clusters, windows, expanded and merged candidates, features, transcript, rule scores, repetition, rank, label and signature, in one plan."""
    windows = sq.merge_overlapping(settled(expanded(spark, sf, False), "windows"), BY, order="cluster", unite=["signals", "evidence", "relations"])
    f = ca.score_candidates(windows, fx.timeline_events(spark, sf), fx.transcript_segments(spark, sf), BY)
    return f.select("asset_id", "start_us", "end_us", "speech_density", "reactions", F.array_join("evidence", ",").alias("evidence"), F.array_join("signals", ",").alias("signals"), "turns_per_min", F.col("text_length").alias("n_chars"), "exclamations", "unique_ratio", "rule", "text_repetition", "rank", "label", "escalation", "signature")


# Streams


def _stream(spark, df, name, files=1000, then=None):
    """df, and `then` after it, written to the shared folder and read as a stream of so many files at a time."""
    path = scratch(spark, name)
    df.write.parquet(path)
    if then is not None:
        time.sleep(1.1)  # files come in order of the second in which they were written
        then.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(stream, spark, name, mode="append"):
    out = scratch(spark, name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}-checkpoint")).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(SEQUENCE_SQL["cluster_by_gap"])
def stream_clusters(spark, sf):
    """Clusters of live events; a late marker event of its own key closes the sessions."""
    e = fx.timeline_events(spark, sf).select("asset_id", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("asset_id"), F.timestamp_micros(F.lit(10**13)).alias("start"), F.timestamp_micros(F.lit(10**13)).alias("end"))
    return _run(jobs.stream_clusters(_stream(spark, e.unionByName(end), "events")), spark, "clusters").where("asset_id >= 0").select("asset_id", F.expr("unix_micros(first)").alias("start_us"), F.expr("unix_micros(last)").alias("end_us"), "n")


@query(f"""WITH {TE}, {SERIES}, s AS (SELECT *, value >= 0.6 AS hot, coalesce(lag(t_us) OVER w, t_us) AS before, coalesce(lead(t_us) OVER w, t_us) AS after FROM ser WINDOW w AS (PARTITION BY asset_id ORDER BY t_us, value)),
 c AS (SELECT *, CASE WHEN lag(hot) OVER (PARTITION BY asset_id ORDER BY t_us, value) = hot THEN 0 ELSE 1 END AS ch FROM s), r AS (SELECT *, sum(ch) OVER (PARTITION BY asset_id ORDER BY t_us, value ROWS UNBOUNDED PRECEDING) AS run FROM c)
 SELECT asset_id, min(before) AS start_us, max(after) AS end_us, count(*) AS n, max(value) AS peak FROM r WHERE hot GROUP BY asset_id, run""")
def stream_bursts(spark, sf):
    """Runs of a live series whose samples come out of order, a file a batch; a late marker of its own key ends the open ones."""
    s = series(spark, sf).withColumn("t", F.timestamp_micros("t_us"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("asset_id"), F.lit(10**13).cast("long").alias("t_us"), F.lit(0.0).alias("value"), F.timestamp_micros(F.lit(10**13)).alias("t"))
    stream = _stream(spark, s.repartition(4, F.xxhash64("t_us")), "series", files=2, then=end)
    return _run(jobs.stream_bursts(stream, 0.6), spark, "bursts").where("asset_id >= 0")


@query(f"WITH {FEEDBACK} SELECT clip_id, max(event_id) AS event_id, arg_max(feedback_type, event_id) AS feedback_type FROM fb GROUP BY clip_id")
def stream_feedback(spark, sf):
    """The newest change of each clip, kept by micro-batches."""
    path = scratch(spark, "feedback")
    log = _stream(spark, feedback(spark, sf).select("clip_id", "event_id", "feedback_type").repartition(3, "event_id"), "log", files=1)
    jobs.stream_feedback(log, path, scratch(spark, "feedback-checkpoint"))
    return jobs.read_feedback(spark, path)


@query("SELECT conv_id, turn, length(text) AS size, length(text) > 400 AS long FROM conversations")
def score_with_model(spark, sf):
    """A user's own function over batches."""

    def size(pdf):
        n = pdf["text"].str.len()
        return pdf[["conv_id", "turn"]].assign(size=n, long=n > 400)

    return score_with(fx.table(spark, sf, "conversations"), size, "conv_id long, turn long, size long, long boolean")

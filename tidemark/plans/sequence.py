"""Queries of sequence operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import BLOCKS, SEGMENTS, TE, merged_sql
from ..operators import sequence as sq
from .rules import REL, relations

BY = ["asset_id"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {TE}, {merged_sql('te', 'm', 3_000_000)}, c AS (SELECT asset_id, island, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM m_2 GROUP BY 1, 2) SELECT asset_id, start_us, end_us, n FROM c")
def cluster_by_gap(spark, sf):
    return sq.cluster_by_gap(fx.timeline_events(spark, sf), BY)


CLUSTERS = f"""{REL}, ev AS (SELECT te.*, relation, relation_confidence FROM te LEFT JOIN (SELECT event_id, relation, relation_confidence FROM rel WHERE relation <> 'unrelated' AND relation_confidence >= 0.6) USING (event_id) WHERE event_type <> 'silence'),
 cl AS (SELECT *, sum(CASE WHEN relation IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY start_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM ev)"""


def clusters(spark, sf):
    return sq.cluster_by_relation(relations(spark, sf), fx.timeline_events(spark, sf).where("event_type <> 'silence'"), BY)


@query(f"WITH {TE}, {CLUSTERS} SELECT asset_id, event_id, cluster FROM cl")
def cluster_by_relation(spark, sf):
    return clusters(spark, sf).select("asset_id", "event_id", "cluster")


WINDOWS = f"""{CLUSTERS}, w0 AS (SELECT asset_id, cluster, min(start_us) AS s, max(end_us) AS e, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS signals, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS evidence, coalesce(array_to_string(list_sort(list(DISTINCT relation) FILTER (relation IS NOT NULL)), ','), '') AS relations, coalesce(round(avg(relation_confidence), 3), 1) AS confidence FROM cl GROUP BY 1, 2),
 w1 AS (SELECT *, CASE WHEN e - s < 8000000 THEN greatest(0, s - (8000000 - (e - s)) // 2) ELSE s END AS start_us FROM w0),
 win AS (SELECT asset_id, cluster, n, signals, evidence, relations, confidence, start_us, CASE WHEN e - s < 8000000 THEN start_us + 8000000 WHEN e - s > 120000000 THEN s + 120000000 ELSE e END AS end_us FROM w1)"""


@query(f"WITH {TE}, {WINDOWS} SELECT * FROM win")
def build_windows(spark, sf):
    w = sq.build_windows(clusters(spark, sf), BY)
    return w.withColumns({c: F.array_join(c, ",") for c in ("signals", "evidence", "relations")})


def expand_ctes(legacy: bool) -> str:
    pad = 1500000 if legacy else 3000000
    seg = "FROM te g WHERE g.asset_id = w.asset_id AND g.event_type = 'speech'"
    x0 = f"""x0 AS (SELECT *, coalesce((SELECT arg_min(start_us, (start_us, end_us)) {seg} AND start_us <= w.start_us AND w.start_us <= end_us), w.start_us) AS a, coalesce((SELECT arg_min(end_us, (start_us, end_us)) {seg} AND start_us <= w.end_us AND w.end_us <= end_us), w.end_us) AS b,
      (SELECT min(start_us) {seg} AND start_us <= w.start_us AND w.start_us - start_us <= {pad} AND end_us >= w.start_us - {pad}) AS bk FROM w)"""
    x1 = "x1 AS (SELECT *, CASE WHEN bk < a THEN bk ELSE a END AS a1 FROM x0)"
    if legacy:
        x2 = "x2 AS (SELECT *, a1 AS a2, b AS b2 FROM x1)"
    else:
        seg1 = seg.replace("w.", "x1.")
        x2 = f"x2 AS (SELECT *, greatest(a1, greatest(0, start_us - {pad})) AS a2, least(coalesce((SELECT arg_min(end_us, (start_us, end_us)) {seg1} AND end_us >= x1.end_us AND end_us - x1.end_us <= {pad} AND end_us > x1.b AND start_us <= x1.end_us + {pad}), b), end_us + {pad}) AS b2 FROM x1)"
    fw = "b2" if legacy else "coalesce((SELECT min(s) FROM sc WHERE sc.asset_id = x2.asset_id AND s >= x2.end_us AND s < x2.b2), b2)"
    x3 = f"x3 AS (SELECT asset_id, cluster, coalesce((SELECT max(s) FROM sc WHERE sc.asset_id = x2.asset_id AND s > x2.a2 AND s <= x2.start_us), a2) AS a3, {fw} AS b3 FROM x2)"
    return f"{WINDOWS}, w AS (SELECT asset_id, cluster, start_us, end_us FROM win), {x0}, {x1}, {x2}, {x3}, expanded AS (SELECT asset_id, cluster, a3 AS core_start_us, greatest(a3, b3) AS core_end_us, greatest(0, a3 - 5000000) AS start_us, greatest(a3, b3) + 5000000 AS end_us FROM x3)"


def _expand_sql(legacy: bool) -> str:
    return f"WITH {TE}, {expand_ctes(legacy)} SELECT * FROM expanded"


def expanded(spark, sf, legacy):
    e = fx.timeline_events(spark, sf)
    return sq.expand_context(sq.build_windows(clusters(spark, sf), BY), fx.of_types(e, "speech"), fx.of_types(e, "silence"), BY, ["cluster"], legacy=legacy)


def _expand(spark, sf, legacy):
    return expanded(spark, sf, legacy).select("asset_id", "cluster", "core_start_us", "core_end_us", "start_us", "end_us")


@query(_expand_sql(False))
def expand_context(spark, sf):
    return _expand(spark, sf, False)


@query(_expand_sql(True))
def expand_context_legacy(spark, sf):
    return _expand(spark, sf, True)


@query(f"""WITH RECURSIVE {TE}, w AS MATERIALIZED (SELECT asset_id, start_us, greatest(end_us, start_us + 8000000) AS end_us, confidence, event_type, event_id, row_number() OVER (PARTITION BY asset_id ORDER BY start_us, greatest(end_us, start_us + 8000000), event_id) AS rn FROM te),
 f AS (SELECT asset_id, rn, start_us AS s, end_us AS e, confidence AS c, 1 AS grp, event_type AS kind, event_id AS id FROM w WHERE rn = 1 UNION ALL
  SELECT w.asset_id, w.rn, CASE WHEN 2 * (least(f.e, w.end_us) - w.start_us) > least(f.e - f.s, w.end_us - w.start_us) THEN f.s ELSE w.start_us END, CASE WHEN 2 * (least(f.e, w.end_us) - w.start_us) > least(f.e - f.s, w.end_us - w.start_us) THEN greatest(f.e, w.end_us) ELSE w.end_us END,
   CASE WHEN 2 * (least(f.e, w.end_us) - w.start_us) > least(f.e - f.s, w.end_us - w.start_us) THEN least(f.c, w.confidence) ELSE w.confidence END, f.grp + CASE WHEN 2 * (least(f.e, w.end_us) - w.start_us) > least(f.e - f.s, w.end_us - w.start_us) THEN 0 ELSE 1 END, w.event_type, w.event_id FROM f JOIN w ON w.asset_id = f.asset_id AND w.rn = f.rn + 1)
 SELECT asset_id, min(s) AS start_us, max(e) AS end_us, min(c) AS confidence, count(*) AS n, array_to_string(list_sort(list(DISTINCT kind)), ',') AS signals, array_to_string(list_sort(list(id)), ',') AS evidence FROM f GROUP BY asset_id, grp""")
def merge_overlapping(spark, sf):
    w = fx.timeline_events(spark, sf).withColumn("end_us", F.greatest("end_us", F.col("start_us") + 8_000_000))
    w = w.withColumns({"signals": F.array("event_type"), "evidence": F.array("event_id")})
    return sq.merge_overlapping(w, BY, unite=["signals", "evidence"]).withColumns({c: F.array_join(c, ",") for c in ("signals", "evidence")})


@query(f"""WITH {TE}, {BLOCKS}, d AS (SELECT *, edit_start_us - lag(edit_start_us) OVER w AS de, source_start_us - lag(source_start_us) OVER w AS ds FROM blocks WINDOW w AS (PARTITION BY asset_id ORDER BY edit_start_us, block_id)),
 q AS (SELECT *, sum(CASE WHEN de > 0 AND 2 * ds >= de AND 2 * ds <= 3 * de THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY edit_start_us, block_id ROWS UNBOUNDED PRECEDING)::BIGINT AS sequence FROM d) SELECT asset_id, block_id, sequence FROM q QUALIFY count(*) OVER (PARTITION BY asset_id, sequence) >= 2""")
def continuity_filter(spark, sf):
    return sq.continuity_filter(fx.blocks(spark, sf), BY).select("asset_id", "block_id", "sequence")


_RUN = "abs(b.edit_start_us - f.ee) < 1500000 AND b.source_start_us - f.se >= -500000 AND b.source_start_us - f.se < 3000000"


@query(f"""WITH RECURSIVE {TE}, {BLOCKS}, b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY edit_start_us, block_id) AS rn FROM blocks),
 f AS (SELECT asset_id, rn, edit_start_us AS es, edit_end_us AS ee, source_start_us AS ss, source_end_us AS se, 1 AS grp FROM b WHERE rn = 1 UNION ALL
  SELECT b.asset_id, b.rn, CASE WHEN {_RUN} THEN f.es ELSE b.edit_start_us END, CASE WHEN {_RUN} THEN greatest(f.ee, b.edit_end_us) ELSE b.edit_end_us END, CASE WHEN {_RUN} THEN f.ss ELSE b.source_start_us END, CASE WHEN {_RUN} THEN greatest(f.se, b.source_end_us) ELSE b.source_end_us END, f.grp + CASE WHEN {_RUN} THEN 0 ELSE 1 END FROM f JOIN b ON b.asset_id = f.asset_id AND b.rn = f.rn + 1)
 SELECT asset_id, min(es) AS edit_start_us, max(ee) AS edit_end_us, min(ss) AS source_start_us, max(se) AS source_end_us, count(*) AS n FROM f GROUP BY asset_id, grp""")
def contiguous_runs(spark, sf):
    return sq.contiguous_runs(fx.blocks(spark, sf), BY)


@query(f"""WITH RECURSIVE {SEGMENTS}, b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start_us, sequence) AS rn FROM segments),
 f AS (SELECT asset_id, rn, start_us AS s, end_us AS e, text, 0 AS grp FROM b WHERE rn = 1 UNION ALL SELECT b.asset_id, b.rn, CASE WHEN b.end_us - f.s <= 45000000 THEN f.s ELSE b.start_us END, b.end_us, b.text, f.grp + CASE WHEN b.end_us - f.s <= 45000000 THEN 0 ELSE 1 END FROM f JOIN b ON b.asset_id = f.asset_id AND b.rn = f.rn + 1)
 SELECT asset_id, grp AS block, min(s) AS start_us, max(e) AS end_us, count(*) AS n, string_agg(text, ' ' ORDER BY rn) AS text FROM f GROUP BY asset_id, grp""")
def chunk_utterances(spark, sf):
    return sq.chunk_utterances(fx.transcript_segments(spark, sf), BY)


MATCHES = "mt AS (SELECT asset_id, start_us + event_id % 3 * 40000 AS source_us, start_us // (1 + asset_id % 2) + event_id % 2 * 20000 AS edit_us FROM te)"
_GO = "m.source_us >= f.ls AND m.source_us - f.ls < 20000000 AND m.edit_us > f.e1 AND (f.e1 = f.e0 OR abs((f.s1 - f.s0) / (f.e1 - f.e0) - (m.source_us - f.s1) / (m.edit_us - f.e1)) < 0.2)"


@query(f"""WITH RECURSIVE {TE}, {MATCHES}, m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY edit_us, source_us) AS rn FROM mt),
 f AS (SELECT asset_id, rn, edit_us AS e0, source_us AS s0, edit_us AS e1, source_us AS s1, source_us AS ls, 1 AS grp FROM m WHERE rn = 1 UNION ALL
  SELECT m.asset_id, m.rn, CASE WHEN {_GO} THEN f.e0 ELSE m.edit_us END, CASE WHEN {_GO} THEN f.s0 ELSE m.source_us END, m.edit_us, m.source_us, m.source_us, f.grp + CASE WHEN {_GO} THEN 0 ELSE 1 END FROM f JOIN m ON m.asset_id = f.asset_id AND m.rn = f.rn + 1),
 g AS (SELECT asset_id, grp, min(e0) AS edit_start_us, max(e1) AS edit_end_us, min(s0) AS source_start_us, max(s1) AS source_end_us, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT asset_id, edit_start_us, edit_end_us, source_start_us, source_end_us, n, round((source_end_us - source_start_us) / (edit_end_us - edit_start_us), 4) AS speed_ratio FROM g""")
def fold_matches(spark, sf):
    m = fx.timeline_events(spark, sf).selectExpr("asset_id", "start_us + event_id % 3 * 40000 as source_us", "start_us div (1 + asset_id % 2) + event_id % 2 * 20000 as edit_us")
    return sq.fold_matches(m, BY, max_gap=20_000_000)


@query(f"WITH {TE}, c AS (SELECT *, min(start_us) OVER (PARTITION BY asset_id) AS first FROM te) SELECT asset_id, (start_us - first) // 60000000 AS chapter, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM c GROUP BY 1, 2")
def chapters(spark, sf):
    return sq.chapters(fx.timeline_events(spark, sf), BY, width=60_000_000)


@query(f"""WITH {TE}, w AS (SELECT asset_id, start_us, start_us + 20000000 AS end_us FROM te WHERE event_type = 'gameplay_clutch'), l AS (SELECT asset_id, max(end_us) AS m FROM w GROUP BY 1),
 j AS (SELECT t.asset_id, w.start_us AS c FROM te t JOIN w ON t.asset_id = w.asset_id AND t.start_us >= w.start_us AND t.start_us < w.end_us WHERE t.event_type = 'speech' UNION ALL SELECT t.asset_id, m FROM te t JOIN l USING (asset_id) WHERE t.event_type = 'speech' AND t.start_us >= m)
 SELECT asset_id, c AS chapter_start_us, count(*) AS n FROM j GROUP BY 1, 2""")
def chapters_by_window(spark, sf):
    e = fx.timeline_events(spark, sf)
    w = fx.of_types(e, "gameplay_clutch").select("asset_id", "start_us", (F.col("start_us") + 20_000_000).alias("end_us"))
    return sq.chapters_by_window(fx.of_types(e, "speech"), w, BY)


@query(f"WITH {SEGMENTS}, s AS (SELECT *, unnest(range(start_us // 30000000, (end_us - 1) // 30000000 + 1)) AS win FROM segments WHERE end_us > start_us) SELECT asset_id, win AS \"window\", count(*) AS n, string_agg(text, ' ' ORDER BY start_us, sequence) AS text, win // 3 AS chapter FROM s GROUP BY asset_id, win")
def summary_windows(spark, sf):
    return sq.summary_windows(fx.transcript_segments(spark, sf), BY, width=30_000_000)


@query(f"WITH {TE}, {BLOCKS}, b AS (SELECT * REPLACE (CASE WHEN block_id % 5 = 0 THEN source_start_us + 40000000 ELSE source_start_us END AS source_start_us, CASE WHEN block_id % 5 = 0 THEN source_end_us + 40000000 ELSE source_end_us END AS source_end_us) FROM blocks), l AS (SELECT *, lag(source_start_us) OVER (PARTITION BY asset_id ORDER BY edit_start_us, block_id) - source_start_us AS back FROM b) SELECT asset_id, count(*) AS n, sum(source_end_us - source_start_us)::BIGINT AS moved_us FROM l WHERE back > 5000000 GROUP BY 1")
def reordered(spark, sf):
    move = F.when(F.expr("block_id % 5 = 0"), 40_000_000).otherwise(0)
    b = fx.blocks(spark, sf).withColumn("source_start_us", F.col("source_start_us") + move).withColumn("source_end_us", F.col("source_end_us") + move)
    return sq.reordered(b, BY)


@query(f"WITH {SEGMENTS}, t AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY asset_id ORDER BY start_us, sequence) = speaker THEN 0 ELSE 1 END AS turn FROM segments), g AS (SELECT asset_id, sum(turn)::BIGINT AS turns, max(end_us) - min(start_us) AS span_us FROM t GROUP BY 1) SELECT *, round(turns / (greatest(span_us, 100000) / 60000000.0::DOUBLE), 4) AS turns_per_min FROM g")
def speaker_turns(spark, sf):
    return sq.speaker_turns(fx.transcript_segments(spark, sf), BY)


@query(f"""WITH {TE}, {WINDOWS}, j AS (SELECT w.asset_id, w.cluster, least(w.end_us, t.end_us) - greatest(w.start_us, t.start_us) AS part, t.event_type FROM win w JOIN te t ON w.asset_id = t.asset_id AND w.start_us < t.end_us AND t.start_us < w.end_us),
 g AS (SELECT asset_id, cluster, sum(CASE WHEN event_type = 'speech' THEN part ELSE 0 END)::BIGINT AS speech_us, sum(CASE WHEN event_type = 'silence' THEN part ELSE 0 END)::BIGINT AS silence_us, count_if(event_type = 'gameplay_clutch')::BIGINT AS peaks, count_if(event_type = 'silence')::BIGINT AS scenes, count_if(event_type = 'face_reaction')::BIGINT AS reactions FROM j GROUP BY 1, 2), x AS (SELECT w.asset_id, w.cluster, greatest(end_us - start_us, 100000) AS len, coalesce(speech_us, 0) AS speech_us, coalesce(silence_us, 0) AS silence_us, coalesce(peaks, 0) AS peaks, coalesce(scenes, 0) AS scenes, coalesce(reactions, 0) AS reactions FROM win w LEFT JOIN g USING (asset_id, cluster))
 SELECT asset_id, cluster, peaks, reactions, round(speech_us / len, 4) AS speech_density, round(silence_us / len, 4) AS silence_ratio, round(scenes / (len / 60000000.0::DOUBLE), 4) AS scene_rate FROM x""")
def window_features(spark, sf):
    f = sq.window_features(sq.build_windows(clusters(spark, sf), BY), fx.timeline_events(spark, sf), BY, ["cluster"])
    return f.select("asset_id", "cluster", "peaks", "reactions", "speech_density", "silence_ratio", "scene_rate")


@query(f"""WITH {TE}, l AS (SELECT asset_id, start_us * 10 + CASE WHEN event_type = 'silence' THEN 0 ELSE 1 END AS line_no, CASE WHEN event_type = 'silence' THEN 's' WHEN event_type = 'speech' THEN 'e' END AS k, start_us FROM te WHERE event_type IN ('silence', 'speech')), p AS (SELECT *, lag(k) OVER w AS pk, lag(start_us) OVER w AS ps FROM l WINDOW w AS (PARTITION BY asset_id ORDER BY line_no)) SELECT asset_id, ps AS start_us, start_us AS end_us FROM p WHERE k = 'e' AND pk = 's'""")
def pair_markers(spark, sf):
    e = fx.timeline_events(spark, sf).where("event_type in ('silence', 'speech')")
    log = e.selectExpr("asset_id", "start_us * 10 + if(event_type = 'silence', 0, 1) as line_no", "concat('[detector] ', if(event_type = 'silence', 'silence_start: ', 'silence_end: '), start_us, ' x') as line")
    return sq.pair_markers(log, BY)

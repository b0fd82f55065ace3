"""Queries of graphs and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import AI, HUMAN, TE, merged_sql
from ..functions.scalar import share
from ..operators import graph as gr
from ..operators import reports as rp
from ..operators import similarity as sm
from ..operators.intervals import covered_us
from ..sources.shared import settled
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


_KINDS = ["payoff_of", "callback_to", "same_thread", "continues", "setup_for", "answers"]
_IN = ", ".join(f"'{r}'" for r in gr.RELATIONS)
_DIR = ", ".join(f"'{r}'" for r in gr.DIRECTED)
_THR = ", ".join(f"'{r}'" for r in gr.THREADS)
EDGES = f"""{REL}, eb AS (SELECT asset_id, event_id AS edge_id, CASE WHEN event_id % 50 = 0 THEN prev_id WHEN event_id % 29 = 0 THEN prev_id ELSE event_id END AS source, CASE WHEN event_id % 50 = 0 THEN prev_id WHEN event_id % 37 = 0 THEN -prev_id WHEN event_id % 29 = 0 THEN event_id ELSE prev_id END AS target,
 CASE WHEN event_id % 41 = 0 THEN 'weird' ELSE list_extract({_KINDS}, CAST(event_id % 6 + 1 AS INTEGER)) END AS relation, CASE WHEN event_id % 43 = 0 THEN 1.5 ELSE relation_confidence END AS confidence, 0.5::DOUBLE AS strength FROM rel WHERE gap_us <= 6000000),
 edges AS (SELECT * FROM eb UNION ALL SELECT asset_id, edge_id + 1000000000, source, target, relation, confidence, strength FROM eb WHERE edge_id % 31 = 0),
 ex AS (SELECT e.*, s.start_us AS su, t.start_us AS tu FROM edges e LEFT JOIN te s ON s.event_id = e.source LEFT JOIN te t ON t.event_id = e.target),
 er AS (SELECT *, CASE WHEN source = target THEN 'self_link' WHEN su IS NULL OR tu IS NULL THEN 'unknown_node' WHEN relation NOT IN ({_IN}) THEN 'invalid_relation' WHEN confidence > 1 THEN 'out_of_range' WHEN relation IN ({_DIR}) AND su <= tu THEN 'temporal' END AS r FROM ex),
 checked AS (SELECT edge_id, source, target, relation, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY source, target, relation, r IS NULL ORDER BY edge_id) > 1 THEN 'duplicate' ELSE 'ok' END) AS reason FROM er), good AS (SELECT * FROM checked WHERE reason = 'ok')"""


def edges(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), F.expr("cast(event_id % 6 + 1 as int)"))
    r = relations(spark, sf).where("gap_us <= 6000000")
    e = r.select("event_id", F.col("event_id").alias("edge_id"), F.expr("case when event_id % 50 = 0 then prev_id when event_id % 29 = 0 then prev_id else event_id end").alias("source"), F.expr("case when event_id % 50 = 0 then prev_id when event_id % 37 = 0 then -prev_id when event_id % 29 = 0 then event_id else prev_id end").alias("target"), F.when(F.expr("event_id % 41 = 0"), "weird").otherwise(kind).alias("relation"), F.when(F.expr("event_id % 43 = 0"), 1.5).otherwise(F.col("relation_confidence")).alias("confidence"), F.lit(0.5).alias("strength")).drop("event_id")
    return e.unionByName(e.where("edge_id % 31 = 0").withColumn("edge_id", F.col("edge_id") + 1_000_000_000))


def nodes(spark, sf):
    return fx.timeline_events(spark, sf).withColumnRenamed("event_id", "node")


def good_edges(spark, sf):
    return gr.validate_edges(edges(spark, sf), nodes(spark, sf).select("node", "start_us")).where("reason = 'ok'")


@query(f"WITH {TE}, {EDGES} SELECT * FROM checked")
def validate_edges(spark, sf):
    return gr.validate_edges(edges(spark, sf), nodes(spark, sf).select("node", "start_us"))


#: Islands of ids under links that run backwards, and inside each the edges in order, with all pairs that the accepted ones connect.
_CYCLES = f"""{TE}, ed AS (SELECT event_id * 4 AS edge_id, event_id AS s, event_id + 3 AS t FROM te WHERE event_id % 3 = 0 UNION ALL SELECT event_id * 4 + 1, event_id + 3, event_id FROM te WHERE event_id % 9 = 0 UNION ALL SELECT event_id * 4 + 2, event_id + 6, event_id FROM te WHERE event_id % 15 = 0),
 bk AS (SELECT *, max(s) OVER (ORDER BY t, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ed WHERE s >= t), sp AS (SELECT *, sum(CASE WHEN reach >= t THEN 0 ELSE 1 END) OVER (ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS grp FROM bk), isl AS (SELECT grp, min(t) AS lo, max(s) AS hi FROM sp GROUP BY grp),
 g AS MATERIALIZED (SELECT grp, edge_id, s, t, row_number() OVER (PARTITION BY grp ORDER BY edge_id) AS rn FROM ed JOIN isl ON least(s, t) >= lo AND greatest(s, t) <= hi),
 r AS (SELECT DISTINCT grp, 0::BIGINT AS rn, []::STRUCT(a BIGINT, b BIGINT)[] AS cl, -1::BIGINT AS edge_id, FALSE AS bad FROM g UNION ALL SELECT g.grp, g.rn, CASE WHEN list_contains(cl, {{'a': g.t, 'b': g.s}}) THEN cl ELSE list_distinct(list_concat(cl, flatten(list_transform(list_append(list_transform(list_filter(cl, lambda x: x.b = g.s), lambda x: x.a), g.s), lambda p: list_transform(list_append(list_transform(list_filter(cl, lambda x: x.a = g.t), lambda x: x.b), g.t), lambda q: {{'a': p, 'b': q}}))))) END,
  g.edge_id, list_contains(cl, {{'a': g.t, 'b': g.s}}) FROM r JOIN g ON g.grp = r.grp AND g.rn = r.rn + 1)"""


def _cyclic_links(spark, sf):
    """Setup links that run both ways between neighbours, and around three events, along one chain of all events."""
    e = fx.timeline_events(spark, sf).where("event_id % 3 = 0")
    parts = [e.selectExpr("event_id * 4 as edge_id", "'setup_for' as relation", "event_id as source", "event_id + 3 as target"), e.where("event_id % 9 = 0").selectExpr("event_id * 4 + 1 as edge_id", "'setup_for' as relation", "event_id + 3 as source", "event_id as target"), e.where("event_id % 15 = 0").selectExpr("event_id * 4 + 2 as edge_id", "'setup_for' as relation", "event_id + 6 as source", "event_id as target")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH RECURSIVE {_CYCLES} SELECT edge_id FROM r WHERE bad")
def reject_cycles(spark, sf):
    return gr.reject_cycles(_cyclic_links(spark, sf))


MEMBERS = f"""te2 AS (SELECT source AS a, target AS b FROM good WHERE relation IN ({_THR}) UNION SELECT target, source FROM good WHERE relation IN ({_THR})), reach AS (SELECT a, b FROM te2 UNION SELECT reach.a, te2.b FROM reach JOIN te2 ON reach.b = te2.a), mem AS (SELECT a AS node, least(a, min(b)) AS thread FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {TE}, {EDGES}, {MEMBERS} SELECT * FROM mem")
def threads(spark, sf):
    return gr.thread_members(good_edges(spark, sf))


SUMMARY = f"""tn AS (SELECT thread, count(*) AS size, min(start_us) AS first_us, max(end_us) AS last_us, arg_min(event_type, (start_us, node)) AS title FROM mem JOIN te ON te.event_id = mem.node GROUP BY 1),
 tg AS (SELECT thread, count_if(relation = 'callback_to')::BIGINT AS callbacks, count_if(relation = 'setup_for')::BIGINT AS setups, count_if(relation = 'payoff_of')::BIGINT AS payoffs FROM good JOIN mem ON mem.node = good.source WHERE relation IN ({_THR}) GROUP BY 1),
 ts AS (SELECT tn.*, callbacks, setups, payoffs, CASE WHEN callbacks > 0 THEN 'callback_chain' WHEN setups + payoffs > 0 THEN 'arc' ELSE 'running_joke' END AS thread_type, NOT (setups > 0 AND payoffs = 0) AS resolved FROM tn JOIN tg USING (thread))"""


@query(f"WITH RECURSIVE {TE}, {EDGES}, {MEMBERS}, {SUMMARY} SELECT * FROM ts")
def thread_summary(spark, sf):
    e = settled(good_edges(spark, sf), "edges")
    return gr.thread_summary(gr.thread_members(e), e, nodes(spark, sf))


@query(f"WITH RECURSIVE {TE}, {EDGES}, {MEMBERS}, b AS (SELECT asset_id, thread, count(*) AS n, array_to_string(list_sort(list(node)), ',') AS nodes FROM mem JOIN te ON te.event_id = mem.node GROUP BY 1, 2) SELECT * FROM b")
def node_threads(spark, sf):
    """Threads with their sorted nodes, by recording."""
    m = gr.thread_members(good_edges(spark, sf)).join(nodes(spark, sf).select("node", "asset_id"), "node")
    return rp.thread_nodes(m, BY).withColumn("nodes", F.array_join("nodes", ","))


@query(f"""WITH {TE}, {EDGES}, n AS (SELECT event_id AS node, asset_id * 100000 + start_us // 20000000 AS clip FROM te), j AS (SELECT relation, s.clip AS sc, t.clip AS tc FROM good JOIN n s ON s.node = source JOIN n t ON t.node = target WHERE s.clip <> t.clip)
 SELECT DISTINCT CASE relation WHEN 'setup_for' THEN tc ELSE sc END AS dependent, CASE relation WHEN 'setup_for' THEN sc ELSE tc END AS prerequisite, CASE relation WHEN 'setup_for' THEN 'requires_context' ELSE relation END AS relation FROM j WHERE relation IN ('setup_for', {', '.join(f"'{r}'" for r in gr.CRITICAL)})""")
def edge_dependencies(spark, sf):
    clips = nodes(spark, sf).selectExpr("node", "asset_id * 100000 + start_us div 20000000 as clip")
    return gr.edge_dependencies(good_edges(spark, sf), clips)


@query(f"WITH {TE}, {EDGES} SELECT count(*) AS edges, count_if(relation = 'callback_to')::BIGINT AS callbacks, count_if(relation IN ('payoff_of', 'setup_for'))::BIGINT AS setup_payoff, (SELECT count(*) FROM te) AS nodes, (SELECT count(*) FROM te WHERE event_id NOT IN (SELECT source FROM good UNION SELECT target FROM good)) AS orphans FROM good")
def graph_summary(spark, sf):
    return gr.graph_summary(nodes(spark, sf), settled(good_edges(spark, sf), "edges"))


@query("WITH m AS (SELECT conv_id, turn AS node, unnest(string_split(text, ' ')) AS label, unnest(range(len(string_split(text, ' ')))) AS position FROM conversations), n AS (SELECT *, lower(trim(label)) AS entity FROM m) SELECT conv_id, entity, min(node) AS first_node, max(node) AS last_node, count(DISTINCT node) AS nodes, arg_min(label, (node, position)) AS label FROM n WHERE entity <> '' GROUP BY 1, 2")
def entity_index(spark, sf):
    m = fx.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("node"), F.posexplode(F.split("text", " ")).alias("position", "label"))
    return gr.entity_index(m, ["conv_id"])


@query(f"""WITH {TE}, {AI}, {HUMAN}, {REL}, p AS (SELECT asset_id, prev_id AS setup, event_id AS payoff FROM rel WHERE relation IN ('setup_to_payoff', 'chat_to_reaction')), {merged_sql('ai', 'am')}, {merged_sql('human', 'hm')},
 ka AS (SELECT n.event_id FROM te n JOIN am m ON n.asset_id = m.asset_id AND n.start_us < m.end_us AND m.start_us < n.end_us GROUP BY 1 HAVING 2 * sum(least(n.end_us, m.end_us) - greatest(n.start_us, m.start_us)) > max(n.end_us - n.start_us)),
 kh AS (SELECT n.event_id FROM te n JOIN hm m ON n.asset_id = m.asset_id AND n.start_us < m.end_us AND m.start_us < n.end_us GROUP BY 1 HAVING 2 * sum(least(n.end_us, m.end_us) - greatest(n.start_us, m.start_us)) > max(n.end_us - n.start_us)),
 f AS (SELECT asset_id, setup IN (SELECT event_id FROM ka) AND payoff IN (SELECT event_id FROM ka) AS ai, (setup IN (SELECT event_id FROM kh)) AND payoff IN (SELECT event_id FROM kh) AS hu, setup IN (SELECT event_id FROM kh) AS hs FROM p),
 g AS (SELECT asset_id, count(*) AS pairs, count_if(ai AND (hu OR NOT hs))::BIGINT AS intact FROM f GROUP BY 1) SELECT *, round(intact / pairs, 4) AS completeness FROM g""")
def setup_payoff(spark, sf):
    """Setup and payoff pairs intact: both kept by the AI, and both by the human or the setup not."""
    e = fx.timeline_events(spark, sf)
    kept = lambda iv, name: covered_us(e, iv, BY, ["event_id"]).where("2 * covered_us > end_us - start_us").select("event_id", F.lit(True).alias(name))
    ai, hu = kept(fx.ai_intervals(spark, sf), "ai"), kept(fx.human_intervals(spark, sf), "hu")
    p = relations(spark, sf).where("relation in ('setup_to_payoff', 'chat_to_reaction')").select("asset_id", F.col("prev_id").alias("setup"), F.col("event_id").alias("payoff"))
    for side in ("setup", "payoff"):
        for df, name in ((ai, "ai"), (hu, "hu")):
            p = p.join(df.select(F.col("event_id").alias(side), F.col(name).alias(f"{side}_{name}")), side, "left").fillna(False, [f"{side}_{name}"])
    good = F.expr("setup_ai and payoff_ai and ((setup_hu and payoff_hu) or not setup_hu)")
    return p.groupBy("asset_id").agg(F.count("*").alias("pairs"), F.count_if(good).alias("intact")).withColumn("completeness", share("intact", "pairs"))


@query(f"""WITH RECURSIVE {TE}, {EDGES}, {MEMBERS}, s AS (SELECT asset_id, thread, bool_or(event_type IN ('speech', 'gameplay_clutch')) AS a, bool_or(event_type IN ('face_reaction', 'chat_message')) AS h FROM mem JOIN te ON te.event_id = mem.node GROUP BY 1, 2)
 SELECT asset_id, count_if(a AND h)::BIGINT AS shared, count_if(a AND NOT h)::BIGINT AS ai_only, count_if(h AND NOT a)::BIGINT AS human_only FROM s GROUP BY 1""")
def thread_overlap(spark, sf):
    """Threads that the AI's and the human's events touch: shared and of one side only."""
    m = gr.thread_members(good_edges(spark, sf)).join(nodes(spark, sf).select("node", "asset_id", "event_type"), "node")
    has = lambda *k: F.max(F.col("event_type").isin(*k))
    s = m.groupBy("asset_id", "thread").agg(has("speech", "gameplay_clutch").alias("a"), has("face_reaction", "chat_message").alias("h"))
    return s.groupBy("asset_id").agg(F.count_if(F.expr("a and h")).alias("shared"), F.count_if(F.expr("a and not h")).alias("ai_only"), F.count_if(F.expr("h and not a")).alias("human_only"))


@query(f"""WITH RECURSIVE {TE}, {EDGES}, {MEMBERS}, {SUMMARY}, ch AS (SELECT count(DISTINCT (asset_id, (start_us - first) // 60000000)) AS chapters FROM (SELECT *, min(start_us) OVER (PARTITION BY asset_id) AS first FROM te))
 SELECT (SELECT chapters FROM ch) AS chapters, (SELECT count(*) FROM edges) AS proposed, (SELECT count(*) FROM good) AS accepted, (SELECT count(*) FROM ts) AS threads, (SELECT count_if(NOT resolved)::BIGINT FROM ts) AS unresolved""")
def story_graph(spark, sf):
    """Chapters, links, checks and threads in one job: its summary."""
    from ..operators.sequence import chapters

    every = settled(gr.validate_edges(edges(spark, sf), nodes(spark, sf).select("node", "start_us")), "checked")
    good = every.where("reason = 'ok'")
    t = gr.thread_summary(gr.thread_members(good), good, nodes(spark, sf))
    c = chapters(fx.timeline_events(spark, sf), BY, width=60_000_000).agg(F.count("*").alias("chapters"))
    e = every.agg(F.count("*").alias("proposed"), F.count_if(F.col("reason") == "ok").alias("accepted"))
    return c.crossJoin(e).crossJoin(t.agg(F.count("*").alias("threads"), F.count_if(~F.col("resolved")).alias("unresolved")))


def _tfidf_sql(least: int, normal: bool) -> str:
    return f"""w AS (SELECT conv_id, turn, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= {least})) AS term FROM conversations), c AS (SELECT conv_id, turn, term, count(*) AS n FROM w GROUP BY ALL),
 df AS (SELECT conv_id, term, count(*) AS df FROM c GROUP BY ALL), it AS (SELECT conv_id, count(*) AS items FROM conversations GROUP BY 1),
 v0 AS (SELECT c.conv_id, c.turn, c.term, {'n / sum(n) OVER (PARTITION BY c.conv_id, c.turn)' if normal else 'n'} * (ln((items + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1) AS w FROM c JOIN df USING (conv_id, term) JOIN it USING (conv_id)), v AS (SELECT conv_id, turn, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS w FROM v0)"""


@query(f"""WITH {_tfidf_sql(2, True)}, p AS (SELECT a.conv_id, a.turn, b.turn AS earlier, round(sum(a.w * b.w), 4) AS similarity, array_to_string(list_sort(list(DISTINCT a.term))[1:10], ',') AS shared FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.term = b.term AND b.turn < a.turn GROUP BY 1, 2, 3)
 SELECT * FROM p WHERE similarity >= 0.15 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, earlier) <= 3""")
def similar_earlier(spark, sf):
    return sm.similar_earlier(fx.table(spark, sf, "conversations"), ["conv_id"], "turn", k=3)


_MARK = "list_extract(['setup_', 'payoff_', 'joke_', 'callback_', 'false_sim_'], CAST(turn % 5 + 1 AS INTEGER)) || (turn // 5 % 2)"
_KIND5 = ["setup_", "payoff_", "joke_", "callback_", "false_sim_"]


@query(f"""WITH RECURSIVE {fx.SEGMENTS}, nd AS MATERIALIZED (SELECT asset_id AS key, asset_id * 1000 + sequence AS node, sequence AS turn, start_us, end_us, string_split(text, ' ')[1] AS label, (start_us - min(start_us) OVER (PARTITION BY asset_id)) // 60000000 AS chapter FROM segments), mk AS (SELECT *, {_MARK} AS marker FROM nd),
 {_tfidf_sql(2, True)}, sp AS MATERIALIZED (SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + e AS earlier FROM (SELECT a.conv_id, a.turn, b.turn AS e, round(sum(a.w * b.w), 4) AS s FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.term = b.term AND b.turn < a.turn GROUP BY 1, 2, 3) WHERE s >= 0.15 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, e) <= 10),
 ml AS (SELECT DISTINCT a.node AS source, b.node AS target, CASE WHEN starts_with(a.marker, 'payoff') THEN 'payoff_of' ELSE 'callback_to' END AS relation, a.start_us AS ss, b.start_us AS ts FROM mk a JOIN mk b ON a.key = b.key AND ((starts_with(a.marker, 'payoff_') AND b.marker = replace(a.marker, 'payoff_', 'setup_')) OR (starts_with(a.marker, 'callback_') AND b.marker = replace(a.marker, 'callback_', 'joke_'))) WHERE a.chapter = b.chapter OR (a.node, b.node) IN (SELECT (node, earlier) FROM sp)),
 gv AS (SELECT node * 4 AS edge_id, node AS source, node + 1 AS target, 'setup_for' AS relation FROM nd WHERE turn % 4 = 0 UNION ALL SELECT node * 4 + 1, node + 1, node, 'setup_for' FROM nd WHERE turn % 8 = 0 UNION ALL SELECT node * 4 + 2, node, node + 2, 'continues' FROM nd WHERE turn % 3 = 0), gk AS (SELECT g.* FROM gv g JOIN nd a ON a.node = g.source JOIN nd b ON b.node = g.target),
 ok AS MATERIALIZED (SELECT source, target, relation FROM gk WHERE NOT (edge_id % 4 = 1) UNION ALL SELECT source, target, relation FROM ml WHERE ss > ts), te2 AS (SELECT source AS a, target AS b FROM ok UNION SELECT target, source FROM ok), reach AS (SELECT a, b FROM te2 UNION SELECT reach.a, te2.b FROM reach JOIN te2 ON reach.b = te2.a), mem AS (SELECT a AS node, least(a, min(b)) AS thread FROM reach GROUP BY a),
 th AS (SELECT thread, count_if(relation = 'setup_for') AS s, count_if(relation = 'payoff_of') AS p FROM ok JOIN mem ON mem.node = ok.source GROUP BY 1)
 SELECT (SELECT count(*) FROM ok) AS edges, (SELECT count_if(relation = 'callback_to') FROM ok)::BIGINT AS callbacks, (SELECT count_if(relation IN ('payoff_of', 'setup_for')) FROM ok)::BIGINT AS setup_payoff, (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM nd WHERE node NOT IN (SELECT node FROM mem)) AS orphans, (SELECT count_if(edge_id % 4 = 1) FROM gk)::BIGINT AS cycles, (SELECT count(*) FROM gv) - (SELECT count(*) FROM gk) + (SELECT count_if(ss <= ts) FROM ml)::BIGINT AS invalid,
  (SELECT count(*) FROM th) AS threads, (SELECT count_if(s > 0 AND p = 0) FROM th)::BIGINT AS unresolved, (SELECT count(DISTINCT (key, chapter)) FROM nd) AS chapters, (SELECT count(*) FROM sp) AS similar, (SELECT count(DISTINCT (key, lower(trim(label)))) FROM nd WHERE trim(label) <> '') AS entities""")
def build_graph(spark, sf):
    """Turns of conversations with links by marks, likeness and given edges: the summary of their graph."""
    from ..operators import story

    s = fx.transcript_segments(spark, sf).withColumnRenamed("asset_id", "conv_id")
    mark = F.concat(F.element_at(F.array(*[F.lit(x) for x in _KIND5]), F.expr("cast(sequence % 5 + 1 as int)")), F.expr("cast(sequence div 5 % 2 as string)"))
    n = s.select("conv_id", F.expr("conv_id * 1000 + sequence").alias("node"), mark.alias("marker"), "text", F.split("text", " ")[0].alias("label"), F.lit("speech").alias("event_type"), "start_us", "end_us", "sequence")
    link = lambda add, a, b, rel, where: n.where(where).selectExpr(f"node * 4 + {add} as edge_id", f"{a} as source", f"{b} as target", f"'{rel}' as relation", "0.9d as confidence", "0.8d as strength")
    e = link(0, "node", "node + 1", "setup_for", "sequence % 4 = 0").unionByName(link(1, "node + 1", "node", "setup_for", "sequence % 8 = 0")).unionByName(link(2, "node", "node + 2", "continues", "sequence % 3 = 0"))
    return story.build_graph(n.drop("sequence"), e, ["conv_id"], width=60_000_000).summary()


@query(f"WITH {_tfidf_sql(1, False)}, p AS (SELECT a.conv_id, a.turn, b.turn AS e, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.term = b.term AND b.turn < a.turn GROUP BY 1, 2, 3), m AS (SELECT conv_id, turn, max(s) AS s FROM p GROUP BY 1, 2) SELECT c.conv_id, c.turn, round(coalesce(s, 0), 4) AS repetition FROM conversations c LEFT JOIN m USING (conv_id, turn)")
def repetition_global(spark, sf):
    return sm.repetition_global(fx.table(spark, sf, "conversations"), ["conv_id"], "turn")


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM conversations), c AS (SELECT conv_id, turn, term, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT conv_id, turn AS now, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS size FROM conversations),
 df AS (SELECT k.conv_id, k.now, k.size, term, count(*) AS df FROM k JOIN c ON c.conv_id = k.conv_id AND c.turn <= k.now GROUP BY ALL), v AS (SELECT c.conv_id, df.now, c.turn, c.term, n * (ln((size + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1) AS w FROM c JOIN df ON df.conv_id = c.conv_id AND df.term = c.term AND c.turn <= df.now),
 nm AS (SELECT conv_id, now, turn, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL), d AS (SELECT a.conv_id, a.now, b.turn, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.now = b.now AND a.term = b.term AND a.turn = a.now AND b.turn < a.now GROUP BY ALL),
 m AS (SELECT d.conv_id, d.now, max(dot / (x.norm * y.norm)) AS s FROM d JOIN nm x ON x.conv_id = d.conv_id AND x.now = d.now AND x.turn = d.turn JOIN nm y ON y.conv_id = d.conv_id AND y.now = d.now AND y.turn = d.now GROUP BY ALL) SELECT c.conv_id, c.turn, round(coalesce(s, 0), 4) AS repetition FROM conversations c LEFT JOIN m ON m.conv_id = c.conv_id AND m.now = c.turn""")
def repetition_prefix(spark, sf):
    return sm.repetition_prefix(fx.table(spark, sf, "conversations"), ["conv_id"], "turn")


_GRAMS = "SELECT conv_id, position, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w) AS gram, lead(word, 2) OVER w AS last FROM p {} WINDOW w AS (PARTITION BY conv_id ORDER BY position)"


#: The words that stay keep their order, so the longest chain has every anchor.
@query(f"""WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), x AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS n FROM c), p AS (SELECT conv_id, turn, turn * 100000 + n AS position, lower(word) AS word FROM x),
 s AS ({_GRAMS.format("")}), e AS ({_GRAMS.format("WHERE turn % 5 <> 2")}), su AS (SELECT conv_id, gram, min(position) AS source_position FROM s WHERE last IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
 eu AS (SELECT conv_id, gram, min(position) AS edit_position FROM e WHERE last IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) SELECT * FROM su JOIN eu USING (conv_id, gram)""")
def align_words(spark, sf):
    """Each conversation's words against the same words without every fifth turn."""
    c = fx.table(spark, sf, "conversations")
    w = c.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("n", "word")).withColumn("position", F.col("turn") * 100_000 + F.col("n"))
    return sm.align_words(w, w.where("turn % 5 <> 2"), ["conv_id"])


@query()
def align_all_words(spark, sf):
    """The same with every equal word, repeated ones too, by alignment between the anchors."""
    c = fx.table(spark, sf, "conversations")
    w = c.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("n", "word")).withColumn("position", F.col("turn") * 100_000 + F.col("n"))
    return sm.align_all_words(w, w.where("turn % 5 <> 2"), ["conv_id"])

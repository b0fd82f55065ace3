"""Set-based rewrites against plain loops, and hand-computed cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph as gr
from tidemark.operators import intervals as iv
from tidemark.operators import metrics as mt
from tidemark.operators import planning as pl
from tidemark.operators import rules as ru
from tidemark.operators import sequence as sq
from tidemark.operators import similarity as sm

S = 1_000_000
SCHEMA = "asset_id long, event_id long, start_us long, end_us long"


def frame(spark, rows):
    return spark.createDataFrame([(1, i, round(a * S), round(b * S)) for i, (a, b) in enumerate(rows)], SCHEMA)


def random_rows(seed, n=300):
    r = random.Random(seed)
    return [(a, a + r.choice([0, 1, 5, 40])) for a in (r.randint(0, 4000) for _ in range(n))]


def merged(rows, gap):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0, 3])
def test_islands_in_chunks_match_a_loop(spark, gap):
    rows = random_rows(gap)
    got = iv.islands(frame(spark, rows), ["asset_id"], gap * S, chunk=500 * S).select("start_us", "end_us").collect()
    assert sorted((r[0] // S, r[1] // S) for r in got) == merged(rows, gap)


@pytest.mark.parametrize("kind", ["overlap", "touch", "contained"])
@pytest.mark.parametrize("pad", [0, 7])
def test_overlap_join_matches_a_loop(spark, kind, pad):
    a, b = random_rows(1, 80), random_rows(2, 80)
    got = iv.overlap_join(frame(spark, a), frame(spark, b), ["asset_id"], pad=pad * S, kind=kind, bucket=11 * S)
    less = (lambda x, y: x < y) if kind == "overlap" else (lambda x, y: x <= y)
    want = sorted((i, j) for i, (s, e) in enumerate(a) for j, (u, v) in enumerate(b) if less(s - pad, v) and less(u, e + pad) and (kind != "contained" or u >= s - pad and v <= e + pad))
    assert sorted((r.event_id, r.r_event_id) for r in got.collect()) == want


def overlap(spark, ai, human, tol):
    r = mt.overlap_metrics(frame(spark, ai), frame(spark, human), ["asset_id"], [round(tol * S)]).collect()[0]
    return r.precision, r.recall


def test_overlap_metrics_golden(spark):
    assert overlap(spark, [(10, 20), (25, 45), (50, 60), (70, 90)], [(10, 20), (50, 60)], 0) == (0.3333, 1.0)
    assert overlap(spark, [(10, 20)], [(10, 20), (30, 40), (50, 60), (70, 80)], 0) == (1.0, 0.25)
    steps = [overlap(spark, [(10.8, 20.8)], [(10, 20)], t)[0] for t in (0.5, 1, 2)]
    assert steps == sorted(steps) and steps[-1] == 1.0


def test_bridge_gaps_golden(spark):
    def chain(rows):
        df = spark.createDataFrame([(1, i, a * 100_000, b * 100_000, 1, False) for i, (a, b) in enumerate(rows)], "plan_id long, clip_id long, start_us long, end_us long, level int, locked boolean")
        return sorted((r.start_us // 100_000, r.end_us // 100_000) for r in iv.bridge_gaps(df, ["plan_id"]).collect())

    assert chain([(1000, 1200), (1235, 1500)]) == [(1000, 1500)]
    assert chain([(1000, 1200), (2000, 2400)]) == [(1000, 1200), (2000, 2400)]


def relation(spark, a, b, scenes=()):
    e = spark.createDataFrame([(1, i, t, round(s * S), round(x * S), p) for i, (t, s, x, p) in enumerate((a, b))], "asset_id long, event_id long, event_type string, start_us long, end_us long, speaker long")
    sc = spark.createDataFrame([(1, 9, round(x * S), round(x * S)) for x in scenes], SCHEMA)
    r = ru.classified_relations(iv.cut_between(e, sc, ["asset_id"]), ["asset_id"])
    clusters = sq.cluster_by_relation(r, e, ["asset_id"]).select("cluster").distinct().count()
    return clusters, r.collect()[0]


def test_relations_golden(spark):
    n, r = relation(spark, ("speech", 1, 3, 0), ("face_reaction", 4, 5, 0))
    assert (n, r.relation) == (1, "setup_to_payoff")
    assert relation(spark, ("speech", 1, 3, 0), ("speech", 4.8, 6.5, 1))[0] == 2
    n, r = relation(spark, ("gameplay_clutch", 2, 4, 0), ("face_reaction", 4.8, 6, 0))
    assert (n, r.relation) == (1, "event_to_reaction") and r.relation_confidence >= 0.9
    n, r = relation(spark, ("speech", 1, 3, 0), ("gameplay", 3.8, 5.5, 0), scenes=[3.4])
    assert n == 2 and r.cut


def test_prune_matches_a_loop(spark):
    r = random.Random(4)
    rows = [(p, p * 100 + i, i, r.randint(1, 5), r.randint(1, 50), r.randint(0, 5), r.random() < 0.1) for p in range(30) for i in range(12)]
    df = spark.createDataFrame(rows, "plan_id long, clip_id long, position int, level int, duration_us long, confidence long, locked boolean")
    budget = df.groupBy("plan_id").agg(F.expr("sum(duration_us) * 6 div 10").alias("budget_us"))
    got = sorted(x.clip_id for x in pl.prune_to_budget(df, ["plan_id"], budget).collect())
    want = []
    for p in range(30):
        clips = [x for x in rows if x[0] == p]
        total, limit = sum(x[4] for x in clips), sum(x[4] for x in clips) * 6 // 10
        for x in sorted((x for x in clips if x[3] > 1 and not x[6]), key=lambda x: (-x[3], x[5], x[2])):
            if total <= limit:
                break
            total -= x[4]
            clips.remove(x)
        want += [x[1] for x in clips]
    assert got == sorted(want)


def test_compile_timeline_golden(spark):
    clips = spark.createDataFrame([(1, 1, 1, 10 * S, 20 * S), (1, 2, 2, 30 * S, 45 * S)], "plan_id long, clip_id long, position int, start_us long, end_us long")
    effects = spark.createDataFrame([(1, 7, 15 * S, 35 * S)], "plan_id long, effect_id long, start_us long, end_us long")
    got = sorted((r.part_start_us // S, r.part_end_us // S, r.output_end_us // S) for r in pl.compile_timeline(clips, effects, ["plan_id"]).collect())
    assert got == [(5, 10, 10), (10, 15, 25)]


def test_similar_earlier_golden(spark):
    t = spark.createDataFrame([(1, 1, "the quick brown fox"), (1, 2, "hello world"), (1, 3, "a brown fox jumps quick fox")], "conv_id long, turn long, text string")
    assert [(r.earlier, r.turn) for r in sm.similar_earlier(t, ["conv_id"], "turn", 2, 0.1).collect()] == [(1, 3)]


def loop_rejects(edges):
    ahead, want = {}, set()
    for k, rel, s, t in sorted(edges):
        seen, todo = {t}, [t]
        while todo:
            for n in ahead.get((rel, todo.pop()), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        if s in seen:
            want.add(k)
        else:
            ahead.setdefault((rel, s), []).append(t)
    return want


@pytest.mark.parametrize(("most", "step"), [(100_000, 60), (5, 60), (5, 7)])
def test_reject_cycles_matches_a_loop(spark, most, step):
    r = random.Random(8)
    edges = [(i, "setup_for", r.randint(0, 30), r.randint(31, 60) if i % 3 else r.randint(0, 30)) for i in range(60)]
    edges = edges + [(200 + i, "setup_for", e[3], e[2]) for i, e in enumerate(edges[::5])]
    edges += [(300 + i, "introduces_objective", 100 + 2 * i, 102 + 2 * i) for i in range(30)] + [(350 + i, "introduces_objective", 100 + 6 * i + 4, 100 + 6 * i) for i in range(5)] + [(360, "introduces_objective", 7, 7), (361, "setup_for", 104, 100), (362, "same_thread", 1, 1)]
    got = [x.edge_id for x in gr.reject_cycles(spark.createDataFrame(edges, "edge_id long, relation string, source long, target long"), most, step).collect()]
    want = loop_rejects([e for e in edges if e[1] in gr.UNDIRECTED_ACYCLIC])
    assert set(got) == want and len(got) == len(want) > 10


def test_cycle_groups_cut_a_chain(spark):
    """A long chain with short links backwards falls into groups that are as long as those."""
    edges = [(4 * i, "setup_for", i, i + 1) for i in range(3000)] + [(4 * i + 1, "setup_for", i + 2, i) for i in range(0, 3000, 10)]
    groups = gr.cycle_groups(spark.createDataFrame(edges, "edge_id long, relation string, source long, target long"), nodes_by=64)
    sizes = [x["count"] for x in groups.groupBy("group").count().collect()]
    assert len(sizes) == 300 and set(sizes) == {3}


@pytest.mark.parametrize("chunk", [7, 1000, 10**9])
def test_carry_last_over_chunks(spark, chunk):
    r = random.Random(chunk)
    rows = [(r.randint(0, 1), r.randint(0, 100), i, r.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t long, i long, v long")
    for before in (False, True):
        for back in (False, True):
            got = {(x.k, x.i): x.out for x in iv.carry_last(df, ["k"], "t", ["i"], back=back, chunk=chunk, out=(F.col("v"), "before" if before else "")).collect()}
            seen, want = {}, {}
            for k, t, i, v in sorted(rows, key=lambda x: (-x[1] if back else x[1], x[2])):
                if before:
                    want[k, i] = seen.get(k)
                seen[k] = v if v is not None else seen.get(k)
                if not before:
                    want[k, i] = seen[k]
            assert got == want


def test_align_words_keeps_order(spark):
    words = "a b c d e f g h a b c i j k".split()
    src = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "k long, position int, word string")
    edit = spark.createDataFrame([(1, i, w) for i, w in enumerate(words[2:])], "k long, position int, word string")
    got = sorted((r.source_position, r.edit_position) for r in sm.align_words(src, edit, ["k"]).collect())
    assert got and all(s - e == 2 for s, e in got)


def test_every_block_and_user_counts(spark):
    from tidemark import fixtures as fx
    from tidemark import plans

    sf, q = "/root/testdata/sf0.001", plans.queries()
    blocks = [(r.block_id, r.edit_start_us, r.edit_end_us) for r in fx.blocks(spark, sf).collect()]
    assert {r.time_id for r in q["asof_every_block"](spark, sf).collect()} == {b for b, _, _ in blocks}
    at = lambda step: sum(len(range(-(-s // step) * step, e, step)) for _, s, e in blocks)
    assert sum(r.samples for r in q["alignment_accuracy_10ms"](spark, sf).collect()) == at(10_000) > 40 * at(500_000)
    users = {r.event_id: r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    assert {users[r.event_id] % 2 for r in q["recent_feedback_all"](spark, sf).collect()} == {0, 1}


def test_align_words_keeps_the_longest_chain(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    pieces = [words[a : a + 6] for a in range(0, 60, 6)]
    for _ in range(3):
        r.shuffle(pieces)
        moved = [w for p in pieces for w in p]
        src = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "k long, position long, word string")
        edit = spark.createDataFrame([(1, i, w) for i, w in enumerate(moved)], "k long, position long, word string")
        got = sorted((x.edit_position, x.source_position) for x in sm.align_words(src, edit, ["k"]).collect())
        at = {tuple(words[i : i + 3]): i for i in range(58)}
        anchors = [at[g] for i in range(58) if (g := tuple(moved[i : i + 3])) in at]
        best = [1] * len(anchors)
        for i, x in enumerate(anchors):
            best[i] = 1 + max((best[j] for j in range(i) if anchors[j] < x), default=0)
        assert len(got) == max(best) and [s for _, s in got] == sorted(s for _, s in got)


def test_readers_keep_every_record(spark, tmp_path):
    from tidemark.sources import io

    (tmp_path / "w").mkdir()
    for name, first in (("a", 0), ("b", 5)):
        (tmp_path / "w" / f"{name}.json").write_text(json.dumps([{"text": f"x{k}", "start": k + 0.5, "end": k + 1} for k in range(first, first + 3)], indent=1))
    got = sorted((r.position, r.text, r.start_us) for r in io.read_words(spark, f"file://{tmp_path}/w").collect())
    assert got == [(0, "x0", 500_000), (0, "x5", 5_500_000), (1, "x1", 1_500_000), (1, "x6", 6_500_000), (2, "x2", 2_500_000), (2, "x7", 7_500_000)]
    (tmp_path / "t").mkdir()
    block = {"source_start": 1, "source_end": 3, "edit_start": 0, "edit_end": 2, "speed_ratio": 1.0}
    for k, record in enumerate(({"blocks": [block, block]}, [block], {"retained_intervals": [{"source_start": 4, "source_end": 5}]}, {})):
        (tmp_path / "t" / f"{k}.json").write_text(json.dumps(record, indent=1))
    rows = io.truth_blocks(io.read_truth(spark, f"file://{tmp_path}/t")).collect()
    assert sorted((r.source_start or 0, r.edit_end or 0) for r in rows) == [(0, 0), (1, 2), (1, 2), (1, 2), (4, 0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_equal_a_loop(spark, seed):
    """Segments that overlap, repeat a start, last longer than the limit and leave long pauses."""
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(200):
        t += r.choice([0, 0, 1, 5, 20, 90 if i % 17 == 0 else 3])
        rows.append((i % 2, t * S, i, (t + r.choice([1, 4, 10, 60 if i % 13 == 0 else 2])) * S, f"w{i}"))
    want = []
    for k in (0, 1):
        block = -1
        for key, start, _, end, text in sorted(x for x in rows if x[0] == k):
            if block < 0 or end - want[-1][2] > 45 * S:
                block += 1
                want.append([key, block, start, end, 1, text])
            else:
                want[-1][3:] = [end, want[-1][4] + 1, want[-1][5] + " " + text]
    got = sq.chunk_utterances(spark.createDataFrame(rows, "asset_id long, start_us long, sequence long, end_us long, text string"), ["asset_id"])
    assert sorted(map(tuple, got.select("asset_id", "block", "start_us", "end_us", "n", "text").collect())) == sorted(map(tuple, want)) and len(want) > 20


def test_merge_overlapping_unites_arrays(spark):
    r = random.Random(5)
    rows = [(1, i, r.randint(0, 900), 0, r.random(), [r.choice("abc")], [i, i + 1]) for i in range(150)]
    rows = [(k, i, s, s + r.randint(1, 30), c, a, e) for k, i, s, _, c, a, e in rows]
    df = spark.createDataFrame(rows, "asset_id long, event_id long, start_us long, end_us long, confidence double, kinds array<string>, ids array<long>")
    want = []
    for _, i, s, e, c, a, d in sorted(rows, key=lambda x: (x[2], x[3], x[1])):
        w = want[-1] if want else None
        if w and 2 * (min(w[1], e) - s) > min(w[1] - w[0], e - s):
            want[-1] = (w[0], max(w[1], e), min(w[2], c), w[3] + 1, w[4] | set(a), w[5] | set(d), min(w[6], i))
        else:
            want.append((s, e, c, 1, set(a), set(d), i))
    got = sq.merge_overlapping(df, ["asset_id"], unite=["kinds", "ids"], least=["event_id"]).select("start_us", "end_us", "confidence", "n", "kinds", "ids", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted((s, e, c, n, sorted(a), sorted(d), i) for s, e, c, n, a, d, i in want) and max(w[3] for w in want) > 2

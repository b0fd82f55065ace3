"""Streams against their batch forms, and sinks."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.operators.series import best_lag, chunks_of
from tidemark.plans.data import QUERIES, _run, _stream
from tidemark.sources import io, shared, versions
from tidemark.streaming import jobs

SCHEMA = "asset_id long, t_us long, value double"


def test_bursts_match_a_loop(spark):
    r = random.Random(1)
    rows = [(a, (t + 1) * 100_000, round(r.random(), 2)) for a in range(3) for t in range(60)]
    s = spark.createDataFrame([*rows, (-1, 10**13, 0.0)], SCHEMA).withColumn("t", F.timestamp_micros("t_us"))  # the marker of key -1 ends all runs
    got = sorted(tuple(x) for x in _run(jobs.stream_bursts(_stream(spark, s, "s"), 0.6), spark, "b").collect())
    want = []
    for a in range(3):
        own = [x for x in rows if x[0] == a]
        run = []
        for i, (_, t, v) in enumerate(own):
            if v >= 0.6:
                run.append(i)
            elif run:
                want.append((a, own[max(0, run[0] - 1)][1], t, len(run), max(own[k][2] for k in run)))
                run = []
        if run:
            want.append((a, own[max(0, run[0] - 1)][1], own[-1][1], len(run), max(own[k][2] for k in run)))
    assert got == sorted(want)


def test_feedback_keeps_the_newest_over_batches(spark):
    path = shared.new_table(spark, "f")
    for number, rows in enumerate(([(1, 1, "accept"), (2, 2, "lock"), (1, 3, "reject")], [(2, 4, "accept"), (3, 1, "lock")])):
        log = spark.createDataFrame(rows, "clip_id long, event_id long, feedback_type string").coalesce(1)
        log.write.mode("append").parquet(f"{path}-log")
        jobs.stream_feedback(spark.readStream.schema(log.schema).parquet(f"{path}-log"), path, f"{path}-checkpoint")
        assert len(jobs.read_feedback(spark, path).collect()) == 2 + number
    assert sorted(tuple(r) for r in jobs.read_feedback(spark, path).collect()) == [(1, 3, "reject"), (2, 4, "accept"), (3, 1, "lock")]


def test_clusters_close_at_the_gap(spark):
    us = lambda c: F.timestamp_micros(F.col(c) * 1_000_000)
    rows = [(1, 0, 2), (1, 5, 6), (1, 10, 11), (2, 0, 1), (-1, 10**6, 10**6)]
    e = spark.createDataFrame(rows, "asset_id long, a long, b long").select("asset_id", us("a").alias("start"), us("b").alias("end"))
    got = _run(jobs.stream_clusters(_stream(spark, e, "e")), spark, "c").where("asset_id > 0").select("asset_id", "n", F.expr("unix_micros(first) div 1000000").alias("s"), F.expr("unix_micros(last) div 1000000").alias("e"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 10, 11), (1, 2, 0, 6), (2, 1, 0, 1)]


def test_append_twice_and_replace(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    path = f"file://{tmp_path}/t"
    io.write_idempotent(df, path, "k")
    assert io.write_idempotent(df.unionByName(spark.createDataFrame([(3, "c")], "k long, v string")), path, "k").count() == 3
    io.replace_asset(df.distinct(), path + "r", "k")
    out = io.replace_asset(spark.createDataFrame([(2, "z")], "k long, v string"), path + "r", "k")
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "a"), (2, "z")]


def test_best_lag_finds_its_place(spark):
    r = random.Random(5)
    y = [r.random() for _ in range(80)]
    chunks = spark.createDataFrame([(1, 0, y[20:35]), (1, 1, y[50:62])], "k long, chunk_id long, levels array<double>")
    got = best_lag(chunks, spark.createDataFrame([(1, y)], "k long, levels array<double>"), ["k"])
    assert sorted((x.chunk_id, x.lag, x.speed) for x in got.collect()) == [(0, 20, 1.0), (1, 50, 1.0)]


def test_best_lag_covers_the_whole_series(spark):
    sf = "/root/testdata/sf0.001"
    want = {(r.user_id, c) for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect() for c in range((r["count"] - 12) // 6 + 1)}
    got = {(r.asset_id, r.chunk_id): r for r in QUERIES["best_lag"](spark, sf).collect()}
    assert set(got) == want and all(r.score > 0.99 for r in got.values())
    rows = spark.createDataFrame([(1, [float(i * i % 7) for i in range(n)]) if n == 9 else (n, [float(i * i % 11) for i in range(n)]) for n in (9, 12, 17, 18, 140)], "k long, levels array<double>")
    cut = {(r.k, r.chunk_id): (len(r.levels), len(r.context), r.context_at) for r in chunks_of(rows, ["k"]).collect()}
    assert cut[1, 0] == (9, 9, 0) and cut[12, 0] == (12, 12, 0) and (17, 1) not in cut and cut[18, 1] == (12, 18, 6)
    assert len([x for x in cut if x[0] == 140]) == 22 and cut[140, 12] == (12, 120, 60) and cut[140, 21] == (12, 74, 60)


def test_best_lag_tries_ambiguous_chunks_with_context(spark):
    r = random.Random(11)
    y = [r.random() for _ in range(1500)]
    noise = [r.random() for _ in range(1500)]
    faint = [0.5 * a + 0.9 * b for a, b in zip(y[700:800], noise, strict=False)]
    rows = [(1, 0, faint, y[400:1000], 300), (1, 1, faint, noise[100:700], 300), (1, 2, faint, y[650:850], 50)]
    kind = "k long, chunk_id long, levels array<double>, context array<double>, context_at int"
    chunks, source = spark.createDataFrame(rows, kind), spark.createDataFrame([(1, y)], "k long, levels array<double>")
    alone = best_lag(chunks.drop("context", "context_at"), source, ["k"], (1.0,)).collect()
    assert len(alone) == 3 and all(0.35 < x.score < 0.45 and x.lag == 700 for x in alone)
    got = {x.chunk_id: (x.lag, round(x.score, 2)) for x in best_lag(chunks, source, ["k"], (1.0,)).collect()}
    assert got == {0: (700, 1.0), 2: (700, round(alone[0].score, 2))}  # confirmed, refused, too little context


def test_bursts_of_late_and_shuffled_samples(spark):
    """Samples that come in any order over many batches give the runs of the whole series."""
    r = random.Random(9)
    rows = [(a, (t + 1) * 100_000, round(r.random(), 2)) for a in range(4) for t in range(80)]
    shuffled = r.sample(rows, len(rows))
    path = shared.new_table(spark, "late")
    parts = [shuffled[k::6] for k in range(6)] + [[(-1, 10**13, 0.0)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).withColumn("t", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(SCHEMA + ", t timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted(tuple(x) for x in _run(jobs.stream_bursts(stream, 0.6), spark, "late-runs").collect())
    want = []
    for a in range(4):
        own, run = [x for x in rows if x[0] == a], []
        for i, (_, t, v) in enumerate(own):
            if v >= 0.6:
                run.append(i)
            elif run:
                want.append((a, own[max(0, run[0] - 1)][1], t, len(run), max(own[k][2] for k in run)))
                run = []
        if run:
            want.append((a, own[max(0, run[0] - 1)][1], own[-1][1], len(run), max(own[k][2] for k in run)))
    assert got == sorted(want)


def test_keys_of_bursts_share_rows_of_state(spark):
    """Many keys, also without a name, take no more rows of state than there are parts, and runs stay apart."""
    r = random.Random(21)
    own = {a: [((t + 1) * 100_000, r.choice([0.1, 0.6, 0.6, 0.9])) for t in range(r.randint(1, 9))] for a in [None, *range(3000)]}
    rows = [(a, t, v) for a, x in own.items() for t, v in x]
    s = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.timestamp_micros("t_us")).repartition(2, "t_us")
    end = spark.createDataFrame([(-1, 10**13, 0.0)], SCHEMA).withColumn("t", F.timestamp_micros("t_us"))
    query = jobs.stream_bursts(_stream(spark, s, "many", files=1, then=end), 0.6).writeStream.format("memory").queryName("many_bursts").option("checkpointLocation", shared.new_table(spark, "many-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(((x.asset_id, x.start_us, x.end_us, x.n, x.peak) for x in spark.table("many_bursts").collect()), key=str)
    want = []
    for a, x in own.items():
        run = []
        for i, (t, v) in enumerate([*x, (x[-1][0], 0.0)]):
            if v >= 0.6:
                run.append(i)
            elif run:
                want.append((a, x[max(0, run[0] - 1)][0], t, len(run), max(x[k][1] for k in run)))
                run = []
    assert got == sorted(want, key=str) and len(want) > 3000
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= jobs.BURST_PARTS + 1


def test_compaction_keeps_one_version(spark):
    path, kind = shared.new_table(spark, "v"), "clip_id long, event_id long, feedback_type string"
    want = {}
    for number in range(9):
        rows = [(number % 4, number, "lock"), (10 + number, number, "accept")]
        want |= {k: (k, v, t) for k, v, t in rows}
        versions.write_delta(spark.createDataFrame(rows, kind), path, number)
        if number % 3 == 2:
            before = jobs.read_feedback(spark, path)  # a reader that began with the version before
            assert versions.compact(spark, path, jobs._newest) == number
            assert sorted(map(tuple, before.collect())) == sorted(want.values())
        assert sorted(map(tuple, jobs.read_feedback(spark, path).collect())) == sorted(want.values())
    assert versions.compact(spark, path, jobs._newest) is None
    assert [c["upto"] for c in versions.commits(spark, path)] == [5, 8]
    assert sorted(versions._numbers(spark, path, "snapshot")) == [5, 8] and versions._numbers(spark, path, "delta") == [6, 7, 8]
    versions.write_delta(spark.createDataFrame([(1, 0, "old")], kind), path, 3)  # a batch that runs again
    assert versions._numbers(spark, path, "delta") == [6, 7, 8] and versions.next_number(spark, path) == 9


def test_appends_are_compacted(spark):
    path = shared.new_table(spark, "a")
    for k in range(5):
        out = io.write_idempotent(spark.createDataFrame([(k, "x"), (k + 1, "x")], "k long, v string"), path, "k", compact_after=2)
        assert sorted(r.k for r in out.collect()) == list(range(k + 2))


def test_sync_writes_only_changed_parts(spark):
    path, keys, parents = shared.new_table(spark, "s"), {"a": ["k"], "b": ["x", "y"]}, {"b": [("a", ["k"])]}
    a = spark.createDataFrame([(k, 1, "one") for k in range(200)], "k long, v long, t string")
    b = spark.createDataFrame([(k, k % 3, k % 250, 1) for k in range(400)], "x long, y long, k long, v long")
    out = io.sync_tables({"b": b, "a": a}, path, keys, parents, "v", buckets=16)
    assert out["a"].count() == 200 and out["b"].count() == 350  # 50 rows of b have no parent
    files = {x for x in out["a"].inputFiles()}
    change = spark.createDataFrame([(7, 2, "two"), (8, 1, "same version"), (7, 3, "three"), (999, 1, "new")], "k long, v long, t string")
    out = io.sync_tables({"a": change}, path, keys, parents, "v", buckets=16)
    got = {r.k: (r.v, r.t) for r in out["a"].collect()}
    assert len(got) == 201 and got[7] == (3, "three") and got[8] == (1, "one") and got[999] == (1, "new")
    kept = files & set(out["a"].inputFiles())
    assert len(files) - 2 <= len(kept) < len(files)


def slide(x, y, speed):
    """The highest normalised correlation of x, stretched, and its first place, by a plain loop."""
    n = max(2, round(len(x) * speed))
    if n > len(y):
        return None
    z = np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)
    z = z - z.mean()
    best = (-2.0, 0)
    for at in range(len(y) - n + 1):
        w = np.asarray(y[at : at + n])
        c = round(float(((w - w.mean()) * z).sum() / np.sqrt(max(((w - w.mean()) ** 2).sum(), 1e-12) * max((z * z).sum(), 1e-12))), 9)
        best = max(best, (c, -at))
    return round(best[0], 4), best[1], speed


@pytest.mark.parametrize("places", [4096, 50])
def test_best_lag_equals_a_loop(spark, monkeypatch, places):
    monkeypatch.setattr(series, "PLACES", places)
    r = random.Random(12)
    ys = {k: [r.random() for _ in range(n)] for k, n in ((1, 300), (2, 40), (3, 5), (4, 1))}
    chunks = [(k, c, [r.random() for _ in range(n)] if c % 2 else y[c * 3 : c * 3 + n]) for k, y in ys.items() for c, n in enumerate((12, 9, 70, 12, 5, 3))]
    chunks = [x for x in chunks if x[2]]
    speeds = (0.5, 1.0, 1.5, 2.0)
    want = {}
    for k, c, x in chunks:
        tried = [t for t in (slide(x, ys[k], s) for s in speeds) if t]
        if tried and max(tried)[0] > 0.35:
            want[k, c] = (max(tried)[0], -max(tried)[1], max(tried)[2])
    df = spark.createDataFrame(chunks, "k long, chunk_id long, levels array<double>")
    got = {(x.k, x.chunk_id): (x.score, x.lag, x.speed) for x in best_lag(df, spark.createDataFrame(list(ys.items()), "k long, levels array<double>"), ["k"], speeds).collect()}
    assert got == want and len(want) > 8

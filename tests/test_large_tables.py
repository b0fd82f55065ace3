"""Steps whose memory or number of files must not follow the input: what they hold, seen in their plans and results."""

from __future__ import annotations

import time
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators import series as se
from tidemark.operators import similarity as sm
from tidemark.sources import io


def broadcasts(spark, run) -> list[int]:
    """Rows of the broadcasts that `run` makes, as its plans tell."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    time.sleep(1)
    found = []
    for i in range(before, store.executionsCount()):
        at = store.executionsList().apply(i).executionId()
        values = store.executionMetrics(at)
        nodes = store.planGraph(at).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if node.name() == "BroadcastExchange":
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows":
                        found.append(int(values.get(metric.accumulatorId()).get().replace(",", "")) if values.contains(metric.accumulatorId()) else 0)
    return found


def test_words_are_not_broadcast(spark):
    """Positions are small in files; a broadcast of them takes the driver's memory."""
    w = spark.range(4000).select((F.col("id") % 4).alias("k"), (F.col("id") / 4).cast("long").alias("position"), F.format_string("w%d", F.expr("id div 4 * 7919 % 500")).alias("word"))
    assert not broadcasts(spark, lambda: sm.align_all_words(w, w.where("position % 5 <> 2"), ["k"]).count())


def test_carried_values_are_not_broadcast(spark):
    e = spark.range(2000).select((F.col("id") % 500).alias("k"), (F.col("id") * iv.CHUNK).alias("start_us"), F.col("id").alias("v"))
    assert not broadcasts(spark, lambda: iv.carry_last(e, ["k"], "start_us", ["v"], seen=F.col("v")).agg(F.sum("seen")).collect())


def test_replaced_keys_share_files(spark, tmp_path):
    """A folder for each key makes as many files as keys; a null key is replaced too, and keys keep their type."""
    path = str(tmp_path / "assets")
    old = spark.range(3000).select(F.when(F.col("id") > 0, F.format_string("%04d", "id")).alias("k"), F.lit(1).alias("v"))
    io.replace_asset(old, path, "k")
    assert len(list((tmp_path / "assets").rglob("*.parquet"))) <= 64 * 4
    out = io.replace_asset(old.where("k is null or k < '0011'").withColumn("v", F.lit(2)), path, "k")
    assert {(r["k"], r["v"]) for r in out.where("k is null or k < '0013'").collect()} == {(None, 2), ("0011", 1), ("0012", 1), *((f"{i:04d}", 2) for i in range(1, 11))}
    assert out.count() == 3000
    assert io.replace_asset(old.limit(0), path, "k").count() == 3000


def test_frames_are_compared_in_blocks(spark, monkeypatch):
    """The nearest of all pairs as by a plain loop, the first on ties after rounding; no row of a plan stands for a pair."""
    monkeypatch.setattr(se, "EDIT_FRAMES", 16)
    monkeypatch.setattr(se, "SOURCE_FRAMES", 32)
    rng = np.random.default_rng(4)
    f = np.round(rng.random((400, 6)), 2)
    f[::7] = f[3]
    f[5::7] += 1e-5 * rng.random((len(f[5::7]), 1))
    rows = [(i % 2, i, x.tolist()) for i, x in enumerate(f)] + [(0, 400, None), (0, 405, [0.5, None]), (1, 401, [0.5])]
    v = spark.createDataFrame(rows, "k long, frame_id long, f array<double>")
    out = se.fingerprint_match(v.where("frame_id % 5 = 0"), v.where("frame_id % 5 <> 0"), ["k"], limit=0.3)
    got = {(r["k"], r["frame_id"]): (r["difference"], r["source_id"]) for r in out.collect()}
    want = {}
    for i in range(0, 400, 5):
        def difference(j):
            total = 0.0
            for x, y in zip(f[i].tolist(), f[j].tolist()):
                total += abs(x - y)
            return float(Decimal(repr(total / 6)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
        best = min((difference(j), j) for j in range(400) if j % 5 and j % 2 == i % 2)
        if best[0] < 0.3:
            want[i % 2, i] = best
    assert got == want
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_gaps_in_one_pass(spark):
    """Merged intervals come once to their gaps, not once for each part of a union; keys without any have one gap."""
    e = spark.createDataFrame([(1, 5, 10), (1, 8, 20), (1, 30, 40), (2, 0, 7), (4, 1, 2)], "k long, start_us long, end_us long")
    h = spark.createDataFrame([(1, 50), (2, 7), (3, 9)], "k long, horizon_us long")
    out = iv.gaps(e, ["k"], h, min_gap=0, eps=1)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 5), (1, 20, 30), (1, 40, 50), (3, 0, 9)]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()

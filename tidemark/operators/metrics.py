"""Evaluation of one selection of intervals against another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import f1, r4, share, stats
from ..schemas import SECOND
from .intervals import Keys, best_overlap, covered_us, merge_intervals, nearest_within, overlap_join, overlap_us

TOLERANCES = [0, SECOND // 2, SECOND, 2 * SECOND]


def overlap_metrics(ai: DataFrame, human: DataFrame, by: Keys, tolerances: list[int] = TOLERANCES) -> DataFrame:
    """Precision, recall and F1 of each key at each tolerance; only the human side is widened."""
    kept = merge_intervals(ai, by)
    # one merge for all tolerances; null: not widened, for the human total
    wide = F.array(*[F.struct(F.lit(t).cast("long").alias("tol_us"), *(F.col(c).cast("long").alias(c) for c in ("start_us", "end_us"))) if t is None else F.struct(F.lit(t).cast("long").alias("tol_us"), F.greatest(F.lit(0), F.col("start_us") - t).cast("long").alias("start_us"), (F.col("end_us") + t).cast("long").alias("end_us")) for t in (None, *tolerances)])
    widened = merge_intervals(human.select(*by, F.explode(wide).alias("w")).select(*by, "w.*"), [*by, "tol_us"])
    length = F.sum(F.col("end_us") - F.col("start_us"))
    human_total = widened.where("tol_us is null").groupBy(*by).agg(length.alias("human_us"))
    inter = overlap_join(kept, widened.where("tol_us is not null"), by).groupBy(*by, F.col("r_tol_us").alias("tol_us")).agg(F.sum(overlap_us()).alias("inter_us"))
    every = F.explode(F.array(*[F.lit(t).cast("long") for t in tolerances])).alias("tol_us")
    out = kept.groupBy(*by).agg(length.alias("ai_us")).join(human_total, by, "full").select("*", every).join(inter, [*by, "tol_us"], "left").fillna(0, ["ai_us", "human_us", "inter_us"])
    out = out.withColumn("inter_us", F.least("inter_us", "ai_us")).withColumn("precision", share("inter_us", "ai_us")).withColumn("recall", share("inter_us", "human_us"))
    return out.withColumn("f1", f1("precision", "recall"))


def context_metrics(ai: DataFrame, human: DataFrame, by: Keys, tol: int = SECOND) -> DataFrame:
    """Per key: matches that start or end too tight, too wide or well, and mean offsets in seconds."""
    m = best_overlap(human, ai, by).withColumn("pre", F.col("r_start_us") - F.col("start_us")).withColumn("post", F.col("r_end_us") - F.col("end_us"))
    short = (F.col("pre") > tol) | (F.col("post") < -tol)
    long_ = (F.col("pre") < -2 * tol) | (F.col("post") > 2 * tol)
    m = m.withColumn("verdict", F.when(short, "short").when(long_, "long").otherwise("good"))
    count = lambda v: F.count_if(F.col("verdict") == v)
    return m.groupBy(*by).agg(F.count("*").alias("matched"), count("short").alias("too_short"), count("long").alias("too_long"), count("good").alias("good"), r4(F.avg(F.col("pre") / SECOND)).alias("mean_pre_s"), r4(F.avg(F.col("post") / SECOND)).alias("mean_post_s"), r4(F.percentile(F.col("pre") / SECOND, 0.5)).alias("median_pre_s"))


def context_offsets(ai: DataFrame, human: DataFrame, by: Keys) -> DataFrame:
    """Per key and edge (pre, post): quantiles, mean and deviation of the matches' offsets in seconds."""
    m = best_overlap(human, ai, by)
    edges = F.explode(F.array(F.struct(F.lit("pre").alias("edge"), (F.col("r_start_us") - F.col("start_us")).alias("us")), F.struct(F.lit("post").alias("edge"), (F.col("r_end_us") - F.col("end_us")).alias("us"))))
    return m.select(*by, edges.alias("e")).groupBy(*by, F.col("e.edge").alias("edge")).agg(F.count("*").alias("n"), *stats(F.col("e.us") / SECOND))


def content_density(clips: DataFrame, events: DataFrame, by: Keys, horizon: DataFrame) -> DataFrame:
    """Per key: the clips' share of the recording (horizon_us), and events wholly inside a clip, in all and by clip minute."""
    total = clips.groupBy(*by).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("total_us")).join(horizon, by)
    inside = overlap_join(clips.select(*by, "start_us", "end_us"), events.select(*by, "event_id", "start_us", "end_us"), by, kind="contained").select(*by, "r_event_id").distinct().groupBy(*by).agg(F.count("*").alias("contained"))
    out = total.join(inside, by, "left").fillna(0, ["contained"])
    ratio = lambda a, b: F.when(b > 0, r4(a / b)).otherwise(F.lit(0.0))
    return out.withColumn("compression", ratio(F.col("total_us"), F.col("horizon_us"))).withColumn("contained_per_min", ratio(F.col("contained"), F.col("total_us") / (60.0 * SECOND)))


def effect_rate(ai_effects: DataFrame, human_effects: DataFrame, clips: DataFrame, by: Keys, over: float = 12.0, under: float = 0.5, least: int = 3) -> DataFrame:
    """Per key of clips: AI effects a minute, whether they are too many, or too few where humans set more than `least`."""
    n = lambda df, c: df.groupBy(*by).agg(F.count("*").alias(c))
    out = clips.groupBy(*by).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("total_us")).join(n(ai_effects, "ai_n"), by, "left").join(n(human_effects, "human_n"), by, "left").fillna(0, ["ai_n", "human_n"])
    rate = F.when(F.col("total_us") > 0, F.col("ai_n") / (F.col("total_us") / (60.0 * SECOND))).otherwise(F.lit(0.0))
    return out.withColumn("per_min", r4(rate)).withColumn("over_effected", rate > over).withColumn("under_effected", (rate < under) & (F.col("human_n") > least))


def pacing_metrics(clips: DataFrame, by: Keys) -> DataFrame:
    """Clips, cuts a minute (over 10 s only), clip lengths and the gaps between clips (from 0 on)."""
    w = Window.partitionBy(*by).orderBy("start_us", "end_us", "event_id")
    c = clips.withColumn("len_us", F.col("end_us") - F.col("start_us")).withColumn("gap_us", F.greatest(F.lit(0), F.col("start_us") - F.lag("end_us").over(w)))
    c = c.groupBy(*by).agg(F.count("*").alias("n"), F.sum("len_us").alias("total_us"), r4(F.avg("len_us") / SECOND).alias("mean_clip_s"), r4(F.percentile("len_us", 0.5) / SECOND).alias("median_clip_s"), r4(F.avg("gap_us") / SECOND).alias("mean_gap_s"))
    return c.withColumn("cuts_per_min", F.when(F.col("total_us") > 10 * SECOND, r4((F.col("n") - 1) / (F.col("total_us") / (60.0 * SECOND)))).otherwise(F.lit(0.0)))


def dead_air(clips: DataFrame, events: DataFrame, by: Keys, kinds: tuple[str, ...] = ("silence", "dead_air", "pause")) -> DataFrame:
    """Quiet events wholly inside clips: count, seconds, share of the clips' time."""
    quiet = events.where(F.col("event_type").isin(*kinds))
    inside = overlap_join(clips, quiet, by, kind="contained").groupBy(*by).agg(F.count("*").alias("quiet_n"), F.sum(F.col("r_end_us") - F.col("r_start_us")).alias("quiet_us"))
    total = clips.groupBy(*by).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))
    return total.join(inside, by, "left").fillna(0, ["quiet_n", "quiet_us"]).withColumn("quiet_share", share("quiet_us", "total_us"))


def segment_support(a: DataFrame, b: DataFrame, by: Keys, tol: int = SECOND) -> DataFrame:
    """Each a-interval: matched if raw overlaps sum to 70 % or all but `tol` of it, partial if over 0, else missed."""
    inter = overlap_join(a, b, by).groupBy(*by, "event_id").agg(F.sum(overlap_us()).alias("support_us"))
    out = a.join(inter, [*by, "event_id"], "left").withColumn("support_us", F.coalesce("support_us", F.lit(0)).cast("long"))
    length = F.col("end_us") - F.col("start_us")
    verdict = F.when((F.col("support_us") * 10 >= length * 7) | (length - F.col("support_us") <= tol), "matched").when(F.col("support_us") > 0, "partial").otherwise("missed")
    return out.withColumn("verdict", verdict).withColumn("zero_overlap", (F.col("support_us") == 0) & (verdict == "matched")).select(*by, "event_id", "support_us", "verdict", "zero_overlap")


def trace_root_cause(failures: DataFrame, layers: list[tuple[str, DataFrame]], by: Keys, found: str = "BUDGET_EXCLUSION") -> DataFrame:
    """The reason of the first layer without a row that overlaps the failure."""
    out, reason = failures, None
    for n, (name, layer) in enumerate(layers):
        hit = overlap_join(failures, layer, by).select(*by, "event_id").distinct().withColumn(f"_hit{n}", F.lit(1))
        out = out.join(hit, [*by, "event_id"], "left")
        reason = F.when(F.col(f"_hit{n}").isNull(), name) if reason is None else reason.when(F.col(f"_hit{n}").isNull(), name)
    return out.withColumn("reason", reason.otherwise(found)).select(*by, "event_id", "reason")


def effect_metrics(ai: DataFrame, human: DataFrame, by: Keys, limit: int = 2 * SECOND) -> DataFrame:
    """Human effects with the nearest AI effect: same, similar (both zoom, speed or text), different; and those of one side only."""
    m = nearest_within(human, ai, by, limit)
    family = lambda c: F.regexp_extract(F.col(c), "(zoom|speed|text)", 1)
    kind = F.when(F.col("effect_type") == F.col("r_effect_type"), "same").when((family("effect_type") != "") & (family("effect_type") == family("r_effect_type")), "similar").otherwise("different")
    m = m.withColumn("kind", kind)
    agg = m.groupBy(*by).agg(F.count("*").alias("matched"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("same", "similar", "different")], F.count_distinct("r_event_id").alias("ai_used"))
    out = human.groupBy(*by).agg(F.count("*").alias("human_n")).join(ai.groupBy(*by).agg(F.count("*").alias("ai_n")), by, "full").join(agg, by, "left").fillna(0)
    agreement = F.when(F.col("matched") > 0, r4((F.col("same") + F.col("similar")) / F.col("matched"))).when((F.col("human_n") == 0) & (F.col("ai_n") == 0), 1.0).otherwise(0.0)
    return out.withColumn("human_only", F.col("human_n") - F.col("matched")).withColumn("ai_only", F.col("ai_n") - F.col("ai_used")).withColumn("agreement", agreement)


def macro_micro(results: DataFrame) -> DataFrame:
    """Means of the ratios, and ratios of the summed durations (each at most 1)."""
    r = results.groupBy("tol_us").agg(r4(F.avg("precision")).alias("macro_precision"), r4(F.avg("recall")).alias("macro_recall"), r4(F.avg("f1")).alias("macro_f1"), share(F.sum("inter_us"), F.sum("ai_us")).alias("micro_precision"), share(F.sum("inter_us"), F.sum("human_us")).alias("micro_recall"))
    return r.withColumn("micro_f1", f1("micro_precision", "micro_recall"))


def quantile_stats(df: DataFrame, column: str, by: Keys) -> DataFrame:
    return df.groupBy(*by).agg(*stats(F.col(column)))


def gap_distribution(events: DataFrame, by: Keys) -> DataFrame:
    """Positive gaps between neighbours in time, by the pair of their types."""
    w = Window.partitionBy(*by).orderBy("start_us", "event_id")
    e = events.withColumn("gap_s", (F.lead("start_us").over(w) - F.col("end_us")) / SECOND).withColumn("next_type", F.lead("event_type").over(w)).where("gap_s > 0")
    return e.groupBy("event_type", "next_type").agg(F.count("*").alias("n"), *stats(F.col("gap_s")))


def coverage_audit(stages: dict[str, DataFrame], by: Keys, horizon: DataFrame) -> DataFrame:
    """Per key and stage: rows, first start, last end, spanned share of the recording, unprocessed tail."""
    out = None
    for name, df in stages.items():
        one = df.groupBy(*by).agg(F.count("*").alias("n"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us")).withColumn("stage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    out = out.join(horizon, by)
    return out.withColumn("span_share", share(F.col("last_us") - F.col("first_us"), F.col("horizon_us"))).withColumn("tail_us", F.greatest(F.lit(0), F.col("horizon_us") - F.col("last_us")))


def bin_coverage(blocks: DataFrame, by: Keys, width: int = 900 * SECOND) -> DataFrame:
    """Kept time of each bin of the blocks' midpoints, and its share of the bin."""
    mid = F.expr(f"(source_start_us + source_end_us) div 2 div {width}")
    b = blocks.groupBy(*by, mid.alias("bin")).agg(F.sum(F.col("source_end_us") - F.col("source_start_us")).alias("kept_us"))
    return b.withColumn("bin_share", r4(F.col("kept_us") / width))


def confusion(predicted: DataFrame, labels: DataFrame, by: Keys) -> DataFrame:
    """Windows with a truth flag against whether any prediction overlaps them: counts and rates of all keys together."""
    hit = overlap_join(labels, predicted, by).select(*by, "event_id").distinct().withColumn("_hit", F.lit(1))
    f = labels.join(hit, [*by, "event_id"], "left").withColumn("p", F.col("_hit").isNotNull())
    c = f.agg(F.count_if(F.expr("p and truth")).alias("tp"), F.count_if(F.expr("p and not truth")).alias("fp"), F.count_if(F.expr("not p and not truth")).alias("tn"), F.count_if(F.expr("not p and truth")).alias("fn"))
    c = c.withColumn("precision", share("tp", F.col("tp") + F.col("fp"))).withColumn("recall", share("tp", F.col("tp") + F.col("fn"))).withColumn("specificity", share("tn", F.col("tn") + F.col("fp")))
    return c.withColumn("f1", f1("precision", "recall"))


def covered_majority(nodes: DataFrame, intervals: DataFrame, by: Keys, key: Keys) -> DataFrame:
    """Nodes of which merged intervals cover more than half."""
    return covered_us(nodes, intervals, by, key).where(F.col("covered_us") * 2 > F.col("end_us") - F.col("start_us"))


def narrative_metrics(ai: DataFrame, human: DataFrame, nodes: DataFrame, by: Keys) -> DataFrame:
    """Per key: setups and payoffs intact, callbacks kept, threads of both sides and of one, time of the AI's threads.

    ai, human: intervals, of which the AI's have a `thread`; nodes: node, start_us, end_us, thread, is_setup, payoff (a
    node), is_callback. A node is kept if a side's merged intervals cover more than half of it. A pair is intact if the
    AI keeps both of it, and the human keeps both or not the setup. Shares of nothing are 1.
    """
    own = covered_us(nodes, ai, by, ["node"]).where("2 * covered_us > end_us - start_us").select(*by, "node", F.lit(True).alias("_ai"))
    hum = covered_us(nodes, human, by, ["node"]).where("2 * covered_us > end_us - start_us").select(*by, "node", F.lit(True).alias("_hu"))
    n = nodes.join(own, [*by, "node"], "left").join(hum, [*by, "node"], "left").fillna(False, ["_ai", "_hu"])
    pay = n.select(*by, F.col("node").alias("payoff"), F.col("_ai").alias("_pay_ai"), F.col("_hu").alias("_pay_hu")).dropDuplicates([*by, "payoff"])
    n = n.join(pay, [*by, "payoff"], "left").fillna(False, ["_pay_ai", "_pay_hu"])
    pair = F.col("is_setup") & F.col("payoff").isNotNull()
    intact = pair & F.expr("_ai and _pay_ai and (not _hu or _pay_hu)")
    listed = lambda c: F.array_sort(F.collect_set(c))
    g = n.groupBy(*by).agg(F.count("*").alias("story_nodes"), F.count_if(pair).alias("pairs"), F.count_if(intact).alias("pairs_intact"), F.count_if("is_callback").alias("callbacks"), F.count_if(F.expr("is_callback and _ai")).alias("callbacks_kept"), listed(F.when(F.col("_hu"), F.col("thread"))).alias("_h"))
    time = ai.where("thread is not null").groupBy(*by, "thread").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    time = time.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("thread", "us"))).alias("_t"))
    out = g.join(time, by, "full").join(ai.select(*by).distinct().unionByName(human.select(*by).distinct()).distinct(), by, "full").fillna(0, ["story_nodes", "pairs", "pairs_intact", "callbacks", "callbacks_kept"])
    a, h = F.coalesce(F.expr("transform(_t, x -> x.thread)"), F.array()), F.coalesce("_h", F.array())
    ratio = lambda x, y: F.when(F.col(y) > 0, r4(F.col(x) / F.col(y))).otherwise(F.lit(1.0))
    text = lambda x: F.array_join(x, ",")
    return out.select(
        *by, "story_nodes", "pairs", "pairs_intact", ratio("pairs_intact", "pairs").alias("completeness"), "callbacks", "callbacks_kept", ratio("callbacks_kept", "callbacks").alias("callback_rate"),
        text(F.array_intersect(a, h)).alias("shared_threads"), text(F.array_except(a, h)).alias("ai_threads"), text(F.array_except(h, a)).alias("human_threads"),
        F.coalesce(F.array_join(F.expr("transform(_t, x -> concat(x.thread, ':', x.us))"), ","), F.lit("")).alias("thread_time"),
    )

"""Reports over the library's tables: selections against references, decisions, densities, listings, nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import f1, r4, share
from ..schemas import SECOND
from .intervals import Keys, gaps, total_duration
from .metrics import overlap_metrics
from .planning import prune_to_budget
from .rules import decision_category

# Decisions that keep a part of the recording
KEPT = ["KEEP", "KEEP_AS_CONTEXT", "KEEP_AS_PAYOFF"]


def scan_asset(table: DataFrame, by: str, asset: object) -> DataFrame:
    """One recording's rows in time order; over a table that is parted by `by` the filter leaves out all other parts."""
    return table.where(F.col(by) == asset).orderBy("start_us", "event_id")


def page(rows: DataFrame, order: list[Column], number: int, size: int, where: Column | None = None) -> DataFrame:
    """Page `number` (from 0) of a filtered and sorted listing."""
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(*order).offset(number * size).limit(size)


def nest_words(segments: DataFrame, words: DataFrame, key: Keys) -> DataFrame:
    """segments with `words`, the ordered array of their words (position, word); empty without any."""
    nested = words.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "word"))), lambda x: x["word"]).alias("words"))
    return segments.join(nested, key, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def evidence_links(candidates: DataFrame, events: DataFrame, by: Keys, key: Keys, ids: str = "evidence") -> DataFrame:
    """A row for each id in the array `ids` of each candidate that is an event of its key, with the event's columns."""
    return candidates.select(*by, *key, F.explode(ids).alias("event_id")).join(events, [*by, "event_id"])


def over_selection(ai: DataFrame, human: DataFrame, by: Keys) -> DataFrame:
    """Per key: time of one side only, and the AI's time over the human's (0 without any)."""
    m = overlap_metrics(ai, human, by, [0])
    ratio = F.when(F.col("human_us") > 0, r4(F.col("ai_us") / F.col("human_us"))).otherwise(0.0)
    return m.select(*by, (F.col("ai_us") - F.col("inter_us")).alias("ai_only_us"), F.greatest(F.col("human_us") - F.col("inter_us"), F.lit(0)).alias("human_only_us"), ratio.alias("ratio"))


def decision_map(blocks: DataFrame, start_s: Column, edit_s: Column) -> DataFrame:
    """Per category of decision_category(start_s, edit_s): blocks, source and edit time, share of all edit time."""
    length = lambda side: F.sum(F.col(f"{side}_end_us") - F.col(f"{side}_start_us")).alias(f"{side}_us")
    g = blocks.withColumn("category", decision_category(start_s, edit_s)).groupBy("category").agg(F.count("*").alias("n"), length("source"), length("edit"))
    # a row for each category
    return g.crossJoin(F.broadcast(g.agg(F.sum("edit_us").alias("_all")))).withColumn("edit_share", r4(F.col("edit_us") / F.col("_all"))).drop("_all")


def retention_by_region(decisions: DataFrame, by: Keys, width: int = 60 * SECOND) -> DataFrame:
    """Per key and region of `width`: time under decisions that keep, and its share of all decided time."""
    length = F.col("end_us") - F.col("start_us")
    g = decisions.groupBy(*by, F.expr(f"start_us div {width}").alias("region")).agg(F.sum(F.when(F.col("decision").isin(KEPT), length).otherwise(0)).alias("kept_us"), F.sum(length).alias("_all"))
    return g.withColumn("kept_share", share("kept_us", "_all")).drop("_all")


def effect_detection_score(truth: DataFrame, found: DataFrame, by: Keys, limit: int = SECOND) -> DataFrame:
    """By effect_type: true effects (event_id) whose nearest found one (found_id) of the type is less than `limit` away in start and end together, the others of both sides, and rates.

    A found effect may be the nearest of several true ones. Types of one side only have their row too.
    """
    near = F.explode(F.array(*[F.expr(f"start_us div {limit} + {k}") for k in (-1, 0, 1)]))
    p = found.select(*by, "effect_type", "found_id", F.col("start_us").alias("_s"), F.col("end_us").alias("_e")).withColumn("_b", F.expr(f"_s div {limit}"))
    away = F.abs(F.col("start_us") - F.col("_s")) + F.abs(F.col("end_us") - F.col("_e"))
    j = truth.withColumn("_b", near).join(p, [*by, "effect_type", "_b"]).withColumn("_d", away).where(F.col("_d") < limit)
    m = j.groupBy(*by, "effect_type", "event_id").agg(F.min(F.struct("_d", "found_id")).alias("m"))
    c = m.groupBy("effect_type").agg(F.count("*").alias("tp"), F.count_distinct("m.found_id").alias("_used"))
    g = truth.groupBy("effect_type").agg(F.count("*").alias("_t")).join(found.groupBy("effect_type").agg(F.count("*").alias("_p")), "effect_type", "full").join(c, "effect_type", "left").fillna(0)
    g = g.withColumn("fn", F.col("_t") - F.col("tp")).withColumn("fp", F.col("_p") - F.col("_used")).withColumn("precision", share("tp", F.col("tp") + F.col("fp"))).withColumn("recall", share("tp", "_t"))
    return g.withColumn("f1", f1("precision", "recall")).select("effect_type", "tp", "fn", "fp", "precision", "recall", "f1")


def density_per_hour(candidates: DataFrame, by: Keys, horizon: DataFrame) -> DataFrame:
    """One row: recordings (of horizon_us over 0), mean and 95th percentile of candidates an hour, and mean candidate seconds an hour."""
    g = candidates.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("us")).join(horizon, by).where("horizon_us > 0")
    h = g.select(r4(F.col("n") * 3600 * SECOND / F.col("horizon_us")).alias("per_hour"), r4(F.col("us") * 3600.0 / F.col("horizon_us")).alias("s"))
    return h.agg(F.count("*").alias("n"), r4(F.avg("per_hour")).alias("mean_per_hour"), r4(F.percentile("per_hour", 0.95)).alias("p95_per_hour"), r4(F.avg("s")).alias("mean_seconds"))


def budget_pressure(clips: DataFrame, plan: Keys, budget: DataFrame) -> DataFrame:
    """Per plan: selected time after pruning, clips dropped, selected time over the target (budget_us)."""
    kept = prune_to_budget(clips, plan, budget).groupBy(*plan).agg(F.count("*").alias("_k"), F.sum("duration_us").alias("selected_us"))
    g = clips.groupBy(*plan).agg(F.count("*").alias("_n")).join(budget, plan).join(kept, plan, "left").fillna(0, ["_k", "selected_us"])
    return g.select(*plan, "selected_us", (F.col("_n") - F.col("_k")).alias("dropped"), F.when(F.col("budget_us") > 0, r4(F.col("selected_us") / F.col("budget_us"))).otherwise(0.0).alias("pressure"))


def ai_timeline(clips: DataFrame, by: Keys) -> DataFrame:
    """clips with their position in source order, and total_us, the merged time of their recording."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy("start_us", "event_id"))
    return clips.join(total_duration(clips, by).withColumnRenamed("duration_us", "total_us"), by).withColumn("position", at)


def infer_decisions(blocks: DataFrame, by: Keys) -> DataFrame:
    """by, decision, start_us, end_us: RETAINED for each block (source_start_us, source_end_us), OMITTED for each gap up to the last one."""
    r = blocks.select(*by, F.lit("RETAINED").alias("decision"), F.col("source_start_us").alias("start_us"), F.col("source_end_us").alias("end_us"))
    omitted = gaps(r, by, r.groupBy(*by).agg(F.max("end_us").alias("horizon_us")))
    return r.unionByName(omitted.withColumn("decision", F.lit("OMITTED")))


def thread_nodes(members: DataFrame, by: Keys) -> DataFrame:
    """by, thread, n, nodes: the sorted nodes of each thread."""
    return members.groupBy(*by, "thread").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node")).alias("nodes"))


def node_threads(members: DataFrame, nodes: DataFrame, by: Keys) -> DataFrame:
    """nodes with `threads`, the sorted threads that they are in; empty without any."""
    t = members.groupBy(*by, "node").agg(F.array_sort(F.collect_set("thread")).alias("threads"))
    return nodes.join(t, [*by, "node"], "left").withColumn("threads", F.coalesce("threads", F.array().cast("array<bigint>")))

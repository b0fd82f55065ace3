"""Canonical tables out of the given star-schema tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hour of event time is one second of recording; an asset is a user."""
    kind = F.create_map(*[F.lit(x) for x in ("click", "speech", "view", "face_reaction", "purchase", "gameplay_clutch", "error", "silence")])
    start = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 3600")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("asset_id"), "event_id", F.coalesce(kind[F.col("event_type")], F.lit("chat_message")).alias("event_type"),
        start.alias("start_us"), (start + F.round(F.col("value") * 100).cast("long") * 500).alias("end_us"),
        (F.col("event_id") % 3).alias("speaker"), (F.col("event_id") * 7919 % 1000 / F.lit(1000.0)).alias("confidence"),
    )


def of_types(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*types))


def ai_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_types(timeline_events(spark, sf_dir), "speech", "gameplay_clutch")


def human_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_types(timeline_events(spark, sf_dir), "face_reaction", "chat_message")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and edit intervals: the edit clock runs over even lengths, at speed 1 or 2."""
    from pyspark.sql import Window

    e = timeline_events(spark, sf_dir).withColumn("n", F.expr("(end_us - start_us) div 2 * 2")).where("n > 0")
    e = e.withColumn("speed", (F.col("event_id") % 2 + 1).cast("long")).withColumn("edit_us", F.expr("n div speed"))
    w = Window.partitionBy("asset_id").orderBy("start_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    edit = F.coalesce(F.sum("edit_us").over(w), F.lit(0)).cast("long")
    return e.withColumn("edit_start_us", edit).select("asset_id", F.col("event_id").alias("block_id"), F.col("start_us").alias("source_start_us"), (F.col("start_us") + F.col("n")).alias("source_end_us"), "edit_start_us", (F.col("edit_start_us") + F.col("edit_us")).alias("edit_end_us"), "speed", "event_type")


def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)) * 60_000).cast("long")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("sequence"), F.col("role").alias("speaker"), "text", start.alias("start_us")).withColumn("end_us", F.col("start_us") + F.length("text") * 60_000)


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of plans: orders of customers, on a source clock that runs in order of date."""
    from pyspark.sql import Window

    names = F.array(*[F.lit(x) for x in ("essential", "high", "medium", "low", "context_only")])
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("clip_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("position"), level.alias("level"), F.element_at(names, level).alias("priority"), F.round(F.col("o_totalprice") * 100).cast("long").alias("duration_us"), (F.col("o_orderkey") % 100).alias("confidence"), (F.col("o_orderkey") % 17 == 0).alias("locked"))
    w = Window.partitionBy("plan_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    gap = (F.col("clip_id") % 7) * 2_000_000
    start = (F.coalesce(F.sum(F.col("duration_us") + gap).over(w), F.lit(0))).cast("long")
    return o.withColumn("start_us", start).withColumn("end_us", F.col("start_us") + F.col("duration_us"))


# The same tables as common table expressions
TE = """te AS (
  SELECT user_id AS asset_id, event_id,
    CASE event_type WHEN 'click' THEN 'speech' WHEN 'view' THEN 'face_reaction' WHEN 'purchase' THEN 'gameplay_clutch' WHEN 'error' THEN 'silence' ELSE 'chat_message' END AS event_type,
    (epoch_us(ts) - 1704067200000000) // 3600 AS start_us,
    (epoch_us(ts) - 1704067200000000) // 3600 + CAST(round(value * 100) AS BIGINT) * 500 AS end_us,
    event_id % 3 AS speaker, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS confidence
  FROM events)"""
AI = "ai AS (SELECT * FROM te WHERE event_type IN ('speech', 'gameplay_clutch'))"
HUMAN = "human AS (SELECT * FROM te WHERE event_type IN ('face_reaction', 'chat_message'))"
BLOCKS = """b0 AS (
  SELECT *, (end_us - start_us) // 2 * 2 AS n, event_id % 2 + 1 AS speed FROM te WHERE (end_us - start_us) // 2 * 2 > 0
), blocks AS (
  SELECT asset_id, event_id AS block_id, start_us AS source_start_us, start_us + n AS source_end_us, speed, event_type,
    coalesce(sum(n // speed) OVER w, 0)::BIGINT AS edit_start_us, (coalesce(sum(n // speed) OVER w, 0) + n // speed)::BIGINT AS edit_end_us
  FROM b0 WINDOW w AS (PARTITION BY asset_id ORDER BY start_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SEGMENTS = """seg AS (
  SELECT conv_id AS asset_id, turn AS sequence, role AS speaker, text, length(text) * 60000 AS len,
    coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 60000 AS start_us
  FROM conversations
), segments AS (SELECT asset_id, sequence, speaker, text, start_us, start_us + len AS end_us FROM seg)"""
CLIPS = """c0 AS (
  SELECT o_custkey AS plan_id, o_orderkey AS clip_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position,
    CAST(o_orderpriority[1] AS INTEGER) AS level, list_extract(['essential', 'high', 'medium', 'low', 'context_only'], CAST(o_orderpriority[1] AS INTEGER)) AS priority,
    CAST(round(o_totalprice * 100) AS BIGINT) AS duration_us, o_orderkey % 100 AS confidence, o_orderkey % 17 = 0 AS locked FROM orders
), clips AS (
  SELECT *, start_us + duration_us AS end_us FROM (
    SELECT *, coalesce(sum(duration_us + clip_id % 7 * 2000000) OVER (PARTITION BY plan_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_us FROM c0))"""


def merged_sql(source: str, name: str, gap: int = 100, by: str = "asset_id") -> str:
    """CTEs that merge intervals of `source` at most `gap` apart into `name` (by, start_us, end_us)."""
    return f"""{name}_1 AS (
  SELECT *, max(end_us) OVER (PARTITION BY {by} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}
), {name}_2 AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM {name}_1
), {name} AS (SELECT {by}, min(start_us) AS start_us, max(end_us) AS end_us FROM {name}_2 GROUP BY {by}, island)"""

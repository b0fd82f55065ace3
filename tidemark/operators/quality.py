"""Constraint checks: each gives a row for each violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import Keys
from .rules import EFFECT_BOUNDS


def _rows(df: DataFrame, keys: Keys, checks: dict) -> DataFrame:
    """key, violation: one row for each check that holds."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return df.select(*keys, F.explode(found).alias("violation"))


def clip_violations(clips: DataFrame, plan: Keys, slack: int = 1000) -> DataFrame:
    """Bad bounds, ends beyond the original, source order against output order, overlap with the clip before, each by itself."""
    w = Window.partitionBy(*plan).orderBy("output_position", "clip_id")
    c = clips.withColumn("_p", F.lag("start_us").over(w)).withColumn("_e", F.lag("end_us").over(w))
    return _rows(c, [*plan, "clip_id"], {"negative_start": F.col("start_us") < 0, "empty": F.col("end_us") <= F.col("start_us"), "beyond_end": F.col("end_us") > F.col("original_us") + slack, "order": F.col("start_us") < F.col("_p"), "overlap": F.col("_e") - F.col("start_us") > slack})


def output_overlap(clips: DataFrame, plan: Keys, slack: int = 1000) -> DataFrame:
    w = Window.partitionBy(*plan).orderBy("output_start_us", "clip_id")
    c = clips.withColumn("previous_end_us", F.lag("output_end_us").over(w))
    return c.where(F.col("output_start_us") < F.col("previous_end_us") - slack).select(*plan, "clip_id", "output_start_us", "previous_end_us")


def effect_param_violations(effects: DataFrame, key: Keys) -> DataFrame:
    """Parameters (a map of numbers) outside the bounds of their effect type."""
    bounds = effects.sparkSession.createDataFrame(EFFECT_BOUNDS, "effect_type string, parameter string, least double, most double")
    each = effects.select(*key, "effect_type", F.explode("params").alias("parameter", "value"))
    return each.join(F.broadcast(bounds), ["effect_type", "parameter"]).where("value < least or value > most").select(*key, "effect_type", "parameter", "value")


def box_violations(df: DataFrame, key: Keys, box: str = "box") -> DataFrame:
    x, y, w, h = (F.col(f"{box}.{c}") for c in ("x", "y", "width", "height"))
    return _rows(df, key, {"x": (x < 0) | (x > 1), "y": (y < 0) | (y > 1), "width": (w <= 0) | (w > 1), "height": (h <= 0) | (h > 1), "right": x + w > 1, "bottom": y + h > 1})


def failed(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)

"""Scalar expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r4(x: str | Column) -> Column:
    """Rounded to 4 digits, halves away from zero on the scaled binary value."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 10000) / 10000


def share(part: str | Column, whole: str | Column, empty: float = 0.0) -> Column:
    """part / whole, at most 1, rounded to 4 digits; `empty` where whole is 0 or null."""
    p, w = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(w > 0, r4(F.least(p / w, F.lit(1.0)))).otherwise(F.lit(empty))


def f1(precision: str, recall: str) -> Column:
    p, r = F.col(precision), F.col(recall)
    return F.when(p + r > 0, r4(2 * p * r / (p + r))).otherwise(F.lit(0.0))


def stats(x: Column) -> list[Column]:
    """Linear quantiles, mean and population deviation, rounded to 4 digits, zeros when empty."""
    names = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    q = [F.coalesce(r4(F.percentile(x, v)), F.lit(0.0)).alias(k) for k, v in names.items()]
    return [*q, F.coalesce(r4(F.avg(x)), F.lit(0.0)).alias("mean"), F.coalesce(r4(F.stddev_pop(x)), F.lit(0.0)).alias("std")]


STATS_SQL = ", ".join([f"coalesce(round(quantile_cont(x, {v}), 4), 0) AS {k}" for k, v in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))] + ["coalesce(round(avg(x), 4), 0) AS mean", "coalesce(round(stddev_pop(x), 4), 0) AS std"])

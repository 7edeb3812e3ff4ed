"""Latency statistics over a table of timings, and timing itself (on the driver)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.ranking import running_total
from ..functions.text import nearest_rank


def statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, min, p50 (interpolated), p95, p99 (nearest rank by floor), max, mean of value by group. Exact; distinct values
    are counted first and ranked in ranges, so neither a group nor the whole is one task's work."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    counted = running_total(per, list(by), value, [value], F.col("__n"), "__upto").withColumnRenamed("__upto_all", "__all")
    rank = lambda p: F.least(F.floor(F.col("__all") * F.lit(p) / 100), F.col("__all") - 1)
    at = lambda r: F.min(F.when(F.col("__upto") > r, F.col(value)))
    lower, upper = at(F.floor((F.col("__all") - 1) / 2)), at(F.floor(F.col("__all") / 2))
    return counted.groupBy(*by).agg(
        F.sum("__n").alias("n"), F.min(value).alias("min"), ((lower + upper) / 2).alias("p50"), at(rank(95.0)).alias("p95"), at(rank(99.0)).alias("p99"), F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"),
    )


def collected_statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The same for small groups (n = 30 a configuration), over collected lists."""
    v = F.collect_list(value)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.percentile(value, 0.5).alias("p50"), nearest_rank(v, 95.0).alias("p95"), nearest_rank(v, 99.0).alias("p99"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def timed(action: Callable[[], object], runs: int = 30, warm_up: int = 1) -> list[float]:
    """Wall milliseconds of each run; warm-up runs are not counted."""
    out = []
    for i in range(warm_up + runs):
        began = time.perf_counter()
        action()
        if i >= warm_up:
            out.append((time.perf_counter() - began) * 1000)
    return out

"""Running totals over ordered rows without one task for a whole group.

Rows are cut into ranges of the ordering key (by approximate quantiles over all rows). Totals of the
ranges are summed over first, then rows within their range, so a hot group is shared by as many tasks as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges at least and at most; in between, some for each partition of the input.
RANGES, MOST = 64, 512


def range_of(df: DataFrame, key: str, ranges: int = RANGES) -> Column:
    """The number of quantile bounds that are not above the key; 0 for null keys, which order first."""
    bounds = sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.002)))
    if not bounds:
        return F.lit(0)
    reached = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key).cast("double")))
    return F.when(F.col(key).isNull(), 0).otherwise(reached)


def running_total(df: DataFrame, by: list[str], key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`, the sum of value over the rows of the group up to and with this one, and `name`_all, the group's."""
    ranges = min(MOST, max(RANGES, 2 * df.rdd.getNumPartitions()))
    cut = df.withColumns({"__range": range_of(df, key, ranges), "__value": value})
    totals = cut.groupBy(*by, "__range").agg(F.sum("__value").alias("__sum"))
    w = Window.partitionBy(*by).orderBy("__range")  # at most MOST rows of each group
    before = F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    base = totals.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__r"), before.alias("__before"), every.alias(f"{name}_all"))
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = F.sum("__value").over(Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = cut.withColumn("__inside", inside).join(base, same)
    return out.withColumn(name, F.col("__inside") + F.col("__before")).drop("__range", "__r", "__value", "__inside", "__before", *(f"__{c}" for c in by))

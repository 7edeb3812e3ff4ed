"""Scores: rates, matches and their aggregates. Rates are unrounded doubles; round only for display (functions.text.shown)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let, literal_contains, overlap_exact, overlap_folded


def rate(part: Column, all_of: Column, percent: bool = False) -> Column:
    """part / all_of as double, 0.0 for none; percent multiplies before dividing."""
    scaled = part * F.lit(100.0) if percent else part.cast("double")
    return F.when(all_of > 0, scaled / all_of).otherwise(F.lit(0.0))


def rate_or_null(part: Column, all_of: Column) -> Column:
    """Percent, null when there is nothing to count."""
    return F.when(all_of > 0, part * F.lit(100.0) / all_of)


def leaked(pii: Column, out: Column) -> Column:
    return literal_contains(out, pii)


def precision_recall(df: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 (micro averages, 0.0 for zero denominators) from per-document tp, fp, fn."""
    sums = df.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    with_pr = sums.withColumns({"precision": p, "recall": r})
    both = F.col("precision") + F.col("recall")
    return with_pr.withColumn("f1", F.when(both > 0, F.col("precision") * 2 * F.col("recall") / both).otherwise(F.lit(0.0)))


GREEDY = "struct<tp:int,used:array<int>,fp:array<string>>"


def greedy_match(detected: Column, expected: Column) -> Column:
    """struct<tp, matched, fp, fn>: each detection, in order, takes the first expected value that no other has taken and
    that overlaps it (trimmed, any case); the rest are false positives and misses. Empty detections are dropped first.
    Canonical order: detections by first occurrence, expected values as labelled."""
    start = F.struct(F.lit(0).alias("tp"), F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("fp")).cast(GREEDY)

    def matched(want: Column) -> Column:
        index = F.filter(F.sequence(F.lit(-1), F.size(want) - 1), lambda i: i >= 0)

        def step(acc: Column, d: Column) -> Column:
            free = F.filter(index, lambda i: ~F.array_contains(acc["used"], i) & overlap_folded(d, F.get(want, i)))
            taken = lambda hit: F.when(hit.isNotNull(), F.struct((acc["tp"] + 1).alias("tp"), F.concat(acc["used"], F.array(hit)).alias("used"), acc["fp"].alias("fp"))).otherwise(F.struct(acc["tp"].alias("tp"), acc["used"].alias("used"), F.concat(acc["fp"], F.array(d)).alias("fp"))).cast(GREEDY)
            return let(F.get(free, F.lit(0)), taken)

        def finish(acc: Column) -> Column:
            used = F.transform(acc["used"], lambda i: F.get(want, i))
            missed = F.transform(F.filter(index, lambda i: ~F.array_contains(acc["used"], i)), lambda i: F.get(want, i))
            return F.struct(acc["tp"].cast("long").alias("tp"), used.alias("matched"), acc["fp"].alias("fp"), missed.alias("fn"))

        return F.aggregate(F.filter(detected, lambda d: F.length(F.trim(d)) > 0), start, step, finish)

    return let(expected, matched)


def recovered(gold: Column, labels: Column) -> Column:
    """How many gold values overlap some label (duplicates count)."""
    return F.size(F.filter(gold, lambda g: F.exists(labels, lambda x: overlap_exact(g, x)))).cast("long")


def grouping_sets(df: DataFrame, aggregates: dict[str, str], sets: list[tuple[str, ...]], view: str = "scored") -> DataFrame:
    """SQL GROUPING SETS over df: all columns of the sets (null where not grouped by) and the aggregates."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    listed = ", ".join(f"({', '.join(s)})" for s in sets)
    picked = ", ".join([*columns, *(f"{e} AS {n}" for n, e in aggregates.items())])
    return df.sparkSession.sql(f"SELECT {picked} FROM {{{view}}} GROUP BY GROUPING SETS ({listed})", **{view: df})

"""Matching of detections to expected values that does not depend on their order: as many pairs as there can be.

Both sides of a document are short lists, and which overlap is found by expressions (trimmed, any case). Augmenting paths then need
loops, so they run in Arrow batches, document by document, on the overlaps alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.text import let, overlap_folded
from ..session import ship

MATCHED = "struct<tp:bigint,matched:array<string>,fp:array<string>,fn:array<string>>"


def largest(edges: list[list[int]], right: int) -> list[int]:
    """For each left node the right node that it is matched with, or -1. Breadth-first searches for augmenting paths, so that long
    chains need no recursion."""
    left_of, right_of = [-1] * right, [-1] * len(edges)
    for start in range(len(edges)):
        came: dict[int, int] = {}
        queue, end = [start], -1
        while queue and end < 0:
            nxt = []
            for u in queue:
                for v in edges[u]:
                    if v in came:
                        continue
                    came[v] = u
                    if left_of[v] < 0:
                        end = v
                        break
                    nxt.append(left_of[v])
                if end >= 0:
                    break
            queue = nxt
        while end >= 0:
            u = came[end]
            before = right_of[u]
            left_of[end], right_of[u] = u, end
            end = before
    return right_of


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        to = [largest(e or [], n or 0) for e, n in zip(b.column("__edges").to_pylist(), b.column("__n").to_pylist(), strict=True)]
        yield b.drop_columns(["__edges", "__n"]).append_column("__to", pa.array(to, pa.list_(pa.int32())))


def with_best_match(docs: DataFrame, detected: str = "detected", expected: str = "expected", name: str = "best") -> DataFrame:
    """docs and struct<tp, matched, fp, fn> as greedy_match() has it, with the most true positives that any order of the detections
    could give. Empty detections are dropped first; null lists count as empty."""
    ship(docs.sparkSession)
    none = F.array().cast("array<string>")
    shown = F.filter(F.coalesce(detected, none), lambda d: F.length(F.trim(d)) > 0)
    wanted = F.coalesce(expected, none)
    near = lambda x: F.transform(x["d"], lambda d: F.filter(F.transform(x["e"], lambda e, i: F.when(overlap_folded(d, e), i)), lambda i: i.isNotNull()))
    ready = docs.withColumns({"__d": shown, "__e": wanted, "__n": F.size(wanted), "__edges": let(F.struct(shown.alias("d"), wanted.alias("e")), near)})
    kept = [f for f in ready.schema if f.name not in ("__edges", "__n")]
    done = ready.mapInArrow(_matched, StructType([*kept, StructField("__to", ArrayType(IntegerType()))]))
    hits = F.filter("__to", lambda i: i >= 0)
    fp = F.transform(F.filter(F.zip_with("__d", "__to", lambda d, i: F.struct(d.alias("d"), i.alias("i"))), lambda p: p["i"] < 0), lambda p: p["d"])
    fn = F.filter(F.transform("__e", lambda e, i: F.when(~F.array_contains("__to", i), e)), lambda e: e.isNotNull())
    best = F.struct(F.size(hits).cast("long").alias("tp"), F.transform(hits, lambda i: F.get("__e", i)).alias("matched"), fp.alias("fp"), fn.alias("fn"))
    return done.withColumn(name, best).drop("__d", "__e", "__to")

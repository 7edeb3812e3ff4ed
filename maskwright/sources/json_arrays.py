"""A file that holds one JSON list of objects, read in many splits.

The text reader cuts files into splits and gives stretches that end with a closing brace (its line separator). Whether a stretch
begins inside a string, and how deep, depends on all before it. So there are two passes over the splits: the first says of each, for
both cases, whether it ends inside a string and how far it goes deeper; a sum over these few rows (one for each split) gives
every split's beginning. The second pass cuts the objects out. An object that runs over a split's end leaves pieces, at most two
for each split, which are put together.

Defined cases. Several files, folders: each by itself. Elements of the list that are no objects are left out, as are empty files. A
file that ends within an object: that object is left out. What is no JSON gives what its braces and quotes make of it; from_json
then yields nulls, as the reader does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import ship
from . import schema

_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*(?:"|\Z)', re.S)
_MARK = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\]]', re.S)


def _closed(token: str) -> bool:
    """Does a string token end with its quote (and not with an escaped one, or with the text)?"""
    return len(token) > 1 and token[-1] == '"' and (len(token) - 1 - len(token[:-1].rstrip("\\"))) % 2 == 0


def outside(text: str, inside: bool) -> tuple[str, bool]:
    """What of text is not in strings, and whether it ends in one; inside: whether it begins in one."""
    at = 0
    if inside:
        m = _REST.match(text)
        if not _closed('"' + m[0]):
            return "", True
        at = m.end()
    ends = False

    def drop(m: re.Match) -> str:
        nonlocal ends
        ends = not _closed(m[0])
        return ""

    return _STRING.sub(drop, text[at:]), ends


class Cutter:
    """Cuts the objects of a list out of stretches that come in order."""

    def __init__(self, inside: bool, depth: int) -> None:
        self.inside, self.depth = inside, depth
        self.parts: list[str] = []
        #: pieces that belong to an object begun before
        self.head: str | None = None
        self.begun = depth >= 2 or (depth == 1 and inside)
        self.first = self.begun

    def feed(self, text: str) -> Iterator[str]:
        at = start = 0
        if self.inside:
            m = _REST.match(text)
            self.inside = not _closed('"' + m[0])
            at = m.end()
        while not self.inside and (m := _MARK.search(text, at)):
            at, c = m.end(), m[0]
            if c[0] == '"':
                self.inside = not _closed(c)
            elif c in "{[":
                if c == "{" and self.depth == 1:
                    self.begun, start = True, m.start()
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == 1 and self.begun and c == "}":
                    self.parts.append(text[start:at])
                    whole, self.parts, self.begun = "".join(self.parts), [], False
                    if self.first:
                        self.head, self.first = whole, False
                    else:
                        yield whole
        if self.begun:
            self.parts.append(text[start:])


def _stretches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: the text of each object of the lists, and file."""
    ship(spark)
    lines = _stretches(spark, path)
    ends = pa.schema([("file", pa.string()), ("block", pa.int64()), ("in0", pa.bool_()), ("in1", pa.bool_()), ("d0", pa.int64()), ("d1", pa.int64())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            for value, *key in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block")), strict=True):
                if key != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(ends.names, [*at, *(s[0] for s in state), *(s[1] for s in state)], strict=True))], schema=ends)
                    at, state = key, [[False, 0], [True, 0]]
                for s in state:
                    rest, s[0] = outside(value + "}", s[0])
                    s[1] += rest.count("{") + rest.count("[") - rest.count("]") - rest.count("}")
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(ends.names, [*at, *(s[0] for s in state), *(s[1] for s in state)], strict=True))], schema=ends)

    splits = lines.mapInArrow(summed, "file string, block long, in0 boolean, in1 boolean, d0 long, d1 long")
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    file, inside, depth = None, False, 0
    for r in sorted(splits.collect()):  # a row of numbers for each split: one after the other, as each begins where the last ended
        if r.file != file:
            file, inside, depth = r.file, False, 0
        begins[r.file, r.block] = inside, depth
        inside, depth = (r.in1, depth + r.d1) if inside else (r.in0, depth + r.d0)
    sent = spark.sparkContext.broadcast(begins)  # a row for each split

    out = pa.schema([("value", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("piece", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cutter, rows = None, None, []

        def finish() -> list[tuple]:
            if cutter is None:
                return []
            if cutter.first:  # all of the split lies within one object
                return [("".join(cutter.parts), *at, "middle")]
            left = [(cutter.head, *at, "head")] if cutter.head is not None else []
            return left + ([("".join(cutter.parts), *at, "tail")] if cutter.begun else [])

        for b in batches:
            for value, *key in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block")), strict=True):
                if key != at:
                    rows += finish()
                    at, cutter = key, Cutter(*sent.value[tuple(key)])
                rows += [(x, *key, None) for x in cutter.feed(value + "}")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                rows = []
        if rows := finish():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    found = lines.mapInArrow(cut, "value string, file string, block long, piece string")
    pieces = found.filter("piece is not null")
    # the object that a piece belongs to began in the last split, up to here, that left a tail; a split's head comes before its tail
    order = Window.partitionBy("file").orderBy("block", "late").rowsBetween(Window.unboundedPreceding, 0)
    named = pieces.withColumn("late", F.col("piece") == "tail").withColumn("began", F.last(F.when(F.col("piece") == "tail", F.col("block")), ignorenulls=True).over(order))
    joined = named.groupBy("file", "began").agg(F.sort_array(F.collect_list(F.struct("block", "late", "piece", "value"))).alias("p"))
    whole = joined.filter(F.exists("p", lambda x: x["piece"] == "head")).select(F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"), "file")
    return found.filter("piece is null").select("value", "file").unionByName(whole)


def read_array(spark: SparkSession, path: str | list[str], ddl: str = schema.CORPUS) -> DataFrame:
    """The objects as rows; fields that are missing are null. Only the columns that are asked for are parsed."""
    return objects(spark, path).select(F.from_json("value", ddl).alias("x")).select("x.*")

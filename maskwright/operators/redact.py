"""Overlap resolution, placeholders, redaction and restoration of one text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import CHUNK, chunks, cut, let, looked_up
from .detect import SPANS

MAPPING = "array<struct<original:string,fake:string,type:string>>"


def resolve(spans: Column) -> Column:
    """Spans that do not overlap: by start, then the longest, then the best score; one is kept if it starts where the last
    kept one has ended, or later. Only spans that do overlap are folded."""
    before = lambda a, b: (
        F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], b["end"] - a["end"])
        .when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1))
        .when(a["type"] < b["type"], -1)
        .when(a["type"] > b["type"], 1)
        .otherwise(0)
    )
    step = lambda acc, s: F.when(s["start"] >= acc["last"], F.struct(s["end"].alias("last"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc)
    start = F.struct(F.lit(0).alias("last"), F.array().cast(SPANS).alias("out"))
    apart = lambda s: F.forall(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i)["start"] >= F.get(s, i - 1)["end"])
    kept = lambda s: F.when(F.size(s) < 2, s).when(apart(s), s).otherwise(F.aggregate(s, start, step, lambda acc: acc["out"]))
    return let(F.array_sort(spans, before), kept)  # spans may be dear to find: they are named once


def _key(s: Column, original: str = "text") -> Column:
    """Type and original as one string: arrays of strings are made distinct by hashing, arrays of structs by comparing all pairs."""
    return F.concat(s["type"], F.lit("\0"), s[original])


def mapping(spans: Column) -> Column:
    """Placeholders of a request, by first occurrence: <TYPE_n>, n counting the distinct originals of a type; equal originals of
    a type share one. Types are few, so each numbers its own originals in one pass."""
    empty = F.array().cast(MAPPING)

    def numbered(first: Column) -> Column:
        """first: struct<type, original, at> of distinct originals."""
        kinds = F.array_distinct(F.transform(first, lambda m: m["type"]))
        fake = lambda m, n: F.concat(F.lit("<"), m["type"], F.lit("_"), (n + 1).cast("string"), F.lit(">"))
        of = lambda kind: F.transform(F.filter(first, lambda m: m["type"] == kind), lambda m, n: F.struct(m["at"].alias("at"), m["original"].alias("original"), fake(m, n).alias("fake"), m["type"].alias("type")))
        each = F.array_sort(F.flatten(F.transform(kinds, of)))
        return F.transform(each, lambda m: F.struct(m["original"].alias("original"), m["fake"].alias("fake"), m["type"].alias("type")))

    part = lambda k, n: F.get(F.split(k, "\0", 2), F.lit(n))
    split = lambda k, i: F.struct(part(k, 0).alias("type"), part(k, 1).alias("original"), i.alias("at"))
    placed = F.transform(F.array_distinct(F.transform(spans, lambda s: _key(s))), split)
    return F.when(F.size(spans) > 0, let(placed, numbered)).otherwise(empty)


def splice(text: Column, spans: Column, mapped: Column) -> Column:
    """text with each span (resolved, in order) replaced by its placeholder: the pieces between them, and the placeholders."""
    fakes = F.array_sort(F.transform(mapped, lambda m: F.struct(_key(m, "original").alias("key"), m["fake"].alias("value"))))
    end = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    last = end(F.size(spans))
    rest = lambda c: F.concat(cut(c, last, (F.floor(last / CHUNK) + 1) * CHUNK), F.array_join(F.slice(c, (F.floor(last / CHUNK) + 2).cast("int"), F.size(c) + 1), ""))
    piece = lambda t: lambda s, i: F.concat(cut(t["chunks"], end(i), s["start"]), looked_up(t["fakes"], _key(s), F.lit("")))
    done = lambda t: F.concat(F.array_join(F.transform(spans, piece(t)), ""), rest(t["chunks"]))
    return F.when(F.size(spans) > 0, let(F.struct(fakes.alias("fakes"), chunks(text).alias("chunks")), done)).otherwise(text)


PLACEHOLDER = "(<[^<>]+_[0-9]+>)"


def restore(text: Column, mapped: Column) -> Column:
    """Placeholders back to originals, in one pass over the text; what the mapping lacks stays."""
    fakes = F.array_sort(F.transform(mapped, lambda m: F.struct(m["fake"].alias("key"), m["original"].alias("value"))))
    found = F.struct(fakes.alias("table"), F.split(text, PLACEHOLDER, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)).alias("fakes"))
    after = lambda f, i: F.coalesce(looked_up(f["table"], F.get(f["fakes"], i), F.get(f["fakes"], i)), F.lit(""))
    both = lambda f: F.array_join(F.transform(f["gaps"], lambda g, i: F.concat(g, after(f, i))), "")
    return F.when(F.size(mapped) > 0, let(found, both)).otherwise(text)


def redact(text: Column, spans: Column) -> Column:
    """struct<text, mapping> of one text, from spans that may overlap."""
    of = lambda kept: let(mapping(kept), lambda m: F.struct(splice(text, kept, m).alias("text"), m.alias("mapping")))
    return let(resolve(spans), of)


def originals(mapped: Column) -> Column:
    """Distinct originals, sorted."""
    return F.array_sort(F.array_distinct(F.transform(mapped, lambda m: m["original"])))


def preserved(out: Column, must_preserve: Column) -> Column:
    """Over-redaction guard: every listed term is still there."""
    return F.forall(F.coalesce(must_preserve, F.array().cast("array<string>")), lambda t: F.contains(F.coalesce(out, F.lit("")), t))

"""Arguments of tool calls as trees: every text in them is seen - strings, object keys, numbers, and JSON documents inside strings,
to any depth - and what stands between them is kept as it was written.

Detection stays an expression: leaf texts are listed (Arrow batches), searched and numbered by expressions, and put back (Arrow
batches). A number in which something was found becomes a string, whose first character is written as an escape; by that, restoring
knows that it was a number. Strings that did not change keep their escapes.

Defined cases. Null messages or arguments stay null. Arguments that are no JSON are one text. Lists nested deeper than DEPTH documents
within documents: the innermost is one text. Empty payloads: nothing found. Rows that repeat: each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import let
from ..session import ship, small_batches
from .detect import SPANS, Detector, detect
from .redact import MAPPING, mapping, resolve, splice

#: Documents within documents that are opened.
DEPTH = 8

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?', re.S)
#: How the first character of a string is written that stands for a number.
_NUMBER = '"\\u003c'


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def _opens(text: str) -> bool:
    """Is it a JSON object or list?"""
    return text.lstrip()[:1] in ("{", "[") and is_json(text)


def walk(arguments: str, change: Callable[[str], str], depth: int = DEPTH) -> str:
    """arguments with every text changed."""
    if not is_json(arguments):
        return change(arguments)

    def token(m: re.Match) -> str:
        raw = m[0]
        if raw[0] != '"':
            new = change(raw)
            return raw if new == raw else _NUMBER + json.dumps(new, ensure_ascii=False)[2:] if new.startswith("<") else json.dumps(new, ensure_ascii=False)
        text = json.loads(raw)
        new = walk(text, change, depth - 1) if depth > 0 and _opens(text) else change(text)
        return raw if new == text else json.dumps(new, ensure_ascii=raw.isascii() and "\\u" in raw)

    return _TOKEN.sub(token, arguments)


def texts_of(arguments: str) -> list[str]:
    out: list[str] = []
    walk(arguments, lambda t: out.append(t) or t)
    return out


def back(arguments: str, originals: dict[str, str], depth: int = DEPTH) -> str:
    """Placeholders of arguments replaced by their originals; strings that stand for numbers become numbers again."""
    change = lambda t: re.sub("<[^<>]+_[0-9]+>", lambda m: originals.get(m[0], m[0]), t)
    if not is_json(arguments):
        return change(arguments)

    def token(m: re.Match) -> str:
        raw = m[0]
        if raw[0] != '"':
            return raw
        text = json.loads(raw)
        if raw.startswith(_NUMBER):
            new = change(text)
            return new if new != text else raw
        new = back(text, originals, depth - 1) if depth > 0 and _opens(text) else change(text)
        return raw if new == text else json.dumps(new, ensure_ascii=raw.isascii() and "\\u" in raw)

    return _TOKEN.sub(token, arguments)


def _texts(messages: list[dict] | None, structured: bool = True) -> list[str]:
    out: list[str] = []
    for m in messages or []:
        if m["content_text"] is not None:
            out.append(m["content_text"])
        if not structured:
            continue
        out += [p["text"] for p in m["content_parts"] or [] if p["text"] is not None]
        for c in m["tool_calls"] or []:
            if c["function"] and c["function"]["arguments"] is not None:
                out += texts_of(c["function"]["arguments"])
    return list(dict.fromkeys(out))


def _changed(messages: list[dict] | None, text: Callable[[str], str], arguments: Callable[[str], str], structured: bool = True) -> list[dict] | None:
    if messages is None:
        return None
    out = []
    for m in messages:
        if not structured:
            out.append(m | {"content_text": None if m["content_text"] is None else text(m["content_text"])})
            continue
        parts = m["content_parts"] and [p | {"text": None if p["text"] is None else text(p["text"])} for p in m["content_parts"]]
        calls = m["tool_calls"] and [c | {"function": c["function"] and c["function"] | {"arguments": None if c["function"]["arguments"] is None else arguments(c["function"]["arguments"])}} for c in m["tool_calls"]]
        out.append(m | {"content_text": None if m["content_text"] is None else text(m["content_text"]), "content_parts": parts, "tool_calls": calls})
    return out


#: Rows, and bytes, that are taken apart at once.
ROWS, BYTES = 128, 1 << 20


def _mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType) -> DataFrame:
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = max(1, min(ROWS, b.num_rows * BYTES // max(b.nbytes, 1)))
            for lo in range(0, b.num_rows, rows):
                yield fn(b.slice(lo, rows))

    return df.mapInArrow(run, schema)


def with_spans(payloads: DataFrame, detectors: Sequence[Detector], messages: str = "messages", structured: bool = True, types: Sequence[str] | None = None) -> DataFrame:
    """payloads with __found: array<struct<text, spans>>, each distinct text of a payload searched once (spans may overlap).
    structured=False: string content alone. types: those that may be found at all."""

    def listed(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.append_column("__texts", pa.array([_texts(m, structured) for m in b.column(messages).to_pylist()], pa.list_(pa.string())))

    seen = _mapped(payloads, listed, StructType([*payloads.schema, StructField("__texts", ArrayType(StringType()))]))
    return seen.withColumn("__found", F.transform("__texts", lambda t: F.struct(t.alias("text"), detect(t, detectors, allow=types).alias("spans")))).drop("__texts")


def redacted(spotted: DataFrame, messages: str = "messages", allow: str | None = None, structured: bool = True) -> DataFrame:
    """with_spans()'s payloads with messages redacted, and mapping, one for the payload. allow: a column with the types that count."""
    wanted: Callable[[Column], Column] = (lambda s: F.filter(s, lambda x: F.array_contains(F.col(allow), x["type"]))) if allow else (lambda s: s)
    kept = spotted.withColumn("__found", F.transform("__found", lambda p: F.struct(p["text"].alias("text"), resolve(wanted(p["spans"])).alias("spans"))))
    kept = kept.withColumn("mapping", let(F.coalesce(F.flatten(F.transform("__found", lambda p: p["spans"])), F.array().cast(SPANS)), mapping).cast(MAPPING))
    new = F.transform(F.filter("__found", lambda p: F.size(p["spans"]) > 0), lambda p: F.struct(p["text"].alias("old"), splice(p["text"], p["spans"], F.col("mapping")).alias("new")))
    ready = kept.withColumn("__new", new).drop("__found")

    def put(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for m, pairs in zip(b.column(messages).to_pylist(), b.column("__new").to_pylist(), strict=True):
            by = {p["old"]: p["new"] for p in pairs or []}
            change = lambda t, by=by: by.get(t, t)
            out.append(_changed(m, change, lambda a, change=change: walk(a, change), structured) if by else m)
        at = b.schema.get_field_index(messages)
        return b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type)).drop_columns(["__new"])

    return _mapped(ready, put, StructType([f for f in ready.schema if f.name != "__new"]))


def redact_payloads(payloads: DataFrame, detectors: Sequence[Detector], messages: str = "messages", allow: str | None = None, structured: bool = True, types: Sequence[str] | None = None) -> DataFrame:
    """payloads with messages redacted by their tree, and the column mapping. structured=False: string content alone."""
    return redacted(with_spans(payloads, detectors, messages, structured, types), messages, allow, structured)


def restore_payloads(payloads: DataFrame, messages: str = "messages") -> DataFrame:
    """payloads with originals back in the arguments of tool calls (texts stay redacted)."""

    def put(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for m, pairs in zip(b.column(messages).to_pylist(), b.column("mapping").to_pylist(), strict=True):
            by = {p["fake"]: p["original"] for p in pairs or []}
            out.append(_changed(m, lambda t: t, lambda a, by=by: back(a, by)) if by else m)
        at = b.schema.get_field_index(messages)
        return b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return _mapped(payloads, put, payloads.schema)

"""Chat payloads: carriers, flattening, structure-aware redaction and restoration. One row is one request; `messages` is an
array of struct<role, content_text, content_parts, tool_calls>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..functions.text import ascii_note, let
from .detect import SPANS, Detector, detect
from .redact import mapping, resolve, restore, splice

PARTS = "array<struct<type:string,text:string,image_url:struct<url:string>>>"
CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
MESSAGE = f"struct<role:string,content_text:string,content_parts:{PARTS},tool_calls:{CALLS}>"
MESSAGES = f"array<{MESSAGE}>"
CARRIERS = ("flat", "multimodal", "tool_call", "tool_call_nested")
IMAGE = "https://files.example.org/page-1.png"


def _message(role: str, text: Column | None = None, parts: Column | None = None, calls: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(role).alias("role"), (none if text is None else text).alias("content_text"), (none if parts is None else parts).alias("content_parts"), (none if calls is None else calls).alias("tool_calls")).cast(MESSAGE)


def _parts(text: Column) -> Column:
    picture = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.lit(IMAGE).alias("url")).alias("image_url"))
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")), picture)


def _call(arguments: Column) -> Column:
    return F.array(F.struct(F.lit("call-a").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("keep_note").alias("name"), arguments.alias("arguments")).alias("function")))


def note(text: Column) -> Column:
    """{"note": text}, other scripts kept."""
    return F.to_json(F.struct(text.alias("note")))


def nested_note(text: Column) -> Column:
    """text in a nested object and once more in a list."""
    return F.to_json(F.struct(F.struct(F.struct(text.alias("bio")).alias("profile")).alias("user"), F.array(text).alias("tags")))


def wrap(text: Column, carrier: str) -> Column:
    """messages that carry text in one of CARRIERS."""
    if carrier == "flat":
        return F.array(_message("user", text))
    if carrier == "multimodal":
        return F.array(_message("user", parts=_parts(text)))
    if carrier == "tool_call":
        return F.array(_message("assistant", calls=_call(note(text))))
    if carrier == "tool_call_nested":
        return F.array(_message("assistant", calls=_call(nested_note(text))))
    raise ValueError(f"unknown carrier {carrier!r}; there are {', '.join(CARRIERS)}")


def called(arguments: Column) -> Column:
    """messages of one tool call with the given arguments."""
    return F.array(_message("assistant", calls=_call(arguments)))


def combined(text: Column) -> Column:
    """Two messages: multimodal, then a tool call whose arguments are ASCII-escaped."""
    return F.array(_message("user", parts=_parts(text)), _message("assistant", calls=_call(ascii_note(text))))


def tool_calls(messages: Column) -> Column:
    """All tool calls, in order."""
    return F.flatten(F.transform(messages, lambda m: F.coalesce(m["tool_calls"], F.array().cast(CALLS))))


def texts(messages: Column) -> Column:
    """Every text of a payload in reading order: string content, texts of parts, raw arguments of tool calls."""
    none = F.array().cast("array<string>")
    of = lambda m: F.concat(
        F.when(m["content_text"].isNotNull(), F.array(m["content_text"])).otherwise(none),
        F.filter(F.transform(F.coalesce(m["content_parts"], F.array().cast(PARTS)), lambda p: p["text"]), lambda t: t.isNotNull()),
        F.filter(F.transform(F.coalesce(m["tool_calls"], F.array().cast(CALLS)), lambda c: c["function"]["arguments"]), lambda t: t.isNotNull()),
    )
    return F.flatten(F.transform(messages, of))


def flatten(messages: Column) -> Column:
    """One string of all texts, joined by line breaks; roles, names and urls are left out."""
    return F.array_join(texts(messages), "\n")


def first_arguments(messages: Column) -> Column:
    return F.coalesce(F.get(tool_calls(messages), F.lit(0))["function"]["arguments"], F.lit(""))


def first_multimodal(messages: Column) -> Column:
    """Texts of the first message with parts, joined by blanks; parts without text count as empty."""
    lists = F.filter(messages, lambda m: m["content_parts"].isNotNull())
    parts = F.coalesce(F.get(lists, F.lit(0))["content_parts"], F.array().cast(PARTS))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " ")


# JSON arguments: string literals are found by pattern; keys (followed by a colon) stay, other strings are values. The
# quantifiers are possessive, so that the matcher loops and does not recurse on long strings.
LITERAL = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'


def _is_json(arguments: Column) -> Column:
    return F.try_parse_json(arguments).isNotNull()


def _values(arguments: Column) -> Column:
    """struct<gaps, literals, values>: values are decoded strings, null for keys."""
    found = F.struct(F.regexp_extract_all(arguments, F.lit(LITERAL), F.lit(1)).alias("literals"), F.split(arguments, LITERAL, -1).alias("gaps"))

    def decoded(f: Column) -> Column:
        value = lambda s, i: F.when(F.get(f["gaps"], i + 1).rlike(r"^\s*:"), F.lit(None)).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), s, F.lit("}")), "$.v"))
        return F.struct(f["gaps"].alias("gaps"), f["literals"].alias("literals"), F.transform(f["literals"], value).alias("values"))

    return let(found, decoded)


def leaves(arguments: Column) -> Column:
    """Decoded string values of JSON arguments; the text itself if it is not JSON."""
    return F.when(_is_json(arguments), F.filter(_values(arguments)["values"], lambda v: v.isNotNull())).otherwise(F.array(arguments))


def _rewrite(arguments: Column, change) -> Column:
    """JSON arguments with every string value changed; text that is not JSON changed as a whole."""

    def rebuilt(v: Column) -> Column:
        back = lambda s, i: F.when(F.get(v["values"], i).isNull(), s).otherwise(F.regexp_replace(F.to_json(F.array(change(F.get(v["values"], i)))), r"^\[|\]$", ""))
        join = lambda made: F.array_join(F.flatten(F.transform(v["gaps"], lambda g, i: F.array(g, F.coalesce(F.get(made, i), F.lit(""))))), "")
        return let(F.transform(v["literals"], back), join)

    return F.when(arguments.isNull(), F.lit(None)).when(_is_json(arguments), let(_values(arguments), rebuilt)).otherwise(change(arguments))


def _map_messages(messages: Column, text, arguments) -> Column:
    part = lambda p: F.struct(p["type"].alias("type"), F.when(p["text"].isNotNull(), text(p["text"])).alias("text"), p["image_url"].alias("image_url"))
    call = lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type"), F.struct(c["function"]["name"].alias("name"), arguments(c["function"]["arguments"]).alias("arguments")).alias("function"))
    return F.transform(
        messages,
        lambda m: F.struct(m["role"].alias("role"), F.when(m["content_text"].isNotNull(), text(m["content_text"])).alias("content_text"), F.transform(m["content_parts"], part).alias("content_parts"), F.transform(m["tool_calls"], call).alias("tool_calls")),
    )


def redact_payload(messages: Column, detectors: Sequence[Detector], structured: bool = True, allow: Sequence[str] | None = None) -> Column:
    """struct<messages, mapping>: one mapping for the request. structured=False redacts string content alone and leaves
    parts and tool calls as they are."""
    none = F.array().cast("array<string>")

    def seen(m: Column) -> Column:
        out = [F.when(m["content_text"].isNotNull(), F.array(m["content_text"])).otherwise(none)]
        if structured:
            out.append(F.filter(F.transform(F.coalesce(m["content_parts"], F.array().cast(PARTS)), lambda p: p["text"]), lambda t: t.isNotNull()))
            out.append(F.flatten(F.transform(F.filter(F.coalesce(m["tool_calls"], F.array().cast(CALLS)), lambda c: c["function"]["arguments"].isNotNull()), lambda c: leaves(c["function"]["arguments"]))))
        return F.concat(*out)

    # each distinct text is searched once; the rewritten texts are looked up by the old ones
    texts_in = F.array_distinct(F.flatten(F.transform(messages, seen)))
    searched = F.transform(texts_in, lambda t: F.struct(t.alias("text"), resolve(detect(t, detectors, allow=allow)).alias("spans")))

    def redacted(pairs: Column) -> Column:
        return let(mapping(F.coalesce(F.flatten(F.transform(pairs, lambda p: p["spans"])), F.array().cast(SPANS))), lambda mapped: rewritten(pairs, mapped))

    def rewritten(pairs: Column, mapped: Column) -> Column:
        lookup = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["text"].alias("old"), splice(p["text"], p["spans"], mapped).alias("new"))))
        return let(lookup, lambda new: F.struct(replaced(lambda t: F.coalesce(F.try_element_at(new, t), t)).alias("messages"), mapped.alias("mapping")))

    def replaced(change) -> Column:
        if structured:
            return _map_messages(messages, change, lambda a: _rewrite(a, change))
        text = lambda m: F.when(m["content_text"].isNotNull(), change(m["content_text"])).alias("content_text")
        return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), text(m), m["content_parts"].alias("content_parts"), m["tool_calls"].alias("tool_calls")))

    return let(searched, redacted)


def restore_tool_calls(messages: Column, mapped: Column) -> Column:
    """messages with originals back in the arguments of tool calls."""
    return _map_messages(messages, lambda t: t, lambda a: F.when(a.isNull(), a).otherwise(_rewrite(a, lambda t: restore(t, mapped))))


def round_trip(redacted: Column, mapped: Column, anonymised: Column) -> Column:
    """Does every anonymised value reappear in the restored arguments? Null without tool calls, true without values."""
    back = F.array_join(F.flatten(F.transform(F.filter(tool_calls(restore_tool_calls(redacted, mapped)), lambda c: c["function"]["arguments"].isNotNull()), lambda c: leaves(c["function"]["arguments"]))), "\n")
    all_back = let(back, lambda b: F.forall(anonymised, lambda v: F.contains(b, v)))
    return F.when(F.size(tool_calls(redacted)) == 0, F.lit(None).cast("boolean")).otherwise(all_back)

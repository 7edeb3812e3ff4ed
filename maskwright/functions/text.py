"""String functions as Column expressions. Lengths and offsets are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: inside lambdas, a plain expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doublings(n: Column) -> Column:
    """0, 1, 2, ... while 2 to that power is below n, and 0 at least: the steps of a loop that doubles its reach."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int") - 1))


def running(values: Column) -> Column:
    """Sums up to and with each element of an array of numbers, in as many passes as the length doubles (a fold that appends would
    copy what it has for every element)."""

    def step(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(doublings(F.size(values)), values, step))


def looked_up(table: Column, x: Column, others: Column) -> Column:
    """The value of key x in a sorted array<struct<key, value>>, by bisection (a map would look at every key); others: of unknown keys."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        below = F.get(table, mid)["key"] < x
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(table).alias("hi"))
    found = lambda acc: F.when(F.coalesce(F.get(table, acc["lo"])["key"] == x, F.lit(False)), F.get(table, acc["lo"])["value"]).otherwise(others)
    return F.aggregate(doublings(F.size(table) + 2), start, step, found)


#: Code points of a chunk.
CHUNK = 512


def chunks(text: Column) -> Column:
    """text in pieces of CHUNK code points: the table by which cut() finds its place."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(table: Column, start: Column, stop: Column) -> Column:
    """Code points from start (from 0) up to stop of a text given as chunks(): substring would count from the start of the text
    each time."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(stop / CHUNK).cast("int")
    part = lambda k: F.coalesce(F.get(table, k), F.lit(""))
    inside = F.substring(part(first), (start % CHUNK + 1).cast("int"), (stop - start).cast("int"))
    across = F.concat(F.substring(part(first), (start % CHUNK + 1).cast("int"), F.lit(CHUNK)), F.array_join(F.slice(table, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(part(last), F.lit(1), (stop % CHUNK).cast("int")))
    return F.when(stop <= start, "").when(first == last, inside).otherwise(across)


WORD_TOKENS = r"([\p{L}\p{N}_]{4,})"


def literal_contains(text: Column, value: Column) -> Column:
    """Is value a case-sensitive literal part of text? Null text counts as empty; the empty value is part of everything."""
    return F.contains(F.coalesce(text, F.lit("")), value)


def strip(text: Column) -> Column:
    """Without white space at both ends (not blanks alone)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def folded(text: Column) -> Column:
    return F.lower(strip(text))


def overlap_exact(a: Column, b: Column) -> Column:
    """One is part of the other."""
    return F.contains(a, b) | F.contains(b, a)


def overlap_folded(a: Column, b: Column) -> Column:
    return overlap_exact(folded(a), folded(b))


def word_tokens(text: Column) -> Column:
    """Runs of four or more letters, digits or underscores of any script."""
    return F.regexp_extract_all(text, F.lit(WORD_TOKENS), F.lit(1))


def strictly_absent(pii: Column, out: Column) -> Column:
    """No word token of pii is left in out; without such tokens, pii itself is not."""
    tokens = word_tokens(pii)
    return F.when(F.size(tokens) == 0, ~literal_contains(out, pii)).otherwise(F.forall(tokens, lambda t: ~literal_contains(out, t)))


def token_estimate(text: Column) -> Column:
    """Words (by ASCII white space) * 4 div 3."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != ""))
    return F.floor(words * 4 / 3).cast("long")


def occurrences(text: Column, term: Column) -> Column:
    """Number of non-overlapping literal occurrences, from the left; 0 for an empty term."""
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(term == "", 0).otherwise(F.size(F.split(text, quoted, -1)) - 1)


def occurrence_starts(text: Column, term: Column) -> Column:
    """Starts (from 0) of the same occurrences: running sums over the pieces between them."""
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    size = lambda p: F.length(p).cast("long") + F.length(term)
    ends = lambda p: F.transform(running(F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), size)), lambda e: e - F.length(term))
    return F.when(term == "", F.array().cast("array<bigint>")).otherwise(let(F.split(text, quoted, -1), ends))


def ascii_note(text: Column) -> Column:
    """The JSON of {note: text}, ASCII-escaped."""
    escaped = lambda run: F.lower(F.regexp_replace(F.hex(F.encode(run, "UTF-16BE")), "(.{4})", r"\\u$1"))
    # runs of ASCII and of other characters, so that only the latter are taken apart
    run = lambda r: F.when(r.rlike(r"^[\x00-\x7F]"), r).otherwise(escaped(r))
    runs = lambda j: F.array_join(F.transform(F.regexp_extract_all(j, F.lit(r"[\x00-\x7F]++|[^\x00-\x7F]++"), F.lit(0)), run), "")
    return let(F.to_json(F.struct(text.alias("note"))), lambda j: F.when(j.rlike(r"[^\x00-\x7F]"), runs(j)).otherwise(j))


def nearest_rank(values: Column, percent: float) -> Column:
    """sorted(values)[min(floor(n * percent / 100), n - 1)]; null for no values."""
    ordered = F.sort_array(values)
    n = F.size(ordered)
    return F.get(ordered, F.least(F.floor(n * F.lit(percent) / 100), n - 1).cast("int"))


def shown(rate: Column) -> Column:
    """A rate for display: one decimal, halves to even."""
    return F.bround(rate, 1)

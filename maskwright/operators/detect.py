"""Detectors: each turns a text column into array<span> with native expressions.

A span is struct<type, text, start, end, score, source>; offsets are code points, end exclusive. A detector is anything with
spans(text, lang) -> Column (the Detector protocol); a model without a Column form joins in through pandas_detector().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, functions as F

from ..functions import checksums
from ..functions.text import let, occurrence_starts, running
from .automaton import kept

SPAN = "struct<type:string,text:string,start:int,end:int,score:double,source:string>"
SPANS = f"array<{SPAN}>"

#: The entity types of the allowlist, and those that the wider taxonomy adds.
ALLOWLIST = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "DATE_TIME", "US_SSN", "UK_NHS")
TAXONOMY = (*ALLOWLIST, "LOCATION", "ORGANIZATION", "FINANCIAL", "SECRET", "URL")

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"
IP = r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
CARD = r"[0-9]{16}"
PHONE = r"[+][0-9]{1,2} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"
SECRET = r'token = "([0-9a-f]{40})"'
URL = r"https?://[A-Za-z0-9./?=&_%#-]+"


class Detector(Protocol):
    name: str

    def spans(self, text: Column, lang: Column | None = None) -> Column: ...


def span(kind: str, text: Column, start: Column, score: float, source: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), F.lit(score).alias("score"), F.lit(source).alias("source"))


@dataclass(frozen=True)
class Rule:
    """All matches of a pattern; group names the part that counts, valid (on that part) what must hold, guard a literal
    without which the pattern need not be tried."""

    name: str
    type: str
    pattern: str
    group: int = 0
    valid: Callable[[Column], Column] | None = None
    guard: str | None = None
    score: float = 0.85
    langs: tuple[str, ...] | None = None

    def spans(self, text: Column, lang: Column | None = None) -> Column:
        whole = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        gaps = F.transform(F.split(text, self.pattern, -1), lambda g: F.length(g))

        def placed(m: Column) -> Column:
            """A match ends where the gaps and matches up to it end; the part's place within its match is found by its text."""
            ends = running(F.transform(m["whole"], lambda w, i: F.get(m["gaps"], i) + F.length(w)))
            if not self.group:
                return F.zip_with(m["whole"], ends, lambda w, e: span(self.type, w, e - F.length(w), self.score, self.name))
            both = F.zip_with(m["whole"], ends, lambda w, e: F.struct(w.alias("w"), (e - F.length(w)).alias("at")))
            return F.zip_with(both, m["part"], lambda b, v: span(self.type, v, b["at"] + F.instr(b["w"], v) - 1, self.score, self.name))

        fields = [whole.alias("whole"), gaps.alias("gaps")]
        if self.group:
            fields.append(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(self.group)).alias("part"))
        found = let(F.struct(*fields), placed)
        if self.valid is not None:
            found = F.filter(found, lambda s: self.valid(s["text"]))
        none = F.array().cast(SPANS)
        tried = text.isNotNull()
        if self.guard is not None:
            tried = tried & F.contains(text, F.lit(self.guard))
        if self.langs is not None and lang is not None:
            tried = tried & F.coalesce(lang.isin(*self.langs), F.lit(True))
        return F.when(tried, found).otherwise(none)


#: Terms of a dictionary that are searched one by one.
NATIVE_TERMS = 512


@dataclass(frozen=True)
class Dictionary:
    """All non-overlapping literal hits of each (term, type); terms must not be empty. Up to NATIVE_TERMS they are an array in
    one expression, which may stand anywhere; more are found by an automaton in Arrow batches, which cannot stand inside a lambda (payloads)."""

    terms: tuple[tuple[str, str], ...]
    name: str = "dictionary"
    score: float = 0.99

    def __post_init__(self) -> None:
        if any(not t for t, _ in self.terms):
            raise ValueError("an empty term has no occurrences")

    def spans(self, text: Column, lang: Column | None = None) -> Column:
        if len(self.terms) > NATIVE_TERMS:
            return _automaton_spans(self)(text)
        if not self.terms:
            return F.array().cast(SPANS)
        each = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(k).alias("type")) for t, k in self.terms))
        place = lambda t: lambda start: F.struct(t["type"].alias("type"), t["term"].alias("text"), start.cast("int").alias("start"), (start + F.length(t["term"])).cast("int").alias("end"), F.lit(self.score).alias("score"), F.lit(self.name).alias("source"))
        held = F.filter(each, lambda t: F.contains(text, t["term"]))
        found = F.flatten(F.transform(held, lambda t: F.transform(occurrence_starts(text, t["term"]), place(t))))
        return F.when(text.isNotNull(), found).otherwise(F.array().cast(SPANS))


def _automaton_spans(d: Dictionary) -> Callable[[Column], Column]:
    """The same spans from one pass over the text."""
    import pandas as pd

    name = uuid.uuid4().hex

    def run(texts):
        own = kept(name, [t for t, _ in d.terms])
        number, entries = {t: i for i, t in enumerate(own.terms)}, [[] for _ in own.terms]
        for t, k in d.terms:
            entries[number[t]].append((t, k))
        out = []
        for x in texts:
            found = own.found(x)
            out.append([{"type": k, "text": t, "start": s, "end": s + len(t), "score": d.score, "source": d.name} for i in sorted(found) for t, k in entries[i] for s in found[i]])
        return pd.Series(out)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, SPANS)


_rules = (
    Rule("email", "EMAIL_ADDRESS", EMAIL, guard="@", score=0.99),
    Rule("ip", "IP_ADDRESS", IP, valid=checksums.octets, guard=".", score=0.9),
    Rule("card", "CREDIT_CARD", r"[0-9](?:[ -]?[0-9]){12,18}", valid=checksums.luhn, score=0.95),
    Rule("phone", "PHONE_NUMBER", r"[+][0-9][0-9 ().-]{7,20}[0-9]", guard="+", score=0.8),
    Rule("iban", "IBAN_CODE", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", valid=checksums.iban, score=0.97),
    Rule("ssn", "US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", valid=lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"), guard="-", score=0.85),
    Rule("nhs", "UK_NHS", r"[0-9]{3} [0-9]{3} [0-9]{4}", valid=checksums.nhs, score=0.85),
    Rule("date", "DATE_TIME", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}", score=0.6),
    Rule("url", "URL", URL, guard="://", score=0.9),
    Rule("secret", "SECRET", SECRET, group=1, guard='token = "', score=0.95),
    # types as the table of source labels has them
    Rule("key", "SECRET", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}", valid=checksums.secret, score=0.7),
    Rule("bitcoin", "FINANCIAL", r"\b[13LM][1-9A-HJ-NP-Za-km-z]{25,34}\b", valid=checksums.base58check, score=0.97),
    Rule("segwit", "FINANCIAL", r"\b(?:bc1|BC1)[02-9A-Za-z]{11,71}\b", valid=checksums.bech32, score=0.97),
    Rule("ether", "FINANCIAL", r"\b0x[0-9A-Fa-f]{40}\b", guard="0x", score=0.9),  # by form: the hash of the mixed case is not checked
    Rule("bic", "FINANCIAL", r"(?:BIC|SWIFT)[ :]+([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", group=1, score=0.8),
    Rule("routing", "FINANCIAL", r"(?:ABA|[Rr]outing)[A-Za-z ]{0,20}[ :]+([0-9]{9})\b", group=1, valid=checksums.routing, score=0.9),
    Rule("vehicle", "US_SSN", r"\b[A-HJ-NPR-Z0-9]{17}\b", valid=checksums.vehicle, score=0.9),
    Rule("imei", "PHONE_NUMBER", r"IMEI[ :]+([0-9]{2}-?[0-9]{6}-?[0-9]{6}-?[0-9])\b", group=1, valid=checksums.luhn, guard="IMEI", score=0.97),
    Rule("mac", "IP_ADDRESS", r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b|\b[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}\b", score=0.9),
    Rule("ipv6", "IP_ADDRESS", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])", valid=checksums.ipv6, guard=":", score=0.9),
    # names and places: a cue before capitalised words. The pattern begins with the classes of the cues' first characters, which
    # dismiss nearly every place of a text at once; trying all cues there takes most of the time otherwise
    Rule("person", "PERSON", r"(?=[MDHFS][rseaio])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora|Signor|Signora)[.]? ((?:\p{Lu}[\p{L}'-]+ ?){1,3}[\p{L}])", group=1, score=0.6),
    Rule("location", "LOCATION", r"(?=[lbwhva][iaob][vshbi][enit])(?:lives in|based in|wohnt in|habite à|vive en|abita a) (\p{Lu}[\p{L}-]+)", group=1, score=0.5),
    Rule("organization", "ORGANIZATION", r"(\p{Lu}[\p{L}&-]+(?: \p{Lu}[\p{L}&-]+){0,3} (?:GmbH|AG|Inc|Ltd|LLC|SARL|SpA|SL))", group=1, score=0.6),
)

REGISTRY: dict[str, Detector] = {r.name: r for r in _rules}


def register(detector: Detector) -> None:
    """Add a detector, or replace the one of that name."""
    REGISTRY[detector.name] = detector


def detect(text: Column, detectors: Sequence[Detector] | None = None, lang: Column | None = None, allow: Sequence[str] | None = None, min_score: float = 0.4) -> Column:
    """All spans of the detectors (default: all that are registered), of allowed types (None: all) and scores, without
    empty ones."""
    found = F.flatten(F.array(*(d.spans(text, lang) for d in (list(REGISTRY.values()) if detectors is None else detectors))))
    keep = lambda s: (s["score"] >= min_score) & (s["end"] > s["start"]) & (s["type"].isin(*allow) if allow is not None else F.lit(True))
    return F.filter(found, keep)


def pandas_detector(name: str, fn: Callable[[list[str]], list[list[tuple[str, str, int, int, float]]]]) -> Detector:
    """A detector from a function over a batch of texts that returns (type, text, start, end, score) for each; it runs in
    Arrow batches, for models that have no Column form."""
    import pandas as pd

    def run(texts):
        return pd.Series([[{"type": t, "text": x, "start": a, "end": b, "score": s, "source": name} for t, x, a, b, s in spans] for spans in fn(texts.fillna("").tolist())])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    column = F.pandas_udf(run, SPANS)

    @dataclass(frozen=True)
    class Opaque:
        name: str

        def spans(self, text: Column, lang: Column | None = None) -> Column:
            return column(text)

    return Opaque(name)


#: What stands in for a missing language, by use.
DEFAULT_LANGUAGES = {"engine": "fr", "result": "?", "clean": "en"}


def default_language(lang: Column, use: str) -> Column:
    return F.coalesce(lang, F.lit(DEFAULT_LANGUAGES[use]))


def languages(lang: Column) -> Column:
    """The languages to try for a document: its own, then English."""
    return F.array_distinct(F.array(default_language(lang, "engine"), F.lit("en")))


def first_language(langs: Column, lang: Column) -> Column:
    """The configured languages with the document's own first."""
    return F.concat(F.array(lang), F.array_remove(langs, lang))

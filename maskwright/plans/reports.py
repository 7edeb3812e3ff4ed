"""Reports over a labelled corpus, as nested frames: precision and recall, carrier parity, solution comparison. Each takes a
corpus (id, lang, text, expected) and Solutions; text is redacted once, and every figure is an aggregate over that."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import let, literal_contains, strictly_absent
from ..operators import arguments, payload as P
from ..operators.detect import ALLOWLIST, DEFAULT_LANGUAGES, REGISTRY, Detector, detect
from ..operators.redact import originals, redact
from ..operators.sampling import label_entries
from ..operators.score import greedy_match, precision_recall, rate
from ..sources.sinks import small


#: How the figures of a report are to be read, by column.
CAVEATS = {
    "recall": "recall: percent of labels whose text is gone from the output; a label that is not in its text counts as caught.",
    "recall_strict": "recall_strict: every word of four letters or more of a label must be gone, not the label as a whole alone.",
    "precision": "precision: detections that overlap no label are false, whether or not they are personal data.",
    "tool_leak": "tool_leak, mm_leak: percent of all labels found in the decoded arguments, or in the parts of a message.",
    "tool_protection": "tool_protection: percent of the labels caught in flat text that the arguments do not show either.",
    "false_positives": "false_positives: distinct originals replaced in documents without labels, as a total, not for each document.",
    "regressions": "regressions: caught in flat text and leaked in the carrier; always 0 for flat.",
    "rt_failed": "rt_checked, rt_failed: payloads without tool calls have nothing to restore and do not count.",
}


def caveats(sections: dict[str, DataFrame]) -> list[str]:
    """The notes for the columns that are there."""
    columns = {c for df in sections.values() for c in df.columns}
    return [note for column, note in CAVEATS.items() if column in columns]


@dataclass(frozen=True)
class Solution:
    """A named redactor: its detectors, the types it may report (None: all) and whether it looks into parts and tool calls."""

    name: str
    detectors: tuple[Detector, ...] = field(default_factory=lambda: tuple(REGISTRY.values()))
    allow: tuple[str, ...] | None = None
    structured: bool = True


def default_solutions() -> list[Solution]:
    return [Solution("allowlisted", allow=ALLOWLIST), Solution("all-types"), Solution("flat-only", structured=False)]


def redacted(corpus: DataFrame, solution: Solution, *more: str) -> DataFrame:
    """id, lang, labels (array<struct<pii, type>>), out, found (distinct originals), and more columns of the corpus."""
    base = corpus.withColumn("labels", label_entries(F.col("expected")))
    done = base.withColumn("__r", redact(F.col("text"), detect(F.col("text"), solution.detectors, F.col("lang"), solution.allow)))
    return done.select("id", "lang", "labels", F.col("__r.text").alias("out"), originals(F.col("__r.mapping")).alias("found"), *more)


def precision_recall_report(corpus: DataFrame, solution: Solution) -> dict[str, DataFrame]:
    """Overall and by language, and each document's misses and false detections."""
    match = greedy_match(F.col("found"), F.transform("labels", lambda x: x["pii"]))
    docs = redacted(corpus, solution).withColumn("m", match).select("id", "lang", F.col("m.tp").alias("tp"), F.size("m.fp").alias("fp"), F.size("m.fn").alias("fn"), F.col("m.fp").alias("fp_items"), F.col("m.fn").alias("fn_items"))
    return {"overall": precision_recall(docs), "by_lang": precision_recall(docs, "lang").orderBy("lang"), "items": docs.select("id", "fp_items", "fn_items").orderBy("id")}


def carrier_report(corpus: DataFrame, solution: Solution, carriers: Sequence[str] = P.CARRIERS) -> DataFrame:
    """For each carrier: labels, anonymized, leaked, regressions (caught in flat, leaked here), round trips checked, failed.

    Each document is a payload for each carrier; payloads are redacted, and restored, as rows."""
    labelled = corpus.withColumn("labels", F.transform(label_entries(F.col("expected")), lambda x: x["pii"])).withColumn("__row", F.monotonically_increasing_id())
    every = F.array(*(F.struct(F.lit(c).alias("carrier"), P.wrap(F.col("text"), c).alias("messages")) for c in dict.fromkeys(("flat", *carriers))))
    payloads = labelled.select("__row", "labels", F.explode(every).alias("c")).select("__row", "labels", "c.*")
    done = arguments.redact_payloads(payloads, solution.detectors, structured=solution.structured, types=solution.allow)
    seen = done.withColumn("leaked", let(P.flatten(F.col("messages")), lambda out: F.filter("labels", lambda v: literal_contains(out, v))))
    flat = F.max(F.when(F.col("carrier") == "flat", F.col("leaked"))).over(Window.partitionBy("__row"))  # the carriers of a document
    back = arguments.restore_payloads(seen.withColumn("flat", flat)).withColumn("calls", P.tool_calls(F.col("messages")))
    told = let(F.array_join(F.flatten(F.transform(F.filter("calls", lambda c: c["function"]["arguments"].isNotNull()), lambda c: P.leaves(c["function"]["arguments"]))), "\n"), lambda text: F.forall(F.array_except("labels", "leaked"), lambda v: F.contains(text, v)))
    judged = back.filter(F.col("carrier").isin(*carriers)).withColumns({"regressions": F.size(F.array_except("leaked", "flat")), "rt": F.when(F.size("calls") > 0, told)})
    rows = judged.select("carrier", F.size("labels").alias("labels"), F.size("leaked").alias("leaked"), "regressions", "rt")
    total = lambda e, n: F.sum(e).cast("long").alias(n)
    return rows.groupBy("carrier").agg(total("labels", "labels"), total(F.col("labels") - F.col("leaked"), "anonymized"), total("leaked", "leaked"), total("regressions", "regressions"), F.count("rt").alias("rt_checked"), F.count_if(~F.col("rt")).alias("rt_failed")).orderBy("carrier")


def keys(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """key: the distinct values of a column, sorted; missing stands in for null."""
    value = F.col(column) if missing is None else F.coalesce(column, F.lit(missing))
    return df.select(value.alias("key")).distinct().orderBy("key")


def comparison_report(corpus: DataFrame, solutions: Sequence[Solution], langs: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Span and strict recall overall, by language and by type (pivots), false positives on clean documents, leaks in
    tool calls and message parts, protection. langs: the columns of by_lang; if not given they are looked up in the corpus, which costs
    a scan of one column (and not of all that the report is made from)."""
    unknown = DEFAULT_LANGUAGES["result"]
    langs = [r["key"] for r in small(keys(corpus, "lang", unknown))] if langs is None else list(langs)
    parts = []
    for s in solutions:
        out = redacted(corpus, s, "text").withColumn("messages", P.combined(F.col("text"))).drop("text")
        out = arguments.redact_payloads(out, s.detectors, structured=s.structured, types=s.allow)
        parts.append(out.select(F.lit(s.name).alias("solution"), "id", "lang", "labels", "out", "found", F.array_join(P.leaves(P.first_arguments(F.col("messages"))), "\n").alias("args"), P.first_multimodal(F.col("messages")).alias("mm")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    labels = every.select("solution", "lang", "out", "args", "mm", F.explode("labels").alias("x")).select("solution", "lang", F.col("x.type").alias("type"), (~literal_contains(F.col("out"), F.col("x.pii"))).alias("caught"), strictly_absent(F.col("x.pii"), F.col("out")).alias("strict"), literal_contains(F.col("args"), F.col("x.pii")).alias("tool_leak"), literal_contains(F.col("mm"), F.col("x.pii")).alias("mm_leak"))
    n = lambda c: F.count_if(c)
    of = F.count(F.lit(1))
    headline = labels.groupBy("solution").agg(of.alias("labels"), n("caught").alias("caught"), n("strict").alias("strict_caught"), rate(n("caught"), of, True).alias("recall"), rate(n("strict"), of, True).alias("recall_strict"), rate(n("tool_leak"), of, True).alias("tool_leak"), rate(n("mm_leak"), of, True).alias("mm_leak"), rate(n(F.col("caught") & ~F.col("tool_leak")), n("caught"), True).alias("tool_protection"))
    clean = every.filter(F.size("labels") == 0).groupBy("solution").agg(F.sum(F.size("found")).alias("false_positives"), F.count("*").alias("clean_docs"))
    recall = rate(n("caught"), of, True)
    return {
        "headline": headline.orderBy("solution"),
        "clean": clean.orderBy("solution"),
        "by_lang": labels.withColumn("lang", F.coalesce("lang", F.lit(unknown))).groupBy("solution").pivot("lang", langs).agg(recall).na.fill(0.0).orderBy("solution"),
        "by_type": labels.groupBy("type").pivot("solution", [s.name for s in solutions]).agg(recall).na.fill(0.0).orderBy("type"),
    }

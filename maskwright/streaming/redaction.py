"""Redaction of text streams, with the expressions of the batch operators, and windowed counts of what was found."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversation import with_spans
from ..operators.detect import Detector, detect
from ..operators.redact import MAPPING, redact, resolve
from ..session import ship


def redact_stream(messages: DataFrame, detectors: Sequence[Detector], text: str = "text") -> DataFrame:
    """messages with text redacted, and a column mapping. Stateless: works on batches too."""
    done = messages.withColumn("__r", redact(F.col(text), detect(F.col(text), detectors)))
    return done.withColumns({text: F.col("__r.text"), "mapping": F.col("__r.mapping")}).drop("__r")


def windowed_counts(messages: DataFrame, detectors: Sequence[Detector], time: str = "ts", text: str = "text", window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, type, n of the spans found, by event time; rows later than `late` are dropped by the watermark."""
    spans = messages.withWatermark(time, late).select(time, F.explode(resolve(detect(F.col(text), detectors))).alias("s"))
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    return spans.groupBy(frame.alias("w"), F.col("s.type").alias("type")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "type", "n")


class Numbering(StatefulProcessor):
    """Keeps a conversation's placeholders, and how many of each type there are; entries that are not used for `ttl` go."""

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fakes = handle.getMapState("fakes", "type string, original string", "fake string", self.ttl)
        self.counts = handle.getMapState("counts", "type string", "n long", self.ttl)

    def fake(self, kind: str, original: str) -> str:
        """Reading an entry renews it."""
        key = (kind, original)
        if known := self.fakes.containsKey(key):
            fake = self.fakes.getValue(key)[0]
        else:
            n = (self.counts.getValue((kind,))[0] if self.counts.containsKey((kind,)) else 0) + 1
            self.counts.updateValue((kind,), (n,))
            fake = f"<{kind}_{n}>"
        if self.ttl is not None or not known:
            self.fakes.updateValue(key, (fake,))
        return fake

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        turns = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for turn, text, spans in zip(turns["turn"], turns["text"], turns["spans"], strict=True):
            out, mapped, at = [], {}, 0
            for s in spans if spans is not None else []:
                fake = self.fake(s["type"], s["text"])
                mapped[s["type"], s["text"]] = fake
                out += [text[at : s["start"]], fake]
                at = s["end"]
            entries = sorted(({"original": o, "fake": f, "type": t} for (t, o), f in mapped.items()), key=lambda m: (m["original"], m["fake"]))
            yield pd.DataFrame({"conv_id": [key[0]], "turn": [turn], "text": [None if text is None else "".join([*out, text[at:]])], "mapping": [entries]})

    def close(self) -> None:
        pass


def redact_conversation_stream(turns: DataFrame, detectors: Sequence[Detector], ttl: int | None = None) -> DataFrame:
    """conv_id, turn, text (redacted) and mapping of a stream of turns: one mapping for a conversation, kept in keyed state between
    batches. Spans are found by expressions; only numbering is stateful. Turns of a conversation must arrive in order (within a
    batch they are sorted) for the numbers to be those of the batch operator. ttl: milliseconds after which unused entries are
    forgotten. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    ship(turns.sparkSession)
    spotted = with_spans(turns.select("conv_id", "turn", "text"), detectors)
    kind = lambda c: spotted.schema[c].dataType.simpleString()
    made = f"conv_id {kind('conv_id')}, turn {kind('turn')}, text string, mapping {MAPPING}"
    return spotted.groupBy("conv_id").transformWithStateInPandas(Numbering(ttl), made, "append", "processingTime" if ttl is not None else "none")

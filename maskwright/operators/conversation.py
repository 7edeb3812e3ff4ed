"""One mapping for a conversation: placeholders are numbered by first occurrence over all its turns, so that a value has the same
placeholder in every turn.

Turns are rows of conv_id, turn, text (other columns are kept). First occurrences are by turn, then by place in the text; they are
found by a pre-aggregated minimum, and numbered by running totals over ranges of turns, so a conversation that holds a
third of all rows is many tasks' work. Each turn then gets those entries of the mapping that it needs, by an equi-join.

Defined cases. Null text: stays null. Null conv_id: one conversation. Turns that share a number: as one turn, by place in their texts, then by
type and original. Repeated rows: each is redacted. Empty table: empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranking import running_total
from ..session import stored
from .detect import Detector, detect
from .redact import MAPPING, resolve, restore, splice


def with_spans(turns: DataFrame, detectors: Sequence[Detector], text: str = "text") -> DataFrame:
    return turns.withColumn("spans", resolve(detect(F.col(text), detectors)))


def mapping_of(spotted: DataFrame) -> DataFrame:
    """conv_id, type, original, fake from turns with spans: every value of a conversation, once."""
    each = spotted.select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", F.col("s.start").alias("start"), F.col("s.type").alias("type"), F.col("s.text").alias("original"))
    first = each.groupBy("conv_id", "type", "original").agg(F.min(F.struct("turn", "start")).alias("at")).select("conv_id", "type", "original", F.col("at.turn").alias("turn"), F.col("at.start").alias("start"))
    numbered = running_total(first, ["conv_id", "type"], "turn", ["turn", "start", "original"], F.lit(1), "n")
    return numbered.select("conv_id", "type", "original", F.concat(F.lit("<"), "type", F.lit("_"), F.col("n").cast("string"), F.lit(">")).alias("fake"))


def redact_conversations(turns: DataFrame, detectors: Sequence[Detector], text: str = "text") -> DataFrame:
    """turns with text redacted, and `mapping`, the entries that the turn needs. Turns and their spans are written once."""
    named = stored(with_spans(turns, detectors, text).withColumn("__row", F.monotonically_increasing_id()), "turns")
    mapped = mapping_of(named.select("conv_id", "turn", "spans"))
    wanted = named.select("__row", "conv_id", F.explode("spans").alias("s")).select("__row", "conv_id", F.col("s.type").alias("type"), F.col("s.text").alias("original")).distinct()
    same = F.col("w.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("w.type") == F.col("m.type")) & (F.col("w.original") == F.col("m.original"))
    own = wanted.alias("w").join(mapped.alias("m"), same).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct(F.col("m.original").alias("original"), F.col("m.fake").alias("fake"), F.col("m.type").alias("type")))).alias("mapping"))
    none = F.array().cast(MAPPING)
    joined = named.join(own, "__row", "left").withColumn("mapping", F.coalesce("mapping", none))
    return joined.withColumn(text, splice(F.col(text), F.col("spans"), F.col("mapping"))).drop("__row", "spans")


def restore_conversations(redacted: DataFrame, text: str = "text") -> DataFrame:
    """The turns of redact_conversations(), or of its stream, with their originals back."""
    return redacted.withColumn(text, restore(F.col(text), F.col("mapping"))).drop("mapping")


def restored_with(texts: DataFrame, mapped: DataFrame, text: str = "text") -> DataFrame:
    """Texts that others wrote in a conversation (conv_id, text), with its placeholders replaced by mapping_of()'s originals: each
    text looks up the placeholders that it holds."""
    named = stored(texts.withColumn("__row", F.monotonically_increasing_id()), "answers")
    held: Column = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("(<[^<>]+_[0-9]+>)"), F.lit(1)))
    wanted = named.select("__row", "conv_id", F.explode(held).alias("fake"))
    same = F.col("w.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("w.fake") == F.col("m.fake"))
    own = wanted.alias("w").join(mapped.alias("m"), same).groupBy("__row").agg(F.collect_list(F.struct(F.col("m.original").alias("original"), F.col("m.fake").alias("fake"), F.col("m.type").alias("type"))).alias("__mapping"))
    joined = named.join(own, "__row", "left")
    return joined.withColumn(text, F.when(F.col("__mapping").isNull(), F.col(text)).otherwise(restore(F.col(text), F.col("__mapping")))).drop("__row", "__mapping")

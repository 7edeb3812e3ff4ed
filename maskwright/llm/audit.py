"""How filters interact: what each removes in every order, alone, and by its fair share (Shapley value).

One pass over whole texts gives each document a mask of the conditions that it fails and the hashes of its successive blocks (the
first 256 code points, then up to 4,096, 65,536, ...). Duplicates are found by partition refinement: documents are classed by their
length in code points, then by one block hash after the other; before each step classes of one document are dropped, so that
later steps move few rows. The full texts of those left in classes are compared: a class whose smallest and largest text are the same is one text.
Classes that hold several texts (equal hashes of different blocks) are parted by the text itself, so the result is exact
whatever the hashes do. Of each text all documents but those with the smallest id fail the condition.

Then documents are counted by part and mask (a row for each, summed before the shuffle); all orders and steps follow from these
counts: a filter removes the masks that have its bit and none of the filters before it.

Defined cases. Null text: as empty, and equal to it. Null language: the empty string. Documents without id: never later copies, and
no copy is later than they are. Rows that repeat an id and a text: each counts; those with the smallest id all stay. Labels that repeat an id: good or toxic
if any row says so; labels of no document, or without id, say nothing. A hot text or length meets in joins that adaptive
execution splits, and in pre-aggregated groups. Empty table: no parts, empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, map_arrow, prepare, saved, table

FILTERS = "ABCDE"
#: The filter that looks at other documents.
COPY = "E"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Length of the first block, and how much further each next block reaches.
FIRST, FACTOR = 256, 16

_SHOUT = bytes(x for x in range(256) if not 65 <= x <= 90)
_MARKS = re.compile("[#$%&*|]")


def fails(text: str) -> int:
    """The mask of the conditions that need the text alone: bit i for the i-th of FILTERS."""
    raw = text.encode()
    words = raw.split()  # of bytes: by ASCII white space
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * len(raw.translate(None, _SHOUT)) > 10 * len(text)) << 2 | (_MARKS.search(text) is not None) << 3


def block_hashes(text: str) -> list[int]:
    """Signed 64-bit hashes of the successive blocks."""
    out, lo, hi = [], 0, FIRST
    while lo < len(text):
        out.append(xxhash.xxh3_64_intdigest(text[lo:hi].encode()))
        lo, hi = hi, hi * FACTOR
    return [x - (1 << 64) if x >> 63 else x for x in out]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, h, part, mask, length, blocks of every document. doc_id and h, a 64-bit hash of the text, name a text of a
    document where rows share an id."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        columns = [*(batch.column(c) for c in ("doc_id", "h", "part")), pa.array(map(fails, texts), pa.int32()), pa.array(map(len, texts), pa.int64()), pa.array(map(block_hashes, texts), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "part", "mask", "length", "blocks"])

    return map_arrow(named(docs), run, "doc_id long, h long, part string, mask int, length long, blocks array<long>")


def named(docs: DataFrame) -> DataFrame:
    """doc_id, h, part, text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))


def shared(rows: DataFrame) -> DataFrame:
    """Without the classes of one document. Counts are made before the shuffle, and the join is a plain one, which can be split."""
    more = rows.groupBy("class").agg(F.count("*").alias("__n")).filter("__n > 1").select("class")
    return rows.join(more, "class", "left_semi")


def refined(rows: DataFrame) -> DataFrame:
    """doc_id, h, class of the documents that share their length and all block hashes with another; saved."""
    start = rows.filter("doc_id is not null").select("doc_id", "h", F.xxhash64("length").alias("class"), "blocks")
    left = saved(shared(start), "audit-classes")
    step = 0
    while not left.filter(F.size("blocks") > step).isEmpty():  # as many turns as the longest shared text has blocks
        finer = left.withColumn("class", F.when(F.size("blocks") > step, F.xxhash64("class", F.get("blocks", F.lit(step)))).otherwise(F.col("class")))
        before, left = left, saved(shared(finer), "audit-classes")
        discard(before)
        step += 1
    return left.select("doc_id", "h", "class")


def later_copies(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, h of the documents in classes whose text a smaller id has too: full texts are compared."""
    classes = classes.distinct()
    # a merge join at every size: how many documents share a text has no bound
    members = named(docs).select("doc_id", "h", "text").join(classes.hint("merge"), ["doc_id", "h"])
    spread = members.groupBy("class").agg(F.min("text").alias("least"), F.max("text").alias("most"), F.min("doc_id").alias("first"))
    spread = saved(spread.select("class", "first", (F.col("least") == F.col("most")).alias("one")), "audit-spread")
    found = saved(classes, "audit-classes").join(spread.filter("one"), "class").filter("doc_id > first").select("doc_id", "h")
    if not spread.filter(~F.col("one")).isEmpty():  # hashes of different blocks that are equal
        mixed = members.join(spread.filter(~F.col("one")).select("class"), "class")
        apart = mixed.join(mixed.groupBy("text").agg(F.min("doc_id").alias("first")), "text")
        found = found.unionByName(apart.filter("doc_id > first").select("doc_id", "h").distinct())
    return found


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask with the bit of copies set; a row for each document."""
    prepare(docs.sparkSession)
    rows = saved(features(docs), "audit-features")
    copies = later_copies(docs, refined(rows)).withColumn("copy", F.lit(1 << FILTERS.index(COPY)))
    return rows.join(copies, ["doc_id", "h"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("copy", F.lit(0))).alias("mask"))


def counted(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: a row for each mask that occurs in a part."""
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return masked.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").cast("long").alias("good"), F.count_if("toxic").cast("long").alias("toxic"))


def audited(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """From counts of masks to every step of every order."""
    orders = ["".join(p) for p in permutations(filters)]
    bit = lambda f: f"shiftleft(1, instr('{filters}', {f}) - 1)"
    each = counts.select("part", "mask", "n", "good", "toxic", F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    each = each.withColumn("own", F.expr(bit("substr(filter_order, step, 1)")))
    each = each.withColumn("before", F.expr(f"aggregate(filter(sequence(1, {len(filters)}), i -> i < step), 0, (m, i) -> m | {bit('substr(filter_order, i, 1)')})"))
    mine = F.col("mask").bitwiseAND(F.col("own")) != 0
    met = F.col("mask").bitwiseAND(F.col("before")) == 0
    # a filter is the first of a mask's filters in one order of so many
    share = F.lit(len(orders)) / F.greatest(F.bit_count("mask"), F.lit(1))
    total = lambda value, when, name: F.sum(F.when(when, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("long").alias(name)
    return each.groupBy("part", "filter_order", "step").agg(
        total("n", met & ~mine, "kept"),
        total("n", met & mine, "removed"),
        total("n", ~met & mine, "redundant"),
        total("n", F.col("mask") == F.col("own"), "unique_fails"),
        total("good", met & mine, "good_lost"),
        total("toxic", met & mine, "toxic_lost"),
        total(F.col("n") * share.cast("long"), mine, "shapley"),
    )


def op12_audit(spark, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of every order, by language."""
    return audited(counted(masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), first AS (
  SELECT text, min(doc_id) AS first_id FROM d GROUP BY text
), w AS (
  SELECT doc_id, part, text, {_WORDS} AS w FROM d
), m AS (
  SELECT doc_id, part, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
    + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > first_id, FALSE) AS INTEGER) AS mask
  FROM w JOIN first USING (text)
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), s(filter_order, step, own, before) AS (
  VALUES {', '.join(f"('{o}', {i + 1}, {1 << FILTERS.index(f)}, {sum(1 << FILTERS.index(x) for x in o[:i])})" for o in ORDERS for i, f in enumerate(o))}
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & own = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""

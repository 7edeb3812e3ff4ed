"""Ranked lexical search by a bit-sliced impact index.

A document's impact for a term is a whole number: the term's weight times a saturated count (see `impacts`). Documents lie in blocks
of up to `BLOCK`, in ascending order of doc_id. For each block and term the index has one bitmap per bit of the impacts: bitmap b has a
document's bit set if bit b of its impact is set. Of a bitmap, only the 64-bit words in which some document holds the
term are kept. Scores of all documents of a block are bit slices too: a term is added by a ripple of carries over the slices, by
AND and XOR of whole words. The k best are found from the most significant slice down: of the documents that are
level so far, those with the bit set are better; whoever is still level at the end is taken in order of doc_id.

Layout. One pass over the texts packs documents into blocks and writes their postings (block, term, places, counts, lengths); the
collection's statistics are sums over these. A join on the term brings its weight, and each row becomes its bitmaps:
the index, a table of (block, term). Items are cut into batches; index rows meet the batches that have their term, by an equi-join, and
a cell of batch and block group streams its blocks, one at a time in memory. Each cell returns k rows for each item, of which
the k best are chosen, cut within each task first. An index for given items holds their terms only: if these are few enough
(`TERMS`, `BYTES`: measured) they are sent to the tasks, else postings of all terms are written and joined with them.

Defined cases. Null or empty text, and text without terms: no document. Documents without id count in the statistics and are not
returned. Rows that share an id: each is a document, with a rank of its own (equal scores: as the rows lie). Items without id or terms: no rows. An item that
occurs several times with one text counts once; with several texts, each has ranks of its own. Very long texts: linear; a
block ends early when it has many postings (`HELD`). Empty tables: empty. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, prepare, saved, table

#: Documents of a block at most (places are 16-bit numbers), and postings after which it ends.
BLOCK, HELD = 8192, 2_000_000
#: Items that are added up together, and how many terms (of how many bytes) are sent to the tasks.
BATCH, TERMS, BYTES = 256, 500_000, 16 << 20
#: Blocks of a cell: what a task reads does not grow with the collection.
STREAMED = 8
#: Fixed values of the score.
SCALE, COUNTED, PER_LENGTH, LEAST, SLOPE = 1_000_000_000, 1000, 8, 100 - 90, 90

#: ASCII letters to lower case; other ASCII that is no digit to a blank. Bytes of other characters stay.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x > 127 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return (text or "").encode().translate(_FOLD).split()


class Index(NamedTuple):
    """blocks: block, ids (a row for each block); slices: block, term, words, planes (a row for each block and term)."""

    blocks: DataFrame
    slices: DataFrame


# --- building -----------------------------------------------------------------------------------------------------

PACKED = "block string, term string, places binary, counts binary, lengths binary, ids binary, docs long, words long"


def packed(docs: DataFrame, vocabulary: frozenset | None) -> DataFrame:
    """Postings by block and term, and for each block a row without term: ids and statistics; saved."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by TERMS and BYTES, or None
    schema = pa.schema([("block", pa.string()), ("term", pa.string()), ("places", pa.binary()), ("counts", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()), ("docs", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        held: list[tuple[int | None, int, list[tuple[bytes, int]]]] = []
        postings = 0

        def out() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: (x[0] is None, x[0]))
            lists: dict[bytes, tuple[list, list]] = {}
            for place, (_, _, found) in enumerate(held):
                for t, n in found:
                    places, counts = lists.setdefault(t, ([], []))
                    places.append(place)
                    counts.append(n)
            lengths = np.array([n for _, n, _ in held], "<u4")
            named = [i for i, _, _ in held if i is not None]
            block = uuid.uuid4().hex
            rows = [(block, None, None, None, None, np.array(named, "<i8").tobytes(), len(held), int(lengths.sum(dtype=np.int64)))]
            for t, (places, counts) in lists.items():
                at = np.array(places, "<u2")
                rows.append((block, t.decode(), at.tobytes(), np.array(counts, "<u4").tobytes(), lengths[at].tobytes(), None, len(places), None))
            for lo in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 4096], strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                found = Counter(words if wanted is None else filter(wanted.__contains__, words))
                held.append((doc_id, len(words), list(found.items())))
                postings += len(found)
                if len(held) >= BLOCK or postings >= HELD:
                    yield from out()
                    held, postings = [], 0
        if held:
            yield from out()

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED), "impact-postings")


def impacts(counts: np.ndarray, lengths: np.ndarray, weight: int, n_docs: int, n_words: int) -> np.ndarray:
    """What each posting adds to its document's score."""
    m = LEAST + SLOPE * lengths.astype(np.int64) * n_docs // n_words
    tf = counts.astype(np.int64)
    return weight * (SCALE * tf // (COUNTED * tf + PER_LENGTH * m))


def sliced(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words that hold the places (ascending), and for each bit of the values these words' bitmaps."""
    words, at = np.unique(places >> 6, return_inverse=True)
    bits = int(values.max(initial=0)).bit_length()
    out = np.zeros((bits, len(words)), np.uint64)
    one = np.uint64(1) << (places & 63).astype(np.uint64)
    for b in range(bits):
        hit = np.flatnonzero((values >> b) & 1)
        np.bitwise_or.at(out[b], at[hit], one[hit])
    return words.astype("<u2"), out


def build(docs: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """The index of doc_id, text; vocabulary (term): the only terms that are asked for."""
    spark = docs.sparkSession
    prepare(spark)
    wanted = None
    if vocabulary is not None:
        size = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).first()
        if size.n <= TERMS and size.b <= BYTES:
            wanted = frozenset(r.term.encode() for r in vocabulary.collect())
    rows = packed(docs, wanted)
    total = rows.filter("term is null").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("l")).first()
    postings = rows.filter("term is not null")
    if vocabulary is not None and wanted is None:
        postings = postings.join(vocabulary, "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(total.n) + 2) / (2 * F.sum("docs") + 1))).cast("long")
    weights = postings.groupBy("term").agg(weight.alias("weight"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, planes = [], []
        of = lambda name, i, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        for i, w in enumerate(batch.column("weight").to_pylist()):
            found, out = sliced(of("places", i, "<u2"), impacts(of("counts", i, "<u4"), of("lengths", i, "<u4"), w, total.n, total.l))
            words.append(found.tobytes())
            planes.append(out.astype("<u8").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("block"), batch.column("term"), pa.array(words, pa.binary()), pa.array(planes, pa.binary())], names=["block", "term", "words", "planes"])

    slices = map_arrow(postings.join(weights, "term").select("block", "term", "places", "counts", "lengths", "weight"), run, "block string, term string, words binary, planes binary")
    return Index(rows.filter("term is null").select("block", "ids"), saved(slices, "impact-index"))


# --- searching ----------------------------------------------------------------------------------------------------


def add(total: np.ndarray, rows: np.ndarray, words: np.ndarray, planes: np.ndarray) -> None:
    """total (slices, rows, words) plus a term's planes in some rows and words of it: carries ripple up the slices."""
    carry = None
    cell = np.ix_(rows, words)
    for b in range(len(total)):
        mine = planes[b] if b < len(planes) else None
        if mine is None and (carry is None or not carry.any()):
            return
        have = total[b][cell]
        if mine is None:
            total[b][cell], carry = have ^ carry, have & carry
        elif carry is None:
            total[b][cell], carry = have ^ mine, have & mine
        else:
            half = have ^ mine
            total[b][cell], carry = half ^ carry, (have & mine) | (half & carry)
    if carry is not None and carry.any():
        raise OverflowError("a score beyond its slices")


def best(total: np.ndarray, live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, bitmaps of the documents that are surely among the k best, and of those that are level for the places that
    remain. live: the documents there are, of which those with a score above 0 count."""
    level = np.bitwise_or.reduce(total, axis=0) & live
    sure = np.zeros_like(level)
    for bits in total[::-1]:
        up = level & bits
        n = np.bitwise_count(sure | up).sum(axis=1, dtype=np.int64)[:, None]
        # more than k have the bit: the others are out; fewer: those with it are in, and the others compete for the rest
        sure = np.where(n <= k, sure | up, sure)
        level = np.where(n > k, up, np.where(n < k, level & ~bits, np.uint64(0)))
    return sure, level


def places_of(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(row.astype("<u8").view(np.uint8), bitorder="little"))


def ranked(items: list[tuple[int, list[bytes]]], found: dict[str, tuple[np.ndarray, np.ndarray]], n: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the item, places, scores) of the k best of a block's first n documents, for each item that has any."""
    width = 1 + max((int(w[-1]) for w, _ in found.values()), default=0)
    most = max((len(p) for _, p in found.values()), default=0)
    longest = max((len(t) for _, t in items), default=0)
    total = np.zeros((most + longest.bit_length(), len(items), width), np.uint64)
    asked: dict[str, list[int]] = {}
    for row, (_, own) in enumerate(items):
        for t in own:
            if t in found:
                asked.setdefault(t, []).append(row)
    for t, rows in asked.items():
        words, planes = found[t]
        add(total, np.array(rows), words.astype(np.int64), planes)
    live = np.zeros(width * 64, np.uint8)
    live[:n] = 1
    sure, level = best(total, np.packbits(live, bitorder="little").view("<u8"), k)
    for row in np.flatnonzero((sure | level).any(axis=1)):
        inside = places_of(sure[row])
        at = np.append(inside, places_of(level[row])[: k - len(inside)])
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        scores = sum((((total[b, row, word] >> shift) & np.uint64(1)).astype(np.int64) << b for b in range(len(total))), np.zeros(len(at), np.int64))
        yield int(row), at, scores


def asked(items: DataFrame) -> DataFrame:
    """item (a row's own number), item_id, terms (distinct) of the items that have any; saved."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [sorted({t.decode() for t in terms(x)}) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(own, pa.list_(pa.string()))], names=["item_id", "terms"])

    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = map_arrow(rows, run, "item_id long, terms array<string>").filter("size(terms) > 0")
    return saved(rows.withColumn("item", F.monotonically_increasing_id()), "impact-items")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item (of asked())."""
    spark = items.sparkSession
    batches = -(-items.count() // BATCH)
    blocks = index.blocks.count()
    groups = max(1, min(blocks, max(-(-4 * spark.sparkContext.defaultParallelism // max(1, batches)), -(-blocks // STREAMED))))
    of = F.pmod(F.xxhash64("item"), F.lit(max(1, batches))).cast("int")
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    mine = items.withColumn("batch", of)
    wanted = mine.select("batch", F.explode("terms").alias("term")).distinct()
    none = lambda kind, *names: {n: F.lit(None).cast(kind) for n in names}
    columns = ["batch", "grp", "block", "item", "item_id", "terms", "term", "ids", "words", "planes"]
    # a cell gets its items first (no block), then each block: its ids (no term), then its terms
    first = mine.withColumn("grp", every(groups)).withColumns(none("string", "block", "term") | none("binary", "ids", "words", "planes"))
    then = index.blocks.withColumn("grp", group).withColumn("batch", every(batches)).withColumns(none("string", "term") | none("binary", "words", "planes") | none("long", "item", "item_id") | none("array<string>", "terms"))
    last = index.slices.join(wanted, "term").withColumn("grp", group).withColumns(none("binary", "ids") | none("long", "item", "item_id") | none("array<string>", "terms"))
    cells = first.select(columns).unionByName(then.select(columns)).unionByName(last.select(columns))
    # more partitions than cells, so that few cells share one by chance
    dealt = cells.repartition(4 * max(1, batches) * groups, "batch", "grp").sortWithinPartitions("batch", "grp", "block", "term", "item")
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, block, held, found, ids = None, None, [], {}, np.zeros(0, "<i8")

        def out() -> Iterator[pa.RecordBatch]:
            if block is None or not found:
                return
            rows = [(np.full(len(at), held[row][0]), np.full(len(at), held[row][2]), ids[at], scores, at) for row, at, scores in ranked([(i, t) for i, t, _ in held], found, len(ids), k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            keys = [b.column(c).to_pylist() for c in ("batch", "grp", "block", "term", "item", "item_id", "terms")]
            for i, (batch, grp, name, term, item, item_id, own) in enumerate(zip(*keys, strict=True)):
                if (batch, grp) != cell or name != block:
                    yield from out()
                    if (batch, grp) != cell:
                        held = []
                    cell, block, found, ids = (batch, grp), name, {}, np.zeros(0, "<i8")
                if name is None:
                    held.append((item, own, item_id))
                elif term is None:
                    ids = np.frombuffer(b.column("ids")[i].as_py(), "<i8")
                else:
                    words = np.frombuffer(b.column("words")[i].as_py(), "<u2")
                    found[term] = words, np.frombuffer(b.column("planes")[i].as_py(), "<u8").reshape(-1, len(words))
        yield from out()

    hits = dealt.mapInArrow(run, "item long, item_id long, doc_id long, score long, place int")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "place")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_impact(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    prepare(spark)
    items = asked(table(spark, sf_dir, "benchmark"))
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    return search(build(table(spark, sf_dir, "documents"), vocabulary), items)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM d WHERE len(t) > 0
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM p
), f AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM p) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term
), i AS (
  SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL
), q AS (
  SELECT DISTINCT item_id, text, unnest({_TERMS}) AS term FROM i
), s AS (
  SELECT item_id, q.text, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN p USING (r), c WHERE doc_id IS NOT NULL GROUP BY item_id, q.text, doc_id, r
), o AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""

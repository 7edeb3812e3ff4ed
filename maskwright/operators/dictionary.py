"""Dictionary of many terms against many documents: one pass over each text with an automaton of all terms.

The automaton is made by each worker from the distinct terms. They are sent to all of them if they have MOST characters at most
(measured); beyond that they are dealt to parts of about that size, and every document meets every part: a cell
of part and document group gets its terms first and then streams its documents, so that one automaton is in memory at a time.
Both ways give the same rows: one for each row of documents and row of terms that it holds, whatever repeats or has no id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .automaton import Terms, kept

#: Characters of all terms of an automaton (about 50 bytes each, in every worker).
MOST = 2_000_000


def _rows(batch: pa.RecordBatch, which: list[int], terms: Terms, schema: pa.Schema) -> pa.RecordBatch | None:
    """doc_id, term, starts of what the texts of some rows hold."""
    texts = batch.column("text")
    at, held, starts = [], [], []
    for i in which:
        for term, found in terms.found(texts[i].as_py()).items():
            at.append(i)
            held.append(terms.terms[term])
            starts.append(found)
    if not at:
        return None
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(held, pa.string()), pa.array(starts, pa.list_(pa.int64()))], schema=schema)


def _pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[list[int]]:
    for lo in range(0, batch.num_rows, rows):
        yield list(range(lo, min(batch.num_rows, lo + rows)))


def found(docs: DataFrame, terms: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, term, starts for every document (doc_id, text) and distinct term (text) that it holds."""
    spark = docs.sparkSession
    ship(spark)
    words = terms.filter("text is not null and text <> ''").select(F.col("text").alias("term")).distinct()
    size = words.agg(F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size // most))
    kind = docs.schema["doc_id"].dataType
    ddl = f"doc_id {kind.simpleString()}, term string, starts array<long>"
    texts = docs.filter("text is not null").select("doc_id", "text")

    def schema_of(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([("doc_id", batch.column("doc_id").type), ("term", pa.string()), ("starts", pa.list_(pa.int64()))])

    if parts == 1:
        name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast([r.term for r in words.collect()])  # MOST characters at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = kept(name, sent.value)
                for which in _pieces(b):
                    if (out := _rows(b, which, own, schema_of(b))) is not None:
                        yield out

        return texts.mapInArrow(run, ddl)

    groups = max(1, -(-4 * spark.sparkContext.defaultParallelism // parts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    first = words.select(of(parts, "term").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("doc_id"), F.col("term").alias("text")).withColumn("grp", every(groups))
    # rows are dealt by their place, as an id may be on many of them
    then = texts.withColumn("grp", of(groups, F.monotonically_increasing_id())).select(F.lit(1).alias("kind"), "doc_id", "text", "grp").withColumn("part", every(parts))
    cells = first.select("part", "grp", "kind", "doc_id", "text").unionByName(then.select("part", "grp", "kind", "doc_id", "text"))
    dealt = cells.repartition(parts * groups, "part", "grp").sortWithinPartitions("part", "grp", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, held = None, None, []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("part", "grp", "kind")), strict=True))
            which: list[int] = []
            for i, (part, grp, kind) in enumerate(keys):
                if (part, grp) != at:
                    if which and (out := _rows(b, which, own, schema_of(b))) is not None:
                        yield out
                    at, own, held, which = (part, grp), None, [], []
                if kind == 0:
                    held.append(b.column("text")[i].as_py())
                    continue
                own = own or Terms(held)
                which.append(i)
                if len(which) >= 256:
                    if (out := _rows(b, which, own, schema_of(b))) is not None:
                        yield out
                    which = []
            if which and (out := _rows(b, which, own, schema_of(b))) is not None:
                yield out

    return dealt.mapInArrow(meet, ddl)


def hits(docs: DataFrame, terms: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, item_id, n_hits, starts for every document (doc_id, text) that holds a term (item_id, text)."""
    given = terms.filter("text is not null and text <> ''").select("item_id", F.col("text").alias("term"))
    return found(docs, terms, most).join(given, "term").select("doc_id", "item_id", F.size("starts").cast("long").alias("n_hits"), "starts")

"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets.

Sets. A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+` of the whole text; a document's set holds the 64-bit hashes of its
distinct `width`-word shingles (of the whole sequence if it has fewer words). Documents with equal sets form one node.

Candidates. `permutations` multiplicative permutations are applied to a set once each; both the smallest and the largest
value stay (min-max hashing: two signature values for one hash evaluation, without bias and with less variance). The
2 * permutations values make bands of `rows`; nodes that agree on a band are candidates. With 64 permutations and bands
of 4 there are 32 bands: a pair of similarity 0.8 shares none with probability (1 - 0.8^4)^32 < 5e-8.

Confirmation. Nodes that are joined by candidate edges (each node to its band's smallest node, so linear in rows) form
groups. A group of bounded weight is one task; there, a node meets, band by band, every earlier node that is not yet in
its component, and pairs are confirmed on the full sets. A heavier group is split into chunks:
  1. every chunk is searched as above, with `PIVOTS` nodes of the group added to each, which joins what is dense;
  2. nodes outside the group's largest component are sent to all its chunks, where they meet every candidate of
     another component. Two nodes that were never compared are then both in the largest component.
So no linked pair that shares a band is lost, and no group meets all its pairs in one task. A task knows the components of
its nodes when it is done: it gives each node's label, and only split groups need a search for components over all labels.

Rows are told apart by doc_id and a 64-bit hash of the text, so that rows without ids, or with equal ones, meet only their own
texts.

Defined cases. Null or empty text: empty set, linked with nothing, kept. Null doc_id: may link, is the smallest of a
component only if all its ids are null. Repeated rows (same doc_id and text): both get the same result; the pipeline stage
keeps one. Equal doc_ids with different texts are different nodes. Empty tables give an empty result; other columns are
ignored, and kept by the stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import U64, discard, grouped, map_arrow, mix64, pieces, prepare, random_odd, saved, table, utf8
from .graph import components

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
BYTE = mix64(np.arange(1, 257, dtype=U64))
PIVOTS = 8
#: Shingles of one task's group or chunk (8 bytes each).
CHUNK = 2_000_000


def text_hash() -> Column:
    return F.xxhash64("text").alias("th")


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word and the number of words in each row. A word's hash is a mix of the sum of a mixed
    value for each byte and its place in the word."""
    word = ~BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = off[:-1][(off[:-1] < off[1:])]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    per_row = np.diff(np.searchsorted(starts, off))
    if not len(starts):
        return np.zeros(0, U64), per_row
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    x = BYTE[FOLD[data]] + place.astype(U64) * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    x[~word] = 0
    return mix64(np.add.reduceat(x, starts)), per_row


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, per_row = word_hashes(data, off)
    odd = random_odd(11, width)
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, U64)
    for k in range(width):
        h += words[k : k + n] * odd[k]
    h = mix64(h)
    out, at = [], 0
    for m in per_row.tolist():
        if m >= width:
            out.append(np.unique(h[at : at + m - width + 1]))
        elif m:
            short = np.append(words[at : at + m] * odd[:m], random_odd(m, 1))
            out.append(mix64(short.sum(dtype=U64, keepdims=True)))
        else:
            out.append(np.zeros(0, U64))
        at += m
    return out


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Min and max of each set under each permutation: (sets, 2 * permutations), min and max next to each other. The sets
    must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * permutations), U64)
    for p, a in enumerate(random_odd(5, permutations)):
        v = flat * a
        out[:, 2 * p] = np.minimum.reduceat(v, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, starts)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    n, width = signature.shape
    odd = random_odd(23, rows)
    keys = (signature[:, : width // rows * rows].reshape(n, width // rows, rows) * odd).sum(axis=2, dtype=U64)
    return mix64(keys + np.arange(1, width // rows + 1, dtype=U64) * U64(0xA0761D6478BD642F))


def digest(s: np.ndarray) -> bytes | None:
    """Names a set; equal sets have equal names. None for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketch(docs: DataFrame, width: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, th (hash of the text), node (name of the set), n_shingles, bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = utf8(batch.column("text"))
        nodes, sizes, keys = [], [], []
        for lo, hi in pieces(off, 1 << 20):
            sets = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
            full = [s for s in sets if len(s)]
            made = iter(bands(signatures(full, permutations), rows).view(np.int64) if full else ())
            for s in sets:
                nodes.append(digest(s))
                sizes.append(len(s))
                keys.append(next(made) if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "node", "n_shingles", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text_hash(), "text"), run, f"doc_id {kind}, th long, node binary, n_shingles long, bands array<long>")


class Search:
    """Nodes of one task: components, and for each band key its nodes by component."""

    def __init__(self, percent: int) -> None:
        self.percent, self.up, self.sets, self.post = percent, {}, {}, {}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def linked(self, a, b) -> bool:
        x, y = self.sets[a], self.sets[b]
        if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def add(self, x, s: np.ndarray, label=None) -> None:
        self.up[x], self.sets[x] = x, s
        if label is not None:
            self.up.setdefault(label, label)
            self.join(x, label)

    def meet(self, x, keys: list[int]) -> Iterator:
        """Confirmed partners of x among indexed nodes of other components; x joins each."""
        tested = set()
        for key in keys:
            places = self.post.get(key)
            if not places:
                continue
            for r in list(places):
                if (now := self.root(r)) != r:  # components grew together since
                    places.setdefault(now, []).extend(places.pop(r))
            for r in list(places):
                if self.root(r) == self.root(x):
                    continue
                for y in places[r]:
                    if y not in tested:
                        tested.add(y)
                        if self.linked(x, y):
                            self.join(x, y)
                            yield y
                            break

    def index(self, x, keys: list[int]) -> None:
        for key in keys:
            self.post.setdefault(key, {}).setdefault(self.root(x), []).append(x)


def within(percent: int):
    """For grouped(): each node's label, the smallest node of its component within the group (nodes that are their own label
    are left out)."""

    def run(key: tuple, rows: list[dict]) -> Iterator[dict]:
        search = Search(percent)
        for r in rows:
            x = r["node"]
            if x in search.up:  # a pivot that is at home here
                continue
            search.add(x, np.frombuffer(r["shingles"], U64))
            for _ in search.meet(x, r["bands"]):
                pass
            search.index(x, r["bands"])
        for x in search.up:
            if (label := search.root(x)) != x:
                yield {"a": x, "b": label}

    return run


def across(percent: int):
    """For grouped(): links between stragglers (first in each group) and the chunk's nodes of other components."""

    def run(key: tuple, rows: list[dict]) -> Iterator[dict]:
        search = Search(percent)
        for r in rows:
            x = (r["straggler"], r["node"])
            if x in search.up:
                continue
            # labels stand beside the nodes, and sort before them, so that they stay roots
            search.add(x, np.frombuffer(r["shingles"], U64), (-1, r["label"]))
            if r["straggler"] == 0:
                search.index(x, r["bands"])
            else:
                for y in search.meet(x, r["bands"]):
                    yield {"a": x[1], "b": y[1]}

    return run


def labels(docs: DataFrame, nodes: DataFrame, width: int, percent: int, chunk: int) -> DataFrame:
    """node, label: the smallest node of the component, for nodes that are not their own label. nodes: node, doc_id and th (of
    one row that has it), n_shingles, bands."""
    # on 64-bit names: a clash would only make a candidate group larger
    named = nodes.select("node", "doc_id", "th", "n_shingles", "bands", F.xxhash64("node").alias("id"))
    keys = named.select("id", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("other")).filter("hub <> other").select("key", "hub")
    candidate = keys.join(hubs, "key").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    group = components(candidate)
    members = saved(named.join(group, "id").withColumnRenamed("component", "grp"), "dedup-members")

    weight = members.groupBy("grp").agg((F.floor(F.sum("n_shingles") / F.lit(chunk)) + 1).cast("int").alias("chunks"))
    placed = members.join(weight, "grp").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), "chunks").cast("int"))

    columns = ["node", "bands", "grp", "chunks", "chunk"]
    wanted = placed.select(F.col("doc_id").alias("want"), F.col("th").alias("want_th"), *columns)
    texts = docs.select("doc_id", "text", text_hash())
    texts = texts.join(wanted, (texts["th"] == F.col("want_th")) & texts["doc_id"].eqNullSafe(F.col("want"))).select("text", *columns)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            names = batch.column("node").to_pylist()
            fresh = [n != m for n, m in zip(names, [before, *names], strict=False)]  # repeated rows come one after the other
            before = names[-1] if names else before
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            if not batch.num_rows:
                continue
            data, off = utf8(batch.column("text"))
            made: list = []
            for lo, hi in pieces(off, 1 << 20):
                made += shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([s.tobytes() for s in made], pa.binary())], names=[*columns, "shingles"])

    sets = saved(texts.mapInArrow(full, "node binary, bands array<long>, grp long, chunks int, chunk int, shingles binary"), "dedup-sets")
    discard(members)
    ab = "a binary, b binary"
    found = saved(grouped(sets.filter("chunks = 1"), ["grp"], ["node"], within(percent), ab), "dedup-labels")
    large = sets.filter("chunks > 1")
    if large.isEmpty():
        discard(sets)
        return found.toDF("node", "label")

    slot = F.pmod(F.xxhash64("node", F.lit("slot")), F.lit(PIVOTS))
    pivots = large.groupBy("grp", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit("pivot")).alias("h"), "node")).alias("m")).select("grp", F.col("m.node").alias("node")).distinct()
    lists = [c for c in sets.columns if c != "chunk"]
    sent = large.join(pivots, ["grp", "node"]).dropDuplicates(["node"]).select(*lists, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    first = saved(grouped(large.unionByName(sent), ["grp", "chunk"], ["node"], within(percent), ab), "dedup-links")

    label = components(first).withColumnsRenamed({"id": "node", "component": "label"})
    known = large.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    count = known.groupBy("grp", "label").agg(F.count("*").alias("n"))
    giant = count.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("m")).select("grp", F.col("m.label").alias("giant"))
    known = saved(known.join(giant, "grp").withColumn("straggler", (F.col("label") != F.col("giant")).cast("int")), "dedup-known")
    blocks = known.filter("straggler = 1").groupBy("grp").agg((F.floor(F.sum(F.length("shingles")) / F.lit(8 * chunk)) + 1).cast("int").alias("blocks"))
    joined = known.join(blocks, "grp")  # groups without stragglers are done
    block = F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int")
    home = joined.withColumn("straggler", F.lit(0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = joined.filter("straggler = 1").withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    order = ["straggler", "node"]
    second = grouped(home.unionByName(sent).select("grp", "chunk", "block", "straggler", "node", "label", "bands", "shingles"), ["grp", "chunk", "block"], order, across(percent), ab)
    second = saved(second, "dedup-links")
    discard(sets, known)
    label = components(first.unionByName(second)).filter("id <> component")
    return found.unionByName(label.select(F.col("id").alias("a"), F.col("component").alias("b"))).toDF("node", "label")


def resolve(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = 64, rows: int = 4, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, th, node, n_shingles), a row for each document; (node, label, component_id, doc_id, th), a row for
    each distinct non-empty set, with the smallest doc_id of its component and its own smallest doc_id, of whose rows th names
    one."""
    prepare(docs.sparkSession)
    sketched = saved(sketch(docs, width, permutations, rows), "dedup-sketch")
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th")))
    one = F.coalesce(named, F.struct(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.min("th").alias("th")))
    nodes = sketched.filter("node is not null").groupBy("node").agg(one.alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = saved(nodes.select("node", "one.doc_id", "one.th", "n_shingles", "bands"), "dedup-nodes")
    label = labels(docs, nodes, width, percent, chunk)
    labelled = nodes.select("node", "doc_id", "th").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = saved(labelled.join(smallest, "label").select("node", "label", "component_id", "doc_id", "th"), "dedup-components")
    discard(nodes)
    return sketched.select("doc_id", "th", "node", "n_shingles"), out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, **more: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    rows, nodes = resolve(docs, width, percent, **more)
    out = rows.join(nodes.select("node", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, on 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


#: Shingles as strings of words; the characters between words are one blank each.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * k >= 80 * (n + m - k)
), d AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, d.b FROM r JOIN d ON r.reached = d.a
), c AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id
"""


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates (five words, 0.8), and all without words; the kept
    one has the smallest doc_id. Columns unchanged."""
    listed, nodes = resolve(docs)
    columns = docs.columns
    names = {c: f"k{i}" for i, c in enumerate(columns)} | {"text": "text"}  # so that no column's name clashes
    doc_id = names["doc_id"]
    rows = docs.toDF(*names.values()).withColumn("th", text_hash())
    # of a component's nodes with its smallest id, the one with the smallest name
    kept = nodes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min(F.struct("node", "doc_id", "th")).alias("m")).select(F.col("m.doc_id").alias("keep_id"), F.col("m.th").alias("keep_th"))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = rows.filter(words).join(kept, (F.col("th") == F.col("keep_th")) & F.col(doc_id).eqNullSafe(F.col("keep_id")), "left_semi")
    if not listed.filter("node is not null").groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        # repeated rows of a kept document: the first by its other columns
        order = [F.col(names[c]) for c in columns if c not in ("text", "doc_id")] or [F.lit(0)]
        nth = F.row_number().over(Window.partitionBy("th", doc_id).orderBy(*order))
        found = found.withColumn("nth", nth).filter("nth = 1").drop("nth")
    return found.unionByName(rows.filter(~words)).select(*names.values()).toDF(*columns)

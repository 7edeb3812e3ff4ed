"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into 1, 4, 16, ... equal segments (coarse to fine). With the segment means m and deviations s (of the
components about m) of a query q and a candidate c over a segment of n components,

    <q, c>  <=  sum over segments of  n * m_q * m_c + |q - m_q| * |c - m_c|,

as the mean part and the rest are orthogonal (Cauchy and Schwarz on the rest). With |q|^2 and |c|^2 this is the lower bound
of the squared distance |q|^2 + |c|^2 - 2 <q, c>; ranking by it within a query only adds candidates of other norms, so the
bound is used on the inner product itself. Candidates whose bound is below the query's k-th score so far are dropped, level
by level, and survivors get their exact integer score.

Layout. Candidates and queries are packed into blocks (`candidate_rows` and `query_rows` vectors), and blocks are dealt to the
cells of a grid of query groups and candidate groups, whose size follows from the numbers of blocks: a cell holds at most
about `HELD` query blocks, so that its memory is bounded, and there are some cells for each core. A task holds its
query blocks and streams its candidate blocks, with their statistics made once; each (query, cell) returns k rows, of which
the k best are chosen. All pairs of blocks are bounded below or scored: queries against all rows is what is asked.

What the bounds save depends on the vectors. Where they lie in clusters, coarse levels drop most pairs. Where all directions
are alike (a Gaussian cloud), only segments of two tell pairs apart, and computing them costs about what the scores do; `Best.examined`
counts the pairs that were scored.

Defined cases. Vectors that are null, empty, or hold null or non-finite components take no part, neither do rows without
id. Vectors of another length than the query's are no candidates. Candidates with the query's id are left out. Equal scores:
smaller ids first. Repeated rows: each is a candidate; a query repeated with the same vector counts once, and one id with
several vectors is several queries, each with ranks of its own. Scores are 64-bit integers, which wrap as a long does; bounds
are doubles, so where sums pass 2^53 candidates may be lost. Any long is an id. Empty table: empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import prepare, saved, table

#: Rounding of the bounds, which are sums of doubles: relative to the norms.
SLACK = 1e-9
#: Query blocks of a cell, and pairs of blocks that are one task's work.
HELD, PAIRS = 16, 1024


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine, for a dimension that is divisible by four: 1, 4, 16, ... while they divide it, and at
    last segments of two."""
    out, n = [], 1
    while n * 4 <= dim and dim % n == 0:
        out.append(n)
        n *= 4
    return [*out, dim // 2] if dim > 2 else [1]


def statistics(v: np.ndarray) -> list[np.ndarray]:
    """For each level, rows whose inner products are the bounds: sqrt(n) * means, then norms of the deviations. Zeros are added up to a
    dimension divisible by four; they change no inner product."""
    out = []
    v = np.pad(v.astype(np.float64), ((0, 0), (0, -v.shape[1] % 4)))
    for n in levels(v.shape[1]):
        cut = v.reshape(len(v), n, -1)
        mean = cut.mean(axis=2)
        rest = np.sqrt(np.maximum(((cut - mean[:, :, None]) ** 2).sum(axis=2), 0))
        out.append(np.hstack([mean * np.sqrt(cut.shape[2]), rest]))
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows."""
    return np.einsum("ij,ij->i", q, c)


class Best:
    """The k best candidates of each query of a block: scores descending, ids ascending among equals."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = [np.zeros(0, np.int64) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]
        self.least = np.full(len(ids), -np.inf)
        self.stats = statistics(vectors)
        self.norm = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.examined = 0

    def see(self, ids: np.ndarray, vectors: np.ndarray, stats: list[np.ndarray]) -> None:
        norm = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        slack = SLACK * (np.outer(self.norm, norm) + 1)
        alive = self.ids[:, None] != ids[None, :]
        # the first candidates fill the lists, so that there is something to compare with
        if np.isinf(self.least).any():
            head = min(len(ids), 4 * self.k)
            self.score(np.nonzero(alive[:, :head]), ids, vectors)
            alive[:, :head] = False
        for q, c in zip(self.stats, stats, strict=True):
            # equal scores may still win by a smaller id
            alive &= q @ c.T + slack >= self.least[:, None]
            if not alive.any():
                return
        self.score(np.nonzero(alive), ids, vectors)

    def score(self, pairs: tuple[np.ndarray, np.ndarray], ids: np.ndarray, vectors: np.ndarray, step: int = 1 << 16) -> None:
        rows, cols = pairs
        if not len(rows):
            return
        self.examined += len(rows)
        scores = np.concatenate([exact(self.vectors[rows[i : i + step]], vectors[cols[i : i + step]]) for i in range(0, len(rows), step)])
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            r = rows[a]
            s, i = np.append(self.scores[r], scores[a:b]), np.append(self.found[r], ids[cols[a:b]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[r], self.found[r] = s[order], i[order]
            if len(order) == self.k:
                self.least[r] = self.scores[r][-1]


def packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """dim, block (a random name), ids and values (little-endian 64-bit integers) of up to `rows` vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, values = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": [uuid.uuid4().bytes], "ids": [np.array(ids, np.int64).tobytes()], "values": [np.array(values, np.int64).tobytes()]})

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                ids, values = held.setdefault(len(v), ([], []))
                ids.append(i)
                values.append(v)
                if len(ids) >= rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return saved(vectors.mapInArrow(run, "dim int, block binary, ids binary, values binary"), name)


def grid(query_blocks: int, candidate_blocks: int, cores: int) -> tuple[int, int]:
    """Numbers of query and candidate groups."""
    cells = max(4 * cores, -(-query_blocks * candidate_blocks // PAIRS))
    query_groups = max(1, -(-query_blocks // HELD))
    return query_groups, max(1, min(candidate_blocks, -(-cells // query_groups)))


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, query_rows: int = 512, candidate_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score from (id long, v array<long>) tables of whole vectors."""
    spark = queries.sparkSession
    prepare(spark)
    q = packed(queries.dropDuplicates(["id", "v"]), query_rows, "topk-queries")
    c = packed(candidates, candidate_rows, "topk-candidates")
    q_groups, c_groups = grid(q.count(), c.count(), spark.sparkContext.defaultParallelism)
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = q.withColumns({"qg": own(q_groups), "kind": F.lit(0)}).withColumn("cg", every(c_groups))
    met = c.withColumns({"cg": own(c_groups), "kind": F.lit(1)}).withColumn("qg", every(q_groups))
    cell = ["dim", "qg", "cg"]
    dealt = sent.unionByName(met).repartition(q_groups * c_groups, *cell).sortWithinPartitions(*cell, "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for block, best in held:
                n = [len(s) for s in best.scores]
                if sum(n):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block] * sum(n), pa.binary()), "row": np.repeat(np.arange(len(n), dtype=np.int32), n), "query_id": np.repeat(best.ids, n), "vec_id": np.concatenate(best.found), "score": np.concatenate(best.scores)})

        for b in batches:
            for row in range(b.num_rows):
                key = tuple(b.column(x)[row].as_py() for x in cell)
                of = lambda name: np.frombuffer(b.column(name)[row].as_buffer(), np.int64)  # noqa: B023, E731
                if key != at:
                    yield from out()
                    at, held = key, []
                if b.column("kind")[row].as_py() == 0:
                    held.append((b.column("block")[row].as_py(), Best(of("ids").copy(), of("values").reshape(-1, key[0]).copy(), k)))
                elif held:
                    vectors = of("values").reshape(-1, key[0])
                    stats = statistics(vectors)
                    for _, best in held:
                        best.see(of("ids"), vectors, stats)
        yield from out()

    found = dealt.select(*cell, "kind", "block", "ids", "values").mapInArrow(run, "block binary, row int, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """id, v: vectors of floor(scale * component), without those that take no part."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != F.lit(float("inf"))))
    return embeddings.filter(good).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"))


def op7_topk(spark, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector with all others."""
    vectors = whole(table(spark, sf_dir, "embeddings"))
    return search(vectors.filter("id % 50 = 0"), vectors)


OP7_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT DISTINCT vec_id, v FROM good WHERE vec_id % 50 = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

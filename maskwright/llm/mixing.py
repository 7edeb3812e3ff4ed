"""Mixing sources to target weights, over packed blocks.

Each source's words, document after document, are packed into blocks of `length` words. The mix is a row of output shards
of `slots` blocks. Each shard draws its source counts from a multinomial; a source's draws are numbered through all shards,
and draw k takes block permutation(k mod blocks), where each pass over the source (k div blocks) has a pseudorandom
permutation of its own (a keyed Feistel network), so no index list is stored. Blocks are joined to slots by index.

Multinomial totals scatter about the quotas, so draws beyond a source's quota are handed, in order, to the sources that fell
short. With this each source meets its target to the word (its last block is cut), and as a target is at most twice the
size, each block is drawn at most twice, and no document is taken beyond twice its size.

What the driver holds: a row for each source (name, size, quota), and nothing that grows with documents or blocks. Running
totals are made in three steps (within buckets, over the buckets of a shelf, over shelves), so a hot source is spread over
many tasks. Rows that are alike get buckets of their own.

Defined cases. Null text or no words: size 0, taken 0, not in the mixed texts. Null source: a source of its own, the last.
Null doc_id, repeated rows and equal doc_ids: each row is placed and taken by itself. Empty table: empty. Other columns are
kept by mixed_texts().
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import U64, map_arrow, mix64, prepare, saved, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating, and the mix's size in percent of all words.
WEIGHTS, PERCENT, MOST = (5, 2, 1), 150, 2
#: Rows of one bucket of a running total, and buckets of one shelf.
BUCKET, SHELF = 256, 4096


class Source(NamedTuple):
    index: int
    name: str | None
    size: int
    target: float
    blocks: int
    draws: int
    last: int  # words of the last draw


class Permutation:
    """A keyed bijection of range(n): four Feistel rounds over the next even power of two, walked until it is in range."""

    def __init__(self, n: int, key: int) -> None:
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [int(k) for k in mix64(np.arange(1, 5, dtype=U64) + U64(key & (2**63 - 1)) * U64(8))]

    def _round(self, x: np.ndarray, key: int) -> np.ndarray:
        return mix64(x ^ U64(key)) & U64((1 << self.half) - 1)

    def _walk(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        x = np.array(x, U64)
        going = np.ones(len(x), bool)
        mask, half = U64((1 << self.half) - 1), U64(self.half)
        while going.any():
            left, right = x[going] >> half, x[going] & mask
            for k in keys:
                left, right = (right ^ self._round(left, k), left) if back else (right, left ^ self._round(right, k))
            x[going] = (left << half) | right
            going = x >= U64(self.n)
        return x.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, self.keys[::-1], True)


def permutation(source: int, turn: int, blocks: int, seed: int) -> Permutation:
    return Permutation(blocks, seed * 1_000_003 + source * 64 + turn)


def water_fill(sizes: list[int], weights: list[int], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight, none above most * size; what is over goes to the others by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        per = left / sum(weights[i] for i in free)
        full = [i for i in sorted(free) if per * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.discard(i)
    return out


def plan(sizes: dict[str | None, int], length: int, seed: int) -> list[Source]:
    """Targets, draws and the words of the last draw of each source, in order."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]
    targets = water_fill([sizes[n] for n in names], weights, sum(sizes.values()) * PERCENT / 100)
    out = []
    for i, (name, target) in enumerate(zip(names, targets, strict=True)):
        size, want = sizes[name], int(target + 0.5)
        blocks = -(-size // length)
        draws = last = 0
        if want:
            short = blocks * length - size  # words that the source's last block lacks
            turn, rest = divmod(want, size)
            draws = turn * blocks
            if rest:
                where = int(permutation(i, turn, blocks, seed).inverse([blocks - 1])[0])
                words = lambda r: r * length - short * (where < r)
                r = -(-rest // length)
                r += words(r) < rest
                last = rest - words(r - 1)
                draws += r
            else:
                at = int(permutation(i, turn - 1, blocks, seed)([blocks - 1])[0])
                last = length - short if at == blocks - 1 else length
        out.append(Source(i, name, size, target, blocks, draws, last))
    return out


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before, within group. Rows are ordered by bucket, then order. A
    bucket is one task's work, so are the totals of a shelf of buckets, and the totals of all shelves of a group."""
    back = lambda *by: Window.partitionBy(*group, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    total = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum")).withColumn("__shelf", F.floor(F.col(bucket) / SHELF))
    shelves = total.groupBy(*group, "__shelf").agg(F.sum("__sum").alias("__all")).withColumn("__below", F.coalesce(F.sum("__all").over(back("__shelf")), F.lit(0))).drop("__all")
    total = total.withColumn("__before", F.coalesce(F.sum("__sum").over(back("__shelf", bucket)), F.lit(0)))
    base = total.join(shelves, [*group, "__shelf"]).select(*group, bucket, (F.col("__before") + F.col("__below")).alias("__base"))
    inside = F.sum(value).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.coalesce(inside, F.lit(0))).join(base, [*group, bucket]).withColumn(name, F.col(name) + F.col("__base")).drop("__base")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_repeats(sized: DataFrame) -> DataFrame:
    """sized (with __row, __part) and __nth, the number of a row among those that share doc_id and __h: such rows are alike, so it does not
    matter which is which, but each has a bucket of its own. Numbers are made within partitions, and partitions are summed
    over, so a row that makes up a third of the table is no single task's work."""
    key = ["doc_id", "__h"]
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["__h"] == b["__h"])
    per = saved(sized.groupBy(*key, "__part").agg(F.count("*").alias("__n")), "mix-repeats")
    often = per.groupBy(*key).agg(F.sum("__n").alias("__all")).filter("__all > 1").drop("__all")
    if often.isEmpty():
        return sized.withColumn("__nth", F.lit(0).cast("long"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = per.join(often, same(per, often), "left_semi").withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    light = sized.select(*key, "__part", "__row")
    inside = F.row_number().over(Window.partitionBy(*key, "__part").orderBy("__row"))
    numbers = light.join(base, same(light, base) & (light["__part"] == base["__part"])).select(light["doc_id"], light["__h"], light["__part"], light["__row"], "__base").withColumn("__nth", F.col("__base") + inside - 1).select("__row", "__nth")
    return sized.join(numbers, "__row", "left").withColumn("__nth", F.coalesce("__nth", F.lit(0)).cast("long"))


def placed(docs: DataFrame, length: int, seed: int, texts: bool) -> tuple[DataFrame, list[Source]]:
    """docs with __size, __source (index) and __start (its first word within the source), saved, without text if that is
    not wanted; and the plan."""
    spark = docs.sparkSession
    sized = docs.withColumns({"__size": n_words(F.col("text")), "__h": F.xxhash64("doc_id", "text")})
    sized = sized.withColumns({"__row": F.monotonically_increasing_id(), "__part": F.spark_partition_id()})
    sized = numbered_repeats(saved(sized if texts else sized.drop("text"), "mix-sizes")).drop("__row", "__part")
    sums = sized.groupBy("source").agg(F.sum("__size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    sources = plan({r.source: r.size for r in sums}, length, seed)
    buckets = max([1, *(-(-r.n // BUCKET) for r in sums)])
    index = spark.createDataFrame([(s.index, s.name) for s in sources], "__source int, __name string")
    rows = sized.join(F.broadcast(index), F.col("source").eqNullSafe(F.col("__name"))).drop("__name").withColumn("__bucket", F.pmod(F.when(F.col("__nth") == 0, F.col("__h")).otherwise(F.xxhash64("__h", "__nth")), F.lit(buckets)))
    placed = running(rows, ["__source"], "__bucket", ["doc_id", "__h", "__nth"], "__size", "__start")
    return saved(placed.drop("__bucket", "__h", "__nth"), "mix-placed"), sources


def shard_counts(spark: SparkSession, sources: list[Source], slots: int, seed: int) -> DataFrame:
    """shard, __source, n: a multinomial draw for each shard."""
    draws = np.array([s.draws for s in sources], np.int64)
    total = int(draws.sum())
    p = draws / max(total, 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shards, owner, n = [], [], []
        for shard in batch.column("id").to_pylist():
            size = min(slots, total - shard * slots)
            got = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(size, p)
            some = np.flatnonzero(got)
            shards += [shard] * len(some)
            owner += some.tolist()
            n += got[some].tolist()
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(owner, pa.int32()), pa.array(n, pa.int64())], names=["shard", "__source", "n"])

    return map_arrow(spark.range(-(-total // slots)), run, "shard long, __source int, n long")


def slot_table(spark: SparkSession, sources: list[Source], length: int, slots: int, seed: int) -> DataFrame:
    """shard, slot, __source, turn (pass over the source), block, words (taken from the block's beginning)."""
    if not any(s.draws for s in sources):
        return spark.createDataFrame([], "shard long, slot int, __source int, turn int, block long, words int")
    counts = saved(shard_counts(spark, sources, slots, seed), "mix-counts")
    drawn = {r[0]: r[1] for r in counts.groupBy("__source").agg(F.sum("n")).collect()}  # a row for each source
    quota = np.array([s.draws for s in sources], np.int64)
    got = np.array([drawn.get(s.index, 0) for s in sources], np.int64)
    over, under = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
    over_from, under_from = np.cumsum(over) - over, np.cumsum(under) - under
    shards = running(counts.withColumn("__bucket", F.floor(F.col("shard") / BUCKET)), ["__source"], "__bucket", ["shard"], "n", "first")
    lists = shards.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("__source", "first", "n"))).alias("draws"))
    # a shard is a short row that becomes `slots` rows: their number, not the bytes read, says how many tasks there should be
    made = -(-int(quota.sum()) // slots)
    lists = lists.repartition(max(1, min(made, max(spark.sparkContext.defaultParallelism, made // 16))), "shard")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("shard", "slot", "__source", "turn", "block", "words")}
        for shard, draws in zip(batch.column("shard").to_pylist(), batch.column("draws").to_pylist(), strict=True):
            own = np.concatenate([np.full(d["n"], d["__source"]) for d in draws])
            k = np.concatenate([np.arange(d["first"], d["first"] + d["n"]) for d in draws])
            late = k >= quota[own]
            if late.any():  # beyond the quota: the rank among all such draws names a source that fell short
                rank = over_from[own[late]] + k[late] - quota[own[late]]
                to = np.searchsorted(under_from + under, rank, side="right")
                k[late] = got[to] + rank - under_from[to]
                own[late] = to
            turn, block, words = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for i in np.unique(own):
                s = sources[i]
                mine = own == i
                turn[mine] = k[mine] // s.blocks
                for t in np.unique(turn[mine]):
                    here = mine & (turn == t)
                    block[here] = permutation(s.index, int(t), s.blocks, seed)(k[here] % s.blocks)
                words[mine] = np.minimum(length, s.size - block[mine] * length)
                words[mine & (k == s.draws - 1)] = s.last
            order = np.random.Generator(np.random.Philox(key=[seed + 1, shard])).permutation(len(k))
            for name, values in (("shard", np.full(len(k), shard)), ("slot", np.arange(len(k))), ("__source", own[order]), ("turn", turn[order]), ("block", block[order]), ("words", words[order])):
                out[name].append(values)
        types = {"shard": pa.int64(), "slot": pa.int32(), "__source": pa.int32(), "turn": pa.int32(), "block": pa.int64(), "words": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), types[k]) for k, v in out.items()], names=list(out))

    return map_arrow(lists, run, "shard long, slot int, __source int, turn int, block long, words int")


def parts(rows: DataFrame, slots: DataFrame, length: int) -> DataFrame:
    """__source, __start of a document, turn, skip, take: in that turn, `take` words after its first `skip` are in the mix."""
    end = F.col("__start") + F.col("__size")
    blocks = rows.filter("__size > 0").select("__source", "__start", "__size", F.explode(F.sequence(F.floor(F.col("__start") / length), F.floor((end - 1) / length))).alias("block"))
    low = F.greatest(F.col("__start"), F.col("block") * length)
    high = F.least(end, F.col("block") * length + F.col("words"))
    # a merge join: slots are made from a few counts, so their size is underestimated before they are written
    joined = blocks.join(slots.select("__source", "turn", "block", "words").hint("merge"), ["__source", "block"])
    return joined.select("__source", "__start", "turn", (low - F.col("__start")).alias("skip"), (high - low).alias("take")).filter("take > 0")


def mix(docs: DataFrame, length: int = 256, slots: int = 1024, seed: int = 17, texts: bool = False) -> tuple[DataFrame, DataFrame, list[Source]]:
    """The placed documents, their parts in the mix, and the plan."""
    prepare(docs.sparkSession)
    rows, sources = placed(docs, length, seed, texts)
    return rows, parts(rows, slot_table(docs.sparkSession, sources, length, slots, seed), length), sources


def taken(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    rows, found, sources = mix(docs.select("doc_id", "text", "source"), **settings)
    sums = found.groupBy("__source", "__start").agg(F.sum("take").alias("taken"))
    per = docs.sparkSession.createDataFrame([(s.index, s.size, s.target) for s in sources], "__source int, source_size long, target double")
    # an empty document starts where its successor does, and takes nothing
    out = rows.join(sums, ["__source", "__start"], "left").select("doc_id", "__source", F.col("__size").alias("size"), F.when(F.col("__size") > 0, F.col("taken")).alias("taken"))
    return out.join(F.broadcast(per), "__source").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of text in ranges (first, count), with the white space between neighbours kept and one space elsewhere."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    out: list[list[int]] = []
    for first, count in sorted(ranges):
        if out and out[-1][1] == first:
            out[-1][1] += count
        else:
            out.append([first, first + count])
    if out == [[0, len(spans)]]:
        return text
    return " ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in out)


def mixed_texts(docs: DataFrame, **settings: int) -> DataFrame:
    """docs as the mix takes them: a row for each document and turn in which some of its words are taken, with these words
    as text; n_chars, if there, follows."""
    names = {c: f"k{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    rows, found, _ = mix(docs.select("doc_id", "text", "source", *(F.col(c).alias(k) for c, k in names.items())), texts=True, **settings)
    per = found.groupBy("__source", "__start", "turn").agg(F.collect_list(F.struct("skip", "take")).alias("ranges"))
    joined = rows.filter("__size > 0").drop("__size").join(per, ["__source", "__start"]).drop("__source", "__start", "turn")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [cut(t, [(r["skip"], r["take"]) for r in ranges]) for t, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
        return batch.set_column(batch.schema.get_field_index("text"), pa.field("text", pa.string()), pa.array(texts, pa.string())).drop_columns(["ranges"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name != "ranges")
    out = map_arrow(joined, run, schema).select(*(names.get(c, c) for c in docs.columns)).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return taken(table(spark, sf_dir, "documents"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' words in the mix, a row for each document and turn."""
    return mixed_texts(docs)

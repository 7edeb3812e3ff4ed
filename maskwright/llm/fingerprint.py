"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up. At each level, runs of one symbol become one symbol; then deterministic coin tossing labels
each symbol by the lowest bit in which it differs from its left neighbour, four times over, which leaves labels below 6
that differ from neighbour to neighbour; phrases begin at the labels' local maxima, and each phrase's name (a hash of its
symbols) is a symbol of the next level, until one is left. Where a phrase begins depends on a few symbols around it alone,
so equal substrings get equal phrases inside, at whatever offset they stand.

The fingerprint is a min-hash signature (64 slots of 16 bits, in hex) of the names of all phrases from level `LEAST` on and
of the topmost name; likeness is the share of equal slots, which estimates the Jaccard similarity of the phrase sets.

Defined cases. Null text: as empty. Empty text: fingerprint of no phrases (`""`), like another empty one (1), unlike all
else (0). Null doc_id: after all others in descending order. Equal doc_ids: by text, descending by hash. A
single row: it is its own next document. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import U64, mix64, map_arrow, prepare, random_odd, saved, table

SLOTS = 64
LEAST = 2
#: Code points parsed at a time; a longer text is parsed alone.
PIECE = 1 << 20
ODD = random_odd(31, 64)
SLOT = random_odd(47, SLOTS)


def coin_toss(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: 2 * (lowest bit that differs from the left neighbour) + that bit. Row beginnings, which have no left
    neighbour, take their lowest bit."""
    x = np.empty_like(a)
    x[1:] = a[1:] ^ a[:-1]
    x[first] = a.dtype.type(1)
    one = a.dtype.type(1)
    k = np.minimum(np.bitwise_count((x & (~x + one)) - one), a.dtype.itemsize * 8 - 1)
    return (2 * k + ((a >> k.astype(a.dtype)) & one).astype(np.uint8)).astype(np.uint8)


def next_level(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names and row offsets, from symbols and row offsets; every row has symbols."""
    change = np.empty(len(a), bool)
    change[1:] = a[1:] != a[:-1]
    change[off[:-1]] = True
    starts = np.flatnonzero(change)
    length = np.diff(np.append(starts, len(a)))
    a = a[starts]
    long = length > 1
    a[long] = mix64(a[long] * ODD[0] + length[long].astype(U64))
    off = np.searchsorted(starts, off)

    first = off[:-1]
    label = coin_toss(a, first)
    for _ in range(3):
        label = coin_toss(label, first)
    top = np.zeros(len(a), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = off[1:] - 1
    top[last] = False
    top[first] = True
    starts = np.flatnonzero(top)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    name = np.add.reduceat(a * ODD[np.minimum(place, 63)], starts)
    return mix64(name), np.searchsorted(starts, off)


def phrases(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(name, row) of the phrases that count, for a list of texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    rows = np.flatnonzero(lengths)
    a = mix64(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1))
    off = np.concatenate([[0], np.cumsum(lengths[rows])])
    names, owners, level = [], [], 0
    while len(rows):
        a, off = next_level(a, off)
        level += 1
        n = np.diff(off)
        owner = np.repeat(np.arange(len(rows)), n)
        done = n == 1
        use = np.ones(len(a), bool) if level >= LEAST else done[owner]
        names.append(a[use])
        owners.append(rows[owner[use]])
        going = ~done[owner]
        a, rows, off = a[going], rows[~done], np.concatenate([[0], np.cumsum(n[~done])])
    return (np.concatenate(names), np.concatenate(owners)) if names else (np.zeros(0, U64), np.zeros(0, np.int64))


def signatures(texts: list[str]) -> np.ndarray:
    """A row of SLOTS 16-bit values for each text; zeros for empty ones."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    lo = 0
    while lo < len(texts):
        hi, n = lo + 1, len(texts[lo])
        while hi < len(texts) and n + len(texts[hi]) <= PIECE:
            n += len(texts[hi])
            hi += 1
        names, owner = phrases(texts[lo:hi])
        order = np.argsort(owner, kind="stable")
        names, owner = names[order], owner[order]
        if len(names):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.stack([np.minimum.reduceat(names * odd, starts) for odd in SLOT], axis=1)
            out[lo + owner[starts]] = (mix64(least) & U64(0xFFFF)).astype(np.uint16)
        lo = hi
    return out


def written(texts: list[str], s: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() if t else "" for t, row in zip(texts, s, strict=True)]


def likeness(x: list[str], a: np.ndarray, y: list[str], b: np.ndarray) -> np.ndarray:
    """Share of equal slots; two empty texts are alike, an empty and another text are not."""
    ex, ey = np.array([not t for t in x], bool), np.array([not t for t in y], bool)
    return np.where(ex | ey, (ex & ey).astype(float), (a == b).mean(axis=1))


def edited(text: str, following: str) -> str:
    """The last half of text replaced by as many code points from the beginning of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each document."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(written(texts, signatures(texts)))], names=["doc_id", "n_chars", "fingerprint"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def compared(ids: list, texts: list[str], own: np.ndarray, following: list[str], following_own: np.ndarray) -> dict[str, list]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    other = signatures(changed)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [sha256(t) for t in changed], "fingerprint": written(texts, own), "edited_fingerprint": written(changed, other),
        "near_edited": likeness(texts, own, changed, other), "near_next": likeness(texts, own, following, following_own),
    }


def compare_edits(docs: DataFrame) -> DataFrame:
    """The table RESULT: each document against its edited text and against the next one in descending doc_id.

    One range shuffle brings neighbours together; sorted partitions are streamed, a batch at a time. What crosses a
    partition's border - its first and last document - is set aside with its text (two rows for each partition) and
    joined in a second, small step.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # equal ids (or none) are cut by text, and repeated rows by their place in the input, so that no id is one task
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("nth"))
    by = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    dealt = rows.repartitionByRange(*by, "nth").sortWithinPartitions(*by, "nth").select("doc_id", "text")
    fields = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    columns = [*RESULT, "part", "edge", "text"]

    def batch_of(x: dict[str, list], part: int, edge: list, text: list) -> pa.RecordBatch:
        n = len(x["doc_id"])
        types = [ids, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([*(pa.array(x[c], t) for c, t in zip(RESULT, types, strict=True)), pa.array([part] * n, pa.int32()), pa.array(edge, pa.string()), pa.array(text, pa.string())], names=columns)

    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, left, head = TaskContext.get().partitionId(), None, True
        bare = lambda i, t, s: {"doc_id": [i], "n_chars": [len(t)], "edited_sha256": [None], "fingerprint": written([t], s), "edited_fingerprint": [None], "near_edited": [None], "near_next": [None]}
        for b in batches:
            if not b.num_rows:
                continue
            texts, keys = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            own = signatures(texts)
            if head:
                yield batch_of(bare(keys[0], texts[0], own[:1]), part, ["head"], [texts[0]])
                head = False
            if left is not None:
                keys, texts, own = [left[0], *keys], [left[1], *texts], np.vstack([left[2], own])
            left = (keys[-1], texts[-1], own[-1:])
            if len(keys) > 1:
                yield batch_of(compared(keys[:-1], texts[:-1], own[:-1], texts[1:], own[1:]), part, [None] * (len(keys) - 1), [None] * (len(keys) - 1))
        if left is not None:
            yield batch_of(bare(*left), part, ["tail"], [left[1]])

    found = saved(dealt.mapInArrow(run, f"{fields}, part int, edge string, text string"), "fingerprints")
    edge = found.filter("edge is not null")  # two rows for each partition
    heads, tails = edge.filter("edge = 'head'"), edge.filter("edge = 'tail'")
    order = Window.orderBy("part")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(every)).alias("next"))
    pairs = tails.join(after, "part").select("doc_id", "text", "next").join(heads.select(F.col("part").alias("next"), F.col("text").alias("following")), "next").select("doc_id", "text", "following")

    def close(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, following = b.column("text").to_pylist(), b.column("following").to_pylist()
        x = compared(b.column("doc_id").to_pylist(), texts, signatures(texts), following, signatures(following))
        return batch_of(x, 0, [None] * len(texts), [None] * len(texts)).select(list(RESULT))

    return found.filter("edge is null").select(*RESULT).union(map_arrow(pairs, close, fields))


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_edits(table(spark, sf_dir, "documents"))

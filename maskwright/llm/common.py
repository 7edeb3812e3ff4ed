"""What the operators of this subpackage share: shared-folder tables, Arrow batches, hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship, small_batches

#: Used only where the session names no shared folder and everything runs on this machine.
LOCAL_SHARED = "/tmp/checkpoints"

U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Ship the package; keep Arrow batches small, as a row may hold a very long text."""
    ship(spark)
    small_batches(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir). Without that setting, a cluster has none."""
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_SHARED


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, so that a lost executor costs a
    read and not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what saved() wrote for these tables: nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_saved_path", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in fewer pieces than there are cores (one large row group, say) is dealt out."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, after: Callable[[], object] | None = None) -> DataFrame:
    """Apply fn to each Arrow batch of df; fn returns a batch with the columns of schema, in order. after is called at the end of
    each task, whatever its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows and (out := fn(batch)) is not None:
                    yield out
        finally:
            if after is not None:
                after()

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` units each, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_odd(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def lowest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """A bounded sample that does not depend on partitioning: the n rows with the smallest hash of keys, saved.

    Rows whose hash is beyond what n rows need (by a count of all) are dropped before the sort, so that about n rows move in
    all, not n from each partition; executors write them, and the driver sees none."""
    rows = df.withColumn("__h", F.xxhash64(F.lit("sample"), *keys))
    total = df.count()
    share = (n + 6 * n**0.5 + 6) / max(total, 1)
    if share < 1:
        rows = rows.filter(F.col("__h") < F.lit(int(-(2**63) + share * 2**64)))
    return saved(rows.orderBy("__h", *keys).limit(n).drop("__h"), "sample")


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 8, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton steps for L2-regularised logistic regression on hard or soft labels; returns weights, bias last. weight: how
    much each row counts (default 1)."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-3
    each = np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (each * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(reg), x.T @ (each * (p - y)) + reg * w)
        w -= step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return w


def grouped(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Deal df by keys, sort, and call fn(key, rows) for each group; one group at a time is in memory, so callers bound
    the groups. fn yields dicts with the columns of schema."""
    from itertools import groupby

    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.to_pylist())
        out: list[dict] = []
        for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            for x in fn(key, list(group)):
                out.append(x)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

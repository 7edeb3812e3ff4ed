"""Readers of labelled corpora. Every one takes paths of any store that Spark reads, and an explicit schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.payload import MESSAGES
from ..operators.sampling import last_wins
from . import schema


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def json_array(spark: SparkSession, path: str, ddl: str = schema.CORPUS) -> DataFrame:
    """A file that holds one JSON list of objects. Fields that are missing are null."""
    return spark.read.schema(ddl).json(path, multiLine=True)


def optional_json_array(spark: SparkSession, path: str, ddl: str = schema.CORPUS) -> DataFrame:
    """json_array, or no rows if there is no such file."""
    return json_array(spark, path, ddl) if exists(spark, path) else spark.createDataFrame([], ddl)


def corpora(spark: SparkSession, paths: Sequence[str], ddl: str = schema.CORPUS, optional: bool = False) -> DataFrame:
    """Several corpora one after the other, with `dataset` (file name) and `ord` (place of the file)."""
    read = optional_json_array if optional else json_array
    parts = [read(spark, p, ddl).withColumns({"dataset": F.lit(p.rsplit("/", 1)[-1].removesuffix(".json")), "ord": F.lit(i)}) for i, p in enumerate(paths)]
    if not parts:
        return spark.createDataFrame([], f"{ddl}, dataset string, ord int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def clean(corpus: DataFrame) -> DataFrame:
    """Documents without expected values."""
    return corpus.filter(F.coalesce(F.size("expected"), F.lit(0)) <= 0)


def structured(spark: SparkSession, path: str) -> DataFrame:
    """Chat payloads. String content goes to content_text, list content to content_parts."""
    raw = spark.read.schema(schema.STRUCTURED_RAW).json(path, multiLine=True)
    listed = lambda c: c.rlike(r"^\s*\[")
    message = lambda m: F.struct(
        m["role"].alias("role"),
        F.when(~listed(m["content"]), m["content"]).alias("content_text"),
        F.when(listed(m["content"]), F.from_json(m["content"], f"array<{schema.PART}>")).alias("content_parts"),
        m["tool_calls"].alias("tool_calls"),
    )
    return raw.withColumn("messages", F.transform("messages", message).cast(MESSAGES))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """id, lang, expected from an object with a list `labels`, or from a bare list."""
    # one schema for both: a bare entry has an id and no list
    rows = spark.read.schema(f"{schema.WRAPPED_LABELS}, {schema.LABELS}").json(path, multiLine=True)
    bare = F.struct(*(F.col(c.split()[0]) for c in schema.LABELS.split(", ")))
    each = F.coalesce("labels", F.when(F.col("id").isNotNull(), F.array(bare)))
    return rows.select(F.explode(each).alias("x")).select("x.*")


def placed_lines(spark: SparkSession, path: str, order: int = 0) -> DataFrame:
    """value (a line) and place, a struct that orders lines as they stand: order (the file's in a list), file, block (where the
    split begins in the file) and row (rows of a split are read one after the other). Large files are read in many splits."""
    place = F.struct(F.lit(order).alias("order"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", place.alias("place"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """placed_lines() with line, the number from 0 in its file: rows of a split are counted by themselves, splits summed over."""
    split = ["place.order", "place.file", "place.block"]
    keyed = lines.select("*", *(F.col(c).alias(f"__{c.split('.')[1]}") for c in split))
    keys = ["__order", "__file", "__block"]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__order", "__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("place.row"))  # a split at most
    return keyed.withColumn("__inside", inside).join(base, keys).withColumn("line", F.col("__base") + F.col("__inside") - 1).drop(*keys, "__base", "__inside")


def masked_sources(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """JSON lines, a file (or folder) for each language; the language is the file's. Adds lang, file_ord and place (the order of the
    lines, see placed_lines), so that the last line of an id can win."""
    place = "struct<order:int,file:string,block:bigint,row:bigint>"
    if not paths:
        return spark.createDataFrame([], f"{schema.MASKED}, lang string, file_ord int, place {place}")
    parts = []
    for i, (lang, path) in enumerate(paths.items()):
        lines = placed_lines(spark, path, i).filter(F.trim("value") != "")
        read = lines.select(F.from_json("value", schema.MASKED).alias("x"), "place").select("x.*", F.lit(lang).alias("lang"), F.lit(i).alias("file_ord"), F.col("place").cast(place).alias("place"))
        parts.append(read)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_lines(masked: DataFrame) -> DataFrame:
    """Of each id the line that is read last, over all files."""
    return last_wins(masked, ["id"], "place")


def label_corpus(label: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels with their texts by id; labels without a text are dropped. The language is the label's."""
    return label.join(texts.select("id", "text"), "id")


def cached_or(spark: SparkSession, path: str, rebuild, ddl: str = schema.CORPUS) -> DataFrame:
    """The file if it is there, else rebuild()."""
    return json_array(spark, path, ddl) if exists(spark, path) else rebuild()


def read_table(spark: SparkSession, path: str, fmt: str | None = None, ddl: str | None = None, **options: str) -> DataFrame:
    """parquet, orc, json, csv, text or any installed source; the format is taken from the name if not given."""
    fmt = fmt or next((f for f in ("parquet", "orc", "jsonl", "json", "csv", "txt") if path.rstrip("/").endswith(f".{f}")), "parquet")
    fmt = {"jsonl": "json", "txt": "text"}.get(fmt, fmt)
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(ddl) if ddl else reader).load(path)

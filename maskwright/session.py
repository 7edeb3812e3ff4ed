"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(app: str = "maskwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the queries expect (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"} | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="maskwright-")) / "maskwright_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as a row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception as e:  # older Spark knows only the row limit
        if "CANNOT_MODIFY_CONFIG" not in str(e):
            raise


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors see (spark.checkpoint.dir; where that is unset and everything runs
    on this machine, /tmp/checkpoints)."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: computed once, and a lost executor costs a read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

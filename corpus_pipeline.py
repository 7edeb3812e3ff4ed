"""From raw documents to token ids: reject toxic texts, drop near copies, mask personal data, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm.common import saved
from maskwright.llm.dedup import drop_near_copies
from maskwright.llm.mixing import mix_stage
from maskwright.llm.pieces import encode_stage
from maskwright.llm.pii import mask_pii
from maskwright.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("near-dedup", drop_near_copies),
    ("pii", mask_pii),
    ("mixing", mix_stage),
    ("encoding", encode_stage),
]

#: No SQL expresses a trained classifier: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

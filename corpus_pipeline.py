"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing and encoding, a written table after each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, exact, mixing, simhash, toxicity
from marginalia.llm.shared import scratch, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact dedup", exact.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing sources to target weights", mixing.stage),
    ("byte-level BPE encoding and decoding", bpe.stage),
]

#: SimHash and BPE aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

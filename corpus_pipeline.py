"""From raw documents to packed sequences: classify, deduplicate twice, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import mixing, packing, quality, simhash, suffixes
from wardline.storage import materialise

STAGES = [
    ("quality", quality.keep_good),
    ("near_dedup", simhash.keep_one),
    ("repeat_removal", suffixes.remove_repeats),
    ("mixing", mixing.mix_documents),
    ("packing", packing.pack_documents),
]
ORACLE_SQL = None  # classifier, fingerprints and packing are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs

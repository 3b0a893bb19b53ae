"""The corpus pipeline: documents through quality rules, near-dedup, secret masking, source mixing and SentencePiece encoding.

Each stage takes the documents that its predecessor returned. run() writes what a stage returns to the
shared folder and reads it again, so a lost executor never sets a stage back to the beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodework.llm import minhash_dedup, quality_rules, secret_scan, sentence_pieces, source_mixing
from lodework.llm.common import Scratch

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("minhash_dedup", minhash_dedup.stage),
    ("secret_scan", secret_scan.stage),
    ("source_mixing", source_mixing.stage),
    ("sentence_pieces", sentence_pieces.stage),
]

#: Compression ratios and piece ids can't be expressed in SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, near-duplicates, personal data, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Between stages the rows are written as Parquet to the shared folder and read
again, so a lost executor costs at most its running stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.bpe import bpe_stage
from colloquy.llm.common import materialize
from colloquy.llm.mixing import mixing_stage
from colloquy.llm.neardup import near_duplicate_stage
from colloquy.llm.pii import pii_stage
from colloquy.llm.quality import quality_stage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: SQL can express neither the learned rules nor byte-pair encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

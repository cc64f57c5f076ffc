"""Helpers that the corpus operators share: words, shared storage, parameters."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators are the six ASCII white-space characters; every other character belongs to a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Used only where the session names no checkpoint folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/colloquy"
#: Bytes of an Arrow batch of texts, where the session sets no other bound.
BATCH_BYTES = 4 << 20
DEFAULT_BATCH_BYTES = "67108864b"


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach: ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or LOCAL_CHECKPOINTS).rstrip("/")


def texts_in_small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python steps get to ``BATCH_BYTES``, unless the session sets a bound
    other than Spark's default; no result hangs on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage without depending on any executor's own disk, so a lost executor costs
    only the running tasks.  The path is on the result as ``df.stored_at`` for :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.stored_at = path
    return again


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "stored_at", None)
    if path is not None:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def free_name(columns: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column bears the name (case-insensitively)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted

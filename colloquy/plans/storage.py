"""Tables that later steps share, in the folder that all executors reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Used only where the session names no checkpoint folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/colloquy"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again: made once, short plan."""
    root = (df.sparkSession.conf.get("spark.checkpoint.dir", None) or LOCAL_CHECKPOINTS).rstrip("/")
    path = f"{root}/meetings-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Benchmark rows: meetings with references and masked spans as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SPLITS
from ..schemas import UTTERANCES_JSON


def checked_splits(names: str | list[str]) -> list[str]:
    wanted = [s.strip() for s in names.split(",")] if isinstance(names, str) else list(names)
    wanted = [s for s in wanted if s]
    if unknown := [s for s in wanted if s not in SPLITS]:
        raise ValueError(f"unknown split {unknown[0]!r}; expected one of {SPLITS}")
    return wanted


def limited(rows: DataFrame, by: str, n: int | None, order: list[str]) -> DataFrame:
    """At most ``n`` rows of each value of ``by``, in order."""
    if n is None:
        return rows
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def read_benchmark(spark: SparkSession, path: str, splits: str | list[str] = ",".join(SPLITS), limit: int | None = None) -> DataFrame:
    """Rows of the splits ``path/<split>.parquet``; a row without corpus has its split's name."""
    parts = []
    for s in checked_splits(splits):
        rows = spark.read.parquet(f"{path}/{s}.parquet")
        parts.append(limited(rows.withColumn("corpus", F.coalesce(F.col("corpus") if "corpus" in rows.columns else F.lit(None), F.lit(s))), "corpus", limit, ["meeting_id"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def references(rows: DataFrame, column: str = "utterances_json") -> DataFrame:
    """(meeting_id, ord, speaker_id, begin_time, end_time, text), whichever of the known keys are used."""
    flat = rows.select("meeting_id", F.posexplode(F.from_json(column, UTTERANCES_JSON)).alias("ord", "u"))
    u = lambda *names: F.coalesce(*(F.col(f"u.{n}") for n in names))
    return flat.select("meeting_id", "ord", u("speaker_id", "speaker").alias("speaker_id"), F.coalesce(u("begin_time", "start", "start_time"), F.lit(0.0)).alias("begin_time"), F.coalesce(u("end_time", "end"), F.lit(0.0)).alias("end_time"), F.coalesce("u.text", F.lit("")).alias("text"))


def masked_spans(rows: DataFrame, column: str = "unknown_spans_json") -> DataFrame:
    spans = F.from_json(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("[]")), "array<array<double>>")
    return rows.select("meeting_id", F.explode(spans).alias("s")).select("meeting_id", F.get("s", F.lit(0)).alias("start"), F.get("s", F.lit(1)).alias("end"))


def audio_column(rows: DataFrame, name: str = "audio") -> Column:
    """A struct (content, samples, path) from audio as bytes, as a path, or as a struct of any of them."""
    kind = rows.schema[name].dataType
    col = F.col(name)
    none = lambda t: F.lit(None).cast(t)
    if isinstance(kind, T.BinaryType):
        parts = col, none("array<float>"), none("string")
    elif isinstance(kind, T.StringType):
        parts = none("binary"), none("array<float>"), col
    elif isinstance(kind, T.StructType) and {"bytes", "array", "path"} & set(kind.names):
        has = set(kind.names)
        content = F.when(F.length(col["bytes"]) > 0, col["bytes"]) if "bytes" in has else none("binary")
        samples = F.when(content.isNull(), col["array"].cast("array<float>")) if "array" in has else none("array<float>")
        parts = content, samples, F.when(content.isNull() & samples.isNull(), col["path"]) if "path" in has else none("string")
    else:
        raise TypeError(f"unrecognised audio column of type {kind.simpleString()}")
    return F.struct(*(p.alias(n) for p, n in zip(parts, ("content", "samples", "path"), strict=True)))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Recorded word cases (case_id, gap_start, gap_end, a, b), one JSON file each."""
    word = "array<struct<text:string,start:double,end:double,node:string,speaker:string,score:double,timing:string>>"
    schema = f"provenance struct<media_sha256:string,aligner_revision:string,human_verified:boolean>, gap array<double>, A {word}, B {word}"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("case_id"), F.get("gap", F.lit(0)).alias("gap_start"), F.get("gap", F.lit(1)).alias("gap_end"), F.col("A").alias("a"), F.col("B").alias("b"), "provenance")

from pathlib import Path

import corpus_pipeline
from colloquy.llm.common import discard, free_name, id_remainder, materialize
from pyspark.sql import functions as F

from .fixtures import documents


def test_pipeline_runs_on_awkward_rows(spark, tmp_path):
    docs = documents(spark, 60)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 0
    for (_, stage) in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_helpers(spark):
    df = materialize(spark.range(5).toDF("a"), "t")
    assert df.count() == 5 and Path(df.stored_at).exists()
    discard(df)
    assert not Path(df.stored_at).exists()
    assert free_name(["A", "_a"], "a") == "__a"
    ids = spark.createDataFrame([(1,), (None,)], "doc_id long")
    import zlib

    assert [r[0] for r in ids.select(id_remainder(F.col("doc_id"), 10)).collect()] == [zlib.crc32(b"1") % 10, 0]

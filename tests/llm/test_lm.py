import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from colloquy.llm import lm, packs

from .fixtures import SCHEMA, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def test_exchange_gains_equal_the_change_of_the_objective():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 9, (12, 12)).astype(float)

    def objective(cls):
        z = np.eye(5)[cls]
        n = z.T @ m @ z
        return lm._f(n).sum() - lm._f(n.sum(1)).sum() - lm._f(n.sum(0)).sum()

    cls = lm.exchange(m, {10: 3, 11: 4}, 3)
    assert cls[10] == 3 and cls[11] == 4
    best = objective(cls)
    for w in range(10):
        for b in range(3):
            other = cls.copy()
            other[w] = b
            assert objective(other) <= best + 1e-9


def two_kinds(spark, n=400, seed=5):
    rng = random.Random(seed)
    kinds = [[f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]]
    rows = [(i, " ".join(rng.choice(kinds[(i + j) % 2]) for j in range(rng.randrange(1, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def marked(docs):
    from pyspark.sql import functions as F

    from colloquy.llm.common import id_remainder

    return docs.select("doc_id", "text", (id_remainder(F.col("doc_id"), 10) == 0).alias("held_out"))


@pytest.mark.parametrize("chunk,core", [(2_000_000, 1024), (300, 20)])
def test_base_score_equals_brute_force_and_classes_help(spark, monkeypatch, chunk, core):
    monkeypatch.setattr(packs, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lm, "HEAD", 20)
    docs = two_kinds(spark)
    rows = {r["doc_id"]: r for r in lm.brown_scores(marked(docs), classes=4, core_size=core).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = Counter(t for i, x in texts.items() if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    total, types = sum(train.values()), len(train)
    for i, x in texts.items():
        want = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (types + 1))) for t in tokens(x))
        r = rows[i]
        assert math.isclose(want, r["base_score"], rel_tol=1e-9) and r["train_tokens"] == total
        assert r["n_tokens"] == len(tokens(x)) and r["n_known"] == sum(t in train for t in tokens(x)) and r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.9


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, (5, 6))
    c = lm.Classes(counts[:, :5].sum(0), np.array([3, 4, 5, 6, 1]), int(counts[:, :5].sum()), 19, 7)
    assert np.allclose((10 ** lm.transition_logs(counts, c)).sum(1), 1)


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lm.op1_brown_lm(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r["score"]) for r in rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert lm.op1_brown_lm(spark, f"{tmp_path}/none").count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = lm.brown_scores(marked(spark.createDataFrame([(held, "some words")], "doc_id long, text string"))).first()
    assert only["train_tokens"] == 0 == only["n_known"] and only["n_tokens"] == 3 and math.isfinite(only["score"])

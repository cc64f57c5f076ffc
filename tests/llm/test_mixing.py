from collections import Counter, defaultdict

import duckdb
import pytest
from colloquy.llm import mixing
from pyspark.sql import functions as F

from .fixtures import SCHEMA, awkward, documents


def sainte_lague(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


@pytest.mark.parametrize("weights,seats", [([1, 2, 3], 7), ([5, 5, 5], 4), ([1000, 1, 1, 1, 1, 1, 1], 20), ([1, 1, 1], 0), ([0, 3], 5), ([7, 11, 13, 170, 3, 3], 501)])
def test_apportionment_equals_giving_seats_one_by_one(spark, weights, seats):
    df = spark.createDataFrame([(0, i, float(w), seats) for i, w in enumerate(weights)], "g int, i int, w double, seats long")
    got = {r["i"]: r["q"] for r in mixing.apportion(df, ["g"], ["i"], "w", "seats", "q").collect()}
    assert [got[i] for i in range(len(weights))] == sainte_lague(weights, seats)


def test_quotas_closeness_and_reruns(spark):
    docs = documents(spark, 300)
    rows = mixing.mix(docs, block_words=8, shard_words=500, fan_out=3).collect()
    assert len(rows) == docs.count()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    shards = defaultdict(int)
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1e-6 and not shards
    assert all(abs(taken[s] - t) <= max(0.05 * t, 60) for s, t in target.items())
    again = mixing.mix(docs.repartition(7), block_words=8, shard_words=500, fan_out=3).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_taken_in_closed_form_counts_the_selected_words(spark):
    docs = documents(spark, 60)
    placed = mixing.mix(docs, block_words=8, shard_words=500)
    each = placed.withColumn("w", F.expr("sequence(0L, size)")).withColumn("w", F.slice("w", 1, F.col("size").cast("int")))
    p = F.col("place")
    counted = each.withColumn("n", F.floor(p["q"] / p["K"]) * F.col("size") + F.aggregate(F.transform("w", lambda x: mixing.selected(p, x, 8)), F.lit(0).cast("long"), lambda a, x: a + x))
    assert counted.where("n <> taken").count() == 0 and counted.count() > 60


def test_query_equals_its_sql(spark, tmp_path):
    documents(spark, 200).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.execute(f"select doc_id, size, source_size, round(target, 6), taken from ({mixing.OP3_SQL})").fetchall())
    got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.op3_mix_sources(spark, str(tmp_path)).collect())
    assert got == want


def test_stage_takes_the_words_that_the_mix_says(spark):
    docs = awkward(documents(spark, 80))
    out = mixing.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    n = lambda df: Counter({r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg(F.sum("n").alias("n")).collect() if r["n"]})
    got = n(out.withColumn("n", F.regexp_count("text", F.lit(mixing.WORD)).cast("long")))
    want = n(mixing.mix(docs.select("doc_id", "source", "text")).withColumn("n", F.col("taken")))
    assert got == want
    assert mixing.mixing_stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0

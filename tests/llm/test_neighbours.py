import numpy as np
from colloquy.llm import neighbours


def brute(rows, every=20, k=20):
    good = [(i, np.array(v, dtype=float)) for i, v in {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}]
    out = {}
    for i, v in good:
        if i % every == 0:
            out[i] = sorted((-float(v @ w), j) for j, w in good if j != i)[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(neighbours.nearest(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((-r["score"], r["vec_id"]))
    return out


def test_small_tables_are_searched_exactly_with_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 260)] + [(300, None), (320, [0.0] * 8), (340, [1.0] * 7 + [float("nan")]), (360, [1.0] * 7 + [None]), (380, [1.0] * 9), (None, [1.0] * 8), (400, [1.0] * 7 + [float("inf")]), (40, rows[40][1]), (420, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got, want = answers(df), brute(rows)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [j for _, j in found] == [j for _, j in got[q]] and np.allclose([s for s, _ in found], [s for s, _ in got[q]], atol=1e-12)
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(20, [1.0, 2.0]), (21, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(few).collect()] == [(20, 1, 21, 4.0)]


def test_recall_of_graph_search(spark, monkeypatch):
    for name, value in (("POOL", 100), ("ASKED", 40), ("BLOCK", 256), ("ROUNDS", 3)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 30] + 0.3 * rng.normal(size=8))]) for i in range(2500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = answers(df), brute(rows)
    recall = np.mean([len({j for _, j in got[q]} & {j for _, j in found}) / 20 for q, found in want.items()])
    assert got.keys() == want.keys() and recall >= 0.9


def test_rounds_go_on_until_lists_are_near_the_true_ones(spark, monkeypatch):
    for name, value in (("BLOCK", 128), ("ROUNDS", 1)):
        monkeypatch.setattr(neighbours, name, value)
    x = np.random.default_rng(5).normal(size=(2000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node long, embedding array<float>")
    state = neighbours.build_graph(neighbours._singles(df), len(x)).collect()
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argsort(-scores, axis=1)[:, : neighbours.LISTED]
    assert np.mean([len(set(best[r["node"]]) & set(np.frombuffer(r["ids"], dtype=np.int64))) / neighbours.LISTED for r in state]) >= 0.8


def test_near_copies_and_large_and_small_components(spark):
    rng = np.random.default_rng(6)
    one = np.full(8, 8**-0.5)
    for x in (one + 1e-5 * rng.normal(size=(600, 8)), 1e6 * rng.normal(size=(100, 8)), 1e-10 * rng.normal(size=(100, 8))):
        rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.float32(x))]
        got, want = answers(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), brute(rows)
        assert got.keys() == want.keys()
        assert np.mean([len({j for _, j in got[q]} & {j for _, j in found}) / 20 for q, found in want.items()]) >= 0.99


def test_a_round_sends_packed_rows_and_copies_apart_are_found_from_their_own_node(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(1500, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node long, embedding array<float>")
    singles, shards = neighbours._singles(df), 5
    state = neighbours._merged(neighbours._dealt(singles, 0, shards), neighbours._block_lists(singles, 3, 1, 4, shards), 4).cache()
    there = neighbours._sent(state, shards, neighbours.MEETING, 1).collect()
    assert len(there) <= shards * shards
    assert sum(len(r["places"]) // 8 for r in there) > 10 * len(x)
    lists = {r["node"]: np.frombuffer(r["ids"], dtype=np.int64) for r in neighbours._lists(state).collect()}
    sent = {(p, n) for r in there for p, n in zip(np.frombuffer(r["places"], np.int64).tolist(), np.frombuffer(r["nodes"], np.int64)[np.frombuffer(r["sender"], np.int32)].tolist(), strict=True)}
    assert {(n, n) for n in lists} <= sent and all(p == n or p in lists[n] for p, n in sent)
    pools = neighbours._start(df.limit(3).selectExpr("node as query").join(singles.withColumnRenamed("node", "query"), "query").join(neighbours._lists(state).withColumnRenamed("node", "query"), "query"), (np.arange(100, 120), x[100:120].astype(float)), 64)
    for r in pools.collect():
        for q, ids in zip(np.frombuffer(r["queries"], np.int64), np.frombuffer(r["ids"], np.int64).reshape(-1, 64), strict=True):
            assert q in ids and set(lists[q]) <= set(ids)


def test_arrow_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "67108864b")
    neighbours.nearest(spark.createDataFrame([(20, [1.0, 2.0]), (21, [2.0, 1.0])], "vec_id long, embedding array<float>"))
    small = spark.conf.get(key)
    spark.conf.set(key, before)
    assert int(small) <= 4 << 20

"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node.  The graph starts from the best of random blocks and gets
better by rounds of joins until few list entries change: each node sends its vector to the
neighbours it lists; all nodes that meet at a node are neighbours of a neighbour, are compared
there, and send what they found to one another.
For searching, a node's edges lead to the nodes that list it, so every node can be reached from
each of its own neighbours.

A query keeps a pool of the best nodes seen; it starts from common entries, its own node and the
nodes that this lists.  In each round it asks the best nodes of the pool that it hasn't asked yet;
they answer with the scores of their edges; it ends when all of the pool have been asked.  The
neighbours of ``SAMPLED`` queries are found by a full scan, and these are searched first: while their
pools hold less than ``RECALL`` of those, their search starts anew from twice the entries with twice the
pool.  All queries are then searched once with the pool that was enough.

Nodes lie in shards by hash, a packed row for each; what nodes send goes in one row for each pair of
shards, so no step handles single messages.  Edges with vectors are persisted on disk (recomputed if
an executor is lost).  Vectors travel as 32-bit floats and are compared in double precision; the best
of the pool, with all within ``ROUNDING`` of the last one asked for, are scored again by the defined
order of sums.

Bounds: a node lists ``LISTED`` others and has ``EDGES`` edges at most; ``MEETING`` nodes meet at
a node in one round; blocks hold about ``BLOCK`` nodes by hash.  So no vector, however common,
makes a large group.

Defined edge cases: vectors that are null, zero, or hold a null, NaN or infinity take no part, nor
do null ids or vectors of another length than most have.  Rows alike in id and vector count once.
With fewer candidates than asked for, all are returned; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packs
from .common import discard, materialize, shuffle_partitions, texts_in_small_batches

NEAREST = 20
LISTED = 24
MEETING = 48
TOLD = 16
EDGES = 256
BLOCK = 1024
PASSES = 2
#: Rounds at least; rounds end when this share of list entries changes at most.
ROUNDS = 1
DELTA = 0.02
#: Nodes that a search starts from, and nodes in a pool, at first; both grow by measured recall.
POOL = 640
ASKED = 160
RESCORED = 64
#: Two sums of the same products differ by less than this share of the largest score.
ROUNDING = 1e-9
SALTS = 64
#: Nodes of a shard (most nodes that a task holds at once), nodes in the pools of a row, scores at once.
SHARD = 2048
POOL_NODES = 1 << 17
ANSWERED = 1 << 16
#: Queries whose neighbours are found by a full scan too, and the recall that they must reach.
SAMPLED = 128
RECALL = 0.95


def valid_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)).where(finite & F.exists(e, lambda x: x != 0))
    usual = rows.groupBy(F.size(e).alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size(e) == (usual["n"] if usual else 0))
    return rows.withColumn("embedding", F.transform(e, lambda x: x + F.lit(0.0).cast("float")))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(node, embedding, ids): each distinct vector with its least ids, one more than are ever asked for."""
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    least = salted.withColumn("r", F.row_number().over(Window.partitionBy("embedding", "salt").orderBy("vec_id"))).where(F.col("r") <= NEAREST + 1)
    grouped = least.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, NEAREST + 1).alias("ids"))
    return grouped.withColumn("node", F.monotonically_increasing_id())


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best distinct ids, best first, ties to the smaller id."""
    u, first = np.unique(ids, return_index=True)
    s = scores[first]
    order = np.lexsort((u, -s))[:k]
    return u[order], s[order]


def _best_of_each(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, marks: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each owner 0 .. n - 1 the ``k`` best distinct ids, best first, ties to the smaller id, with
    their scores and marks; of equal ids the first given stays.  Rows are filled up with -1, -inf, False."""
    order = np.lexsort((ids, owner))
    owner, ids, scores, marks = owner[order], ids[order], scores[order], marks[order]
    once = np.r_[True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])][: len(owner)]
    owner, ids, scores, marks = owner[once], ids[once], scores[once], marks[once]
    order = np.lexsort((-scores, owner))
    place = _ranks(owner[order])
    order, place = order[place < k], place[place < k]
    out = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf), np.zeros((n, k), dtype=bool)
    for filled, given in zip(out, (ids, scores, marks), strict=True):
        filled[owner[order], place] = given[order]
    return out


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])


def _ranks(keys: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of equal keys."""
    starts = _starts(keys)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))


def _hashed(nodes: np.ndarray, seed: int, n: int) -> np.ndarray:
    """A number below ``n`` for each node."""
    h = nodes.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the places that hold it, in order."""
    order = np.argsort(keys, kind="stable")
    starts = _starts(keys[order])
    for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
        yield int(keys[order[a]]), order[a:b]


def _matrix(vecs: bytes, n: int) -> np.ndarray:
    return np.frombuffer(vecs, dtype=np.float32).reshape(n, -1)


def _runs(rows: Iterator[dict], key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each key, from rows in order of keys."""
    at, held = None, []
    for row in rows:
        if row[key] != at and held:
            yield at, held
            held = []
        at = row[key]
        held.append(row)
    if held:
        yield at, held


def _joined(rows: list[dict], column: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), dtype=dtype)


def _emitted(rows: Iterable[dict], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of packed arrays as batches of bounded size."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if size >= packs.BYTES_HELD:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {c: b[c][k].as_py() for c in b.schema.names}


def _singles(classes: DataFrame) -> DataFrame:
    """(node, vec): vectors as 32-bit floats."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [np.array(x.as_py(), dtype=np.float32).tobytes() for x in b["embedding"]]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(vecs, pa.binary())], ["node", "vec"])

    return classes.select("node", "embedding").mapInArrow(pack, "node long, vec binary")


def _vectors(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=np.float32) for v in rows]).astype(np.float64)


def _shards(count: int, parts: int) -> int:
    """Shards of ``SHARD`` nodes at most on average, more where they are fewer than the tasks need."""
    return max(1, -(-count // SHARD), min(4 * parts, -(-count // (SHARD // 8))))


_PART = "shard long, nodes binary, vecs binary"
_NEWS = "shard long, nodes binary, ids binary, scores binary"
#: A row for each shard: its nodes, their vectors and lists; ``fresh`` marks list entries that weren't
#: there before the last round, ``changed`` counts them.
_STATE = "shard long, nodes binary, vecs binary, ids binary, scores binary, fresh binary, changed long"


def _dealt(singles: DataFrame, seed: int, n: int) -> DataFrame:
    """Vectors packed by the hash of their node; several rows can have one number."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for b in batches:
                nodes, vecs = b["node"].to_numpy(), b["vec"].to_pylist()
                for shard, sel in _groups(_hashed(nodes, seed, n)):
                    yield {"shard": shard, "nodes": nodes[sel].tobytes(), "vecs": b"".join(vecs[k] for k in sel)}

        return _emitted(made(), _PART)

    return singles.select("node", "vec").mapInArrow(deal, _PART)


def _news(nodes: np.ndarray, ids: np.ndarray, scores: np.ndarray, shards: int) -> Iterator[dict]:
    """What nodes are told, packed by their shards."""
    for shard, sel in _groups(_hashed(nodes, 0, shards)):
        yield {"shard": shard, "nodes": nodes[sel].tobytes(), "ids": ids[sel].tobytes(), "scores": scores[sel].tobytes()}


def _block_lists(singles: DataFrame, blocks: int, seed: int, parts: int, shards: int) -> DataFrame:
    """The best of a random block, as news."""

    def compare(rows: Iterator[dict]) -> Iterator[dict]:
        for _, held in _runs(rows, "shard"):
            nodes = _joined(held, "nodes", np.int64)
            x = _matrix(b"".join(r["vecs"] for r in held), len(nodes)).astype(np.float64)
            k = min(LISTED, len(x) - 1)
            for a in range(0, len(x) if k else 0, 512):
                s = x[a : a + 512] @ x.T
                s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield from _news(np.repeat(nodes[a : a + 512], k), nodes[top].ravel(), np.take_along_axis(s, top, 1).ravel(), shards)

    return packs.in_groups(_dealt(singles, seed, blocks), parts, "shard", None, compare, _NEWS)


def _merged(state: DataFrame, news: DataFrame, parts: int) -> DataFrame:
    """States with what other nodes have found; rows of vectors alone are states without lists."""

    def merge(rows: Iterator[dict]) -> Iterator[dict]:
        for shard, held in _runs(rows, "shard"):
            olds, found = [r for r in held if r["kind"] == 0], [r for r in held if r["kind"] == 1]
            nodes = _joined(olds, "nodes", np.int64)
            x = _matrix(b"".join(r["vecs"] for r in olds), len(nodes))
            order = np.argsort(nodes)
            nodes, x = nodes[order], x[order]
            if olds[0]["ids"] is None:
                ids, scores = np.full((len(nodes), LISTED), -1, dtype=np.int64), np.full((len(nodes), LISTED), -np.inf)
            else:
                ids, scores = (_joined(olds, c, k).reshape(len(nodes), LISTED)[order] for c, k in (("ids", np.int64), ("scores", np.float64)))
            there = ids >= 0
            told = np.searchsorted(nodes, _joined(found, "nodes", np.int64))
            owner = np.concatenate([np.nonzero(there)[0], told])
            marks = np.r_[np.zeros(there.sum(), dtype=bool), np.ones(len(told), dtype=bool)]
            ids, scores, fresh = _best_of_each(owner, np.concatenate([ids[there], _joined(found, "ids", np.int64)]), np.concatenate([scores[there], _joined(found, "scores", np.float64)]), marks, len(nodes), LISTED)
            yield {"shard": shard, "nodes": nodes.tobytes(), "vecs": x.tobytes(), "ids": ids.tobytes(), "scores": scores.tobytes(), "fresh": fresh.tobytes(), "changed": int(fresh.sum())}

    none = F.lit(None).cast("binary")
    lists = [F.col(c) if c in state.columns else none.alias(c) for c in ("ids", "scores")]
    olds = state.select("shard", F.lit(0).alias("kind"), "nodes", "vecs", *lists)
    return packs.in_groups(olds.unionByName(news.select("shard", F.lit(1).alias("kind"), "nodes", none.alias("vecs"), "ids", "scores")), parts, "shard", "kind", merge, _STATE)


_SENT = "shard long, places binary, draws binary, sender binary, fresh binary, nodes binary, vecs binary, worst binary"


def _sent(state: DataFrame, shards: int, most: int, seed: int | None) -> DataFrame:
    """Each node to the nodes that it lists, packed by their shards, each vector once in a row; a shard
    sends ``most`` to a place.  With a seed, draws are random, entries that are fresh first, and each
    node is at its own place too; without one, the nearest come first."""

    def messages(row: dict) -> Iterator[dict]:
        nodes = packs.array(row["nodes"], np.int64)
        x = _matrix(row["vecs"], len(nodes))
        ids, scores, fresh = (packs.array(row[c], k).reshape(len(nodes), LISTED) for c, k in (("ids", np.int64), ("scores", np.float64), ("fresh", bool)))
        there = ids >= 0
        sender, place, new, worst = np.nonzero(there)[0], ids[there], fresh[there], scores[:, -1]
        if seed is None:
            draw = -scores[there]
        else:
            draw = np.random.default_rng((row["shard"], seed)).random(len(place)) - new
        order = np.lexsort((draw, place))
        order = order[_ranks(place[order]) < most]
        sender, place, new, draw = sender[order], place[order], new[order], draw[order]
        if seed is not None:
            sender, place = np.r_[sender, np.arange(len(nodes))], np.r_[place, nodes]
            new, draw = np.r_[new, np.zeros(len(nodes), dtype=bool)], np.r_[draw, np.full(len(nodes), -2.0)]
        for shard, sel in _groups(_hashed(place, 0, shards)):
            who, sent_by = np.unique(sender[sel], return_inverse=True)
            yield {"shard": shard, "places": place[sel].tobytes(), "draws": draw[sel].tobytes(), "sender": sent_by.astype(np.int32).tobytes(), "fresh": new[sel].tobytes(), "nodes": nodes[who].tobytes(), "vecs": x[who].tobytes(), "worst": worst[who].tobytes()}

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted((m for row in _rows(batches) for m in messages(row)), _SENT)

    return state.mapInArrow(send, _SENT)


def _received(held: list[dict], most: int) -> tuple[np.ndarray, ...]:
    """(place, sender, fresh) of the ``most`` first messages to each place, by place and draw, and
    (nodes, vectors, worst scores) of the senders."""
    counts = [len(r["nodes"]) // 8 for r in held]
    shift = np.repeat(np.cumsum([0, *counts[:-1]]), [len(r["places"]) // 8 for r in held])
    place, sender = _joined(held, "places", np.int64), _joined(held, "sender", np.int32) + shift
    order = np.lexsort((_joined(held, "draws", np.float64), place))
    order = order[_ranks(place[order]) < most]
    nodes = _joined(held, "nodes", np.int64)
    x = _matrix(b"".join(r["vecs"] for r in held), len(nodes))
    return place[order], sender[order], _joined(held, "fresh", bool)[order], nodes, x, _joined(held, "worst", np.float64)


def _meeting(held: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, ids, scores): what the nodes that meet at places tell one another, ``TOLD`` a node and
    place; two that met by entries that aren't fresh have been compared before."""
    place, sender, fresh, nodes, x, worst = _received(held, MEETING)
    starts = _starts(place)
    sizes = np.diff(np.r_[starts, len(place)])
    useful = np.flatnonzero((sizes > 1) & np.logical_or.reduceat(fresh, starts))
    useful = useful[np.argsort(sizes[useful], kind="stable")]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(useful), 64):
        some = useful[a : a + 64]
        slot = np.arange(sizes[some].max())
        there = slot < sizes[some][:, None]
        at = np.where(there, starts[some][:, None] + slot, 0)
        who = sender[at]
        y = x[who].astype(np.float64)
        s = y @ y.transpose(0, 2, 1)
        new = fresh[at] & there
        good = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & (s > worst[who][:, :, None])
        good[:, slot, slot] = False
        many = good.sum(2) > TOLD
        if many.any():
            among = np.where(good[many], s[many], -np.inf)
            good[many] &= among >= -np.partition(-among, TOLD - 1, axis=1)[:, TOLD - 1 : TOLD]
        g, i, j = np.nonzero(good)
        out.append((nodes[who[g, i]], nodes[who[g, j]], s[g, i, j]))
    if not out:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def descend(state: DataFrame, seed: int, parts: int, shards: int) -> DataFrame:
    """One round of NN-descent."""

    def meet(rows: Iterator[dict]) -> Iterator[dict]:
        for _, held in _runs(rows, "shard"):
            yield from _news(*_meeting(held), shards)

    there = _sent(state, shards, MEETING, seed)
    return _merged(state, packs.in_groups(there, parts, "shard", None, meet, _NEWS), parts)


_EDGES = "shard long, nodes binary, starts binary, others binary, places binary, vecs binary"


def search_edges(state: DataFrame, parts: int, shards: int) -> DataFrame:
    """A row for each shard: its nodes, and for each the nodes that list it, nearest first, with the
    places of their vectors."""

    def gather(rows: Iterator[dict]) -> Iterator[dict]:
        for shard, held in _runs(rows, "shard"):
            place, sender, _, nodes, x, _ = _received(held, EDGES)
            starts = _starts(place)
            yield {"shard": shard, "nodes": place[starts].tobytes(), "starts": np.r_[starts, len(place)].tobytes(), "others": nodes[sender].tobytes(), "places": sender.astype(np.int32).tobytes(), "vecs": x.tobytes()}

    return packs.in_groups(_sent(state, shards, EDGES, None), parts, "shard", None, gather, _EDGES)


def _graph(singles: DataFrame, count: int, parts: int, shards: int) -> DataFrame:
    """States after NN-descent."""
    blocks = max(1, -(-count // BLOCK))
    news = _block_lists(singles, blocks, 1, parts, shards)
    for k in range(1, PASSES if blocks > 1 else 1):
        news = news.unionByName(_block_lists(singles, blocks, 1 + k, parts, shards))
    state = materialize(_merged(_dealt(singles, 0, shards), news, parts), "graph")
    r, moving = 0, count > 1
    while moving:
        r += 1
        after = materialize(descend(state, r, parts, shards), "graph")
        discard(state)
        state = after
        _free_shuffles(singles.sparkSession)
        moving = r < ROUNDS or state.agg(F.sum("changed")).first()[0] > DELTA * LISTED * count
    return state


def _lists(state: DataFrame) -> DataFrame:
    """(node, ids, scores): each node's list of near nodes."""

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            nodes = packs.array(row["nodes"], np.int64)
            ids, scores = packs.array(row["ids"], np.int64).reshape(-1, LISTED), packs.array(row["scores"], np.float64).reshape(-1, LISTED)
            out = {"ids": [i[i >= 0].tobytes() for i in ids], "scores": [s[i >= 0].tobytes() for i, s in zip(ids, scores, strict=True)]}
            yield pa.RecordBatch.from_pydict({"node": nodes} | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    return state.select("nodes", "ids", "scores").mapInArrow(lists, "node long, ids binary, scores binary")


def build_graph(singles: DataFrame, count: int) -> DataFrame:
    """(node, ids, scores) after NN-descent."""
    parts = shuffle_partitions(singles.sparkSession)
    return _lists(_graph(singles, count, parts, _shards(count, parts)))


def _free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of past rounds, so that disk doesn't grow with the rounds."""
    spark.sparkContext._jvm.System.gc()


#: A row for some queries, named by the first: vectors and pools; ``open`` counts pool nodes not asked yet.
_POOL = "at long, queries binary, vecs binary, ids binary, scores binary, asked binary, open long"


def _open(ids: np.ndarray, asked: np.ndarray, most: int) -> np.ndarray:
    """Which nodes of pools are asked next."""
    left = (ids >= 0) & ~asked
    return left & (np.cumsum(left, axis=1) <= most)


def _start(queries: DataFrame, entries: tuple[np.ndarray, np.ndarray], pool: int) -> DataFrame:
    """A pool for each query (query, vec, ids, scores) from a fixed number of entry nodes, its own node
    and the nodes that this lists."""
    shared = queries.sparkSession.sparkContext.broadcast(entries)
    together = max(8, POOL_NODES // pool)

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            nodes, x = shared.value
            for b in batches:
                for a in range(0, b.num_rows, together):
                    part = b.slice(a, together)
                    own, vecs = part["query"].to_numpy(), part["vec"].to_pylist()
                    y, listed = _vectors(vecs), [len(i) // 8 for i in part["ids"].to_pylist()]
                    every = np.arange(len(own))
                    owner = np.concatenate([np.repeat(every, len(nodes)), every, np.repeat(every, listed)])
                    found = np.concatenate([np.tile(nodes, len(own)), own, packs.array(b"".join(part["ids"].to_pylist()), np.int64)])
                    s = np.concatenate([(y @ x.T).ravel(), np.einsum("ij,ij->i", y, y), packs.array(b"".join(part["scores"].to_pylist()), np.float64)])
                    ids, s, asked = _best_of_each(owner, found, s, np.zeros(len(s), dtype=bool), len(own), pool)
                    yield {"at": int(own[0]), "queries": own.tobytes(), "vecs": b"".join(vecs), "ids": ids.tobytes(), "scores": s.tobytes(), "asked": asked.tobytes(), "open": int((ids >= 0).sum())}

        return _emitted(made(), _POOL)

    return queries.mapInArrow(begin, _POOL)


_QUESTIONS = "shard long, at long, query binary, node binary, asker binary, vecs binary, worst binary"
_ANSWERS = "at long, query binary, ids binary, scores binary"


def _answered(rows: list[dict], there: dict) -> Iterator[dict]:
    """Scores of the edges of the asked nodes, where they can enter the pools."""
    known, starts, others, places = (packs.array(there[c], k) for c, k in (("nodes", np.int64), ("starts", np.int64), ("others", np.int64), ("places", np.int32)))
    x = np.frombuffer(there["vecs"], dtype=np.float32).reshape(places.max() + 1, -1) if len(places) else None
    for row in rows:
        query, node, asker = packs.array(row["query"], np.int32), packs.array(row["node"], np.int64), packs.array(row["asker"], np.int32)
        worst = packs.array(row["worst"], np.float64)
        own = _matrix(row["vecs"], len(worst)).astype(np.float64)
        at = np.minimum(np.searchsorted(known, node), len(known) - 1)
        has = known[at] == node
        at, query, asker = at[has], query[has], asker[has]
        out = []
        step = max(1, ANSWERED // EDGES)
        for a in range(0, len(at), step):
            first, sizes = starts[at[a : a + step]], starts[at[a : a + step] + 1] - starts[at[a : a + step]]
            edge = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            who = np.repeat(asker[a : a + step], sizes)
            s = np.einsum("ij,ij->i", x[places[edge]].astype(np.float64), own[who])
            good = np.flatnonzero(s > worst[who])
            out.append((np.repeat(query[a : a + step], sizes)[good], others[edge[good]], s[good]))
        if out:
            q, i, s = (np.concatenate(c) for c in zip(*out, strict=True))
            if len(q):
                yield {"at": row["at"], "query": q.tobytes(), "ids": i.tobytes(), "scores": s.tobytes()}


def _step(pools: DataFrame, edges: DataFrame, parts: int, shards: int, pool: int) -> DataFrame:
    """One round of search with pools of ``pool`` nodes."""
    most = max(1, ASKED * pool // POOL)

    def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(row["queries"]) // 8
        return tuple(packs.array(row[c], k).reshape(n, -1) for c, k in (("ids", np.int64), ("scores", np.float64), ("asked", bool)))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for row in _rows(batches):
                ids, scores, asked = unpacked(row)
                vecs = _matrix(row["vecs"], len(ids))
                worst = scores[:, -1]
                chosen = _open(ids, asked, most)
                query, node = np.nonzero(chosen)[0], ids[chosen]
                for shard, sel in _groups(_hashed(node, 0, shards)):
                    who, asker = np.unique(query[sel], return_inverse=True)
                    yield {"shard": shard, "at": row["at"], "query": query[sel].astype(np.int32).tobytes(), "node": node[sel].tobytes(), "asker": asker.astype(np.int32).tobytes(), "vecs": vecs[who].tobytes(), "worst": worst[who].tobytes()}

        return _emitted(made(), _QUESTIONS)

    def answer(questions: pa.Table, there: pa.Table) -> pa.Table:
        rows = list(_answered(questions.to_pylist(), there.to_pylist()[0])) if questions.num_rows and there.num_rows else []
        return pa.Table.from_pylist(rows, schema=pa.schema([("at", pa.int64()), ("query", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())]))

    def merge(rows: Iterator[dict]) -> Iterator[dict]:
        for at, held in _runs(rows, "at"):
            head, found = held[0], held[1:]
            ids, scores, asked = unpacked(head)
            asked = asked | _open(ids, asked, most)
            there = ids >= 0
            owner = np.concatenate([np.nonzero(there)[0], _joined(found, "queries", np.int32)])
            marks = np.r_[asked[there], np.zeros(len(owner) - there.sum(), dtype=bool)]
            new, s, asked = _best_of_each(owner, np.concatenate([ids[there], _joined(found, "ids", np.int64)]), np.concatenate([scores[there], _joined(found, "scores", np.float64)]), marks, len(ids), pool)
            yield {"at": at, "queries": head["queries"], "vecs": head["vecs"], "ids": new.tobytes(), "scores": s.tobytes(), "asked": asked.tobytes(), "open": int(((new >= 0) & ~asked).sum())}

    questions = pools.where("open > 0").mapInArrow(ask, _QUESTIONS)
    answers = questions.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(answer, _ANSWERS)
    none = F.lit(None).cast("binary")
    rows = pools.select("at", F.lit(0).alias("kind"), "queries", "vecs", "ids", "scores", "asked")
    rows = rows.unionByName(answers.select("at", F.lit(1).alias("kind"), F.col("query").alias("queries"), none.alias("vecs"), "ids", "scores", none.alias("asked")))
    return packs.in_groups(rows, parts, "at", "kind", merge, _POOL)


def true_neighbours(classes: DataFrame, queries: DataFrame) -> dict[int, set[int]]:
    """The best other nodes of ``SAMPLED`` queries by hash, from a full scan."""
    rows = queries.select("query").distinct().orderBy(F.xxhash64("query"), "query").limit(SAMPLED)
    rows = rows.join(classes.select(F.col("node").alias("query"), "embedding"), "query").collect()
    if not rows:
        return {}
    own = np.array([r["query"] for r in rows], dtype=np.int64)
    shared = classes.sparkSession.sparkContext.broadcast((own, np.array([r["embedding"] for r in rows], dtype=np.float64)))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, x = shared.value
        kept = [(np.array([], dtype=np.int64), np.array([], dtype=np.float64))] * len(nodes)
        for b in batches:
            there = b["node"].to_numpy()
            s = x @ np.array(b["embedding"].to_pylist(), dtype=np.float64).T
            s[nodes[:, None] == there[None, :]] = -np.inf
            kept = [_best(np.concatenate([i, there]), np.concatenate([v, row]), NEAREST) for (i, v), row in zip(kept, s, strict=True)]
        for q, (i, v) in zip(nodes.tolist(), kept, strict=True):
            yield pa.RecordBatch.from_pydict({"query": pa.array([q] * len(i), pa.int64()), "node": i, "score": v})

    best: dict[int, list[tuple[float, int]]] = {}
    for r in classes.select("node", "embedding").mapInArrow(scan, "query long, node long, score double").where(F.col("score") > float("-inf")).toLocalIterator():
        best[r["query"]] = sorted([*best.get(r["query"], []), (-r["score"], r["node"])])[:NEAREST]
    return {q: {n for _, n in found} for q, found in best.items()}


def _recall(pools: DataFrame, true: dict[int, set[int]]) -> float:
    """The share of the true neighbours that the pools hold among those scored again."""
    held = 0
    for row in pools.select("queries", "ids").toLocalIterator():
        queries = packs.array(row["queries"], np.int64).tolist()
        ids = packs.array(row["ids"], np.int64).reshape(len(queries), -1)[:, :RESCORED].tolist()
        held += sum(len(true[q] & set(i)) for q, i in zip(queries, ids, strict=True))
    return held / max(1, sum(map(len, true.values())))


def nearest(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    texts_in_small_batches(spark)
    parts = shuffle_partitions(spark)
    rows = valid_rows(vectors, vec_id, embedding)
    classes = materialize(distinct_vectors(rows), "vectors")
    singles = materialize(_singles(classes), "singles")
    count = singles.count()
    shards = _shards(count, parts)
    state = _graph(singles, count, parts, shards)
    edges = materialize(search_edges(state, parts, shards), "edges").repartition(parts, "shard").sortWithinPartitions("shard").persist(StorageLevel.DISK_ONLY)
    asking = rows.where(F.col("vec_id") % every == 0).distinct().join(classes.select("node", F.col("embedding")), "embedding").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    asking = materialize(asking, "asking")
    queries = asking.select("query").distinct().join(singles.withColumnRenamed("node", "query"), "query")
    queries = materialize(queries.join(_lists(state).withColumnRenamed("node", "query"), "query"), "queries")
    discard(state)

    def searched(some: DataFrame, pool: int) -> DataFrame:
        entries = singles.orderBy(F.xxhash64("node"), "node").limit(pool).collect()
        x = _vectors([r["vec"] for r in entries]) if entries else np.zeros((0, 1), dtype=np.float64)
        pools = materialize(_start(some, (np.array([r["node"] for r in entries], dtype=np.int64), x), pool), "pools")
        while pools.where("open > 0").limit(1).count():
            after = materialize(_step(pools, edges, parts, shards, pool), "pools")
            discard(pools)
            pools = after
            _free_shuffles(spark)
        return pools

    true, pool = true_neighbours(classes, asking), POOL
    sample = queries.where(F.col("query").isin(list(true)))
    while pool < count and true:
        tried = searched(sample, pool)
        recall = _recall(tried, true)
        discard(tried)
        if recall >= RECALL:
            break
        pool *= 2  # clusters without an edge between them are found only from entries of their own
    pools = searched(queries, pool)
    edges.unpersist()
    return _ranked(pools, classes, asking)


def _ranked(pools: DataFrame, classes: DataFrame, asking: DataFrame) -> DataFrame:
    """The best of each pool by exact scores, with the ids of equal vectors."""

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            queries = packs.array(row["queries"], np.int64)
            ids, scores = (packs.array(row[c], k).reshape(len(queries), -1) for c, k in (("ids", np.int64), ("scores", np.float64)))
            there = ids >= 0
            last = scores[np.arange(len(ids)), np.minimum(NEAREST, there.sum(1) - 1)] - ROUNDING * np.abs(np.where(there, scores, 0.0)).max(1)
            taken = there & ((np.arange(ids.shape[1]) < RESCORED) | (scores >= last[:, None]))
            yield pa.RecordBatch.from_pydict({"query": queries[np.nonzero(taken)[0]], "node": ids[taken]})

    pairs = pools.select("queries", "ids", "scores").mapInArrow(best, "query long, node long")
    found = pairs.join(classes.select("node", F.col("embedding").alias("theirs"), "ids"), "node").join(classes.select(F.col("node").alias("query"), F.col("embedding").alias("own")), "query")
    product = F.aggregate(F.zip_with("own", "theirs", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    listed = found.select("query", product.alias("score"), F.explode("ids").alias("vec_id"))
    ranked = listed.join(asking, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

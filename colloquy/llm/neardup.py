"""MinHash near-duplicates with tensored banding.

Each text's set of word shingles gets two small collections of ``tuples`` tuples of ``width``
minhashes.  A table key joins one tuple of each collection, so ``tuples`` squared tables need
minhashes only for twice ``tuples`` tuples: about the square root of the work.  Texts that meet
under a key are candidates; links are confirmed on full sets, with integers.

A pair at the threshold s meets unless one collection has no equal tuple, so it is missed with a
chance of at most 2 * (1 - s ** width) ** tuples (4e-4 for 0.8, 3, 12), and links of one group help
each other.

No step lists all pairs of a group.
1. Texts with equal sets are one class; copies go no further.
2. Under each key, classes meet the least one there (the pivot).  A class is confirmed against the
   pivot that it meets most often, and components are formed.
3. Pivots met otherwise are confirmed where they are in another component.
4. What remains is exact: a component and the classes outside it that met it are compared in
   blocks, by their differences from one member; a block streams past and only links are listed.
The confirmations stream the members of a pivot past its set; a pivot with many members is dealt
to many tasks.

Defined edge cases: a text with fewer words than a shingle has its whole sequence as the one
shingle; null texts and texts without words have the empty set, link with nothing and are kept.
A null id is never the least of a component unless it has no other; a row is kept if its id is
its component's, so null ids beside others go.  Rows with the same id and text are all kept or all
dropped by :func:`link_documents`; :func:`near_duplicate_stage` keeps one of them.  An empty table
gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packs
from .common import discard, free_name, materialize, shuffle_partitions, text_or_empty, texts_in_small_batches
from .graphs import components

WIDTH = 3
TUPLES = 12
#: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Guests that are compared at once, and classes that pass them in one task; and shingles of either.
GUESTS, PASSING = 512, 512
BLOCK_SHINGLES = 1 << 19
#: Tasks that the members of one group are dealt to while they find their places or their least id.
DEALS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    h = np.array(packs.word_hashes(text), dtype=np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, len(h))):
        out = _mixed(out * _MIX[0] + h[k : k + n])
    return np.unique(out)


def tuple_hashes(s: np.ndarray, width: int = WIDTH, tuples: int = TUPLES) -> np.ndarray:
    """The hashed tuples of both collections, the first ``tuples`` being the first collection."""
    seeds = _mixed(np.arange(1, 2 * width * tuples + 1, dtype=np.uint64) * _MIX[0])
    least = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 4096):
        least = np.minimum(least, _mixed(s[a : a + 4096][:, None] ^ seeds).min(0))
    sub = np.zeros(2 * tuples, dtype=np.uint64)
    for k in range(width):
        sub = _mixed(sub * _MIX[0] + least.reshape(-1, width)[:, k])
    return sub


def table_keys(sub: np.ndarray) -> np.ndarray:
    """Keys of all tables from rows of tuple hashes: each tuple of one collection with each of the other."""
    tuples = sub.shape[1] // 2
    table = np.arange(tuples * tuples, dtype=np.uint64).reshape(1, tuples, tuples)
    return _mixed(sub[:, :tuples, None] * _MIX[0] + _mixed(sub[:, None, tuples:] + table)).reshape(len(sub), -1)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document: id, hash of the text, size and digest of its set, tuple hashes."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, tuples = [], [], []
            for t in b["text"]:
                t = t.as_py()
                s = shingles(t, words)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                tuples.append(tuple_hashes(s).tobytes() if len(s) else None)
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tuples, pa.binary())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], *made], ["doc_id", "text_hash", "n_shingles", "digest", "tuples"])

    texts_in_small_batches(docs.sparkSession)
    return docs.select("doc_id", text_hash(), "text").mapInArrow(measure, "doc_id long, text_hash long, n_shingles long, digest binary, tuples binary")


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text)).alias("text_hash")


def _id_key(doc_id: str = "doc_id") -> Column:
    """The id, or the least number for a null id, so that keys can be equal."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)))


def _keys(classes: DataFrame) -> DataFrame:
    """A row for each class and table."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                sub = np.frombuffer(b"".join(part["tuples"].to_pylist()), dtype=np.uint64).reshape(part.num_rows, -1)
                keys = table_keys(sub)
                yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "node": np.repeat(part["node"].to_numpy(), keys.shape[1])})

    return classes.select("node", "tuples").mapInArrow(emit, "key long, node long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, salts: int) -> DataFrame:
    """The pairs (node, pivot) whose sets are similar enough."""
    salted = pairs.select("node", "pivot", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt"))
    members = salted.join(texts, "node").select("pivot", "salt", F.lit(1).alias("kind"), "node", "text")
    heads = salted.select("pivot", "salt").distinct().join(texts.select(F.col("node").alias("pivot"), "text"), "pivot").select("pivot", "salt", F.lit(0).alias("kind"), F.col("pivot").alias("node"), "text")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.array([], dtype=np.uint64)
        for b in batches:
            nodes, pivots = [], []
            for pivot, kind, node, text in zip(*(b[c].to_pylist() for c in ("pivot", "kind", "node", "text")), strict=True):
                if kind == 0:
                    if pivot != at:
                        at, head = pivot, shingles(text, words)
                elif linked(head, shingles(text, words)):
                    nodes.append(node)
                    pivots.append(pivot)
            yield pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array(pivots, pa.int64())})

    rows = heads.unionByName(members).repartition(shuffle_partitions(pairs.sparkSession), "pivot", "salt").sortWithinPartitions("pivot", "salt", "kind")
    return rows.mapInArrow(compare, "a long, b long")


def _across(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (node, pivot) whose ends lie in different components."""
    own = known.select("node", F.col("component").alias("c1"))
    other = known.select(F.col("node").alias("pivot"), F.col("component").alias("c2"))
    joined = pairs.join(own, "node", "left").join(other, "pivot", "left")
    return joined.where(F.coalesce("c1", "node") != F.coalesce("c2", "pivot")).select("node", "pivot")


def _remaining_links(met: DataFrame, known: DataFrame, texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """All links (a, b) between classes that share a key and lie in different components, one at least
    for each class and component that are linked.

    Two classes share a key only if both met its pivot (or one is it), so a component and the
    classes outside it that met a pivot of it (its guests) are compared as a group.  All are
    written as differences from one member; for sets x and y with what they lack and add,
        |x & y| = |p| - lack(x) - lack(y) + shared,   |x | y| = |p| + add(x) + add(y) - shared,
    where ``shared`` counts the common differences, found in sorted arrays of the guests'.  Guests
    come in blocks of bounded number and bounded shingles, and members stream past each block, so no
    pairs are listed and a worker's memory has a bound.
    """
    own = known.select("node", F.col("component").alias("c1"))
    other = known.select(F.col("node").alias("pivot"), F.col("component").alias("group"))
    both = met.join(own, "node", "left").join(other, "pivot", "left").select("node", "pivot", "times", F.coalesce("c1", "node").alias("component"), F.coalesce("group", "pivot").alias("group"))
    across = materialize(both.where("component <> group"), "across")
    guests = across.select("group", "node", "component").distinct()
    chosen = across.groupBy("group", "pivot").agg(F.sum("times").alias("times")).groupBy("group").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("head"))
    members = known.select(F.col("component").alias("group"), "node").unionAll(guests.select("group", F.col("group").alias("node"))).distinct()
    sizes = classes.select("node", "n_shingles")
    measured = guests.select("group", "node", F.lit(1).alias("guest")).unionAll(members.select("group", "node", F.lit(0).alias("guest"))).join(sizes, "node")
    counted = measured.groupBy("group").agg(
        F.sum("guest").alias("n_guests"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"), F.sum(F.col("guest") * F.col("n_shingles")).alias("guest_shingles")
    )
    groups = counted.where("n_guests > 1 OR n > n_guests + 1").join(chosen, "group")
    parts = lambda n, most, s: F.ceil(F.greatest(F.col(n) / most, F.col(s) / BLOCK_SHINGLES)).cast("int")
    groups = groups.select("group", "head", parts("n_guests", GUESTS, "guest_shingles").alias("blocks"), parts("n", PASSING, "shingles").alias("salts"))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    order = ["group", "block", "salt", "kind", "node", "component"]
    heads = groups.withColumn("block", every("blocks")).withColumn("salt", every("salts")).withColumn("node", F.col("head")).withColumn("component", F.col("group")).withColumn("kind", F.lit(0))
    spread = groups.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    placed = lambda rows: rows.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(DEALS)).cast("int")).join(spread, ["group", "deal"])
    sitting = placed(guests).withColumn("block", dealt("blocks")).withColumn("salt", every("salts")).withColumn("kind", F.lit(1))
    passing = placed(guests.unionByName(members.withColumn("component", F.col("group")))).withColumn("salt", dealt("salts")).withColumn("block", every("blocks")).withColumn("kind", F.lit(2))
    places = heads.select(order).unionByName(sitting.select(order)).unionByName(passing.select(order))
    rows = places.join(texts, "node").repartition(shuffle_partitions(met.sparkSession), "group", "block", "salt").sortWithinPartitions("group", "block", "salt", "kind")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, block = None, np.array([], dtype=np.uint64), _Guests()
        for b in batches:
            found: list[tuple[int, int]] = []
            for group, part, salt, kind, node, component, text in zip(*(b[c].to_pylist() for c in (*order, "text")), strict=True):
                if (group, part, salt) != at:
                    at, block = (group, part, salt), _Guests()
                s = shingles(text, words)
                if kind == 0:
                    head = s
                elif kind == 1:
                    block.add(node, component, head, s)
                else:
                    found += block.links(node, component, head, s)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.select(*order, "text").mapInArrow(compare, "a long, b long")


class _Guests:
    """Differences of a block of classes from one head, and the links that passing classes have with them."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.seen: set[int] = set()
        self.components: list[int] = []
        self.sizes: list[tuple[int, int]] = []
        self.parts: list[np.ndarray] = []
        self.index: tuple | None = None
        self.told: set[tuple[int, int]] = set()

    def add(self, node: int, component: int, head: np.ndarray, s: np.ndarray) -> None:
        if node not in self.seen:  # equal rows bring the text of a class repeatedly
            self.seen.add(node)
            lack, more = _differences(head, s)
            self.nodes.append(node)
            self.components.append(component)
            self.sizes.append((len(lack), len(more)))
            self.parts.append(np.concatenate([lack, more]))

    def links(self, node: int, component: int, head: np.ndarray, s: np.ndarray) -> list[tuple[int, int]]:
        if self.index is None:
            every = np.concatenate([*self.parts, np.array([], dtype=np.uint64)])
            order = np.argsort(every, kind="stable")
            owner = np.repeat(np.arange(len(self.parts)), [len(x) for x in self.parts])
            self.index = every[order], owner[order], np.array(self.sizes, dtype=np.int64).reshape(-1, 2), np.array(self.components, dtype=np.int64)
        every, owner, sizes, components_ = self.index
        lack, more = _differences(head, s)
        mine = np.concatenate([lack, more])
        first, last = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
        hit = np.repeat(first, last - first) + _counting(last - first)
        shared = np.bincount(owner[hit], minlength=len(sizes))
        both = len(head) - len(lack) - sizes[:, 0] + shared
        union = len(head) + len(more) + sizes[:, 1] - shared
        good = np.flatnonzero((100 * both >= PERCENT * union) & (components_ != component))
        out = [(self.nodes[k], node) for k in good if (k, component) not in self.told]
        self.told.update((k, component) for k in good)
        return out


def _differences(head: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.setdiff1d(head, s, assume_unique=True), np.setdiff1d(s, head, assume_unique=True)


def _counting(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _classes(sets: DataFrame) -> DataFrame:
    """Texts with equal sets: digest, number, the least id, id and hash of a text of it, tuple hashes."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), _id_key().alias("id"), "text_hash"))
    classes = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least_id"), one.alias("one"), F.first("tuples").alias("tuples"), F.first("n_shingles").alias("n_shingles"))
    return classes.select("digest", "n_shingles", "least_id", F.col("one.id").alias("id_key"), F.col("one.text_hash").alias("text_hash"), "tuples").withColumn("node", F.monotonically_increasing_id())


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """A text of each class; equal rows give it repeatedly."""
    rows = docs.select("doc_id", "text", text_hash()).withColumn("id_key", _id_key())
    return rows.join(classes.select("node", "id_key", "text_hash"), ["id_key", "text_hash"]).select("node", "text")


def link_documents(docs: DataFrame, *, words: int, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    salts = shuffle_partitions(spark)
    sets = materialize(_sets(docs, words), "sets")
    classes = materialize(_classes(sets), "classes")
    in_key = Window.partitionBy("key").orderBy("node")
    ranked = _keys(classes).select("key", "node", F.first("node").over(in_key).alias("pivot"), F.row_number().over(in_key).alias("rank"), F.lead("node").over(in_key).alias("next"))
    shared = ranked.where("rank > 1 OR next IS NOT NULL")
    met = materialize(shared.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("times")), "met")
    candidates = met.select("node").unionAll(met.select(F.col("pivot").alias("node"))).distinct()
    texts = materialize(_texts(docs, classes.join(candidates, "node", "left_semi")), "texts")
    best = met.groupBy("node").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("pivot"))
    known = materialize(components(_confirmed(best, texts, words, salts)), "components")
    for step in (lambda k: _confirmed(_across(met.select("node", "pivot"), k), texts, words, salts), lambda k: _remaining_links(met, k, texts, classes, words)):
        known = materialize(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(step(known))), "components")
    discard(texts)
    discard(met)
    deal = F.pmod(F.xxhash64("digest"), F.lit(DEALS)).cast("int").alias("deal")
    named = classes.join(known, "node", "left").select("digest", "least_id", deal, F.col("component").isNotNull().alias("grouped"), F.coalesce("component", "node").alias("component"))
    least = named.where("grouped").groupBy("component").agg(F.min("least_id").alias("component_id")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("least_id"))
    ids = named.join(least, ["component", "deal"], "left").select("digest", component.alias("component_id"))
    out = sets.join(ids, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_documents(docs, words=2).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, for small tables only.
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets), flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five words, 0.8) the document with the least
    id stays; of rows with the same id and words one.  Documents without words stay, as do columns."""
    links = link_documents(docs, words=5)
    own = {c: free_name(docs.columns, c) for c in ("__hash", "__id", "__turn", "__kept", "__size")}
    decided = links.groupBy(_id_key().alias(own["__id"]), F.col("text_hash").alias(own["__hash"])).agg(F.max("kept").alias(own["__kept"]), F.max("n_shingles").alias(own["__size"]))
    rows = docs.withColumn(own["__hash"], text_hash()).withColumn(own["__id"], _id_key()).join(decided, [own["__id"], own["__hash"]])
    turn = F.row_number().over(Window.partitionBy(own["__id"], own["__hash"]).orderBy(own["__hash"]))
    left = rows.where(F.col(own["__kept"]) | (F.col(own["__size"]) == 0)).withColumn(own["__turn"], turn)
    return left.where((F.col(own["__turn"]) == 1) | (F.col(own["__size"]) == 0)).select(*docs.columns)

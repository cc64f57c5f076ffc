"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, seeded selection.

The size of a document is its number of words.  Sources, ordered by code point with null last,
weigh 1, 2, 3, repeating, and share the total size by weight; a target stops at ``max_repeats``
times its source's size and the excess is shared again by weight.  Blocks of ``block_words`` words
go to sources, then to groups of shards, then to shards, by highest quotient.  A shard lays its
documents out in a seeded order and cuts them into equal blocks (the last may be short).  With a
quota of q on K blocks every block is taken q div K times, and q mod K blocks at a seeded offset
once more, so the words taken from any document follow in closed form from its place in the
shard; no block row is ever made and no text is shuffled.

Windows are bounded: a shard holds about ``shard_words`` words of whatever source (a large
source just has more shards), and apportionment runs over at most ``fan_out`` shards or groups at
a time.  Only the table with one row per source is ordered as a whole.

Defined edge cases: null text has size 0, takes no part and gets ``taken`` 0; a null source is a
source of its own; repeated rows each count; an empty table gives no rows.  The order in a shard
hangs on the seed, id and size, so reruns agree and repeated rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, free_name, text_or_empty

SEED = 17
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 17
FAN_OUT = 4096
MAX_REPEATS = 3


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``__id``, ``__source``, ``__size`` and whatever else is in ``docs``."""
    return docs.withColumns({"__size": F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")})


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources reach their cap in the order of size over weight.  A source is capped if, with all
    earlier ones at their caps, its share of the rest would pass its cap; that test is a running
    sum, so one ordered pass finds the level for all.
    """
    per_source = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    weighed = per_source.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("__source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = max_repeats * F.col("source_size")
    tested = weighed.withColumns(
        {
            "rest": F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(earlier), F.lit(0)),
            "rest_weight": F.sum("weight").over(later),
        }
    ).withColumn("capped", cap * F.col("rest_weight") < F.col("rest") * F.col("weight"))
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    free_words = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(whole), F.lit(0))
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(free_words.cast("double") * F.col("weight") / free_weight)
    return tested.select("__source", "source_size", target.alias("target"))


def apportion(parts: DataFrame, within: list[str], order: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: give the ``seats`` of each group ``within`` to its rows by highest quotients.

    The divisor method equals rounding weight / divisor.  Rounding the exact share comes within
    half a seat per row of the right sum; the rest are given or taken back by quotient, and a row
    offers only as many candidate seats as its weight can win, so the work is linear in the rows.
    """
    group = Window.partitionBy(*within)
    w = F.col(weight).cast("double")
    share = F.when(F.sum(w).over(group) > 0, F.col(seats) * w / F.sum(w).over(group)).otherwise(F.lit(0.0))
    first = parts.withColumn("__share", share).withColumn("__seats", F.floor(F.col("__share") + 0.5))
    lack = F.when(F.sum(w).over(group) > 0, F.col(seats) - F.sum("__seats").over(group)).otherwise(F.lit(0))
    offer = F.when(F.sum(w).over(group) > 0, F.ceil(1.5 * F.count(F.lit(1)).over(group) * w / F.sum(w).over(group))).otherwise(0) + 1
    first = first.withColumns({"__lack": lack.cast("long"), "__offer": offer.cast("int")})
    # Seat k of a row (from 1) has quotient weight / (2k - 1).
    up = F.col("__lack") > 0
    candidates = (
        first.where("__lack <> 0").select(*within, *order, "__lack", "__seats", w.alias("__w"), F.explode(F.sequence(F.lit(1), F.col("__offer"))).alias("__k"))
        .withColumn("__seat", F.when(up, F.col("__seats") + F.col("__k")).otherwise(F.col("__seats") - F.col("__k") + 1))
        .where("__seat >= 1")
        .withColumn("__quotient", F.col("__w") / (2 * F.col("__seat") - 1))
    )
    # Highest first when seats are lacking; lowest first when some must go back.
    rank = Window.partitionBy(*within).orderBy(
        F.when(up, -F.col("__quotient")).otherwise(F.col("__quotient")), *(F.when(up, F.col(c)) .asc_nulls_last() for c in order), *(F.when(~up, F.col(c)).desc_nulls_first() for c in order)
    )
    moved = (
        candidates.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= F.abs("__lack"))
        .groupBy(*within, *order).agg(F.sum(F.sign("__lack")).cast("long").alias("__moved"))
    )
    keys = [*within, *order]
    moved = moved.select(*(F.col(c).alias(f"__m{i}") for i, c in enumerate(keys)), "__moved")
    same = [F.col(c).eqNullSafe(F.col(f"__m{i}")) for i, c in enumerate(keys)]
    joined = first.join(moved, same, "left").withColumn(out, F.col("__seats") + F.coalesce("__moved", F.lit(0)))
    return joined.drop("__share", "__seats", "__lack", "__offer", "__moved", *(f"__m{i}" for i in range(len(keys))))


def quotas(placed: DataFrame, targets: DataFrame, block_words: int, fan_out: int) -> DataFrame:
    """Blocks (``K``) and quota (``q``) of each shard, by three levels of apportionment."""
    shards = placed.groupBy("__source", "__shard").agg(F.sum("__size").alias("words")).where("words > 0")
    shards = shards.withColumns({"__group": F.floor(F.col("__shard") / fan_out), "K": F.ceil(F.col("words") / block_words)})
    groups = shards.groupBy("__source", "__group").agg(F.sum("words").alias("words"))
    seats = targets.withColumns({"__all": F.lit(0), "seats": F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")})
    per_source = apportion(seats, ["__all"], ["__source"], "target", "seats", "__quota").select(F.col("__source").alias("__s"), "__quota")
    by_source = F.col("__source").eqNullSafe(F.col("__s"))
    per_group = apportion(groups.join(per_source, by_source).drop("__s"), ["__source"], ["__group"], "words", "__quota", "__group_quota")
    per_group = per_group.select(F.col("__source").alias("__s"), F.col("__group").alias("__g"), "__group_quota")
    merged = shards.join(per_group, by_source & (F.col("__group") == F.col("__g"))).drop("__s", "__g")
    per_shard = apportion(merged, ["__source", "__group"], ["__shard"], "words", "__group_quota", "q")
    return per_shard.select(F.col("__source").alias("__s"), F.col("__shard").alias("__h"), "K", "q")


def _hashed(seed: int, *parts: Column) -> Column:
    """A seeded hash that any SQL engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, fan_out: int = FAN_OUT, max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``, and the struct
    ``place`` (start word in the shard, K, q, offset) from which :func:`selected` tells the blocks."""
    sizes = sized(docs.select(F.col(doc_id).alias("__id"), F.col(source).alias("__source"), F.col(text).alias("__text")), "__text").select("__id", "__source", "__size")
    return place(sizes, seed, block_words, shard_words, fan_out, max_repeats)


def place(sizes: DataFrame, seed: int, block_words: int, shard_words: int, fan_out: int, max_repeats: int) -> DataFrame:
    targets = source_targets(sizes, max_repeats)
    order = _hashed(seed, F.col("__id"), F.col("__size"))
    by_source = F.col("__source").eqNullSafe(F.col("__s"))
    known = targets.withColumnRenamed("__source", "__s")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    placed = sizes.join(known, by_source).drop("__s").withColumn("__order", order)
    placed = placed.withColumn("__shard", _number(F.substring("__order", 9, 8)) % shards)
    q = quotas(placed, targets, block_words, fan_out)
    in_shard = Window.partitionBy("__source", "__shard").orderBy("__order", F.col("__id").asc_nulls_last(), "__size")
    laid = placed.withColumn("__start", F.sum("__size").over(in_shard) - F.col("__size"))
    full = laid.join(q, by_source & (F.col("__shard") == F.col("__h")), "left").drop("__s", "__h")
    offset = _number(_hashed(seed, F.col("__source"), F.col("__shard"))) % F.col("K")
    spot = F.struct(F.col("__start").alias("start"), F.coalesce("K", F.lit(1)).alias("K"), F.coalesce(F.least("q", max_repeats * F.col("K")), F.lit(0)).alias("q"), F.coalesce(offset, F.lit(0)).alias("offset"))
    taken = _taken(F.col("place"), F.col("size"), block_words)
    return (
        full.withColumn("place", spot).select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", "place")
        .withColumn("taken", taken.cast("long"))
    )


def _steps(p: Column, b: Column) -> Column:
    """Blocks of the last, partial round that are selected among the first ``b``."""
    return F.floor((b * (p["q"] % p["K"]) + p["offset"]) / p["K"]).cast("long") - F.floor(p["offset"] / p["K"]).cast("long")


def selected(p: Column, word: Column, block_words: int) -> Column:
    """1 if the block of this word (from 0, in the document) is selected in the partial round, else 0."""
    b = F.floor((p["start"] + word) / block_words).cast("long")
    return _steps(p, b + 1) - _steps(p, b)


def _taken(p: Column, size: Column, block_words: int) -> Column:
    """Words of a document that the mix takes: whole rounds, plus its part of the selected blocks."""
    upto = lambda x: _steps(p, F.floor(x / block_words).cast("long")) * block_words + (x % block_words) * (
        _steps(p, F.floor(x / block_words).cast("long") + 1) - _steps(p, F.floor(x / block_words).cast("long"))
    )
    rounds = F.floor(p["q"] / p["K"]).cast("long")
    return rounds * size + upto(p["start"] + size) - upto(p["start"])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pipeline stage: each whole round is a full copy of the document, the partial round a row with
    the words of its selected blocks (each word with the white space behind it).  Columns stay, and
    ``n_chars`` follows the text.

    Documents meet their place again by id, source and size; of rows alike in all three each
    takes the place of the same number, whichever that is: their places are interchangeable.
    Documents without words go, as do empty tables' none; null ids and sources are values like others.
    """
    own = {c: free_name(docs.columns, c) for c in ("__id", "__source", "__size", "__n", "place", "__p0", "__p1", "__p2", "__p3", "__text")}
    key = [own["__id"], own["__source"], own["__size"], own["__n"]]
    counted = docs.withColumns({own["__id"]: F.col("doc_id"), own["__source"]: F.col("source"), own["__size"]: F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")})
    alike = Window.partitionBy(*key[:3]).orderBy(*([F.xxhash64("text")] if "text" in docs.columns else [F.lit(0)]))
    numbered = counted.withColumn(own["__n"], F.row_number().over(alike))
    sizes = counted.select(F.col(key[0]).alias("__id"), F.col(key[1]).alias("__source"), F.col(key[2]).alias("__size"))
    places = place(sizes, SEED, block_words, SHARD_WORDS, FAN_OUT, MAX_REPEATS).where("taken > 0")
    turn = Window.partitionBy("doc_id", "source", "size").orderBy("place")
    places = places.withColumn("n", F.row_number().over(turn)).select(*(F.col(c).alias(own[f"__p{i}"]) for i, c in enumerate(("doc_id", "source", "size", "n"))), F.col("place").alias(own["place"]))
    joined = numbered.join(places, [F.col(c).eqNullSafe(F.col(own[f"__p{i}"])) for i, c in enumerate(key)])
    p, text = F.col(own["place"]), text_or_empty()
    rounds = F.floor(p["q"] / p["K"]).cast("int")
    pieces = F.regexp_extract_all(text, F.lit(f"({SPACE_CLASS}*{WORD}{SPACE_CLASS}*)"), F.lit(1))
    part = F.array_join(F.filter(pieces, lambda x, i: selected(p, i, block_words) == 1), "")
    texts = F.filter(F.concat(F.array_repeat(text, rounds), F.array(part)), lambda t: t != "")
    new = {"text": F.col(own["__text"]), "n_chars": F.length(own["__text"]).cast("long")}
    columns = [new[c].alias(c) if c in new else F.col(c) for c in docs.columns]
    return joined.withColumn(own["__text"], F.explode(texts)).select(*columns)


#: The same result in DuckDB's SQL, quotas included.
OP3_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes GROUP BY source
), tested AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum({MAX_REPEATS} * source_size) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest,
    sum(weight) OVER (e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM per_source WINDOW e AS (ORDER BY source_size / weight, source ASC NULLS LAST)
), marked AS (
  SELECT *, {MAX_REPEATS} * source_size * rest_weight < rest * weight AS capped FROM tested
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN ({MAX_REPEATS} * source_size)::DOUBLE
    ELSE (sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN {MAX_REPEATS} * source_size END) OVER (), 0))::DOUBLE * weight
      / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target
  FROM marked
), hashed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.size::VARCHAR) AS o
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, ('0x' || substr(o, 9, 8))::BIGINT % greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS shard FROM hashed
), laid AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY o, doc_id ASC NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM placed
), shards AS (
  SELECT source, shard, sum(size)::BIGINT AS words, ceil(sum(size) / {BLOCK_WORDS})::BIGINT AS k FROM placed GROUP BY source, shard HAVING sum(size) > 0
), seats AS (
  SELECT source, target, round((SELECT sum(target) FROM targets) / {BLOCK_WORDS})::BIGINT AS seats, target / nullif(sum(target) OVER (), 0) AS part, count(*) OVER () AS n FROM targets
), source_candidates AS (
  SELECT source, seat, target / (2 * seat - 1) AS quotient, seats FROM (
    SELECT *, unnest(generate_series(greatest(1, floor(seats * part)::BIGINT - n), ceil(seats * part)::BIGINT + n + 1)) AS seat FROM seats)
), source_quotas AS (
  SELECT s.source, coalesce(max(c.seat), 0) AS quota FROM seats s LEFT JOIN (
    SELECT a.source, a.seat FROM (
      SELECT c.source, c.seat, row_number() OVER (ORDER BY quotient DESC, c.source ASC NULLS LAST) AS r,
        c.seats - (SELECT sum(greatest(1, floor(seats * part)::BIGINT - n) - 1) FROM seats) AS given FROM source_candidates c) a
    WHERE r <= given) c ON c.source IS NOT DISTINCT FROM s.source GROUP BY s.source
), shard_parts AS (
  SELECT h.source, h.shard, h.words, h.k, q.quota, h.words / sum(h.words) OVER g AS part, count(*) OVER g AS n
  FROM shards h JOIN source_quotas q ON h.source IS NOT DISTINCT FROM q.source WINDOW g AS (PARTITION BY h.source)
), shard_candidates AS (
  SELECT source, shard, seat, words / (2 * seat - 1) AS quotient FROM (
    SELECT *, unnest(generate_series(greatest(1, floor(quota * part)::BIGINT - n), ceil(quota * part)::BIGINT + n + 1)) AS seat FROM shard_parts)
), given AS (
  SELECT source, any_value(quota) - sum(greatest(1, floor(quota * part)::BIGINT - n) - 1) AS given FROM shard_parts GROUP BY source
), shard_quotas AS (
  SELECT p.source, p.shard, p.k, least(coalesce(max(c.seat), 0), {MAX_REPEATS} * p.k)::BIGINT AS q FROM shard_parts p LEFT JOIN (
    SELECT r.source, r.shard, r.seat FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard) AS r FROM shard_candidates) r
    JOIN given v ON r.source IS NOT DISTINCT FROM v.source WHERE r.r <= v.given) c ON c.source IS NOT DISTINCT FROM p.source AND c.shard = p.shard
  GROUP BY p.source, p.shard, p.k
), spot AS (
  SELECT l.*, coalesce(s.k, 1) AS k, coalesce(s.q, 0) AS q,
    coalesce(('0x' || substr(md5('{SEED}:' || coalesce(l.source, '') || ':' || l.shard::VARCHAR), 1, 8))::BIGINT % s.k, 0) AS o2
  FROM laid l LEFT JOIN shard_quotas s ON l.source IS NOT DISTINCT FROM s.source AND l.shard = s.shard
), ends AS (
  SELECT *, start // {BLOCK_WORDS} AS b0, start % {BLOCK_WORDS} AS r0, (start + size) // {BLOCK_WORDS} AS b1, (start + size) % {BLOCK_WORDS} AS r1, q % k AS m FROM spot
)
SELECT doc_id, size, source_size, target,
  ((q // k) * size
    + ((b1 * m + o2) // k) * {BLOCK_WORDS} + r1 * (((b1 + 1) * m + o2) // k - (b1 * m + o2) // k)
    - ((b0 * m + o2) // k) * {BLOCK_WORDS} - r0 * (((b0 + 1) * m + o2) // k - (b0 * m + o2) // k))::BIGINT AS taken
FROM ends
"""

"""URL filters: a sort-merge range join between rules and urls.

A host is written with its labels reversed, so that a rule's host and all its subdomains form one
interval of keys.  Urls and rules are dealt to partitions by key ranges (a rule to every range
that its interval touches), sorted, and swept once: a stack holds the rules whose intervals are
open, the innermost on top.  Memory is the stack, however many rows share a host; ranges also
split on a hash of the url, so a host with a third of all rows spreads over many tasks.

Defined edge cases: a null url, or one without ``://``, has empty host and path and matches only
the default verdict.  Repeated urls and rules are judged alike.  Of rules that fit, the longest
(host and path together) wins, then the one with the longer host, then block before allow.
An empty table of urls or rules gives no rows or only default verdicts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

#: Sorts below every character that occurs in a label.
LABEL_END = "\x01"
DEFAULT_VERDICT = "allow"
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Keys read for each range bound; the sample only places bounds and decides nothing else.
SAMPLE_PER_RANGE = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), LABEL_END), F.lit(LABEL_END))


Bound = tuple[str, int]


def _bounds(urls: DataFrame, ranges: int) -> list[Bound]:
    """Bounds of about equal ranges, from the keys with the smallest hashes."""
    rows = urls.select("__key", "__salt").orderBy("__salt").limit(SAMPLE_PER_RANGE * ranges).collect()
    # Rows with the smallest hashes are a random sample of the keys, but their salts are all alike: deal those evenly.
    keys = sorted(r["__key"] for r in rows)
    out: list[Bound] = []
    for k in range(1, ranges):
        at = len(keys) * k // ranges
        if keys:
            key = keys[at]
            first, last = bisect_left(keys, key), bisect_right(keys, key)
            out.append((key, int(-(1 << 63) + (1 << 64) * (at - first + 1) // (last - first + 1))))
    return sorted(set(out))


def _deal(urls: DataFrame, bounds: list[Bound]) -> DataFrame:
    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(bounds, x) for x in zip(b["__key"].to_pylist(), b["__salt"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "__range"])

    return urls.mapInArrow(assign, T.StructType([*urls.schema.fields, T.StructField("__range", T.IntegerType())]))


def _deal_rules(rules: DataFrame, bounds: list[Bound]) -> DataFrame:
    """Each rule once for every range that its interval of keys touches."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, which = [], []
            for i, k in enumerate(b["__key"].to_pylist()):
                span = range(bisect_right(bounds, (k, -(1 << 63) - 1)), bisect_right(bounds, (k + "\U0010ffff", 1 << 63)) + 1)
                at += span
                which += [i] * len(span)
            again = b.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(at, pa.int32())], [*b.schema.names, "__range"])

    return rules.mapInArrow(assign, T.StructType([*rules.schema.fields, T.StructField("__range", T.IntegerType())]))


class _Open:
    """The rules of one host whose interval is open, by the length of their path."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.by_length: dict[int, dict[str, tuple[str, str]]] = {}

    def add(self, path: str, rule: str, verdict: str) -> None:
        same = self.by_length.setdefault(len(path), {})
        if path not in same or verdict == "block":
            same[path] = rule, verdict

    def best(self, path: str) -> tuple[int, tuple[str, str]] | None:
        return max(((n, x) for n, same in self.by_length.items() if (x := same.get(path[:n])) and len(path) >= n), default=None)


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[_Open] = []
    at = None
    for b in batches:
        rule, verdict = [], []
        columns = [b[c].to_pylist() for c in ("__range", "__key", "__is_url", "__path", "__rule", "__verdict")]
        for rng, key, is_url, path, name, says in zip(*columns, strict=True):
            if rng != at:
                at, stack = rng, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if not is_url:
                if not stack or stack[-1].key != key:
                    stack.append(_Open(key))
                stack[-1].add(path, name, says)
                continue
            found = None
            for host in stack:
                if (x := host.best(path)) and (found is None or (len(host.key) + x[0], len(host.key)) > found[0]):
                    found = (len(host.key) + x[0], len(host.key)), x[1]
            rule.append(found[1][0] if found else None)
            verdict.append(found[1][1] if found else None)
        urls = b.filter(b["__is_url"])
        yield pa.RecordBatch.from_arrays(
            [urls["__row"], urls["__host"], urls["__path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["__row", "__host", "__path", "__rule", "__verdict"]
        )


def match_rules(urls: DataFrame, rules: DataFrame, *, url: str = "url", default: str = DEFAULT_VERDICT, ranges: int | None = None) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns so named give way).

    ``rules`` has columns verdict, host and path, and may be as large as the urls.
    """
    spark = urls.sparkSession
    n = ranges or shuffle_partitions(spark)
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    keyed = urls.select(F.struct(*(urls[c] for c in kept)).alias("__row"), host_of(urls[url]).alias("__host"), path_of(urls[url]).alias("__path"))
    keyed = keyed.withColumns({"__key": host_key(F.col("__host")), "__salt": F.xxhash64("__row")})
    bounds = _bounds(keyed, n)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    dealt = _deal(keyed, bounds)
    row_type = keyed.schema["__row"].dataType
    dealt = dealt.select("__range", "__key", F.lit(True).alias("__is_url"), "__path", none("__rule", "string"), none("__verdict", "string"), "__host", "__row")
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        host_key(F.translate("host", UPPER, LOWER)).alias("__key"), F.col("path").alias("__path"), F.concat("host", "path").alias("__rule"), F.col("verdict").alias("__verdict")
    )
    listed = _deal_rules(listed, bounds).select("__range", "__key", F.lit(False).alias("__is_url"), "__path", "__rule", "__verdict", none("__host", "string"), none("__row", row_type))
    both = dealt.unionByName(listed).repartition(n, "__range").sortWithinPartitions("__range", "__key", "__is_url", "__path")
    out = T.StructType([T.StructField("__row", row_type), *(T.StructField(c, T.StringType()) for c in ("__host", "__path", "__rule", "__verdict"))])
    swept = both.mapInArrow(_sweep, out)
    return swept.select(
        *(F.col("__row")[c].alias(c) for c in kept), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict")
    )


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "verdict string, host string, path string")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return match_rules(pages, contract_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP10_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
rest AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT n, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), fits AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.n ORDER BY length(r.host) + length(r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT_VERDICT}') AS verdict FROM fits WHERE k = 1
"""

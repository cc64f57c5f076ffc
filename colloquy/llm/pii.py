"""Personal data: patterns, and terms that give a protected entity away.

Patterns find e-mail addresses, IP addresses, card numbers and telephone numbers.  Each distinct
value is a protected entity.  How strongly a term t reveals an entity e is estimated from the
whole corpus: with D documents, n(e) and n(t) of them holding e and t, and n(e, t) holding t
within ``WINDOW`` terms of e, the disclosure is

    PMI(e; t) / IC(e) = 1 + log(n(e, t) / n(t)) / log(D / n(e)),

which is 1 if t occurs near e only.  In place of the share n(e, t) / n(t) stands its lower
confidence bound (Wilson, ``Z`` standard errors), where s different surroundings of e that show t
count as s observations, so that copies of one text are one piece of evidence and few count less.  In all documents, terms with a
disclosure of at least ``GENERALISE`` for any e become their kind wherever they stand, and from
``REMOVE`` on they go.

One pass finds patterns and the terms near them; a second counts documents for those terms only,
and a third finds all places of those that disclose; they are recognised by a bit table of fixed size that all other words pass by (a false hit is only one
more counted word).  Counts and joins are by hash, pre-aggregated; texts are not shuffled.

Defined edge cases: null text is empty; repeated rows count as documents and get the same spans;
an entity that is in every document discloses nothing; an empty table gives no rows; very long texts
are scanned whole, one at a time; columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packs
from .common import discard, free_name, materialize, text_or_empty, texts_in_small_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
Z = 1.645
GENERALISE, REMOVE = 0.8, 0.95
#: Bits of the table that recognises counted terms.
TABLE_BITS = 1 << 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"\w[\w'-]*")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """The local part cannot hold an @, so it is the run of its characters before each one."""
    out: list[Span] = []
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            end = m.end()
    return out


def _small(number: str) -> bool:
    digits = number.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def ips(text: str) -> list[Span]:
    """Runs of numbers with single dots between, taken four at a time; linear in long runs of digits."""
    out = []
    for m in _NUMBERS.finditer(text):
        numbers = m[0].split(".")
        at = m.start()
        for k in range(0, len(numbers) - 3, 4):
            end = at + sum(map(len, numbers[k : k + 4])) + 3
            if all(map(_small, numbers[k : k + 4])):
                out.append((at, end))
            at = end + 1
    return out


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All pattern spans by kind as listed, then start."""
    found = [("email", s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", s) for s in ips(text)] + [("card", s) for s in cards(text)]
        found += [("phone", s) for s in phones(text)] if "+" in text else []
    return [(k, a, b) for k, (a, b) in found]


def spans_text(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) - (1 << 63)


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> list[re.Match]:
    """The terms outside the spans."""
    terms = [m for m in _TERM.finditer(text) if not m[0].isdigit()]
    covered = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in covered]

    def outside(m: re.Match) -> bool:
        k = bisect_left(starts, m.end())
        return all(b <= m.start() for _, b in covered[max(0, k - len(KINDS)) : k])

    return [m for m in terms if outside(m)]


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Terms near each entity; a row with term 0 for each entity, once.  ``first`` marks the first of
    equal (entity, term) in the document, ``fresh`` that of equal terms."""
    terms = free_terms(text, spans)
    places = [m.start() for m in terms]
    out, seen, fresh = [], set(), set()
    for kind, a, b in spans:
        entity = _hash(f"{kind}:{text[a:b].lower()}")
        at = bisect_left(places, a)
        near = [*terms[max(0, at - WINDOW) : at], *terms[at : at + WINDOW]]
        context = _hash(" ".join(m[0].lower() for m in near))
        if (entity, 0) not in seen:
            seen.add((entity, 0))
            out.append({"entity": entity, "term": 0, "context": 0, "first": 1, "fresh": 0})
        for m in near:
            term = _hash(m[0].lower())
            out.append({"entity": entity, "term": term, "context": context, "first": int((entity, term) not in seen), "fresh": int(term not in fresh)})
            seen.add((entity, term))
            fresh.add(term)
    return out


_MENTION = "array<struct<entity:long,term:long,context:long,first:int,fresh:int>>"


def find(docs: DataFrame) -> DataFrame:
    """A row for each document: id, text_hash, base spans (text), counts by kind, terms near entities."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(f"doc_id long, text_hash long, base string, n array<long>, near {_MENTION}")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        for b in batches:
            rows = {"base": [], "n": [], "near": []}
            for t in b["text"]:
                text = t.as_py() or ""
                spans = base_spans(text)
                rows["base"].append(spans_text(spans))
                rows["n"].append([sum(k == kind for k, _, _ in spans) for kind in KINDS])
                rows["near"].append(mentions(text, spans) if spans else [])
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "text_hash": b["text_hash"]} | rows, schema=arrow)

    texts_in_small_batches(docs.sparkSession)
    return docs.select("doc_id", text_hash(), "text").mapInArrow(scan, target)


def text_hash() -> Column:
    return F.xxhash64(text_or_empty()).alias("text_hash")


def _bit(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) % np.uint64(TABLE_BITS)).astype(np.int64)


def _bit_table(terms: DataFrame) -> np.ndarray:
    """One bit for each term's hash; merged in slices, so that its size is the same for any corpus."""
    slices = 16
    width = TABLE_BITS // slices

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(TABLE_BITS, dtype=bool)
        for b in batches:
            bits[_bit(b["term"].to_numpy())] = True
        parts = [np.packbits(bits[k * width : (k + 1) * width]).tobytes() for k in range(slices)]
        if bits.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(slices), pa.int32()), "bits": parts})

    def merge(rows: Iterator[dict]) -> Iterator[dict]:
        at, bits = None, None
        for row in rows:
            own = packs.array(row["bits"], np.uint8)
            if row["part"] != at:
                if bits is not None:
                    yield {"part": at, "bits": bits.tobytes()}
                at, bits = row["part"], own.copy()
            else:
                bits |= own
        if bits is not None:
            yield {"part": at, "bits": bits.tobytes()}

    out = np.zeros((slices, width), dtype=bool)
    for row in packs.in_groups(terms.mapInArrow(mark, "part int, bits binary"), slices, "part", None, merge, "part int, bits binary").toLocalIterator():
        out[row["part"]] = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8)).astype(bool)
    return out.ravel()


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many documents each of the terms occurs (and a few others, by false hits)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(_bit_table(terms)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        held, waiting = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"term": h, "n": pa.array(n, pa.int64())})

        for b in batches:
            for t in b["text"]:
                words = {x.lower() for x in _TERM.findall(t.as_py() or "")}
                h = np.array([_hash(x) for x in words], dtype=np.int64)
                h = h[table[_bit(h)]] if len(h) else h
                held.append(h)
                waiting += len(h)
                if waiting > 1_000_000:
                    yield flush()
                    held, waiting = [], 0
        if waiting:
            yield flush()

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def lower_share(share: Column, hits: Column) -> Column:
    """Wilson's lower bound of a share in which ``hits`` observations are hits."""
    n = hits / share
    middle, width = share + Z * Z / (2 * n), Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))
    return (middle - width) / (1 + Z * Z / n)


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, disclosure) for the pairs that pass the lower threshold."""
    total = docs.count()
    near = found.select(F.inline("near"))
    entities = near.where("term = 0").groupBy("entity").agg(F.sum("first").alias("n_e"))
    pairs = near.where("term <> 0").groupBy("entity", "term", "context").agg(F.sum("first").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("n_et"))
    content = F.log(F.lit(float(max(total, 1))) / F.col("n_e"))

    def disclosure(n_t: str) -> Column:
        share = lower_share(F.col("n_et") / F.greatest(n_t, "n_et"), F.col("support"))
        return F.when(content > 0, 1 + F.log(share) / content).otherwise(F.lit(0.0))

    # A term is in no fewer documents than those that show it near any entity, and disclosure falls with
    # that number, so pairs below the threshold by this count can't reach it by the full one.
    beside = near.where("term <> 0").groupBy("term").agg(F.sum("fresh").alias("n_near"))
    pairs = materialize(pairs.join(entities, "entity").join(beside, "term").where(disclosure("n_near") >= GENERALISE), "pairs")
    counts = document_counts(docs, pairs.select("term").distinct())
    return pairs.join(counts, "term").withColumn("disclosure", disclosure("n_t")).where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): the terms to treat in each document that has any, by start,
    wherever they stand; the bit table finds them, the join by hash decides."""
    known = terms.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(_bit_table(known.select("term"))))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            rows = {"doc_id": [], "text_hash": [], "term": [], "start": [], "end": []}
            for i, own, t in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), b["text"], strict=True):
                text = t.as_py() or ""
                words = list({x.lower() for x in _TERM.findall(text)})
                h = np.array([_hash(x) for x in words], dtype=np.int64)
                hits = {words[k]: int(h[k]) for k in np.flatnonzero(table[_bit(h)])}
                for m in free_terms(text, base_spans(text)) if hits else ():
                    if m[0].lower() in hits:
                        for name, x in zip(rows, (i, own, hits[m[0].lower()], m.start(), m.end()), strict=True):
                            rows[name].append(x)
            yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int32() if n in ("start", "end") else pa.int64()) for n, x in rows.items()})

    places = docs.select("doc_id", text_hash(), "text").mapInArrow(scan, "doc_id long, text_hash long, term long, start int, end int").distinct()
    return places.join(known, "term").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))


def analyse(docs: DataFrame) -> DataFrame:
    """A row for each document: id, counts, ``base`` and ``terms`` (start, end, disclosure)."""
    found = materialize(find(docs), "pii")
    spans = _treated(docs, found).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "terms")
    return found.join(spans, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left").drop("i", "h", "near")


def _treated(docs: DataFrame, found: DataFrame) -> DataFrame:
    disclosing = materialize(disclosing_terms(docs, found), "disclosing")
    spans = materialize(term_spans(docs, disclosing), "terms")
    discard(disclosing)
    return spans


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = analyse(docs)
    kind = lambda t: F.when(t["disclosure"] >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise"))
    extra = F.array_join(F.transform(F.coalesce("terms", F.array()), lambda t: F.concat_ws(":", kind(t), t["start"], t["end"])), ",")
    return rows.select(
        "doc_id", *(F.get("n", F.lit(k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(extra != "", extra)).alias("spans"),
    )


def kind_of(term: str) -> str:
    """What a generalised term becomes: a code if it holds a digit, a name if it starts upper-case, else a word."""
    return "[CODE]" if _DIGIT.search(term) else "[NAME]" if term[0].isupper() else "[WORD]"


def sanitise(text: str, terms: Iterable[tuple[int, int, float]] = ()) -> str:
    """The text with entities as ``[KIND]``, terms as their kind by :func:`kind_of`, or without them."""
    spans = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
    spans += [(a, b, "" if d >= REMOVE else kind_of(text[a:b])) for a, b, d in terms]
    out, end = [], 0
    for a, b, put in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a < end:  # overlapping spans go as one, under the first one's name
            end = max(end, b)
            continue
        out += [text[end:a], put]
        end = b
    return "".join([*out, text[end:]])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts are sanitised and ``n_chars`` follows; no document goes, columns stay whatever
    their names, null texts stay null, an empty table gives no rows."""
    ids = docs.select("doc_id", "text")
    found = materialize(find(ids), "pii")
    own, own_id, own_terms = (free_name(docs.columns, c) for c in ("__text_hash", "__id", "terms"))
    spans = _treated(ids, found).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own), F.col("terms").alias(own_terms))
    discard(found)
    known = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_hash() == F.col(own)), "left")

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                None if t is None else sanitise(t, [(x["start"], x["end"], x["disclosure"]) for x in s or ()])
                for t, s in zip(b["text"].to_pylist(), b[own_terms].to_pylist(), strict=True)
            ]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            kept = [new[c].cast(b[c].type) if c in new else b[c] for c in docs_columns]
            yield pa.RecordBatch.from_arrays(kept, docs_columns)

    docs_columns = docs.columns
    return known.select(*docs_columns, own_terms).mapInArrow(clean, docs.schema)

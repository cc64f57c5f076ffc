"""Packed shuffles: token statistics travel as arrays, a row for each range of word hashes.

A word is its 64-bit hash (XXH3); with V distinct words the chance that any two share one is
about V * V / 2**65.  Tasks read documents in chunks of a bounded number of tokens, reduce each
chunk with numpy, and emit one row for each hash range that the chunk touches.  The rows of a
range meet in one task, which merges them as a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens in a chunk, and entries of a range that are held before they are merged.
CHUNK_TOKENS = 2_000_000
MERGE_ENTRIES = 6_000_000
#: Rows that leave a task together.
ROWS_HELD, BYTES_HELD = 1024, 4 << 20
#: Text bytes for each hash range; the number of ranges stays within these limits.
BYTES_PER_RANGE = 16 << 20
FEWEST_RANGES, MOST_RANGES = 16, 16_384


def word_hashes(text: str | None) -> list[int]:
    """Hashes of the words, ASCII letters lower-cased; only ASCII white space separates."""
    return [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]


def range_bits(docs: DataFrame, text: str = "text") -> int:
    """log2 of the number of hash ranges, from the amount of text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = min(max(FEWEST_RANGES, total // BYTES_PER_RANGE), MOST_RANGES)
    return max(1, int(n - 1).bit_length())


def chunks(batches: Iterable[pa.RecordBatch], end: int | None, limit: int = CHUNK_TOKENS) -> Iterator[tuple[list[dict], np.ndarray, np.ndarray]]:
    """(the rows without their text, tokens of each, all tokens) for bounded runs of documents;
    ``end`` is the token that closes each text, if there is one."""
    rows: list[dict] = []
    sizes: list[int] = []
    parts: list[np.ndarray] = []
    held = 0
    close = [] if end is None else [end]
    for b in batches:
        others = [c for c in b.schema.names if c != "text"]
        plain = b.select(others).to_pylist() if others else [{}] * b.num_rows
        for row, text in zip(plain, b["text"], strict=True):
            tokens = np.array(word_hashes(text.as_py()) + close, dtype=np.uint64)
            rows.append(row)
            sizes.append(len(tokens))
            parts.append(tokens)
            held += len(tokens)
            if held >= limit:
                yield rows, np.array(sizes, dtype=np.int64), np.concatenate(parts)
                rows, sizes, parts, held = [], [], [], 0
    if rows:
        yield rows, np.array(sizes, dtype=np.int64), np.concatenate(parts)


def by_range(sorted_hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The ranges that sorted hashes touch, with the slice of each."""
    if not len(sorted_hashes):
        return
    part = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(part)], strict=True):
        yield int(part[a]), slice(int(a), int(b))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def array(column: pa.Array | bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(column, dtype=dtype)


def in_groups(df: DataFrame, n: int, key: str, kind: str | None, body: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Bring rows with equal ``key`` together, ordered by ``kind``, and stream them through ``body``.

    ``body`` gets all rows of its task in order and holds only what one key needs.
    """
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        rows = (dict(zip(b.schema.names, x, strict=True)) for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        names = [f.name for f in arrow]
        held: list[dict] = []
        size = 0
        for out in body(rows):
            if any(isinstance(out[n], list | pa.Array) for n in names):  # a batch of its own
                yield pa.RecordBatch.from_pydict({n: out[n] if isinstance(out[n], list | pa.Array) else [out[n]] for n in names}, schema=arrow)
                continue
            held.append(out)
            size += sum(len(x) for x in out.values() if isinstance(x, bytes))
            if len(held) >= ROWS_HELD or size >= BYTES_HELD:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    order = [key] if kind is None else [key, kind]
    return df.repartition(n, key).sortWithinPartitions(*order).mapInArrow(run, target)

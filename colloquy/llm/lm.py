"""LM scoring with Brown classes.

P(w | before) = P(class of w | class before) * P(w | class of w).  Classes maximise the likelihood
of the class bigrams, that is the mutual information of adjacent classes, by exchange: a word
moves to the class where the gain is largest.

1. Words are counted over the whole training part.
2. The ``core`` most frequent words (a fixed number) are exchanged one after another until no word
   moves; their bigram counts come from the whole training part, and all other words take part as
   one context.
3. Every other word of the training part gets its counts with the classes before and behind it,
   and moves from that common context to the class with the largest gain.  Each hash range of
   words is a task of its own.
4. Words of documents meet their class and count: frequent words by a table of bounded size, the
   rest by hash range.  Documents become sequences of classes.
5. Class transitions are counted over the whole training part and smoothed.

Smoothing.  With N(p) tokens behind class p, N(p, c) of class c, and P(c) the share of class c,
a transition is (1 - u(p)) * (N(p, c) + A * P(c)) / (N(p) + A); the chance u(p) of an unknown word
is estimated from the words that occur once (each is unknown if left out).  A word has share
(count + 0.1) / (sum of that over its class).  So the probabilities of all known words and the one
unknown word sum to one.  An unknown word leaves the context as it was; the context of the first
word is the end token's class.

Defined edge cases: null text is empty and consists of the end token only; a null id counts as
the empty text when parts are dealt; repeated rows count and are scored each; an empty table, or
one without a training part, gives no rows or scores with zero counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packs
from .common import discard, id_remainder, materialize

#: No word contains white space, so this is the hash of no word's spelling.
END = xxhash.xxh3_64_intdigest(b"\n")
CLASSES = 64
CORE = 1024
MOST_SWEEPS = 20
#: Words whose class and count go to every task: those with at least 1 / (8 * HEAD) of all tokens, HEAD at most.
HEAD = 65_536
TRANSITION_PRIOR = 20.0
ADDED = 0.1
UNKNOWN, HOLE, ONCE = 127, 126, 128


@dataclass(frozen=True)
class Classes:
    """Counts of the classes: tokens and words of each, by class id; the last is the end token's."""

    tokens: np.ndarray
    words: np.ndarray
    n_tokens: int
    n_words: int
    n_once: int

    def mass(self) -> np.ndarray:
        return self.tokens + ADDED * self.words


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, fixed: dict[int, int], classes: int, sweeps: int = MOST_SWEEPS) -> np.ndarray:
    """Class of each row of the bigram counts ``pairs``, by exchange in order of frequency.

    ``fixed`` gives rows that form classes of their own, with ids from ``classes`` on.  Word i
    starts in class i mod ``classes``; a sweep takes each word out and puts it where the
    log-likelihood of class bigrams is highest, until no word moves.
    """
    m = pairs.astype(np.float64)
    n, groups = len(m), classes + len(fixed)
    words = [w for w in np.argsort(-m.sum(1), kind="stable") if w not in fixed]
    cls = np.zeros(n, dtype=np.int64)
    for k, w in enumerate(words):
        cls[w] = k % classes
    for w, c in fixed.items():
        cls[w] = c
    z = np.eye(groups)[cls]
    right, left = m @ z, m.T @ z  # of each word, with each class behind and before it
    big = z.T @ right
    for _ in range(sweeps):
        moves = 0
        for w in words:
            a, own, total = cls[w], m[w, w], m[w].sum()
            arrives = m[:, w].sum()
            if not total and not arrives:
                continue
            r, lf = right[w].copy(), left[w].copy()
            r[a] -= own
            lf[a] -= own
            big[a] -= r
            big[:, a] -= lf
            big[a, a] -= own
            b = _gains(big, r, lf, own, total, arrives, classes).argmax()
            big[b] += r
            big[:, b] += lf
            big[b, b] += own
            if b != a:
                moves += 1
                cls[w] = b
                right[:, a] -= m[:, w]
                right[:, b] += m[:, w]
                left[:, a] -= m[w]
                left[:, b] += m[w]
        if not moves:
            break
    return cls


def _gains(big: np.ndarray, r: np.ndarray, lf: np.ndarray, own: float, total: float, arrives: float, classes: int) -> np.ndarray:
    """Gain in log-likelihood when a word without a class enters each of the classes."""
    rows, columns = big[:classes], big[:, :classes].T
    out = (_f(rows + r) - _f(rows)).sum(1) + (_f(columns + lf) - _f(columns)).sum(1)
    d = np.arange(classes)
    same = big[d, d]
    out += _f(same + r[d] + lf[d] + own) - _f(same + r[d]) - _f(same + lf[d]) + _f(same)
    before, behind = rows.sum(1) + lf[:classes], columns.sum(1) + r[:classes]  # what meets the word stays in the margins
    return out - (_f(before + total) - _f(before)) - (_f(behind + arrives) - _f(behind))


def _train(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("held_out")).select("text")


def _training_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (tokens for _, _, tokens in packs.chunks(batches, END))


def count_words(docs: DataFrame, bits: int) -> DataFrame:
    """A row for each hash range: tokens, words, words that occur once, and the most frequent words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _training_chunks(batches):
            u, n = np.unique(tokens, return_counts=True)
            found = list(packs.by_range(u, bits))
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in found], pa.int32()), "h": [u[s].tobytes() for _, s in found], "n": [n[s].astype(np.int64).tobytes() for _, s in found]})

    def merge(rows: Iterator[dict]) -> Iterator[dict]:
        for h, n in _merged(rows):
            top = np.lexsort((h, -n))[:CORE]
            yield {"tokens": int(n.sum()), "words": len(h), "once": int((n == 1).sum()), "top": [[{"h": int(a), "n": int(b)} for a, b in zip(h[top].view(np.int64), n[top], strict=True)]]}

    rows = docs.mapInArrow(count, "part int, h binary, n binary")
    return packs.in_groups(rows, 1 << bits, "part", None, merge, "tokens long, words long, once long, top array<struct<h:long,n:long>>")


def _merged(rows: Iterator[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of each range, from rows that come range by range."""
    at, keys, counts, held = None, [], [], 0
    for row in rows:
        if row["part"] != at and keys:
            yield packs.summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [], [], 0
        at = row["part"]
        keys.append(packs.array(row["h"], np.uint64))
        counts.append(packs.array(row["n"], np.int64))
        held += len(keys[-1])
        if held > packs.MERGE_ENTRIES:
            k, c = packs.summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [k], [c], 0
    if keys:
        yield packs.summed(np.concatenate(keys), np.concatenate(counts))


def _index(sorted_hashes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Place of each token in the sorted hashes; their number if it isn't there."""
    if not len(sorted_hashes):
        return np.zeros(len(tokens), dtype=np.int64)
    at = np.searchsorted(sorted_hashes, tokens)
    at[at == len(sorted_hashes)] = 0
    return np.where(sorted_hashes[at] == tokens, at, len(sorted_hashes))


def core_pairs(docs: DataFrame, core: np.ndarray) -> np.ndarray:
    """Bigram counts of the core words (the row behind the last is any other word); size fixed by the core."""
    k = len(core) + 1
    slices = np.linspace(0, k * k, 17).astype(np.int64)
    end = int(np.searchsorted(core, np.uint64(END)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(k * k, dtype=np.int64)
        for tokens in _training_chunks(batches):
            idx = _index(core, tokens)
            dense += np.bincount(np.r_[end, idx[:-1]] * k + idx, minlength=k * k)
        if dense.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(16), pa.int32()), "n": [dense[a:b].tobytes() for a, b in zip(slices, slices[1:], strict=False)]})

    def merge(rows: Iterator[dict]) -> Iterator[dict]:
        at, total = None, None
        for row in rows:
            n = packs.array(row["n"], np.int64)
            if row["part"] != at:
                if total is not None:
                    yield {"part": at, "n": total.tobytes()}
                at, total = row["part"], n.copy()
            else:
                total += n
        if total is not None:
            yield {"part": at, "n": total.tobytes()}

    out = np.zeros(k * k, dtype=np.int64)
    for row in packs.in_groups(docs.mapInArrow(count, "part int, n binary"), 16, "part", None, merge, "part int, n binary").toLocalIterator():
        out[slices[row["part"]] : slices[row["part"] + 1]] = np.frombuffer(row["n"], dtype=np.int64)
    return out.reshape(k, k)


def other_words(docs: DataFrame, bits: int, core: np.ndarray, cls: np.ndarray, pairs: np.ndarray, classes: int) -> DataFrame:
    """Hashes, counts and classes of all words outside the core, a row for each hash range."""
    groups = classes + 2
    context = cls.astype(np.uint8)  # the last entry is that of words outside the core
    z = np.eye(groups)[cls]
    big = z.T @ pairs @ z
    codes = 2 * groups

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _training_chunks(batches):
            idx = _index(core, tokens)
            around = context[idx]
            at = np.flatnonzero(idx == len(core))  # never the last token, which is an end
            u, which = np.unique(tokens[at], return_inverse=True)
            before = np.where(at > 0, around[at - 1], classes)
            key = np.concatenate([which * codes + before, which * codes + groups + around[at + 1].astype(np.int64)])
            key, n = np.unique(key, return_counts=True)
            if n.max(initial=0) > 255:  # counts are bytes; a large one is several entries
                times = -(-n // 255)
                rest = n - 255 * (times - 1)
                key, last = np.repeat(key, times), np.cumsum(times) - 1
                n = np.full(len(key), 255, dtype=np.int64)
                n[last] = rest
            word = key // codes
            first = np.searchsorted(word, np.arange(len(u) + 1))
            found = list(packs.by_range(u, bits))
            if not found:
                continue
            spans = [(s, slice(int(first[s.start]), int(first[s.stop]))) for _, s in found]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p for p, _ in found], pa.int32()),
                "h": [u[s].tobytes() for s, _ in spans],
                "each": [np.diff(first[s.start : s.stop + 1]).astype(np.uint32).tobytes() for s, _ in spans],
                "code": [(key[e] % codes).astype(np.uint8).tobytes() for _, e in spans],
                "n": [n[e].astype(np.uint8).tobytes() for _, e in spans],
            })

    def place(rows: Iterator[dict]) -> Iterator[dict]:
        table = np.zeros((9, codes, classes), dtype=np.float32)
        ends = np.concatenate([big[:, :classes], big[:classes].T])  # by code: counts of each class with that context
        for c in range(1, 9):
            table[c] = _f(ends + c) - _f(ends)
        before, behind = big[:classes].sum(1), big[:, :classes].sum(0)

        def choose(h: np.ndarray, code: np.ndarray, n: np.ndarray) -> dict:
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            edge = np.r_[starts, len(h)]
            total = np.add.reduceat(np.where(code >= groups, n, 0), starts)
            best = np.empty(len(starts), dtype=np.uint8)
            a = 0
            while a < len(starts):
                b = max(a + 1, int(np.searchsorted(edge, edge[a] + 100_000, side="right")) - 1)
                s = slice(int(edge[a]), int(edge[b]))
                gain = table[np.minimum(n[s], 8), code[s]].astype(np.float64)
                more = np.flatnonzero(n[s] > 8)
                e = ends[code[s][more]]
                gain[more] = _f(e + n[s][more][:, None]) - _f(e)
                gain = np.add.reduceat(gain, starts[a:b] - edge[a], axis=0)
                t = total[a:b, None]
                best[a:b] = (gain - _f(before + t) + _f(before) - _f(behind + t) + _f(behind)).argmax(1)
                a = b
            tokens, words = np.bincount(best, weights=total, minlength=classes), np.bincount(best, minlength=classes)
            return {"h": h[starts].tobytes(), "n": total.astype(np.int64).tobytes(), "cls": best.tobytes(), "tokens": [tokens.astype(np.int64).tolist()], "words": [words.tolist()]}

        at, held, waiting = None, [], 0
        for row in rows:
            if row["part"] != at and held:
                yield {"part": at, **choose(*_profiles(held))}
                held, waiting = [], 0
            at = row["part"]
            h = np.repeat(packs.array(row["h"], np.uint64), packs.array(row["each"], np.uint32))
            held.append((h, packs.array(row["code"], np.uint8).astype(np.int16), packs.array(row["n"], np.uint8).astype(np.int64)))
            waiting += len(h)
            if waiting > packs.MERGE_ENTRIES:
                held, waiting = [_profiles(held)], 0
        if held:
            yield {"part": at, **choose(*_profiles(held))}

    rows = docs.mapInArrow(count, "part int, h binary, each binary, code binary, n binary")
    return packs.in_groups(rows, 1 << bits, "part", None, place, "part int, h binary, n binary, cls binary, tokens array<long>, words array<long>")


def _profiles(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (word, code, count) in order, equal ones summed."""
    h, code, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((code, h))
    h, code, n = h[order], code[order], n[order]
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (code[1:] != code[:-1])])
    return h[starts], code[starts], np.add.reduceat(n, starts)


def frequent_words(vocabulary: DataFrame, least: int) -> list[tuple[int, int, int]]:
    """(hash, count, class) of the most frequent words outside the core, HEAD at most."""

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, n, c in zip(*(b[x].to_pylist() for x in ("h", "n", "cls")), strict=True):
                counts = packs.array(n, np.int64)
                top = np.flatnonzero(counts >= least)
                yield pa.RecordBatch.from_pydict({"h": packs.array(h, np.int64)[top], "n": counts[top], "c": packs.array(c, np.uint8)[top].astype(np.int32)})

    rows = vocabulary.select("h", "n", "cls").mapInArrow(pick, "h long, n long, c int")
    return [tuple(r) for r in rows.orderBy(F.desc("n"), "h").limit(HEAD).collect()]


def class_sequences(docs: DataFrame, vocabulary: DataFrame, bits: int, head: tuple[np.ndarray, np.ndarray, np.ndarray], c: Classes) -> DataFrame:
    """A row for each document: id, part, counts, base score, score of the words in their classes, and
    the sequence of classes (a byte each; the high bit marks words that occur once)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(head)
    mass, denominator = c.mass(), c.n_tokens + ADDED * (c.n_words + 1)

    def logs(n: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the base probability and of the word in its class (0 if unknown)."""
        known = n > 0
        own = np.where(known, mass[np.where(known, cls, 0)], 1.0)
        return np.log10((n + ADDED) / denominator), np.where(known, np.log10((n + ADDED) / own), 0.0)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hs, ns, cs = shared.value
        base_log, class_log = logs(np.r_[ns, 0], np.r_[cs, 0].astype(np.int64))
        ns, cs = np.r_[ns, 0], np.r_[cs, HOLE].astype(np.uint8)
        for k, (rows, sizes, tokens) in enumerate(packs.chunks(batches, END)):
            chunk = (TaskContext.get().partitionId() << 32) + k
            idx = _index(hs, tokens)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            hole = idx == len(hs)
            sums = [np.bincount(doc[~hole], weights=x[idx[~hole]], minlength=len(sizes)) for x in (base_log, class_log)]
            seq = cs[idx]
            seq[ns[idx] == 1] |= ONCE
            seq[hole] = HOLE
            asked = tokens[hole]
            parts = (asked >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(parts, kind="stable")
            found = list(packs.by_range(asked[order] if len(asked) else asked, bits))
            meta = {"doc_id": [r["doc_id"] for r in rows], "held": [r["held_out"] for r in rows]}
            one = {"part": [-1], "chunk": [chunk], "ids": pa.array([meta["doc_id"]], pa.list_(pa.int64())), "held": pa.array([meta["held"]], pa.list_(pa.bool_())), "a": [sizes.tobytes()], "b": [sums[0].tobytes()], "c": [sums[1].tobytes()], "d": [seq.tobytes()], "e": [parts.tobytes()]}
            yield pa.RecordBatch.from_pydict(one, schema=arrow)
            if found:
                m = len(found)
                some = {"part": [p for p, _ in found], "chunk": [chunk] * m, "ids": [None] * m, "held": [None] * m, "a": [asked[order][s].tobytes() for _, s in found]} | {x: [None] * m for x in "bcde"}
                yield pa.RecordBatch.from_pydict(some, schema=arrow)

    def answer(rows: Iterator[dict]) -> Iterator[dict]:
        at = None
        for row in rows:
            if row["kind"] == 0:
                at, h, n, cls = row["part"], packs.array(row["a"], np.uint64), packs.array(row["b"], np.int64), packs.array(row["c"], np.uint8)
                continue
            asked = packs.array(row["a"], np.uint64)
            if at != row["part"] or not len(h):
                n_out, c_out = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), UNKNOWN, dtype=np.uint8)
            else:
                idx = _index(h, asked)
                n_out, c_out = np.r_[n, 0][idx], np.r_[cls, UNKNOWN].astype(np.uint8)[idx]
            yield {"chunk": row["chunk"], "part": row["part"], "a": n_out.tobytes(), "b": c_out.tobytes()}

    def fill(rows: Iterator[dict]) -> Iterator[dict]:
        state: dict | None = None

        def done(x: dict) -> dict:
            sizes, seq = x["sizes"], x["seq"]
            base, inside = logs(x["n"], np.where(x["n"] > 0, x["cls"], 0))
            doc = np.repeat(np.arange(len(sizes)), sizes)[x["holes"]]
            k = len(sizes)
            seq[x["holes"]] = np.where(x["n"] == 1, x["cls"] | ONCE, x["cls"])
            unknown = np.bincount(doc[x["n"] == 0], minlength=k)
            edge = np.r_[0, np.cumsum(sizes)]
            return {
                "doc_id": pa.array(x["ids"], pa.int64()), "held_out": pa.array(x["held"], pa.bool_()), "n_tokens": pa.array(sizes), "n_known": pa.array(sizes - unknown),
                "base_score": pa.array(x["base"] + np.bincount(doc, weights=base, minlength=k)), "inside": pa.array(x["inside"] + np.bincount(doc, weights=inside, minlength=k)),
                "seq": pa.array([seq[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary()),
            }

        for row in rows:
            if row["part"] == -1:
                if state is not None:
                    yield done(state)
                seq = packs.array(row["d"], np.uint8).copy()
                holes = np.flatnonzero(seq == HOLE)
                state = {"ids": row["ids"], "held": row["held"], "sizes": packs.array(row["a"], np.int64), "base": packs.array(row["b"], np.float64), "inside": packs.array(row["c"], np.float64), "seq": seq, "holes": holes, "parts": packs.array(row["e"], np.int32), "n": np.zeros(len(holes), dtype=np.int64), "cls": np.full(len(holes), UNKNOWN, dtype=np.uint8)}
                continue
            where = np.flatnonzero(state["parts"] == row["part"])
            state["n"][where] = packs.array(row["a"], np.int64)
            state["cls"][where] = packs.array(row["b"], np.uint8)
        if state is not None:
            yield done(state)

    arrow = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((x, pa.binary()) for x in "abcde")])
    asked = materialize(docs.select("doc_id", "held_out", "text").mapInArrow(ask, "part int, chunk long, ids array<long>, held array<boolean>, a binary, b binary, c binary, d binary, e binary"), "lm-asked")
    known = vocabulary.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), F.col("h").alias("a"), F.col("n").alias("b"), F.col("cls").alias("c"))
    asks = asked.where("part >= 0").select("part", F.lit(1).alias("kind"), "chunk", "a", F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("c"))
    answers = packs.in_groups(known.unionByName(asks), 1 << bits, "part", "kind", answer, "chunk long, part int, a binary, b binary")
    both = asked.where("part = -1").unionByName(answers, allowMissingColumns=True)
    out = materialize(packs.in_groups(both, 1 << bits, "chunk", "part", fill, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, seq binary"), "lm-classes")
    discard(asked)
    return out


def _contexts(cls: np.ndarray, end: int) -> np.ndarray:
    """The class of the last known word before each token."""
    known = np.where(cls == UNKNOWN, -1, np.arange(len(cls)))
    last = np.r_[-1, np.maximum.accumulate(known)[:-1]]
    return np.where(last < 0, end, cls[np.maximum(last, 0)])


def count_transitions(sequences: DataFrame, groups: int) -> np.ndarray:
    """Tokens of each class behind each class; the last column counts words that occur once."""
    end, width = groups - 1, groups + 1

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups * width, dtype=np.int64)
        for b in batches:
            for raw in b["seq"]:
                seq = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                cls = (seq & 127).astype(np.int64)
                before = np.r_[end, cls[:-1]]
                total += np.bincount(before * width + cls, minlength=len(total))
                total += np.bincount(before[seq >= ONCE] * width + groups, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(groups * width, dtype=np.int64)
    rows = sequences.where(~F.col("held_out")).select("seq").mapInArrow(count, "k long, n long")
    for k, n in rows.groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out.reshape(groups, width)


def transition_logs(counts: np.ndarray, c: Classes, prior: float = TRANSITION_PRIOR) -> np.ndarray:
    """log10 of the chance of each class (last: an unknown word) behind each class."""
    groups = len(counts)
    n, once = counts[:, :groups].astype(float), counts[:, groups].astype(float)
    total = n.sum(1)
    mass = c.mass()
    share = mass / max(mass.sum(), 1e-300)
    unknown = (c.n_once + 1) / (c.n_tokens + 2)
    u = (once + prior * unknown) / (total + prior)
    known = (1 - u)[:, None] * (n + prior * share) / (total + prior)[:, None]
    return np.log10(np.maximum(np.c_[known, u], 1e-300))


def score_documents(sequences: DataFrame, logs: np.ndarray) -> DataFrame:
    groups = len(logs)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, inside in zip(b["seq"], b["inside"].to_numpy(), strict=True):
                cls = (np.frombuffer(raw.as_buffer(), dtype=np.uint8) & 127).astype(np.int64)
                before = _contexts(cls, groups - 1)
                out.append(inside + logs[before, np.where(cls == UNKNOWN, groups, cls)].sum())
            kept = b.select(["doc_id", "held_out", "n_tokens", "n_known", "base_score"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.float64())], [*kept.schema.names, "score"])

    return sequences.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def brown_scores(docs: DataFrame, *, classes: int = CLASSES, core_size: int = CORE) -> DataFrame:
    """Learn from rows of ``docs`` (doc_id, text, held_out) that aren't held out; score all of them."""
    bits = packs.range_bits(docs)
    train = _train(docs)
    counts = materialize(count_words(train, bits), "lm-counts")
    n_tokens, n_words, n_once = (x or 0 for x in counts.agg(F.sum("tokens"), F.sum("words"), F.sum("once")).first())
    top = counts.select(F.inline("top")).where(F.col("h") != F.lit(int(np.uint64(END).view(np.int64)))).orderBy(F.desc("n"), "h").limit(core_size - 1).collect()
    discard(counts)
    core = np.sort(np.array([END, *(np.int64(r["h"]).view(np.uint64) for r in top)], dtype=np.uint64))
    end = int(np.searchsorted(core, np.uint64(END)))
    pairs = core_pairs(train, core)
    cls = exchange(pairs, {end: classes, len(core): classes + 1}, classes)
    vocabulary = materialize(other_words(train, bits, core, cls, pairs, classes), "lm-vocabulary")
    core_counts = pairs.sum(0)[: len(core)]
    tokens, words = (np.bincount(cls[:-1], weights=x, minlength=classes + 1) for x in (core_counts, core_counts > 0))
    for k, t, w in vocabulary.select(F.posexplode(F.arrays_zip("tokens", "words"))).groupBy("pos").agg(F.sum("col.tokens"), F.sum("col.words")).collect():
        tokens[k], words[k] = tokens[k] + t, words[k] + w
    model = Classes(tokens, words, n_tokens, n_words, n_once)
    often = frequent_words(vocabulary, max(2, n_tokens // (8 * HEAD)))
    h = np.array([*core, *(np.int64(x[0]).view(np.uint64) for x in often)], dtype=np.uint64)
    n = np.array([*core_counts, *(x[1] for x in often)], dtype=np.int64)
    c = np.array([*cls[:-1], *(x[2] for x in often)], dtype=np.uint8)
    order = np.argsort(h)
    order = order[n[order] > 0]
    sequences = class_sequences(docs, vocabulary, bits, (h[order], n[order], c[order]), model)
    discard(vocabulary)
    logs = transition_logs(count_transitions(sequences, classes + 1), model)
    return score_documents(sequences, logs).withColumn("train_tokens", F.lit(n_tokens).cast("long"))


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (id_remainder(F.col("doc_id"), 10) == 0).alias("held_out"))
    out = brown_scores(docs)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

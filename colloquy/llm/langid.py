"""Language of each word by a linear-chain conditional random field.

Words are runs of letters, lower-cased.  Features of a word are its affixes and n-grams (byte
n-grams with marks for both ends, hashed) and the lexicons that list it.  Weights and transitions
between the languages of adjacent words are learned together, from texts and from sequences
spliced of pieces of texts in different languages, so the model can follow a switch inside a text.
Forward-backward gives each word's probabilities; a document's language has the largest mean, and
that mean is the score.

The model is fitted on a bounded sample: ``PER_LANGUAGE`` training documents of each of at most
``LANGUAGES`` languages, by the hash of their id, none longer than ``LONGEST`` characters; its size
is fixed.  Every text is labelled whole, in batches of bounded size.  Long texts are cut for
computing only: each piece of ``PIECE`` words passes on the exact product of its steps, so
results equal those of one pass over the whole text.

Defined edge cases: null text or one without a letter is ``und`` with score 0; training texts
that are null or have null language are passed over; without any training text everything is
``und``; repeated rows are labelled alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_remainder

PER_LANGUAGE = 128
LANGUAGES = 64
LONGEST = 20_000
SALTS = 32
HASHED = 1 << 15
GRAMS = 4
LEXICON = 2000
PIECE = 64
BATCH_WORDS = 500_000
UNDETERMINED = "und"


def letters(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", (text or "").lower())


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all words one after another, where each word's begin).

    A word is bytes between two marks; its n-grams of 1 to ``GRAMS`` bytes include the affixes,
    which are those with a mark.
    """
    raw = [b"\x01" + w.encode() + b"\x02" for w in words]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(raw)), sizes)
    left = ends[word] - np.arange(len(data))  # bytes from here to the end of the word
    h = np.zeros(len(data), dtype=np.uint64)
    features, owners = [], []
    for n in range(1, GRAMS + 1):
        fits = np.flatnonzero(left >= n)
        h[fits] = (h[fits] * np.uint64(0x100000001B3)) ^ (data[fits + n - 1] + np.uint64(n << 8))
        mixed = h[fits] * np.uint64(0x9E3779B97F4A7C15)
        features.append((mixed >> np.uint64(64 - 15)).astype(np.int64))
        owners.append(word[fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(features)[order], np.searchsorted(owner[order], np.arange(len(raw)))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # HASHED + languages (lexicons) rows, a column for each language
    transitions: np.ndarray
    lexicon: dict[str, list[int]]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each word for each language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        out = np.empty((len(words), len(self.languages)))
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            f, starts = gram_features(part)
            out[a : a + len(part)] = np.add.reduceat(self.weights[f], starts, axis=0)
        for k, w in enumerate(words):
            for lang in self.lexicon.get(w, ()):
                out[k] += self.weights[HASHED + lang]
        return out


def _unit(x: np.ndarray, axes: int = 1) -> np.ndarray:
    return x / np.maximum(x.max(axis=tuple(range(-axes, 0)), keepdims=True), 1e-300)


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over sequences that lie one after another in ``scores``.

    All sequences are cut into pieces of ``PIECE`` words.  The product of the steps of each piece
    is found for all pieces at once; passing vectors from piece to piece gives what enters each;
    then all pieces run forward and backward at once.
    """
    k = scores.shape[1]
    a = np.exp(transitions - transitions.max())
    pieces = -(-lengths // PIECE)
    first = np.cumsum(pieces) - pieces
    n = int(pieces.sum())
    of = np.repeat(np.arange(len(lengths)), pieces)
    rank = np.arange(n) - first[of]
    start = (np.cumsum(lengths) - lengths)[of] + rank * PIECE
    size = np.minimum(lengths[of] - rank * PIECE, PIECE)
    at = start[:, None] + np.arange(PIECE)
    inside = np.arange(PIECE) < size[:, None]
    e = np.exp(scores - scores.max(1, keepdims=True))[np.where(inside, at, 0)]  # piece, word, language
    product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    long = np.flatnonzero(pieces[of] > 1)
    for t in range(PIECE):
        step = (product[long] @ a) * e[long, t][:, None, :]
        product[long] = np.where(inside[long, t][:, None, None], _unit(step, 2), product[long])
    enter, leave = np.ones((n, k)), np.ones((n, k))
    for r in range(1, int(pieces.max(initial=1))):
        here = first[pieces > r] + r
        enter[here] = _unit(np.einsum("ni,nij->nj", enter[here - 1], product[here - 1]))
    for r in range(int(pieces.max(initial=1)) - 2, -1, -1):
        here = first[pieces > r + 1] + r
        leave[here] = _unit(np.einsum("nij,nj->ni", product[here + 1], leave[here + 1]))
    alpha = np.empty((PIECE, n, k))
    x = enter
    for t in range(PIECE):
        x = _unit((x @ a) * e[:, t])
        alpha[t] = x
    out = np.empty((PIECE, n, k))
    y = leave
    for t in range(PIECE - 1, -1, -1):
        y = np.where(inside[:, t, None], y, leave)
        out[t] = alpha[t] * y
        y = np.where(inside[:, t, None], _unit((y * e[:, t]) @ a.T), leave)
    both = out.transpose(1, 0, 2)[inside]
    return both / np.maximum(both.sum(1, keepdims=True), 1e-300)


def _pairs(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and expected transitions over all sequences (none enters the first word of any
    but from a uniform state), for training."""
    m = marginals(scores, lengths, transitions)
    k, width = scores.shape[1], int(lengths.max())
    a = np.exp(transitions - transitions.max())
    start = np.cumsum(lengths) - lengths
    e = np.exp(scores - scores.max(1, keepdims=True))
    at = np.minimum(start[:, None] + np.arange(width), len(scores) - 1)
    inside = np.arange(width) < lengths[:, None]
    alpha, beta = np.empty((width, len(lengths), k)), np.ones((width, len(lengths), k))
    x = np.ones((len(lengths), k))
    for t in range(width):
        x = _unit((x @ a) * e[at[:, t]])
        alpha[t] = x
    y = np.ones((len(lengths), k))
    for t in range(width - 1, -1, -1):
        beta[t] = y
        y = np.where(inside[:, t, None], _unit((y * e[at[:, t]]) @ a.T), 1.0)
    expected = np.zeros((k, k))
    for t in range(width):
        before = alpha[t - 1] if t else np.ones((len(lengths), k))
        joint = before[:, :, None] * a * (e[at[:, t]] * beta[t])[:, None, :]
        joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)
        expected += joint[inside[:, t]].sum(0)
    return m, expected


def fit(sample: list[tuple[str, str]], *, seed: int = 5, epochs: int = 4, sequences: int = 1500, rate: float = 0.3) -> Model:
    """Maximum likelihood by AdaGrad over (text, language) rows."""
    rng = np.random.default_rng(seed)
    texts = [(w, lang) for t, lang in sorted(sample) if (w := letters(t))]
    languages = sorted({lang for _, lang in texts})
    place = {lang: k for k, lang in enumerate(languages)}
    k = len(languages)
    counts = [Counter() for _ in languages]
    for w, lang in texts:
        counts[place[lang]].update(w)
    totals = Counter()
    for c in counts:
        totals.update(c)
    lexicon: dict[str, list[int]] = {}
    for j, c in enumerate(counts):
        for w in sorted((w for w, n in c.items() if n >= 3 and n >= 0.6 * totals[w]), key=lambda w: (-c[w], w))[:LEXICON]:
            lexicon.setdefault(w, []).append(j)
    model = Model(languages, np.zeros((HASHED + k, k)), np.zeros((k, k)), lexicon)
    if k < 2:
        return model
    by = [[w for w, lang in texts if lang == x] for x in languages]

    def piece(j: int, most: int) -> list[str]:
        w = by[j][rng.integers(len(by[j]))]
        at = int(rng.integers(max(1, len(w) - most + 1)))
        return w[at : at + most]

    def sequence() -> tuple[list[str], list[int]]:
        words, labels = [], []
        spliced = rng.random() < 0.5
        for _ in range(int(rng.integers(2, 5)) if spliced else 1):
            j = int(rng.integers(k))
            p = piece(j, int(rng.integers(3, 13)) if spliced else 40)
            words += p
            labels += [j] * len(p)
        return words, labels

    data = [sequence() for _ in range(sequences)]
    g_w, g_t = np.full_like(model.weights, 1e-2), np.full((k, k), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for b in range(0, len(order), 50):
            batch = [data[i] for i in order[b : b + 50]]
            words = [w for ws, _ in batch for w in ws]
            labels = np.array([y for _, ys in batch for y in ys])
            lengths = np.array([len(ws) for ws, _ in batch])
            m, expected = _pairs(model.emissions(words), lengths, model.transitions)
            error = -m
            error[np.arange(len(labels)), labels] += 1
            f, starts = gram_features(words)
            owner = np.repeat(np.arange(len(words)), np.diff(np.r_[starts, len(f)]))
            rows, values = [f], [error[owner]]
            listed = [(i, j) for i, w in enumerate(words) for j in lexicon.get(w, ())]
            if listed:
                i, j = np.array(listed).T
                rows.append(HASHED + j)
                values.append(error[i])
            row, which = np.unique(np.concatenate(rows), return_inverse=True)
            every = np.concatenate(values)
            grad = np.stack([np.bincount(which, weights=every[:, c], minlength=len(row)) for c in range(k)], 1) / len(words)
            seen = np.zeros((k, k))
            inner = np.ones(len(labels), dtype=bool)
            inner[np.cumsum(lengths) - lengths] = False
            np.add.at(seen, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
            heads = np.bincount(labels[~inner], minlength=k)
            seen += heads / k  # the uniform state before the first word
            g_w[row] += grad**2
            model.weights[row] += rate * grad / np.sqrt(g_w[row])
            step = (seen - expected) / len(batch)
            g_t += step**2
            model.transitions += rate * step / np.sqrt(g_t)
    return model


def training_sample(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language among ``docs`` (doc_id, text, lang).

    Ids are ranked by hash within (language, salt), so no task ranks a whole language; only the
    chosen ids, whose number is bounded, are broadcast to fetch texts.
    """
    short = docs.where((F.length("text") > 0) & (F.length("text") <= LONGEST) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    often = short.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    hashed = short.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(often), "lang")
    rank = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h", "doc_id"))
    chosen = hashed.withColumn("r", rank).where(F.col("r") <= max(1, per_language // SALTS)).select("doc_id").distinct()
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x"))
    return [(r["x"]["text"], r["x"]["lang"]) for r in rows.toLocalIterator()]


def label_documents(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``; inputs are texts only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value

        def answer(held: list[list[str]]) -> tuple[list[str], list[float]]:
            names, scores = [UNDETERMINED] * len(held), [0.0] * len(held)
            full = [i for i, w in enumerate(held) if w] if m.languages else []
            if full:
                index: dict[str, int] = {}
                ids = np.array([index.setdefault(w, len(index)) for i in full for w in held[i]])
                lengths = np.array([len(held[i]) for i in full])
                p = marginals(m.emissions(list(index))[ids], lengths, m.transitions)
                means = np.add.reduceat(p, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
                for i, row in zip(full, means, strict=True):
                    best = int(row.argmax())
                    names[i], scores[i] = m.languages[best], float(min(1.0, max(0.0, row[best])))
            return names, scores

        for b in batches:
            a, held, waiting = 0, [], 0
            for k, t in enumerate(b["__text"]):
                held.append(letters(t.as_py()))
                waiting += len(held[-1])
                if waiting > BATCH_WORDS or k == b.num_rows - 1:
                    names, scores = answer(held)
                    kept = [b[c].slice(a, len(held)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])
                    a, held, waiting = k + 1, [], 0

    rows = docs.select(*keep, docs["text"].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep), "lang_pred string, score double"])
    return rows.mapInArrow(label, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = docs.select("doc_id", "text", "lang", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = fit(training_sample(marked.where("NOT held_out").select("doc_id", "text", "lang")))
    return label_documents(marked, model, keep=("doc_id", "held_out"))

import random
import re

import numpy as np
import pytest
from colloquy.llm import neardup
from colloquy.llm.graphs import components

from .fixtures import SCHEMA, awkward, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n):
    """component by place of the row"""
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * len(a | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    return [min((x for x in groups[root(k)] if x is not None), default=None) for k in range(len(rows))], [len(s) for s in sets]


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, rows, n):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link_documents(df, words=n).collect()), key=str)
    least, sizes = brute(rows, n)
    want = sorted(((i is None, i or 0, s, c, i == c) for (i, _), s, c in zip(rows, sizes, least)), key=str)
    assert got == want


@pytest.mark.parametrize("guests", [1024, 7])
def test_families_around_the_threshold(spark, monkeypatch, guests):
    monkeypatch.setattr(neardup, "GUESTS", guests)
    monkeypatch.setattr(neardup, "PASSING", guests)
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [*family(rng, words(100), 60, 14), *family(rng, words(60), 40, 6), *(" ".join(words(50)) for _ in range(40))]
    texts += [texts[0]] * 20 + [texts[0].upper()] * 3
    rng.shuffle(texts)
    check(spark, list(enumerate(texts, 10)), 2)


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "X"), (6, "x y"), (None, "x y"), (None, "only null"), (7, "Ä"), (8, "ä"), (9, "a b c d e f"), (9, "a b c d e f"), (9, "other text here")], 2)


def test_links_are_decided_in_integers():
    a, b = np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64)
    assert neardup.linked(a, b) and not neardup.linked(a, b[:7]) and not neardup.linked(a[:0], a[:0])


def test_differences_give_the_same_links_as_sets():
    rng = np.random.default_rng(2)
    for _ in range(100):
        head = np.unique(rng.integers(0, 60, 50).astype(np.uint64))
        sets = [np.unique(np.concatenate([rng.permutation(head)[: rng.integers(20, 50)], rng.integers(0, 90, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(12)]
        g = neardup._Guests()
        for k, s in enumerate(sets[:6]):
            g.add(k, k, head, s)
        got = {(a, b) for k, s in enumerate(sets[6:], 6) for a, b in g.links(k, k, head, s)}
        assert got == {(a, b) for a in range(6) for b in range(6, 12) if neardup.linked(sets[a], sets[b])}


def test_tables_catch_pairs_as_often_as_they_should():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        s = rng.integers(0, 1 << 62, 180).astype(np.uint64)
        a, b = np.sort(s[:162]), np.sort(s[18:])
        keys = neardup.table_keys(np.stack([neardup.tuple_hashes(a), neardup.tuple_hashes(b)]))
        met += bool((keys[0] == keys[1]).any())
    assert met >= 298


def test_components(spark):
    edges = [(k, k + 1) for k in range(40) if k != 20] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 21 for k in range(21, 41)}, 100: 90, 95: 90, 90: 90}


def test_stage_keeps_one_of_each_group(spark):
    docs = documents(spark)
    out = neardup.near_duplicate_stage(spark, awkward(docs), "")
    assert out.columns == awkward(docs).columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    least, sizes = brute(rows, 5)
    want = sorted(({(i, t) for (i, t), c, s in zip(rows, least, sizes) if i == c and s}), key=str) + sorted([(i, t) for (i, t), s in zip(rows, sizes) if not s], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert neardup.near_duplicate_stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0

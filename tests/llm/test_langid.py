import random

import numpy as np
from colloquy.llm import langid

from .fixtures import SCHEMA, documents

SYLLABLES = {"en": ["the", "ing", "wh", "th", "er"], "fr": ["eau", "ou", "é", "que", "ment"], "de": ["sch", "ung", "ei", "ß", "keit"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_marginals_equal_enumeration_and_one_long_pass(monkeypatch):
    rng = np.random.default_rng(1)
    t = rng.normal(size=(3, 3))
    lengths = np.array([4, 1, 5])
    s = rng.normal(size=(10, 3))
    got, at = langid.marginals(s, lengths, t), 0
    for n in lengths:
        p = np.zeros((n, 3))
        for y in np.ndindex(*[3] * n):
            w = np.exp(np.logaddexp.reduce(t[:, y[0]]) + sum(t[a, b] for a, b in zip(y, y[1:])) + sum(s[at + i, y[i]] for i in range(n)))
            for i in range(n):
                p[i, y[i]] += w
        assert np.allclose(got[at : at + n], p / p.sum(1, keepdims=True))
        at += n
    lengths, s = np.array([200, 64, 65, 1, 129]), rng.normal(size=(459, 3)) * 5
    cut = langid.marginals(s, lengths, t)
    monkeypatch.setattr(langid, "PIECE", 512)
    assert np.allclose(cut, langid.marginals(s, lengths, t))


def test_gradient_of_expected_transitions():
    rng = np.random.default_rng(2)
    lengths, s, t = np.array([3, 5]), rng.normal(size=(8, 2)), rng.normal(size=(2, 2))

    def log_z(t):
        total, at = 0.0, 0
        for n in lengths:
            x = np.zeros(2)
            for k in range(n):
                x = np.logaddexp.reduce(x[:, None] + t, axis=0) + s[at + k]
            total += np.logaddexp.reduce(x)
            at += n
        return total

    _, expected = langid._pairs(s, lengths, t)
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = 1e-5
            assert abs((log_z(t + d) - log_z(t - d)) / 2e-5 - expected[i, j]) < 1e-6


def test_held_out_accuracy_and_switches(spark):
    rng = random.Random(3)
    model = langid.fit([(speak(rng, lang, 60), lang) for lang in SYLLABLES for _ in range(30)])
    docs = spark.createDataFrame([(i, speak(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(1, 80)), lang) for i in range(200)], "doc_id long, text string, lang string")
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.label_documents(docs, model).collect()
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    words = langid.letters(speak(rng, "en", 15) + " " + speak(rng, "de", 15))
    p = langid.marginals(model.emissions(words), np.array([len(words)]), model.transitions).argmax(1)
    assert np.mean(p == [model.languages.index(x) for x in ["en"] * 15 + ["de"] * 15]) > 0.9


def test_query_on_awkward_rows(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = langid.op6_language_id(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() and {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (100, 101, 102)} == {"und"}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert langid.op6_language_id(spark, f"{tmp_path}/none").count() == 0

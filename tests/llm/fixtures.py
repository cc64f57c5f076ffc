"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta,"]) + str(rng.randrange(40)) for _ in range(n))


def documents(spark, n: int = 40, seed: int = 3):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randrange(1, 120)), rng.choice(["en", "de"]), rng.choice(["a", "b", None]), 0) for i in range(n)]
    rows += [
        (100, None, "en", "a", None), (101, "", "en", "a", 0), (102, "\n \t", None, "b", 3), (103, "x", None, None, 1),
        (104, words(rng, 6000), "en", "a", 0), (None, "one two three", "en", "b", 13), (None, None, None, None, None),
        (105, rows[1][1], "en", "a", 0), (106, rows[1][1] + " tail", "en", "a", 0), (107, "same row", "en", "c", 8), (107, "same row", "en", "c", 8),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(df):
    """The same rows with more columns, whose names clash with those that operators add."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in ("n_words", "kept", "stats", "quality_verdict", "place", "__size", "text_hash", "node", "terms", "__text_hash", "rank", "host", "rule", "__i", "__h", "__p0", "__p3", "__text", "__n", "__id", "__hash", "__turn")})

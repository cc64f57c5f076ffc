import itertools
import math
import random

import pytest
from colloquy import config as c
from colloquy.operators import grammar
from pyspark.sql import functions as F

S = c.SPEAKER_TOKENS
TS = c.TS_FIRST


def allowed(spark, ids, g=grammar.Grammar()):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    return [(r["lo"], r["hi"]) for r in df.select(grammar.allowed_ranges(F.col("ids"), g).alias("x")).first()["x"]]


TEXT, TIMES, END = (0, c.EOS - 1), (c.TS_FIRST, c.TS_LAST), (c.EOS, c.EOS)
one = lambda t: (t, t)


@pytest.mark.parametrize("ids,options,want", [
    ([], {}, [one(S[0])]), ([], {"first_no_speech": True}, [one(c.NO_SPEECH), one(S[0])]),
    ([], {"mode": "interleaved_on_change", "window_token": c.WINDOW_TOKEN, "windows": 1}, [one(S[0]), one(c.WINDOW_TOKEN)]),
    ([c.NO_SPEECH], {}, [END]), ([S[0]], {"first_ts_steps": 10}, [(TS, TS + 10)]), ([S[0], TS], {}, [TEXT]), ([S[0], TS, TS + 1], {}, [TEXT]), ([S[0], TS, 5], {}, [TEXT, TIMES]),
    ([S[0], TS, 5, TS + 9], {}, [END, TIMES, one(S[1])]), ([S[0], TS, 5, TS + 9], {"most_speakers": 1}, [END, TIMES]),
    ([S[0], TS, 5, TS + 9], {"mode": "interleaved_each_utterance"}, [END, one(S[0]), one(S[1])]),
    ([S[0], TS, 5, TS + 9], {"mode": "interleaved_on_change"}, [END, TIMES, one(S[1])]),
    ([S[0], TS, 5, TS + 9, S[1]], {"monotonic": True}, [(TS, c.TS_LAST)]), ([S[0], TS + 7, 5, TS + 9, S[1]], {"monotonic": True}, [(TS + 7, c.TS_LAST)]),
    ([S[0], TS, 5, TS + 9], {"window_token": c.WINDOW_TOKEN, "windows": 8, "fewest_windows": 1}, [TIMES, one(S[1]), one(c.WINDOW_TOKEN)]),
    ([S[0], c.WINDOW_TOKEN], {"window_token": c.WINDOW_TOKEN, "windows": 8}, [TIMES]),
])
def test_rules(spark, ids, options, want):
    assert allowed(spark, ids, grammar.Grammar(**options)) == want


def test_repeated_ngrams_are_cut_out(spark):
    ids = [S[0], TS, 5, 6, 7, 5, 6]
    assert allowed(spark, ids, grammar.Grammar(ngram=3)) == [(0, 6), (8, c.EOS - 1), TIMES]


def test_next_speakers_equal_the_rules(spark):
    pool = S[:3]
    for mode, history in itertools.product(c.MODES, [[], [0], [0, 1], [0, 1, 0], [0, 1, 2], [0, 1, 2, 1]]):
        top, last = max(history, default=-1), history[-1] if history else None
        if mode == "speaker_blocks":
            want = [top + 1] if top + 1 < 3 else []
        else:
            want = [k for k in range(min(top + 2, 3)) if mode != "interleaved_on_change" or k != last or not history]
        got = spark.createDataFrame([([pool[k] for k in history],)], "ids array<int>").select(grammar.next_speakers(F.col("ids"), mode, pool).alias("x")).first()["x"]
        assert got == [pool[k] for k in want], (mode, history)


def test_times_outweigh_text(spark):
    rng = random.Random(1)
    n = c.WINDOW_TOKEN + 1
    for boost in (0.0, 20.0):
        scores = [rng.random() for _ in range(n)]
        scores[3] += boost
        row = spark.createDataFrame([([S[0], TS, 5], scores)], "ids array<int>, scores array<double>")
        out = grammar.mask_rows(row).first()["masked"]
        assert all((x == -math.inf) == (not (TS <= k <= c.TS_LAST or boost and k < c.EOS)) for k, x in enumerate(out))


def test_pool_and_modes():
    assert grammar.Grammar(most_speakers=None).pool == S and grammar.Grammar(most_speakers=0).pool == S
    assert grammar.Grammar(most_speakers=-3).pool == S[:1] and grammar.Grammar(most_speakers=99).pool == S
    with pytest.raises(ValueError, match="mode"):
        grammar.Grammar(mode="x")


def test_slot_times_and_window_budget(spark):
    ids = [S[0], c.WINDOW_TOKEN, TS + 1, 5, TS + 2, S[1], TS + 3, c.WINDOW_TOKEN, c.WINDOW_TOKEN]
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    r = df.select(grammar.windows_in_block(F.col("ids"), c.WINDOW_TOKEN, S).alias("w"), *(grammar.first_time_of_slot(F.col("ids"), F.lit(k), S).alias(f"t{k}") for k in (1, 2, 3))).first()
    assert tuple(r) == (2, TS + 1, TS + 3, None)

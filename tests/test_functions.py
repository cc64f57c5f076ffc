from colloquy import config as c
from colloquy.functions import math as m
from colloquy.functions import text as t
from pyspark.sql import functions as F
import pytest


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("seconds,vtt,srt", [(0.0, "00:00:00.000", "00:00:00,000"), (3661.5, "01:01:01.500", "01:01:01,500"), (59.9996, "00:00:60.000", "00:01:00,000"), (-1.0, None, "00:00:00,000"), (0.0125, None, "00:00:00,012")])
def test_times(spark, seconds, vtt, srt):
    assert one(spark, t.srt_time(F.lit(seconds))) == srt
    if vtt:
        assert one(spark, t.vtt_time(F.lit(seconds))) == vtt


def test_escapes(spark):
    assert one(spark, t.escape_vtt(F.lit("a&b<c>"))) == "a&amp;b&lt;c&gt;"
    assert one(spark, t.escape_srt(F.lit("a\r\nb\nc\rd"))) == "a b c\rd"


@pytest.mark.parametrize("text,silent", [("<|nospeech|>", True), ("", True), ("<|speaker1|><|0.00|> ", True), ("<|speaker1|><|0.00|> hi<|1.00|>", False)])
def test_silence(spark, text, silent):
    assert one(spark, t.is_silent(F.lit(text))) is silent


@pytest.mark.parametrize("raw,want", [("L_C_D_ screen", "LCD screen"), ("O_ yes", "O yes"), ("T_Vs on", "TVs on"), ("A_B", "AB"), ("the D_V_Ds", "the DVDs"), ("the D_V_D_s", "the DV_D_s"), ("X_ray", "Xray"), ("plain_text", "plain_text")])
def test_acronyms(spark, raw, want):
    assert one(spark, t.join_acronyms(F.lit(raw))) == want


def test_acronyms_equal_one_match_at_a_time(spark):
    import random
    import re

    # Fixed patterns of the markup: a spelling, a capital before letters, a capital at an end.
    spelled, before, alone = r"\b([A-Z](?:_[A-Z])+)(s?)_?\b", r"\b([A-Z])_(?=[A-Za-z])", r"\b([A-Z])_(?=\W|$)"
    rng = random.Random(1)
    raw = ["".join(rng.choice("ABs__ a.") for _ in range(rng.randrange(14))) for _ in range(3000)]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(list(enumerate(raw)), "i int, t string").select("i", t.join_acronyms(F.col("t")).alias("x")).collect()}
    for i, x in enumerate(raw):
        want = re.sub(spelled, lambda m: m[1].replace("_", "") + m[2], x)
        assert got[i] == re.sub(alone, r"\1", re.sub(before, r"\1", want)), x


def test_markup_and_normalising(spark):
    assert one(spark, t.strip_markup(F.lit(" [laugh] so $ it  works , B_B_C_ . "))) == "so it works, BBC."
    n = lambda x: one(spark, t.normalize_spoken(F.lit(x)))
    assert n("The E-mail’s 1990's team 's (um) [noise] 1,999 3.5% Okay. Café naïve!") == "the email's 1990s team's 1999 3.5% ok cafe naive"
    assert n("") == "" and n("$ five %") == "five"
    assert n("$5 and ¢7") == "$5.07"


def test_keys_languages_and_apostrophes(spark):
    assert one(spark, t.word_key(F.lit("don't1 É."))) == "DON'T"
    assert one(spark, t.plain_apostrophes(F.lit("a’b‘cʼd`e´f"))) == "a'b'c'd'e'f"
    assert [one(spark, t.language_code(F.lit(x))) for x in ("en", " German ", "auto", "", None)] == ["en", "de", None, None, None]
    with pytest.raises(Exception, match="unsupported language"):
        one(spark, t.language_code(F.lit("klingon")))


def test_vectors(spark):
    d = lambda a, b: one(spark, m.cosine_distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert d([1.0, 0.0], [0.0, 2.0]) == 1 and abs(d([1.0, 1.0], [2.0, 2.0])) < 1e-12
    assert d([0.0, 0.0], [0.0, 0.0]) == 0 and d([0.0, 0.0], [1.0, 0.0]) == 1


def test_numbers(spark):
    assert one(spark, m.tiles(F.lit(30.0))) == 0 and one(spark, m.tiles(F.lit(61.0))) == 2
    assert str(one(spark, m.percent(F.lit(1), F.lit(0)))) == "nan"
    seq = [1, 2, 3, 1, 2]
    want = {seq[i + 2] for i in range(len(seq) - 2) if seq[i : i + 2] == seq[-2:]}
    assert one(spark, m.repeated_next(F.array(*map(F.lit, seq)), 3)) == sorted(want) == [3]
    assert one(spark, m.repeated_next(F.array(F.lit(1)), 3)) == []


def test_token_guard_and_options():
    c.check_tokens(EOS=50257, NO_SPEECH=None)
    with pytest.raises(ValueError, match="expected"):
        c.check_tokens(EOS=1)
    with pytest.raises(ValueError, match="at least 1"):
        c.LinkOptions(most_speakers=0)

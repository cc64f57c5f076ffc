import random
import re

import pytest
from colloquy import config as c
from colloquy.operators import parsing
from pyspark.sql import functions as F


def parse(spark, text, duration=None):
    df = spark.createDataFrame([(text, duration)], "decoded string, duration double")
    return [tuple(x) for x in df.select(parsing.segments_of(F.col("decoded"), F.col("duration")).alias("s")).first()["s"]]


def slow(text, duration):
    """The rules one by one, for comparison."""
    out, start, speaker, words, last = [], None, None, [], 0.0

    def close(end):
        nonlocal start, words, last
        said = " ".join(words)
        if re.search(r"\w", said):
            out.append([start if start is not None else last, end, said, speaker or 1])
            last = end
        start, words = None, []

    for piece in re.split(f"({parsing.TAG})", text):
        if re.fullmatch(parsing.TAG, piece):
            body = piece[2:-2]
            if body == "endoftext":
                break
            if body == "nospeech":
                start, speaker, words = None, None, []
            elif body.startswith("speaker"):
                if words:
                    close(start if start is not None else last)
                speaker = int(body[7:])
            elif words:
                close(float(body))
            else:
                start = float(body)
        elif piece.strip():
            words.append(piece.strip())
    if words:
        close(duration if duration is not None else start if start is not None else last)
    if duration is not None:
        for s in out:
            s[0] = max(0.0, min(s[0], duration))
            s[1] = max(s[0], min(s[1], duration))
    return [tuple(s) for s in out]


@pytest.mark.parametrize("text,duration,want", [
    ("<|speaker1|><|0.00|> hello there<|1.20|><|speaker2|><|1.00|> yes<|2.00|>", 3.0, [(0.0, 1.2, "hello there", 1), (1.0, 2.0, "yes", 2)]),
    ("<|nospeech|>", 3.0, []), ("<|speaker1|><|1.00|> open end", 9.0, [(1.0, 9.0, "open end", 1)]),
    ("<|speaker1|><|1.00|> beyond<|40.00|>", 30.0, [(1.0, 30.0, "beyond", 1)]), ("<|0.50|> ...<|1.00|> ok<|2.00|>", None, [(0.0, 2.0, "ok", 1)]), (None, 1.0, []),
])
def test_examples(spark, text, duration, want):
    assert parse(spark, text, duration) == want


def test_random_tags_equal_the_rules(spark):
    rng = random.Random(1)
    bits = ["<|speaker1|>", "<|speaker2|>", "<|nospeech|>", "<|endoftext|>", "<|0.00|>", "<|1.50|>", "<|2|>", "<|31.00|>", " hi", " you ", "...", "<|oops|>", " é", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(14))), rng.choice([None, 2.0, 30.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, decoded string, duration double")
    got = {r["i"]: [tuple(x) for x in r["s"]] for r in df.select("i", parsing.segments_of(F.col("decoded"), F.col("duration")).alias("s")).collect()}
    for i, text, duration in rows:
        assert got[i] == slow(text, duration), text


def test_speakers_keep_the_order_in_which_they_speak(spark):
    df = spark.createDataFrame([("m", "A", 0, "<|speaker2|><|0.00|> b<|1.00|><|speaker1|><|1.00|> a<|2.00|><|speaker2|><|2.00|> c<|3.00|>", 3.0), ("m", "A", 1, "<|nospeech|>", 3.0)], "meeting_id string, pass string, ci int, decoded string, duration double")
    rows = parsing.parse_windows(df).orderBy("seg_ord").collect()
    assert [(r["lspk"], r["text"]) for r in rows] == [(2, "b"), (1, "a"), (2, "c")] and rows[0]["spk_ord"] < rows[1]["spk_ord"]
    texts = df.select(parsing.first_emit_texts(parsing.segments_of(F.col("decoded"), F.col("duration"))).alias("x")).first()["x"]
    assert texts == ["b c", "a"]


def test_tokens_to_text(spark):
    ids = [c.SPEAKER_TOKENS[0], c.TS_FIRST, 7, c.WINDOW_TOKEN, c.TS_FIRST + 50, c.SPEAKER_TOKENS[1], c.TS_FIRST + 5, 8, c.EOS, 9]
    tokens = spark.createDataFrame([("r", k, x) for k, x in enumerate(ids)], "row_id string, pos int, token int")
    vocabulary = spark.createDataFrame([(7, " seven"), (8, " eight"), (9, " nine")], "token int, piece string")
    kept = parsing.decode_tokens(tokens, vocabulary).first()["decoded"]
    assert kept == "<|speaker1|><|0.00|> seven<|31.00|><|speaker2|><|30.10|> eight"
    assert parsing.decode_tokens(tokens, vocabulary, reset_on_speaker=True).first()["decoded"].endswith("<|speaker2|><|0.10|> eight")


def test_every_token_history_is_decoded(spark, tmp_path):
    from colloquy.plans.queries import QUERIES

    turns = spark.createDataFrame([(7, 0, "user", "abc"), (7, 1, "assistant", "de")], "conv_id long, turn int, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["row_id"]: r["decoded"] for r in QUERIES["decode_tokens"](spark, str(tmp_path)).collect()}
    assert got.keys() == {f"7:{k}" for k in range(11)} and got["7:0"] == "" and got["7:1"] == "<|speaker1|>"
    assert all(got[f"7:{k + 1}"].startswith(got[f"7:{k}"]) for k in range(10))

import json
import math

import numpy as np
import pytest
from colloquy import config as c
from colloquy.operators import kernels, scoring, turns
from colloquy.sources import benchmark, render
from pyspark.sql import functions as F

SEG = "meeting_id string, seg_idx int, gid int, speaker string, start double, end double, text string"


def segments(spark, *rows):
    return spark.createDataFrame([("m", k, g, f"SPEAKER_{g:02d}", float(s), float(e), x) for k, (g, s, e, x) in enumerate(rows)], SEG)


def names(df):
    return [r["speaker"][-1] for r in df.orderBy("seg_idx").collect()]


def test_bridges_are_smoothed_from_left_to_right(spark):
    rows = [(0, 0, 1, "a"), (1, 1.1, 1.5, "mm"), (0, 1.6, 3, "b"), (1, 3.1, 3.5, "x"), (2, 3.6, 4.0, "y"), (0, 4.1, 5, "c")]
    assert names(turns.smooth_bridges(segments(spark, *rows))) == ["0", "0", "0", "1", "2", "0"]
    chained = [(0, 0, 1, "a"), (1, 1.1, 1.5, "b"), (0, 1.6, 2.0, "c"), (1, 2.1, 2.5, "d")]
    assert names(turns.smooth_bridges(segments(spark, *chained))) == ["0", "0", "0", "1"]
    long = [(0, 0, 1, "a"), (1, 1.1, 2.5, "b"), (0, 2.6, 3, "c"), (1, 4, 4.2, "d"), (0, 4.3, 5, "e"), (1, 5.1, 5.3, "one two three four five"), (0, 5.4, 6, "f")]
    assert names(turns.smooth_bridges(segments(spark, *long))) == ["0", "1", "0", "1", "1", "1", "0"]
    assert names(turns.smooth_bridges(segments(spark, (0, 0, 1, "only")))) == ["0"]


def test_light_speakers_follow_their_neighbours(spark):
    def talk(light):
        rows, at = [], 0.0
        for k in range(6):
            rows.append((0, at, at + 6, "long talk"))
            at += 6
            if k in light:
                rows.append((light[k], at + 0.1, at + 0.6, "yes"))
                at += 0.7
        return rows

    merged = turns.merge_by_context(segments(spark, *talk({0: 1, 2: 1, 4: 2})))
    assert {r["gid"] for r in merged.collect()} == {0, 2}
    votes = {r["gid"]: r for r in turns.context_votes(segments(spark, *talk({0: 1, 2: 1, 4: 2}))).collect()}
    assert votes[1]["decision"] == "merge" and votes[1]["best_votes"] == 2 and votes[2]["decision"] == "keep_weak_context"
    wordy = segments(spark, (0, 0, 20, "x"), (1, 20.1, 21, "a b c d e f g h i"), (2, 40, 41, "far"))
    assert {r["gid"]: r["decision"] for r in turns.context_votes(wordy).collect()} == {1: "keep_long_turns", 2: "keep_no_context_votes"}
    assert turns.context_votes(segments(spark, (0, 0, 1, "short"))).count() == 0


def test_names_and_times(spark):
    rows = segments(spark, (5, 1, 2, "a"), (3, 2, 3, "b"), (5, 3, 4, "c"))
    assert names(turns.name_by_appearance(rows)) == ["0", "1", "0"]
    assert [(r["start"], r["end"]) for r in turns.to_original_time(segments(spark, (0, 0.5, 2, "a"))).collect()] == [(0.0, 1.25)]


def slow_errors(r, h):
    d = np.zeros((len(r) + 1, len(h) + 1), dtype=int)
    d[:, 0], d[0] = np.arange(len(r) + 1), np.arange(len(h) + 1)
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (r[i - 1] != h[j - 1]))
    return d[-1, -1]


def test_word_errors_equal_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(100):
        r, h = ([str(x) for x in rng.integers(0, 5, rng.integers(0, 12))] for _ in range(2))
        assert kernels.word_errors(r, h) == slow_errors(r, h)


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "meeting_id string, speaker string, text string")


def test_cpwer_pairs_speakers_best_and_counts_extra_ones(spark):
    refs = texts(spark, ("m", "x", "one two three"), ("m", "y", "four five"), ("n", "x", "alone"), ("k", "x", "a b"))
    hyps = texts(spark, ("m", "p", "four five"), ("m", "q", "one too three"), ("m", "r", "extra words"), ("k", "p", "a b"), ("h", "p", "nobody said"))
    got = {r["meeting_id"]: (r["errs"], r["ref_words"]) for r in scoring.cpwer(refs, hyps).collect()}
    assert got == {"m": (3, 5), "n": (1, 1), "k": (0, 2), "h": (2, 0)}


def test_masks_follow_the_corpus(spark):
    refs = spark.createDataFrame([(m, 0, "x", 0.0, 2.0, "one two") for m in ("ami1", "no1")] + [(m, 1, "x", 5.0, 6.0, "three") for m in ("ami1", "no1")], "meeting_id string, ord int, speaker_id string, begin_time double, end_time double, text string")
    hyps = spark.createDataFrame([(m, 0, "p", 0.0, 2.0, "one two") for m in ("ami1", "no1")] + [(m, 1, "p", 5.0, 6.0, "three") for m in ("ami1", "no1")], "meeting_id string, seg_idx int, speaker string, start double, end double, text string")
    spans = spark.createDataFrame([("ami1", 1.0, 2.5), ("no1", 1.0, 2.5)], "meeting_id string, start double, end double")
    corpora = spark.createDataFrame([("ami1", "AMI"), ("no1", "notsofar"), ("empty", "icsi")], "meeting_id string, corpus string")
    got = {r["meeting_id"]: (r["errs"], r["ref_words"]) for r in scoring.score_meetings(refs, hyps, spans, corpora).collect()}
    assert got == {"ami1": (0, 1), "no1": (1, 3), "empty": (0, 0)}


def test_pooling_takes_the_mean_of_rounded_percentages(spark):
    rows = spark.createDataFrame([("ami", 1, 3), ("ami", 1, 3), ("icsi", 1, 7)], "corpus string, errs long, ref_words long")
    got = {r["corpus"]: r["cpwer_pct"] for r in scoring.pooled(rows).collect()}
    assert got == {"ami": 33.33, "icsi": 14.29, "macro": 23.81}
    none = {r["corpus"]: r["cpwer_pct"] for r in scoring.pooled(spark.createDataFrame([("x", 0, 0)], rows.schema)).collect()}
    assert math.isnan(none["x"]) and scoring.pooled(rows.limit(0)).count() == 0


def test_renderers(spark):
    rows = segments(spark, (0, 0, 1.5, "a & <b>"), (0, 2, 3, "two\nlines"), (1, 3661, 3662, "late"))
    body = lambda fmt: render.render(rows, fmt).first()["body"]
    assert body("vtt").startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\n<v SPEAKER_00>a &amp; &lt;b&gt;</v>\n\n")
    assert body("srt").split("\n")[:4] == ["1", "00:00:00,000 --> 00:00:01,500", "SPEAKER_00: a & <b>", ""] and "SPEAKER_00: two lines" in body("srt")
    assert body("text") == "[SPEAKER_00]\na & <b>\ntwo\nlines\n\n[SPEAKER_01]\nlate"
    meetings = spark.createDataFrame([("m", 9.0, None), ("quiet", 1.0, "en")], "meeting_id string, duration double, language string")
    got = {r["meeting_id"]: json.loads(r["body"]) for r in render.render(rows, "json", meetings).collect()}
    assert got["m"]["speakers"] == ["SPEAKER_00", "SPEAKER_01"] and got["m"]["language"] is None and got["quiet"]["segments"] == []
    with pytest.raises(ValueError, match="unknown response format"):
        render.render(rows, "pdf")


def test_text_sink_and_evidence(spark, tmp_path):
    rows = segments(spark, (0, 0, 1, "hello"))
    render.write_text(render.render(rows, "text"), f"{tmp_path}/out")
    assert [p.read_text() for p in (tmp_path / "out").rglob("part-*.txt")] == ["[SPEAKER_00]\nhello\n"]
    windows = spark.createDataFrame([("m", "A", 0, 0.0, 1.5)], "meeting_id string, pass string, ci int, start_s double, end_s double")
    tagged = spark.createDataFrame([("m", "A", 0, "x", 1.5)], "meeting_id string, pass string, ci int, decoded string, duration double")
    local = spark.createDataFrame([], "meeting_id string, pass string, ci int, lspk int, spk_ord int, seg_ord int, start double, end double, text string")
    one = render.decode_evidence(windows, tagged, local, rate=16000, pad_seconds=0.75).first()
    assert one["windows"][0]["end_sample"] == 24000 and one["onset_pad_samples"] == 12000
    with pytest.raises(Exception, match="cardinality"):
        render.decode_evidence(windows, tagged.limit(0), local, rate=16000, pad_seconds=0.75).collect()
    ids = spark.createDataFrame([("m", 0, 1, 4)], "meeting_id string, ci int, lspk int, gid int")
    final = spark.createDataFrame([("m", 4, "SPEAKER_00")], "meeting_id string, gid int, final_speaker string")
    assert render.speaker_mapping(ids, final, rewritten=False).first()["final_speaker"] == "SPEAKER_00" and render.speaker_mapping(ids, final, rewritten=True).count() == 0


def test_benchmark_rows(spark, tmp_path):
    utterances = json.dumps([{"speaker": "x", "start": 1, "end": 2.5, "text": "a"}, {"speaker_id": "y", "begin_time": 3, "end_time": 4}, {"speaker": "z", "start_time": 7}])
    rows = spark.createDataFrame([("m2", utterances, "[[1, 2]]"), ("m1", "[]", ""), ("m3", "[]", None)], "meeting_id string, utterances_json string, unknown_spans_json string")
    got = [tuple(r)[1:] for r in benchmark.references(rows).orderBy("ord").collect()]
    assert got == [(0, "x", 1.0, 2.5, "a"), (1, "y", 3.0, 4.0, ""), (2, "z", 7.0, 0.0, "")]
    assert [tuple(r) for r in benchmark.masked_spans(rows).collect()] == [("m2", 1.0, 2.0)]
    rows.write.parquet(f"{tmp_path}/ami.parquet")
    read = benchmark.read_benchmark(spark, str(tmp_path), "ami", limit=2)
    assert {(r["meeting_id"], r["corpus"]) for r in read.collect()} == {("m1", "ami"), ("m2", "ami")}
    with pytest.raises(ValueError, match="unknown split"):
        benchmark.checked_splits("ami,tv")
    audio = spark.createDataFrame([((bytearray(b"x"), "p"),), ((None, "p"),)], "audio struct<bytes:binary,path:string>")
    picked = [tuple(r["a"]) for r in audio.select(benchmark.audio_column(audio).alias("a")).collect()]
    assert (bytes(picked[0][0]), *picked[0][1:]) == (b"x", None, None) and picked[1] == (None, None, "p")
    with pytest.raises(TypeError, match="audio"):
        benchmark.audio_column(spark.range(1).withColumn("audio", F.lit(1)))


def test_word_cases_from_json(spark, tmp_path):
    word = {"text": "a", "start": 0.0, "end": 1.0, "node": "A:1:1", "speaker": None, "score": 0.5, "timing": "ctc_forced"}
    (tmp_path / "case-one.json").write_text(json.dumps({"provenance": {"human_verified": False}, "gap": [0.5, 2.0], "A": [word], "B": [word, word]}, indent=1))
    r = benchmark.read_cases(spark, str(tmp_path)).first()
    assert (r["case_id"], r["gap_start"], len(r["b"]), r["a"][0]["score"]) == ("case-one", 0.5, 2, 0.5) and c.SPLITS

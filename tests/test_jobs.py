import io
import json
import struct
import wave

import numpy as np
import pytest
from colloquy import cli
from colloquy import config as c
from colloquy.plans import meetings
from colloquy.plans.queries import ORACLE, QUERIES
from colloquy.sources import audio, render
from colloquy.streaming import events as streams


def wav(x, rate=16000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        full = 2 ** (8 * width - 1) - 1
        data = b"".join(struct.pack("<i", int(v * full))[:width] for v in x for _ in range(channels)) if width > 1 else bytes(int(v * 127) + 128 for v in x for _ in range(channels))
        w.writeframes(data)
    return out.getvalue()


@pytest.mark.parametrize("width,channels,rate", [(2, 1, 16000), (2, 2, 16000), (1, 1, 16000), (3, 1, 16000), (4, 2, 16000), (2, 1, 8000), (2, 1, 48000)])
def test_wav_formats(width, channels, rate):
    x = np.sin(np.arange(rate // 10) * 2 * np.pi * 100 / rate) * 0.5
    got, found = audio.decode_wav(wav(x, rate, channels, width))
    assert found == rate and np.abs(got - x).max() < (0.01 if width == 1 else 1e-3)
    again = audio.resampled(got, rate)
    assert abs(len(again) - 1600) <= 1 and abs(np.abs(again[200:-200]).max() - 0.5) < 0.05


def model_stub():
    """A recogniser that hears who speaks from the level of the samples, and a voice per level."""

    def decode(batch, seconds):
        out = []
        for x, d in zip(batch, seconds, strict=True):
            x = np.abs(np.asarray(x[: int(d * 16000)]))
            level = x[: len(x) // 800 * 800].reshape(-1, 800).max(1).round(1)
            text, seen, k = "", [], 0
            while k < len(level):
                j = k
                while j < len(level) and level[j] == level[k]:
                    j += 1
                if level[k] > 0 and j - k > 4:
                    if level[k] not in seen:
                        seen.append(level[k])
                    text += f"<|speaker{seen.index(level[k]) + 1}|><|{k * 0.05:.2f}|> level {int(level[k] * 10)}<|{j * 0.05:.2f}|>"
                k = j
            out.append(text or "<|nospeech|>")
        return out

    return decode


def voice_stub():
    def embed(clips):
        return [np.eye(12)[int(round(float(np.abs(np.asarray(x)).max()), 1) * 10)].tolist() for x in clips]

    return embed


models = meetings.Models(decoder=model_stub, embedder=voice_stub, batch=4)


def talk(seconds):
    """Three levels in turn: 0.3, 0.6, 0.9, seven seconds each, a second of silence between."""
    x = np.zeros(int(seconds * 16000), dtype=np.float32)
    for k in range(int(seconds // 8)):
        x[k * 128000 : k * 128000 + 112000] = (0.3, 0.6, 0.9)[k % 3]
    return x


@pytest.fixture(scope="module")
def transcripts(spark, tmp_path_factory):
    rows = spark.createDataFrame([("long", talk(200).tolist()), ("short", talk(24).tolist()), ("quiet", [0.0] * 16000)], "meeting_id string, samples array<float>")
    def keep(df):
        path = str(tmp_path_factory.mktemp("kept") / "t")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = meetings.transcribe(keep(audio.audio_frames(rows)), models, c.LinkOptions(samples=2), checkpoint=keep)
    return found


def test_recordings_to_speakers(transcripts):
    rows = transcripts.segments.orderBy("meeting_id", "seg_idx").collect()
    for meeting, n in (("long", 3), ("short", 3)):
        said = [(r["speaker"], r["text"]) for r in rows if r["meeting_id"] == meeting]
        assert len(set(said)) == len({s for s, _ in said}) == n and said[0][0] == "SPEAKER_00"
    assert not [r for r in rows if r["meeting_id"] == "quiet"]
    first = next(r for r in rows if r["meeting_id"] == "short")
    assert abs(first["start"] - 0.0) < 0.06 and abs(first["end"] - 7.0) < 0.06
    told = {r["meeting_id"]: r for r in transcripts.meetings.collect()}
    assert told["long"]["duration"] == 200.0 and told["long"]["num_chunks"] >= 5 and told["quiet"]["mode"] is None
    body = {r["meeting_id"]: json.loads(r["body"]) for r in render.render(transcripts.segments, "json", transcripts.meetings).collect()}
    assert body["quiet"]["speakers"] == [] and body["short"]["num_chunks"] == 1


def test_scores_of_a_benchmark(spark, transcripts):
    segs = [r for r in transcripts.segments.collect() if r["meeting_id"] == "short"]
    utterances = json.dumps([{"speaker": r["speaker"], "start": r["start"], "end": r["end"], "text": r["text"]} for r in segs])
    rows = spark.createDataFrame([("short", "ami", utterances, "[]")], "meeting_id string, corpus string, utterances_json string, unknown_spans_json string")
    scores, pooled = meetings.evaluate(rows, transcripts.segments)
    assert scores.first()["errs"] == 0 and scores.first()["ref_words"] == 2 * len(segs)
    assert {r["corpus"]: r["cpwer_pct"] for r in pooled.collect()} == {"ami": 0.0, "macro": 0.0}


def test_out_of_memory_halves_a_batch(spark):
    from colloquy.operators import windows

    def backend():
        def decode(xs, ds):
            if len(xs) > 1:
                raise RuntimeError("out of memory")
            return ["<|nospeech|>"]

        return decode

    rows = spark.createDataFrame([("m", "A", k, 0.0, 1.0, [0.0]) for k in range(5)], "meeting_id string, pass string, ci int, start_s double, end_s double, samples array<float>")
    assert windows.decode_windows(rows, backend).count() == 5


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "talk.wav").write_bytes(wav(talk(24)))
    assert cli.main([str(tmp_path / "in"), "--models", "tests.test_jobs:models", "--format", "text", "--no-two-pass"]) == 0
    assert capsys.readouterr().out.startswith("[SPEAKER_00]\nlevel 3\n")
    assert cli.main([str(tmp_path / "in"), "--models", "tests.test_jobs:models", "--format", "srt", "-o", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out" / "meeting_id=talk").exists()
    with pytest.raises(ValueError, match="max_speakers"):
        cli.options_of(cli.parser().parse_args(["x", "--models", "m", "--max-speakers", "0"]))
    assert cli.options_of(cli.parser().parse_args(["x", "--models", "m", "--max-speakers", "99"])).most_speakers == 8


def test_streams_equal_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=17 * k), k % 3, "ab"[k % 2], 1.0) for k in range(50)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    live = streams.read_events(spark, f"{tmp_path}/in", df.schema.simpleString()[7:-1].replace(":", " "))
    q = streams.tumbling_counts(live).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.table("counts").collect()}
    assert got == {tuple(r) for r in streams.tumbling_counts(df).collect()}
    assert streams.sessions(df, "30 minutes").count() == 3 and streams.staggered_counts(df).count() > 0


def test_every_query_has_a_name_and_sql_names_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 40

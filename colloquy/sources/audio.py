"""Audio files to frames of 50 ms."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LONGEST_AUDIO_SECONDS, SAMPLE_RATE
from ..operators.windows import FRAME_SAMPLES
from ..schemas import FRAMES


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1) and their rate, from PCM of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), dtype=np.uint8)
    if width == 1:
        x = (raw.astype(np.float32) - 128) / 128
    else:
        wide = np.zeros((len(raw) // width, 4), dtype=np.uint8)
        wide[:, 4 - width :] = raw[: len(wide) * width].reshape(-1, width)
        x = wide.view("<i4").ravel().astype(np.float32) / 2**31
    return x.reshape(-1, channels).mean(1).astype(np.float32), rate


def resampled(x: np.ndarray, rate: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Linear interpolation to another rate, behind a moving average when going down."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    if rate > to:
        k = max(1, round(rate / to))
        x = np.convolve(x, np.ones(k) / k, mode="same")
    at = np.arange(int(len(x) * to / rate)) * rate / to
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def frames_of(samples: np.ndarray) -> Iterator[tuple[int, list[float], bool]]:
    for k in range(0, len(samples), FRAME_SAMPLES):
        part = samples[k : k + FRAME_SAMPLES]
        yield k // FRAME_SAMPLES, part.tolist(), len(part) < FRAME_SAMPLES


def audio_frames(rows: DataFrame) -> DataFrame:
    """Frames of recordings given as (meeting_id, content: WAV bytes) or (meeting_id, samples at 16 kHz).

    Rows leave a file's task as frames, so no later step holds a whole recording.
    """
    raw = "content" in rows.columns

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for meeting, data in zip(pdf["meeting_id"], pdf["content" if raw else "samples"], strict=True):
                x = resampled(*decode_wav(bytes(data))) if raw else np.asarray(data, dtype=np.float32)
                if len(x) > LONGEST_AUDIO_SECONDS * SAMPLE_RATE:
                    raise ValueError(f"{meeting}: longer than {LONGEST_AUDIO_SECONDS} s")
                held = list(frames_of(x))
                for a in range(0, len(held), 1200):
                    yield pd.DataFrame([(meeting, *f) for f in held[a : a + 1200]], columns=["meeting_id", "frame_idx", "samples", "is_tail"])

    return rows.select("meeting_id", "content" if raw else "samples").mapInPandas(run, FRAMES)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all WAV files under ``path``; a meeting is named after its file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return audio_frames(files.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("meeting_id"), "content"))


def durations(frames: DataFrame) -> DataFrame:
    return frames.groupBy("meeting_id").agg((F.sum(F.size("samples")) / F.lit(float(SAMPLE_RATE))).alias("duration"))

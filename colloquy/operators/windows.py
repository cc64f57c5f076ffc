"""Recordings to windows: frames, loudness, cuts at quiet places."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions.math import let

FRAME_SAMPLES = int(c.FRAME_SECONDS * c.SAMPLE_RATE)


def pad_onset(frames: DataFrame, seconds: float = c.ONSET_PAD_SECONDS) -> DataFrame:
    """Silent frames in front of every recording."""
    n = round(seconds / c.FRAME_SECONDS)
    if n <= 0:
        return frames
    silent = frames.select("meeting_id").distinct().select("meeting_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("frame_idx"), F.array_repeat(F.lit(0.0).cast("float"), FRAME_SAMPLES).alias("samples"), F.lit(False).alias("is_tail"))
    return silent.unionByName(frames.withColumn("frame_idx", (F.col("frame_idx") + n).cast("int")))


def loudness(frames: DataFrame) -> DataFrame:
    """(meeting_id, frame_idx, rms) of whole frames."""
    power = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return frames.where(~F.col("is_tail")).select("meeting_id", "frame_idx", F.sqrt(power / F.size("samples") + 1e-12).alias("rms"))


def noise_floor(rms: DataFrame) -> DataFrame:
    return rms.groupBy("meeting_id").agg(F.percentile("rms", F.lit(0.25)).alias("floor"))


def cuts_of(rms: Column, floor: Column, duration: Column, window: float, first_window: float | None = None) -> Column:
    """Windows (start_s, end_s) of one recording, by one fold over its frames' loudness.

    A window ends at the quietest frame of the last seconds before its full length, if that is
    quiet and leaves enough of it, else at its full length.
    """
    w = lambda n: F.when(n == 0, F.lit(float(first_window))).otherwise(F.lit(float(window))) if first_window is not None else F.lit(float(window))
    zero = F.struct(F.lit(0.0).alias("pos"), F.array().cast("array<struct<start_s:double,end_s:double>>").alias("out"))
    most = F.ceil(duration / F.lit(min(c.SHORTEST_WINDOW_SECONDS, window, first_window or window))).cast("int") + 1
    search = int(c.CUT_SEARCH_SECONDS / c.FRAME_SECONDS)

    frame = lambda x: F.floor(x / F.lit(c.FRAME_SECONDS)).cast("int")

    def cut_at(pos: Column, ideal: Column) -> Column:
        """The quiet place before ``ideal``, or ``ideal``."""
        first = F.greatest(frame(pos) + 1, frame(ideal) - search)

        def quietest(v: Column) -> Column:
            part, low = v["part"], F.array_min(v["part"])
            at = (v["first"] + F.array_position(part, low).cast("int") - 1) * F.lit(c.FRAME_SECONDS)
            return F.when((low <= floor) & (at - pos >= c.SHORTEST_WINDOW_SECONDS), at).otherwise(ideal)

        last = F.least(frame(ideal), F.size(rms))
        found = let(first, lambda f: F.struct(f.alias("first"), F.slice(rms, f + 1, F.greatest(last - f, F.lit(0))).alias("part")))
        return F.when(ideal >= duration, ideal).otherwise(let(found, quietest))

    def step(s: Column, _: Column) -> Column:
        def add(end: Column) -> Column:
            more = F.concat(s["out"], F.array(F.struct(s["pos"].alias("start_s"), end.alias("end_s"))))
            return F.struct(end.alias("pos"), more.alias("out"))

        ideal = F.least(s["pos"] + w(F.size(s["out"])), duration)
        return F.when(s["pos"] >= duration, s).otherwise(let(let(ideal, lambda i: cut_at(s["pos"], i)), add))

    return F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda s: s["out"])


def cut_windows(rms: DataFrame, durations: DataFrame, *, window: float = c.WINDOW_SECONDS, first_window: float | None = None, name: str = "A") -> DataFrame:
    """(meeting_id, pass, ci, start_s, end_s) of every recording; one not longer than a window stays whole."""
    listed = rms.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "rms"))), lambda x: x["rms"]).alias("rms"))
    known = durations.join(listed, "meeting_id", "left").join(noise_floor(rms), "meeting_id", "left").withColumn("rms", F.coalesce("rms", F.array().cast("array<double>")))
    cut = cuts_of(F.col("rms"), F.coalesce("floor", F.lit(0.0)), F.col("duration"), window, first_window)
    return known.where("duration > 0").select("meeting_id", F.lit(name).alias("pass"), F.posexplode(cut).alias("ci", "w")).select("meeting_id", "pass", "ci", "w.start_s", "w.end_s")


def window_samples(frames: DataFrame, windows: DataFrame, *, pad_to: float | None = c.WINDOW_SECONDS) -> DataFrame:
    """Samples of each window, cut exactly and padded with silence at the end; at most one window's
    samples are a row."""
    span = F.sequence(F.floor(F.col("start_s") / c.FRAME_SECONDS).cast("int"), F.ceil(F.col("end_s") / c.FRAME_SECONDS).cast("int"))
    wanted = windows.withColumn("frame_idx", F.explode(span))
    met = wanted.join(frames.select("meeting_id", "frame_idx", "samples"), ["meeting_id", "frame_idx"])
    whole = met.groupBy("meeting_id", "pass", "ci", "start_s", "end_s").agg(F.min("frame_idx").alias("f"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "samples"))), lambda x: x["samples"])).alias("s"))
    first, last = F.floor(F.col("start_s") * c.SAMPLE_RATE).cast("int"), F.floor(F.col("end_s") * c.SAMPLE_RATE).cast("int")
    cut = F.slice("s", first - F.col("f") * FRAME_SAMPLES + 1, last - first)
    full = F.concat(cut, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(int((pad_to or 0) * c.SAMPLE_RATE)) - F.size(cut), F.lit(0)))) if pad_to else cut
    return whole.select("meeting_id", "pass", "ci", "start_s", "end_s", full.alias("samples"))


Decoder = Callable[[Iterable[list[float]], Iterable[float]], list[str]]


def decode_windows(samples: DataFrame, backend: Callable[[], Decoder], *, batch: int = 8) -> DataFrame:
    """Tagged text of each window from a model.  ``backend`` is called once for each worker and
    returns what decodes a batch; a batch that runs out of memory is halved."""

    def halve(decode: Decoder, xs: list, ds: list) -> list[str]:
        try:
            return list(decode(xs, ds))
        except (MemoryError, RuntimeError) as error:
            if len(xs) == 1 or not (isinstance(error, MemoryError) or "out of memory" in str(error).lower()):
                raise
            k = len(xs) // 2
            return halve(decode, xs[:k], ds[:k]) + halve(decode, xs[k:], ds[k:])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = backend()
        for pdf in pdfs:
            texts: list[str] = []
            seconds = (pdf["end_s"] - pdf["start_s"]).tolist()
            for a in range(0, len(pdf), batch):
                texts += halve(decode, list(pdf["samples"][a : a + batch]), seconds[a : a + batch])
            yield pd.DataFrame({"meeting_id": pdf["meeting_id"], "pass": pdf["pass"], "ci": pdf["ci"], "decoded": texts, "duration": seconds})

    return samples.mapInPandas(run, "meeting_id string, pass string, ci int, decoded string, duration double")


Embedder = Callable[[list], list]


def node_evidence(local: DataFrame, samples: DataFrame, clean: DataFrame, backend: Callable[[], Embedder]) -> DataFrame:
    """Nodes with seconds, cleanness and voice vectors: of the clean stretch, and of all own speech."""
    node = ["meeting_id", "pass", "ci", "lspk"]
    spoken = local.groupBy(*node).agg(F.min("spk_ord").alias("spk_ord"), F.sum(F.col("end") - F.col("start")).alias("total_dur"), F.array_sort(F.collect_list(F.struct("seg_ord", "start", "end"))).alias("own"))
    known = spoken.join(clean.select(*node, F.col("start").alias("cs"), F.col("end").alias("ce"), "is_clean"), node, "left")
    rows = known.join(samples.select("meeting_id", "pass", "ci", "samples"), ["meeting_id", "pass", "ci"], "left")
    rate = c.SAMPLE_RATE

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = backend()
        for pdf in pdfs:
            out = []
            for which, r in zip(pdf["pass"], pdf.itertuples(), strict=True):
                x = [] if r.samples is None else r.samples
                clean_clip = x[int(r.cs * rate) : int(r.ce * rate)] if r.is_clean and r.cs is not None and not pd.isna(r.cs) else []
                parts = [x[int(s["start"] * rate) : int(s["end"] * rate)] for s in r.own]
                every = [v for p in parts for v in p]
                spine = embed([clean_clip])[0] if len(clean_clip) / rate >= c.LEAST_EMBED_SECONDS else None
                whole = embed([every])[0] if r.total_dur >= c.LEAST_CONCAT_SECONDS and len(every) / rate >= c.LEAST_CONCAT_SECONDS else None
                length = float(r.ce - r.cs) if r.is_clean and not pd.isna(r.cs) else 0.0
                out.append((r.meeting_id, which, int(r.ci), int(r.lspk), int(r.spk_ord), float(r.total_dur), bool(r.is_clean), length, spine, whole))
            yield pd.DataFrame(out, columns=["meeting_id", "pass", "ci", "lspk", "spk_ord", "total_dur", "is_clean", "window_s", "spine_emb", "concat_emb"])

    from ..schemas import NODES

    return rows.mapInPandas(run, NODES)

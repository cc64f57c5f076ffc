"""Whole jobs: recordings to linked transcripts, and benchmark rows to scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..operators import intervals, linking, parsing, scoring, turns, windows
from ..sources.audio import durations
from .storage import stored


@dataclass(frozen=True)
class Models:
    """What recognises speech and voices; each is a function that a worker calls once."""

    decoder: Callable[[], windows.Decoder]
    embedder: Callable[[], windows.Embedder]
    batch: int = 8


@dataclass(frozen=True)
class Transcripts:
    segments: DataFrame
    identities: DataFrame
    meetings: DataFrame
    windows: DataFrame
    tagged: DataFrame
    local: DataFrame


def absolute(local: DataFrame, grid: DataFrame) -> DataFrame:
    """Local segments on the meeting's timeline, with their window's bounds."""
    placed = local.join(grid, ["meeting_id", "pass", "ci"])
    return placed.select("meeting_id", "ci", "lspk", (F.col("start_s") + F.col("start")).alias("start"), (F.col("start_s") + F.col("end")).alias("end"), F.col("start_s").alias("window_start"), F.col("end_s").alias("window_end"))


def link_passes(local: DataFrame, grid: DataFrame, nodes: DataFrame, options: c.LinkOptions = c.LinkOptions()) -> DataFrame:
    """Identities from both passes' local segments, windows and node evidence (pass A and B in each)."""
    of = lambda df, name: df.where(F.col("pass") == name)
    a, b = of(nodes, "A"), of(nodes, "B")
    co = intervals.co_time(absolute(of(local, "A"), of(grid, "A")), absolute(of(local, "B"), of(grid, "B")))
    pairs = linking.witness_pairs(co, a, b)
    durable = nodes.where((F.col("total_dur") >= c.LEAST_DURABLE_SECONDS) & F.col("spine_emb").isNotNull())
    left = of(durable, "A").select("meeting_id", F.col("ci").alias("ci_a"), F.col("lspk").alias("l_a"), F.col("spine_emb").alias("va"))
    right = of(durable, "B").select("meeting_id", F.col("ci").alias("ci_b"), F.col("lspk").alias("l_b"), F.col("spine_emb").alias("vb"))
    same = pairs.join(left, ["meeting_id", "ci_a", "l_a"]).join(right, ["meeting_id", "ci_b", "l_b"]).select("meeting_id", linking.cosine_distance(F.col("va"), F.col("vb")).alias("d"))
    other = durable.select("meeting_id", "pass", "ci", F.col("lspk").alias("l2"), F.col("spine_emb").alias("v2"))
    cross = durable.join(other, ["meeting_id", "pass", "ci"]).where("lspk < l2").select("meeting_id", linking.cosine_distance(F.col("spine_emb"), F.col("v2")).alias("d"))
    thresholds = linking.calibrated_threshold(same, cross, options.samples)
    counts = of(grid, "A").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n_windows"))
    return linking.link(nodes, pairs, thresholds, counts, options)


def transcribe(frames: DataFrame, models: Models, options: c.LinkOptions = c.LinkOptions(), *, languages: DataFrame | None = None, merge_context: bool = False, smooth: bool = False, checkpoint: Callable[[DataFrame], DataFrame] = stored) -> Transcripts:
    """Recordings as frames to speaker-attributed segments.

    ``checkpoint`` stores what later steps share (loudness, windows, decoded texts, voice vectors),
    so that it is made once and plans stay short.
    Only recordings with enough windows are decoded a second time.
    """
    if options.most_speakers is not None and int(options.most_speakers) < 1:
        raise ValueError("most_speakers must be at least 1")
    lengths = durations(frames)
    padded = windows.pad_onset(frames)
    padded_lengths = durations(padded)
    rms = checkpoint(windows.loudness(padded))
    grid_a = windows.cut_windows(rms, padded_lengths)
    enough = grid_a.groupBy("meeting_id").count().where(F.col("count") >= c.SECOND_PASS_LEAST_WINDOWS).select("meeting_id")
    grid = grid_a
    if options.two_pass:
        again = lambda df: df.join(enough, "meeting_id", "left_semi")
        grid = grid_a.unionByName(windows.cut_windows(again(rms), again(padded_lengths), window=c.SECOND_PASS_SECONDS, first_window=c.SECOND_PASS_FIRST_SECONDS, name="B"))
    grid = checkpoint(grid)
    samples = windows.window_samples(padded, grid)
    tagged = checkpoint(windows.decode_windows(samples, models.decoder, batch=models.batch))
    local = checkpoint(parsing.parse_windows(tagged))
    nodes = checkpoint(windows.node_evidence(local, samples, intervals.clean_windows(local), models.embedder))
    identities = checkpoint(link_passes(local, grid, nodes, options))
    found = turns.project(local.where("pass = 'A'"), grid.where("pass = 'A'"), identities)
    if merge_context:
        found = turns.merge_by_context(found)
    if smooth:
        found = turns.smooth_bridges(found)
    segments = turns.to_original_time(turns.name_by_appearance(found))
    counts = grid.where("pass = 'A'").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("num_chunks"))
    mode = identities.groupBy("meeting_id").agg(F.first("mode").alias("mode"))
    meetings = lengths.join(counts, "meeting_id", "left").join(mode, "meeting_id", "left")
    meetings = meetings.join(languages, "meeting_id", "left") if languages is not None else meetings.withColumn("language", F.lit("auto"))
    meetings = meetings.select("meeting_id", F.round("duration", 2).alias("duration"), F.coalesce("language", F.lit("auto")).alias("language"), F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), "mode")
    return Transcripts(segments, identities, meetings, grid, tagged, local)


def evaluate(benchmark: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores of meetings, pooled scores) of benchmark rows against segments."""
    from ..sources.benchmark import masked_spans, references

    corpora = benchmark.select("meeting_id", "corpus")
    scores = scoring.score_meetings(references(benchmark), segments, masked_spans(benchmark), corpora)
    return scores, scoring.pooled(scores)

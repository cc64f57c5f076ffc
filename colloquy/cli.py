"""Command line: ``python -m colloquy.cli AUDIO...`` and ``python -m colloquy.cli --evaluate PATH``."""

from __future__ import annotations

import argparse
import importlib
import sys

from . import config as c


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Speaker-attributed transcripts of recordings, on Spark")
    p.add_argument("audio", help="folder or glob of WAV files, or of benchmark splits with --evaluate")
    p.add_argument("--models", required=True, help="module:attribute of a Models object")
    p.add_argument("--language", default="auto")
    p.add_argument("--format", choices=("json", "vtt", "srt", "text"), default="json")
    p.add_argument("--output", "-o", help="folder for the results; standard output without it")
    p.add_argument("--max-speakers", type=int)
    p.add_argument("--no-two-pass", action="store_true")
    p.add_argument("--evaluate", action="store_true")
    p.add_argument("--splits", default=",".join(c.SPLITS))
    p.add_argument("--limit", type=int)
    return p


def options_of(args: argparse.Namespace) -> c.LinkOptions:
    most = None if args.max_speakers is None else args.max_speakers
    if most is not None and most < 1:
        raise ValueError("max_speakers must be at least 1")
    return c.LinkOptions(most_speakers=None if most is None else min(most, c.MOST_SPEAKERS), two_pass=not args.no_two_pass)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans.meetings import evaluate, transcribe
    from .sources.audio import audio_frames, read_audio
    from .sources.benchmark import audio_column, read_benchmark
    from .sources.render import render, write_text

    spark = SparkSession.builder.getOrCreate()
    module, _, name = args.models.partition(":")
    models = getattr(importlib.import_module(module), name or "models")
    if args.evaluate:
        rows = read_benchmark(spark, args.audio, args.splits, args.limit)
        frames = audio_frames(rows.select("meeting_id", audio_column(rows)["content"].alias("content")))
        scores, pooled = evaluate(rows, transcribe(frames, models, options_of(args)).segments)
        scores.show(truncate=False)
        pooled.show(truncate=False)
        return 0
    found = transcribe(read_audio(spark, args.audio), models, options_of(args))
    out = render(found.segments, args.format, found.meetings)
    if args.output:
        write_text(out, args.output)
    else:
        for row in out.orderBy("meeting_id").toLocalIterator():
            sys.stdout.write(row["body"] if row["body"].endswith("\n") else row["body"] + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Colloquy: a Spark-native engine for multi-speaker conversation data."""

__version__ = "0.1.0"


def transcribe(frames, models, **options):  # noqa: ANN001, ANN003, ANN201
    """See :func:`colloquy.plans.meetings.transcribe`; loaded only when called."""
    from .plans.meetings import transcribe as run

    return run(frames, models, **options)

"""Settings of the engine.  Fixed values: thresholds, limits and token ids that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Audio and windows
SAMPLE_RATE = 16_000
WINDOW_SECONDS = 30.0
ONSET_PAD_SECONDS = 0.75
FRAME_SECONDS = 0.05
CUT_SEARCH_SECONDS = 3.0
SHORTEST_WINDOW_SECONDS = 3.0
LONGEST_AUDIO_SECONDS = 10_800
MOST_SPEAKERS = 8
SECOND_PASS_FIRST_SECONDS, SECOND_PASS_SECONDS = 15.0, 25.0
SECOND_PASS_LEAST_WINDOWS = 5

# Linking
LEAST_EMBED_SECONDS, LEAST_DURABLE_SECONDS, LEAST_SPINE_MASS_SECONDS = 0.5, 1.0, 2.0
LEAST_CONCAT_SECONDS = 0.3
STRICT_TOTAL_SECONDS, STRICT_EMBED_SECONDS = 3.0, 1.0
ATTRIBUTION_MARGIN, ATTRIBUTION_DISTANCE = 1.3, 0.6
LOW_MASS_SECONDS, LOW_MASS_DISTANCE, LOW_MASS_MARGIN = 10.0, 0.45, 1.3
CLUSTER_DISTANCE = 0.4
DEMOTE_MASS_SECONDS, DEMOTE_WINDOWS = 5.0, 2
CALIBRATED_DEMOTE_MASS_SECONDS, CALIBRATED_DEMOTE_WINDOWS = 10.0, 2
PROTECTED_WINDOWS, PROTECTED_MASS_SECONDS = 2, 5.0
WITNESS_SECONDS, WITNESS_DISTANCE, WITNESS_MARGIN_SECONDS = 0.5, 0.65, 0.25
CALIBRATED_LOW, CALIBRATED_HIGH, CALIBRATION_SAMPLES = 0.35, 0.95, 30
SMALLEST_DISTANCE = 1e-6
FORWARD_PENALTY = 0.1

# Rewrites after linking
BRIDGE_SECONDS, BRIDGE_WORDS, GAP_LOW, BRIDGE_GAP = 0.75, 4, -0.05, 0.35
CONTEXT_SECONDS, CONTEXT_TURN_SECONDS, CONTEXT_WORDS, CONTEXT_VOTES, CONTEXT_DOMINANCE, CONTEXT_GAP = 10.0, 3.0, 8, 2, 0.75, 1.0

# Word reconciliation
LEAST_SCORE, LEAST_ANCHORS, TOLERANCE_SECONDS, LONGEST_PASSAGE_SECONDS = 0.5, 2, 0.25, 30.0

# Tokens
EOS, NO_SPEECH, NO_TIMESTAMPS, TS_FIRST, TS_LAST, WINDOW_TOKEN = 50_257, 50_363, 50_364, 50_365, 51_865, 51_874
SPEAKER_TOKENS = tuple(range(51_866, 51_874))
TS_STEP_SECONDS = 0.02
FIRST_TS_STEPS, REPEATED_NGRAM = 1500, 15
MODES = ("speaker_blocks", "interleaved_each_utterance", "interleaved_on_change")

# Scoring
WHOLE_ITEM_CORPORA = ("ami", "icsi", "dipco")
SPLITS = ("ami", "icsi", "notsofar")


@dataclass(frozen=True)
class LinkOptions:
    """How speakers of windows become identities of a meeting."""

    most_speakers: int | None = None
    fewest_speakers: int = 1
    simplified: bool = False
    strict_spine: bool = False
    low_mass_merge: bool = True
    demote_weak: bool = True
    demote_mass: float = DEMOTE_MASS_SECONDS
    demote_windows: int = DEMOTE_WINDOWS
    cluster_distance: float = CLUSTER_DISTANCE
    attribution_distance: float = ATTRIBUTION_DISTANCE
    two_pass: bool = True
    samples: int = CALIBRATION_SAMPLES
    calibrated_demote_mass: float = CALIBRATED_DEMOTE_MASS_SECONDS
    calibrated_demote_windows: int = CALIBRATED_DEMOTE_WINDOWS

    def __post_init__(self) -> None:
        if self.most_speakers is not None and int(self.most_speakers) < 1:
            raise ValueError("most_speakers must be at least 1")


def check_tokens(**found: int | None) -> None:
    """Raise if a tokenizer's ids differ from those that the grammar assumes."""
    for name, value in found.items():
        expected = globals().get(name)
        if not isinstance(expected, int):
            raise ValueError(f"no token named {name}")
        if value is not None and int(value) != expected:
            raise ValueError(f"token {name} is {value}, expected {expected}")

"""Which tokens may come next: rules over token histories, as data.

A history is one row with an array of ids; the answer is a sorted array of id ranges, so no vector
of the vocabulary's length is built.  Masking logits with the ranges is one pass over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions.math import let, repeated_next


@dataclass(frozen=True)
class Grammar:
    mode: str = "speaker_blocks"
    speakers: tuple[int, ...] = c.SPEAKER_TOKENS
    most_speakers: int | None = None
    window_token: int | None = None
    windows: int = 0
    fewest_windows: int = 0
    first_no_speech: bool = False
    monotonic: bool = False
    ngram: int = c.REPEATED_NGRAM
    first_ts_steps: int = c.FIRST_TS_STEPS
    vocabulary: int = c.WINDOW_TOKEN + 1

    def __post_init__(self) -> None:
        if self.mode not in c.MODES:
            raise ValueError(f"unsupported mode {self.mode!r}")
        if not self.speakers:
            raise ValueError("at least one speaker token is needed")

    @property
    def pool(self) -> tuple[int, ...]:
        """Speakers that may be used: the first ``most_speakers``, one at least; none or 0 means all."""
        return tuple(sorted(self.speakers))[: max(1, min(int(self.most_speakers), len(self.speakers)))] if self.most_speakers else tuple(sorted(self.speakers))


def _slots(ids: Column, pool: tuple[int, ...]) -> Column:
    """Places in the pool (from 0) of the speakers in a history, in order."""
    at = F.array(*(F.lit(x) for x in pool))
    return F.filter(F.transform(ids, lambda t: F.array_position(at, t).cast("int") - 1), lambda k: k >= 0)


def next_speakers(ids: Column, mode: str, pool: tuple[int, ...]) -> Column:
    """Speakers that may follow.  In blocks only the next new one; otherwise all seen and the next new
    one, but on change not the current one."""
    seen = _slots(ids, pool)
    at = F.array(*(F.lit(x) for x in pool))
    none = F.array().cast("array<int>")
    top = F.array_max(seen)
    if mode == "speaker_blocks":
        after = F.when(top + 1 < len(pool), F.slice(at, top + 2, F.lit(1))).otherwise(none)
    else:
        after = F.slice(at, F.lit(1), F.least(top + 2, F.lit(len(pool))))
        if mode == "interleaved_on_change":
            after = F.array_remove(after, F.element_at(at, F.element_at(seen, -1) + 1))
    return F.when(F.size(seen) == 0, F.slice(at, 1, 1)).otherwise(after)


def windows_in_block(ids: Column, window: int, speakers: tuple[int, ...]) -> Column:
    """Window tokens since the last speaker token."""
    back = F.array_max(F.transform(ids, lambda t, i: F.when(t.isin(*speakers), i).otherwise(F.lit(-1))))
    return F.size(F.filter(ids, lambda t, i: (t == window) & (i > F.coalesce(back, F.lit(-1)))))


def first_time_of_slot(ids: Column, slot: Column, speakers: tuple[int, ...]) -> Column:
    """The first timestamp under a speaker slot (from 1), null if there is none."""
    at = F.array(*(F.lit(x) for x in sorted(speakers)))
    current = lambda i: F.array_position(at, F.element_at(F.filter(F.slice(ids, F.lit(1), i + 1), lambda t: t.isin(*speakers)), -1))
    under = F.filter(F.transform(ids, lambda t, i: F.when(t.between(c.TS_FIRST, c.TS_LAST) & F.exists(F.slice(ids, F.lit(1), i + 1), lambda x: x.isin(*speakers)) & (current(i) == slot), t)), lambda t: t.isNotNull())
    return F.get(under, F.lit(0))


def _ids(values: Column) -> Column:
    return F.transform(values, lambda t: F.struct(t.cast("int").alias("lo"), t.cast("int").alias("hi")))


def _range(lo: Column | int, hi: Column | int) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array(F.struct(as_column(lo).cast("int").alias("lo"), as_column(hi).cast("int").alias("hi")))


def allowed_ranges(ids: Column, g: Grammar = Grammar()) -> Column:
    """Ranges (lo, hi) of ids that the grammar lets follow a history; text and times both inside text."""
    none = F.slice(_range(0, 0), 1, 0)
    ts, text = _range(c.TS_FIRST, c.TS_LAST), _range(0, c.EOS - 1)
    is_ts = lambda t: F.coalesce(t.between(c.TS_FIRST, c.TS_LAST), F.lit(False))
    is_speaker = lambda t: F.coalesce(t.isin(*g.speakers), F.lit(False))
    is_window = lambda t: F.coalesce(t == g.window_token, F.lit(False)) if g.window_token is not None else F.lit(False)
    n, last, before = F.size(ids), F.element_at(ids, -1), F.try_element_at(ids, F.lit(-2))
    blocks = g.mode == "speaker_blocks"
    used = F.size(F.filter(ids, is_window))
    room = (used < g.windows) if g.window_token is not None and g.windows > 0 else F.lit(False)
    if blocks and g.window_token is not None:
        room = room & (windows_in_block(ids, g.window_token, g.speakers) < max(1, g.windows // len(g.speakers)))
    window = F.when(room, _range(g.window_token or 0, g.window_token or 0)).otherwise(none)
    speakers = _ids(next_speakers(ids, g.mode, g.pool))
    end = F.when(used < g.fewest_windows, none).otherwise(_range(c.EOS, c.EOS)) if g.fewest_windows and g.window_token is not None else _range(c.EOS, c.EOS)
    start = F.concat(_ids(F.array(F.lit(sorted(g.speakers)[0]))), _range(c.NO_SPEECH, c.NO_SPEECH) if g.first_no_speech else none, _range(g.window_token, g.window_token) if not blocks and g.window_token is not None and g.windows > 0 else none)
    low = F.lit(c.TS_FIRST)
    if g.monotonic:
        slot = F.array_position(F.array(*(F.lit(x) for x in sorted(g.speakers))), last)
        earlier = F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(1)))
        fresh = first_time_of_slot(earlier, slot, g.speakers).isNull() & (slot > 1)
        low = F.when(fresh, F.coalesce(first_time_of_slot(earlier, slot - 1, g.speakers), low)).otherwise(low)
    times = F.when(F.exists(ids, is_ts), _range(low, c.TS_LAST)).otherwise(_range(c.TS_FIRST, min(c.TS_FIRST + g.first_ts_steps, c.TS_LAST)))
    after_speaker = F.concat(times, window) if blocks else times
    after_window = F.concat(ts if blocks else speakers, window)
    closing = F.concat(ts if g.mode != "interleaved_each_utterance" else none, speakers, window, end)
    after_time = F.when(is_speaker(before) | is_window(before) | is_ts(before), text).otherwise(closing)
    ranges = (
        F.when(n == 0, start).when(last == c.NO_SPEECH, _range(c.EOS, c.EOS)).when(is_speaker(last), after_speaker)
        .when(is_window(last), after_window).when(is_ts(last), after_time).otherwise(F.concat(text, ts))
    )
    return F.array_sort(ranges) if not g.ngram else _without(F.array_sort(ranges), F.when((n == 0) | (last == c.NO_SPEECH), F.array().cast("array<int>")).otherwise(F.array_remove(repeated_next(ids, g.ngram), F.lit(c.EOS))))


def _without(ranges: Column, blocked: Column) -> Column:
    """Ranges with single ids cut out."""

    def cut(acc: Column, b: Column) -> Column:
        piece = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
        return F.filter(F.flatten(F.transform(acc, lambda r: F.when(b.between(r["lo"], r["hi"]), F.array(piece(r["lo"], b - 1), piece(b + 1, r["hi"]))).otherwise(F.array(r)))), lambda r: r["lo"] <= r["hi"])

    return F.aggregate(blocked, ranges, cut)


def masked(scores: Column, ranges: Column) -> Column:
    """A dense row of logits with everything outside the ranges at minus infinity."""
    inside = lambda rs, i: F.exists(rs, lambda r: i.between(r["lo"], r["hi"]))
    return let(ranges, lambda rs: F.transform(scores, lambda x, i: F.when(inside(rs, i), x.cast("double")).otherwise(F.lit(float("-inf")))))


def must_close(scores: Column, ranges: Column) -> Column:
    """True if, among allowed ids, all times together outweigh the best single other one."""
    inside = lambda rs, i: F.exists(rs, lambda r: i.between(r["lo"], r["hi"]))
    is_ts = lambda e: e["i"].between(c.TS_FIRST, c.TS_LAST)
    marked = let(ranges, lambda rs: F.transform(scores, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"), inside(rs, i).alias("ok"))))

    def outweighs(kept: Column) -> Column:
        top = F.array_max(F.transform(kept, lambda e: e["x"]))
        best = F.array_max(F.transform(F.filter(kept, lambda e: ~is_ts(e)), lambda e: e["x"]))
        return let(top, lambda t: F.aggregate(F.filter(kept, is_ts), F.lit(0.0), lambda s, e: s + F.exp(e["x"] - t)) > F.exp(best - t))

    return let(F.filter(marked, lambda e: e["ok"]), outweighs)


def mask_rows(rows: DataFrame, g: Grammar = Grammar()) -> DataFrame:
    """Rows (ids, scores) with ``masked`` scores; inside text times are forced if they outweigh it."""
    staged = rows.withColumn("__ranges", allowed_ranges(F.col("ids"), g))
    last = F.try_element_at(F.col("ids"), F.lit(-1))
    special = last.between(c.TS_FIRST, c.TS_LAST) | last.isin(*g.speakers, c.NO_SPEECH, *([g.window_token] if g.window_token is not None else []))
    in_text = (F.size("ids") > 0) & ~F.coalesce(special, F.lit(False))
    text_free = allowed_ranges(F.col("ids"), Grammar(**{**g.__dict__, "ngram": 0}))
    force = in_text & must_close(F.col("scores"), text_free)
    only = F.filter("__ranges", lambda r: r["lo"] >= c.TS_FIRST)
    return staged.withColumn("masked", masked(F.col("scores"), F.when(force, only).otherwise(F.col("__ranges")))).drop("__ranges")

"""Decoded windows to timed segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EOS, NO_SPEECH, SPEAKER_TOKENS, TS_FIRST, TS_LAST, TS_STEP_SECONDS, WINDOW_SECONDS, WINDOW_TOKEN
from ..functions.text import TAG, has_word_character, is_silent, strip, timestamp_text

_STATE = "start double, speaker int, text string, last_end double, done boolean, segments array<struct<start:double,end:double,text:string,speaker_idx:int>>"


def _events(decoded: Column) -> Column:
    """Tags and texts in order: (kind, value, text)."""
    pieces = F.split(F.coalesce(decoded, F.lit("")), f"(?={TAG})")
    event = lambda kind, value, text: F.struct(kind.alias("kind"), value.alias("value"), text.alias("text"))

    def both(piece: Column) -> Column:
        tag = F.regexp_extract(piece, f"^({TAG})", 1)
        rest = strip(F.substring(piece, F.length(tag) + 1, F.length(piece)))
        kind = F.when(tag == "", "none").when(tag.startswith("<|speaker"), "speaker").when(tag == "<|nospeech|>", "silence").when(tag == "<|endoftext|>", "end").otherwise("time")
        number = F.regexp_extract(tag, r"(\d+(?:\.\d+)?)", 1)
        return F.array(event(kind, F.when(number != "", number).cast("double"), F.lit("")), event(F.when(rest == "", "none").otherwise("text"), F.lit(None).cast("double"), rest))

    return F.filter(F.flatten(F.transform(pieces, both)), lambda e: e["kind"] != "none")


def _with(s: Column, **changes: Column) -> Column:
    names = [x.split()[0] for x in _STATE.split(", ")]
    return F.struct(*(changes.get(n, s[n]).alias(n) for n in names)).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in _STATE.split(', '))}>")


def _close(s: Column, end: Column, **changes: Column) -> Column:
    """End the pending text; without a word character it is dropped and moves no time."""
    good = has_word_character(s["text"])
    segment = F.struct(F.coalesce(s["start"], s["last_end"]).alias("start"), end.cast("double").alias("end"), s["text"].alias("text"), F.coalesce(s["speaker"], F.lit(1)).alias("speaker_idx"))
    none = {"start": F.lit(None).cast("double"), "text": F.lit("")}
    return F.when(good, _with(s, **none, last_end=end.cast("double"), segments=F.concat(s["segments"], F.array(segment)), **changes)).otherwise(_with(s, **none, **changes))


def segments_of(decoded: Column, duration: Column) -> Column:
    """Segments (start, end, text, speaker_idx) of one window's tagged text, by one fold.

    A time opens a segment or, behind text, closes it; a speaker closes pending text without
    length; silence discards it; text left at the end runs to ``duration`` (if it is not null).
    """
    start = F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("int").alias("speaker"), F.lit("").alias("text"), F.lit(0.0).alias("last_end"), F.lit(False).alias("done"), F.array().alias("segments"))
    zero = _with(start, segments=F.array())

    def step(s: Column, e: Column) -> Column:
        pending = s["text"] != ""
        return (
            F.when(s["done"], s)
            .when(e["kind"] == "time", F.when(pending, _close(s, e["value"])).otherwise(_with(s, start=e["value"])))
            .when(e["kind"] == "speaker", F.when(pending, _close(s, F.coalesce(s["start"], s["last_end"]), speaker=e["value"].cast("int"))).otherwise(_with(s, speaker=e["value"].cast("int"))))
            .when(e["kind"] == "silence", _with(s, start=F.lit(None).cast("double"), speaker=F.lit(None).cast("int"), text=F.lit("")))
            .when(e["kind"] == "end", _with(s, done=F.lit(True)))
            .otherwise(_with(s, text=F.when(pending, F.concat_ws(" ", s["text"], e["text"])).otherwise(e["text"])))
        )

    def finish(s: Column) -> Column:
        return F.when(s["text"] != "", _close(s, F.coalesce(duration.cast("double"), s["start"], s["last_end"]))).otherwise(s)["segments"]

    raw = F.aggregate(_events(decoded), zero, step, finish)
    inside = lambda x, low: F.greatest(low, F.least(x, duration))

    def clamp(x: Column) -> Column:
        begin = inside(x["start"], F.lit(0.0))
        return F.struct(begin.alias("start"), F.greatest(begin, F.least(x["end"], duration)).alias("end"), x["text"].alias("text"), x["speaker_idx"].alias("speaker_idx"))

    return F.when(duration.isNull(), raw).otherwise(F.transform(raw, clamp))


def parse_windows(tagged: DataFrame) -> DataFrame:
    """Local segments of all windows that are not silent: (meeting_id, pass, ci, lspk, spk_ord, seg_ord, start, end, text).

    Speakers are in the order in which they first speak.  No shuffle but that of the window's own order.
    """
    loud = tagged.where(~is_silent(F.coalesce("decoded", F.lit("")))).withColumn("parsed", segments_of(F.col("decoded"), F.col("duration")))
    first = lambda s: F.array_position(F.transform("parsed", lambda x: x["speaker_idx"]), s)
    flat = loud.select("meeting_id", "pass", "ci", "parsed", F.posexplode("parsed").alias("seg_ord", "s"))
    return flat.select("meeting_id", "pass", "ci", F.col("s.speaker_idx").alias("lspk"), first(F.col("s.speaker_idx")).cast("int").alias("spk_ord"), "seg_ord", "s.start", "s.end", "s.text")


def first_emit_texts(segments: Column) -> Column:
    """Each speaker's text, in the order in which speakers first occur."""
    speakers = F.array_distinct(F.transform(segments, lambda x: x["speaker_idx"]))
    return F.transform(speakers, lambda k: strip(F.array_join(F.transform(F.filter(segments, lambda x: x["speaker_idx"] == k), lambda x: x["text"]), " ")))


def decode_tokens(tokens: DataFrame, vocabulary: DataFrame, *, reset_on_speaker: bool = False, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Token rows (row_id, pos, token) to tagged text per row, with ``vocabulary`` (token, piece).

    Everything behind the first end token is dropped.  A window token moves later times on; with
    ``reset_on_speaker`` a speaker starts from zero again.
    """
    at = Window.partitionBy("row_id").orderBy("pos")
    upto = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = tokens.withColumn("ended", F.max((F.col("token") == EOS).cast("int")).over(upto)).where("ended = 0")
    is_window, is_speaker = F.col("token") == WINDOW_TOKEN, F.col("token").isin(*SPEAKER_TOKENS)
    live = live.withColumn("block", F.sum(is_speaker.cast("int")).over(upto) if reset_on_speaker else F.lit(0))
    within = Window.partitionBy("row_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = live.withColumn("offset", F.sum(F.when(is_window, F.lit(window_seconds)).otherwise(F.lit(0.0))).over(within))
    known = live.join(F.broadcast(vocabulary), "token", "left")
    piece = (
        F.when(is_window, F.lit(""))
        .when(F.col("token").between(TS_FIRST, TS_LAST), timestamp_text(F.col("token"), F.col("offset"), TS_FIRST, TS_STEP_SECONDS))
        .when(is_speaker, F.format_string("<|speaker%d|>", F.col("token") - SPEAKER_TOKENS[0] + 1))
        .when(F.col("token") == NO_SPEECH, F.lit("<|nospeech|>"))
        .otherwise(F.coalesce("piece", F.lit("")))
    )
    return known.withColumn("piece", piece).groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("decoded"))

"""Linked segments to JSON, WebVTT, SubRip and plain text, one row per meeting, and to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_srt, escape_vtt, srt_time, vtt_time

MEDIA_TYPES = {"json": "application/json", "vtt": "text/vtt", "srt": "application/x-subrip", "text": "text/plain"}


def _joined(segments: DataFrame, line: Column, head: str = "", *, trim: bool = False) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("line"))))
    body = F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))
    return segments.groupBy("meeting_id").agg((F.regexp_replace(body, r"(?U)^\s+|\s+$", "") if trim else body).alias("body"))


def render(segments: DataFrame, fmt: str, meetings: DataFrame | None = None) -> DataFrame:
    """(meeting_id, body, media_type).  ``meetings`` (meeting_id, duration, language, num_chunks, mode)
    adds what the JSON result tells besides segments, and meetings without any."""
    if fmt not in MEDIA_TYPES:
        raise ValueError(f"unknown response format: {fmt}")
    if fmt == "json":
        out = _json(segments, meetings)
    elif fmt == "vtt":
        cue = F.concat(vtt_time(F.col("start")), F.lit(" --> "), vtt_time(F.col("end")), F.lit("\n<v "), escape_vtt(F.col("speaker")), F.lit(">"), escape_vtt(F.col("text")), F.lit("</v>\n"))
        out = _joined(segments, cue, "WEBVTT\n\n")
    elif fmt == "srt":
        number = F.row_number().over(Window.partitionBy("meeting_id").orderBy("seg_idx"))
        numbered = segments.withColumn("__n", number)
        cue = F.concat(F.col("__n").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), escape_srt(F.col("speaker")), F.lit(": "), escape_srt(F.col("text")), F.lit("\n"))
        out = _joined(numbered, cue)
    else:
        before = F.lag("speaker").over(Window.partitionBy("meeting_id").orderBy("seg_idx"))
        changed = segments.withColumn("__new", ~F.col("speaker").eqNullSafe(before))
        out = _joined(changed, F.concat(F.when(F.col("__new"), F.concat(F.lit("\n["), F.col("speaker"), F.lit("]\n"))).otherwise(F.lit("")), F.col("text")), trim=True)
    return out.withColumn("media_type", F.lit(MEDIA_TYPES[fmt]))


def _json(segments: DataFrame, meetings: DataFrame | None) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", F.struct("speaker", "start", "end", "text").alias("s"))))
    listed = segments.groupBy("meeting_id").agg(F.transform(rows, lambda x: x["s"]).alias("segments"), F.array_sort(F.collect_set("speaker")).alias("speakers"))
    if meetings is None:
        return listed.select("meeting_id", F.to_json(F.struct("speakers", "segments"), {"ignoreNullFields": "false"}).alias("body"))
    named = [c for c in meetings.columns if c != "meeting_id"]
    both = meetings.join(listed, "meeting_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType))
    return both.select("meeting_id", F.to_json(F.struct(*named, none("speakers").alias("speakers"), none("segments").alias("segments")), {"ignoreNullFields": "false"}).alias("body"))


def write_text(rendered: DataFrame, path: str) -> None:
    """One folder per meeting, a body each, ended by a newline."""
    rendered.select("meeting_id", F.regexp_replace("body", r"\n$", "").alias("value")).write.partitionBy("meeting_id").text(path)


def decode_evidence(windows: DataFrame, tagged: DataFrame, local: DataFrame, *, rate: int, pad_seconds: float) -> DataFrame:
    """Per pass of a meeting: windows in samples, raw texts and parsed segments, for later inspection.

    Fails if a window lacks its text.
    """
    key = ["meeting_id", "pass", "ci"]
    seg = local.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("spk_ord", "seg_ord", "lspk", "start", "end", "text"))).alias("segments"))
    both = windows.join(tagged.select(*key, "decoded"), key, "full").join(seg, key, "left")
    both = both.withColumn("decoded", F.when(F.col("decoded").isNull() | F.col("start_s").isNull(), F.raise_error(F.lit("decode capture cardinality mismatch")).cast("string")).otherwise(F.col("decoded")))
    sample = lambda c: F.floor(F.col(c) * rate).cast("long")
    one = F.struct("ci", sample("start_s").alias("start_sample"), sample("end_s").alias("end_sample"), "decoded", "segments")
    return both.groupBy("meeting_id", "pass").agg(F.array_sort(F.collect_list(one)).alias("windows")).withColumns({"sample_rate": F.lit(rate), "onset_pad_samples": F.lit(int(pad_seconds * rate)), "coordinate_system": F.lit("padded_audio")})


def speaker_mapping(identities: DataFrame, named: DataFrame, *, rewritten: bool) -> DataFrame:
    """Final name of each node (``named``: meeting_id, gid, final_speaker); nothing if turns were
    rewritten after linking, for then a node may have several."""
    out = identities.select("meeting_id", "ci", "lspk", "gid").join(named, ["meeting_id", "gid"], "left")
    return out.limit(0) if rewritten else out

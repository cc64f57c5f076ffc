"""Rewrites of linked segments (meeting_id, seg_idx, speaker or gid, start, end, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions.text import speaker_name, unpad, words_of


def _order(*more: str) -> Window:
    return Window.partitionBy("meeting_id").orderBy("seg_idx", *more)


def project(local: DataFrame, windows: DataFrame, identities: DataFrame) -> DataFrame:
    """Segments of the whole meeting in time order; ties keep window, speaker and segment order."""
    placed = local.join(windows.select("meeting_id", "ci", "start_s"), ["meeting_id", "ci"]).join(identities.select("meeting_id", "ci", "lspk", "gid"), ["meeting_id", "ci", "lspk"])
    placed = placed.withColumns({"begin": F.round(F.col("start_s") + F.col("start"), 2), "finish": F.round(F.col("start_s") + F.col("end"), 2)})
    order = Window.partitionBy("meeting_id").orderBy("begin", "ci", "spk_ord", "seg_ord")
    return placed.select("meeting_id", (F.row_number().over(order) - 1).alias("seg_idx"), "gid", speaker_name(F.col("gid")).alias("speaker"), F.col("begin").alias("start"), F.col("finish").alias("end"), "text")


def smooth_bridges(segments: DataFrame) -> DataFrame:
    """A very short turn between two turns of one other speaker becomes theirs.

    Left to right, so a turn just changed counts as the one before the next; a fold over each
    meeting's turns says which change (a turn changes only if the one before did not, or is theirs
    already).
    """
    row = F.struct("seg_idx", "speaker", "start", "end", "text")
    listed = segments.groupBy("meeting_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    t = F.col("t")

    def step(done, i):  # noqa: ANN001, ANN202
        cur, nxt = F.get(t, i), F.get(t, i + 1)
        before = F.element_at(done, -1)
        bridge = (
            (i < F.size(t) - 1) & (before["speaker"] == nxt["speaker"]) & (cur["speaker"] != before["speaker"])
            & (cur["end"] - cur["start"] <= c.BRIDGE_SECONDS) & (F.size(words_of(cur["text"])) <= c.BRIDGE_WORDS)
            & (cur["start"] - before["end"]).between(c.GAP_LOW, c.BRIDGE_GAP) & (nxt["start"] - cur["end"]).between(c.GAP_LOW, c.BRIDGE_GAP)
        )
        new = F.struct(cur["seg_idx"].alias("seg_idx"), F.when(bridge, before["speaker"]).otherwise(cur["speaker"]).alias("speaker"), cur["start"].alias("start"), cur["end"].alias("end"), cur["text"].alias("text"))
        return F.concat(done, F.array(new))

    rest = F.when(F.size(t) > 1, F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return listed.select("meeting_id", F.inline(F.aggregate(rest, F.slice(t, 1, 1), step)))


def context_votes(segments: DataFrame) -> DataFrame:
    """Decision for each identity of little speech: merged into the durable one that its neighbours
    in time name, or kept.  (meeting_id, gid, mass, decision, to_gid, best_votes, total_votes)."""
    seconds = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    mass = segments.where("gid IS NOT NULL").groupBy("meeting_id", "gid").agg(
        F.sum(seconds).alias("mass"),
        F.min(((seconds <= c.CONTEXT_TURN_SECONDS) & (F.size(words_of(F.col("text"))) <= c.CONTEXT_WORDS)).cast("int")).alias("all_short"),
    )
    durable = mass.where(F.col("mass") >= c.CONTEXT_SECONDS).select("meeting_id", "gid")
    near = segments.select(
        "meeting_id", "gid", F.lag("gid").over(_order()).alias("before"), F.lead("gid").over(_order()).alias("behind"),
        (F.col("start") - F.lag("end").over(_order())).alias("gap_before"), (F.lead("start").over(_order()) - F.col("end")).alias("gap_behind"),
    )
    at = lambda g: F.when(F.col(f"gap_{g}").between(c.GAP_LOW, c.CONTEXT_GAP), F.col(g))
    near = near.withColumns({"before": at("before"), "behind": at("behind")})
    for side in ("before", "behind"):
        near = near.join(durable.select("meeting_id", F.col("gid").alias(side), F.col("gid").alias(f"{side}_ok")), ["meeting_id", side], "left")
    same = F.array_distinct(F.array_compact(F.array("before_ok", "behind_ok")))
    voted = near.where("gid IS NOT NULL").withColumn("vote", F.when(F.size(same) == 1, F.get(same, F.lit(0))))
    counted = voted.where("vote IS NOT NULL").groupBy("meeting_id", "gid", "vote").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("meeting_id", "gid").agg(F.max_by("vote", F.struct("n", -F.col("vote"))).alias("to_gid"), F.max("n").alias("best_votes"), F.sum("n").alias("total_votes"))
    has_durable = durable.select("meeting_id").distinct()
    low = mass.where((F.col("mass") > 0) & (F.col("mass") < c.CONTEXT_SECONDS)).join(has_durable, "meeting_id", "left_semi").join(best, ["meeting_id", "gid"], "left")
    sure = (F.col("best_votes") >= c.CONTEXT_VOTES) & (F.col("best_votes") / F.col("total_votes") >= c.CONTEXT_DOMINANCE)
    decision = F.when(F.col("all_short") == 0, "keep_long_turns").when(F.col("best_votes").isNull(), "keep_no_context_votes").when(sure, "merge").otherwise("keep_weak_context")
    return low.select("meeting_id", "gid", "mass", decision.alias("decision"), "to_gid", "best_votes", "total_votes")


def merge_by_context(segments: DataFrame) -> DataFrame:
    """``segments`` with the merges of :func:`context_votes` done."""
    to = context_votes(segments).where("decision = 'merge'").select("meeting_id", "gid", "to_gid")
    merged = segments.join(to, ["meeting_id", "gid"], "left")
    gid = F.coalesce("to_gid", "gid")
    return merged.select("meeting_id", "seg_idx", gid.alias("gid"), F.when(F.col("to_gid").isNotNull(), speaker_name(gid)).otherwise(F.col("speaker")).alias("speaker"), "start", "end", "text")


def name_by_appearance(segments: DataFrame) -> DataFrame:
    """Speakers numbered from 0 in the order in which they first speak."""
    first = segments.groupBy("meeting_id", "speaker").agg(F.min("seg_idx").alias("since"))
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy("since")) - 1
    names = first.select("meeting_id", "speaker", speaker_name(rank).alias("named"))
    return segments.join(names, ["meeting_id", "speaker"]).select("meeting_id", "seg_idx", F.col("named").alias("speaker"), "start", "end", "text")


def to_original_time(segments: DataFrame, pad: float = c.ONSET_PAD_SECONDS) -> DataFrame:
    return segments.withColumns({"start": unpad(F.col("start"), pad), "end": unpad(F.col("end"), pad)})


def talk_time(segments: DataFrame) -> DataFrame:
    """Seconds, turns and words of each speaker of a meeting."""
    return segments.groupBy("meeting_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count(F.lit(1)).alias("turns"), F.sum(F.size(words_of(F.col("text")))).alias("words"))

"""Joins and aggregates over time intervals.

Range conditions are joined on (meeting, time slot): each interval is repeated for the slots that it
touches, so a long meeting is split over tasks instead of meeting as one key, and a pair counts
in the slot where its overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LEAST_EMBED_SECONDS
from ..functions.math import overlap
from ..functions.text import words_of

SLOT_SECONDS = 60.0


def _slots(start: Column, end: Column, seconds: float) -> Column:
    first = F.floor(start / F.lit(seconds))
    return F.explode(F.sequence(first, F.greatest(first, F.floor(end / F.lit(seconds)))))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], *, how: str = "inner", seconds: float = SLOT_SECONDS) -> DataFrame:
    """Pairs of intervals (start, end) / (other_start, other_end) that share more than a point.

    ``left`` and ``right`` agree on the columns ``on``.  ``how`` is inner, left_semi or left_anti.
    """
    strict = (F.col("start") < F.col("other_end")) & (F.col("end") > F.col("other_start"))
    if how == "inner":
        a = left.withColumn("__slot", _slots(F.col("start"), F.col("end"), seconds))
        b = right.withColumn("__slot", _slots(F.col("other_start"), F.col("other_end"), seconds))
        begins = F.floor(F.greatest("start", "other_start") / F.lit(seconds))
        return a.join(b, [*on, "__slot"]).where(strict & (begins == F.col("__slot"))).drop("__slot")
    keyed = left.withColumn("__row", F.monotonically_increasing_id()) if "__row" not in left.columns else left
    b = right.select(*(F.col(c).alias(f"__{c}") for c in on), "other_start", "other_end")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return keyed.join(b, [*same, strict], how).drop("__row")


def co_time(pass_a: DataFrame, pass_b: DataFrame) -> DataFrame:
    """Seconds that nodes of two passes speak together: (meeting_id, ci_a, l_a, ci_b, l_b, co_s).

    Inputs are absolute segments (meeting_id, ci, lspk, start, end, window_start, window_end); only
    nodes of windows that overlap are paired.
    """
    a = pass_a.select("meeting_id", F.col("ci").alias("ci_a"), F.col("lspk").alias("l_a"), "start", "end", F.col("window_start").alias("wa"), F.col("window_end").alias("wae"))
    b = pass_b.select("meeting_id", F.col("ci").alias("ci_b"), F.col("lspk").alias("l_b"), F.col("start").alias("other_start"), F.col("end").alias("other_end"), F.col("window_start").alias("wb"), F.col("window_end").alias("wbe"))
    both = overlap_join(a, b, ["meeting_id"]).where("wbe > wa AND wb < wae")
    return both.groupBy("meeting_id", "ci_a", "l_a", "ci_b", "l_b").agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end"))).alias("co_s"))


def clean_windows(segments: DataFrame, *, least: float = LEAST_EMBED_SECONDS) -> DataFrame:
    """Longest stretch of each node's own segments that no other speaker of the window talks into.

    Returns (meeting_id, pass, ci, lspk, start, end, is_clean): without a clean stretch of ``least``
    seconds the longest raw segment of that length, else null times.  Gaps come from a running
    maximum over the others' ends, cut to each segment; the first of equal stretches counts.
    """
    node = ["meeting_id", "pass", "ci", "lspk"]
    own = segments.select(*node, "seg_ord", "start", "end")
    other = segments.select("meeting_id", "pass", "ci", F.col("lspk").alias("o"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    met = own.join(other, ["meeting_id", "pass", "ci"], "left").where("o IS NULL OR o <> lspk")
    hit = met.where("other_end > start AND other_start < end").select(*node, "seg_ord", "start", "end", "other_start", "other_end")
    edge = hit.unionByName(own.select(*node, "seg_ord", "start", "end", F.col("end").alias("other_start"), F.col("end").alias("other_end")))
    order = Window.partitionBy(*node, "seg_ord").orderBy("other_start", "other_end")
    upto = F.greatest("start", F.coalesce(F.max("other_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("start")))
    gaps = edge.withColumn("from", upto).withColumn("to", F.col("other_start")).where("to > from").select(*node, "seg_ord", F.col("from").alias("start"), F.col("to").alias("end"), F.lit(True).alias("is_clean"))
    raw = own.withColumn("is_clean", F.lit(False))
    both = gaps.unionByName(raw).where(F.col("end") - F.col("start") >= least)
    rank = Window.partitionBy(*node).orderBy(F.desc("is_clean"), F.desc(F.round(F.col("end") - F.col("start"), 6)), "seg_ord", "start")
    best = both.withColumn("r", F.row_number().over(rank)).where("r = 1").select(*node, "start", "end", "is_clean")
    return own.select(*node).distinct().join(best, node, "left").withColumn("is_clean", F.coalesce("is_clean", F.lit(False)))


def drop_in_spans(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Items (meeting_id, start, end) that share time with no span of their meeting."""
    return overlap_join(items, spans.select("meeting_id", F.col("start").alias("other_start"), F.col("end").alias("other_end")), ["meeting_id"], how="left_anti")


def mask_words(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments (meeting_id, seg_idx, start, end, text) without the words whose middle lies in a span.

    Words share their segment's time evenly.  A segment without words stays; one without length goes
    or stays as a whole; one that loses all its words goes.  A null time leaves it as it is.
    """
    listed = spans.groupBy("meeting_id").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    known = segments.join(listed, "meeting_id", "left").withColumn("__spans", F.coalesce("__spans", F.array()))
    met = F.filter("__spans", lambda s: F.coalesce((F.col("start") < s["end"]) & (F.col("end") > s["start"]), F.lit(False)))
    # Each value that later ones use again is the one element of an array, so it is computed once a row.
    bound = F.transform(F.array(F.struct(met.alias("met"), words_of(F.col("text")).alias("words"))), _left_words)
    known = known.withColumn("__left", bound[0])
    left = F.col("__left")
    return known.where(left["stays"]).withColumn("text", F.when(left["changed"], left["text"]).otherwise(F.col("text"))).drop("__spans", "__left")


def _left_words(b: Column) -> Column:
    """(stays, changed, text) from the words of a segment and the spans ``met`` that it shares time with."""
    words, count = b["words"], F.size(b["words"])
    step = F.array(F.struct(((F.col("end") - F.col("start")) / F.nullif(count, F.lit(0))).alias("x")))

    def masked(s: Column) -> Column:
        middle = lambda i: F.col("start") + (i + 0.5) * s["x"]
        return F.filter(words, lambda w, i: ~F.exists(b["met"], lambda span: middle(i).between(span["start"], span["end"])))

    some = F.when(F.col("end") <= F.col("start"), F.array().cast("array<string>")).otherwise(F.transform(step, masked)[0])
    left = F.when((F.size(b["met"]) == 0) | (count == 0), words).otherwise(some)
    told = lambda x: F.struct(((F.size(x) > 0) | (count == 0)).alias("stays"), (F.size(x) < count).alias("changed"), F.array_join(x, " ").alias("text"))
    return F.transform(F.array(left), told)[0]

"""Word errors under the best pairing of speakers, and their averages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WHOLE_ITEM_CORPORA
from ..functions.math import percent
from ..functions.text import normalize_spoken, strip_markup, words_of
from .intervals import drop_in_spans, mask_words
from .kernels import assign, word_errors


def speaker_texts(items: DataFrame, speaker: str, order: list[str]) -> DataFrame:
    """One text per meeting and speaker: markup stripped, emptied items left out, in order of time."""
    clean = items.withColumn("text", strip_markup(F.coalesce("text", F.lit("")))).where("text <> ''")
    rows = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return clean.groupBy("meeting_id", F.col(speaker).alias("speaker")).agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))


def mask_by_corpus(refs: DataFrame, segments: DataFrame, spans: DataFrame, corpora: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and segments without what the spans mask: whole items on both sides in some
    corpora, single words of the segments in all others."""
    whole = corpora.where(F.lower(F.coalesce("corpus", F.lit(""))).isin(*WHOLE_ITEM_CORPORA)).select("meeting_id")
    pick = lambda df, how: df.join(whole, "meeting_id", how)
    timed = refs.withColumns({"start": F.col("begin_time"), "end": F.col("end_time")})
    dropped = drop_in_spans(pick(timed, "left_semi"), pick(spans, "left_semi"))
    out_refs = pick(timed, "left_anti").unionByName(dropped).drop("start", "end")
    out_segments = drop_in_spans(pick(segments, "left_semi"), pick(spans, "left_semi")).unionByName(mask_words(pick(segments, "left_anti"), pick(spans, "left_anti")))
    return out_refs, out_segments


def count_word_errors(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", *, normalize: Callable[[Column], Column] = normalize_spoken) -> DataFrame:
    """``pairs`` with ``errs`` and ``ref_words``: least edits between normalised words."""
    named = pairs.withColumns({"__r": words_of(normalize(F.col(ref))), "__h": words_of(normalize(F.col(hyp)))})

    @F.pandas_udf("long")
    def edits(rs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, h in rs:
            yield pd.Series([word_errors(list(a), list(b)) for a, b in zip(r, h, strict=True)], dtype="int64")

    return named.withColumns({"errs": edits("__r", "__h"), "ref_words": F.size("__r").cast("long")}).drop("__r", "__h")


def cpwer(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """(meeting_id, errs, ref_words) under the best one-to-one pairing of speakers.

    Inputs are (meeting_id, speaker, text).  Only pairs of one meeting are compared, each by one
    vectorised table; speakers without partner meet the empty text.
    """
    words = lambda df, name: df.select("meeting_id", F.col("speaker").alias(name), words_of(normalize_spoken(F.col("text"))).alias(f"{name}_words"))
    r, h = words(refs, "r"), words(hyps, "h")
    pairs = r.join(h, "meeting_id", "full")

    @F.pandas_udf("long")
    def edits(rs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in rs:
            none = lambda x: [] if x is None else list(x)
            yield pd.Series([word_errors(none(x), none(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    n = lambda w: F.coalesce(F.size(F.col(w)), F.lit(0)).cast("long")
    costs = pairs.select("meeting_id", "r", "h", n("r_words").alias("nr"), n("h_words").alias("nh"), edits("r_words", "h_words").alias("e"))

    def pair_up(pdf: pd.DataFrame) -> pd.DataFrame:
        rs, hs = sorted(pdf["r"].dropna().unique()), sorted(pdf["h"].dropna().unique())
        k = max(len(rs), len(hs), 1)
        cost = np.zeros((k, k))
        at_r, at_h = {x: i for i, x in enumerate(rs)}, {x: i for i, x in enumerate(hs)}
        lengths = np.zeros(k)
        for row in pdf.itertuples():
            if row.r is not None:
                lengths[at_r[row.r]] = row.nr
                cost[at_r[row.r], len(hs) :] = row.nr
            if row.h is not None:
                cost[len(rs) :, at_h[row.h]] = row.nh
        for row in pdf.itertuples():
            if row.r is not None and row.h is not None:
                cost[at_r[row.r], at_h[row.h]] = row.e
        columns = assign(cost)
        return pd.DataFrame({"meeting_id": [pdf["meeting_id"].iloc[0]], "errs": [int(cost[np.arange(k), columns].sum())], "ref_words": [int(lengths.sum())]})

    return costs.groupBy("meeting_id").applyInPandas(pair_up, "meeting_id string, errs long, ref_words long")


def score_meetings(refs: DataFrame, segments: DataFrame, spans: DataFrame, corpora: DataFrame) -> DataFrame:
    """(meeting_id, corpus, errs, ref_words) of each meeting of ``corpora``."""
    r, s = mask_by_corpus(refs, segments, spans, corpora)
    scored = cpwer(speaker_texts(r, "speaker_id", ["begin_time", "end_time", "ord"]), speaker_texts(s, "speaker", ["start", "seg_idx"]))
    return corpora.join(scored, "meeting_id", "left").fillna(0, ["errs", "ref_words"])


def pooled(scores: DataFrame) -> DataFrame:
    """Errors over words of each corpus, and ``macro``: the plain mean of the rounded percentages."""
    per = scores.groupBy("corpus").agg(F.sum("errs").alias("errs"), F.sum("ref_words").alias("ref_words")).withColumn("cpwer_pct", F.round(percent(F.col("errs"), F.col("ref_words")), 2))
    macro = per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cpwer_pct"), 2).alias("cpwer_pct")).where("n > 0").select(F.lit("macro").alias("corpus"), F.lit(None).cast("long").alias("errs"), F.lit(None).cast("long").alias("ref_words"), "cpwer_pct")
    return per.unionByName(macro)


def meeting_report(scores: DataFrame) -> DataFrame:
    """Percentages and, with ``duration_s`` and ``wall_s``, speed against real time."""
    out = scores.withColumn("cpwer_pct", percent(F.col("errs"), F.col("ref_words")))
    return out.withColumn("rtfx", F.try_divide("duration_s", "wall_s")) if {"duration_s", "wall_s"} <= set(out.columns) else out

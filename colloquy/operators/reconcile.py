"""Words of two decodes of one gap: what the fuller one may add, and where it must not.

Cases are rows (case_id, gap_start, gap_end, a, b) with arrays of words; everything is one native
projection over both arrays, without joins or Python, so cases scale as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEAST_ANCHORS, LEAST_SCORE, LONGEST_PASSAGE_SECONDS, TOLERANCE_SECONDS
from ..functions.math import let
from ..functions.text import word_key

TIMED = "ctc_forced"


def _meets(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (x["end"] > y["start"])


def _same(x: Column, y: Column) -> Column:
    return x["key"] == y["key"]


def _strong(w: Column, least: float) -> Column:
    return (w["timing"] == TIMED) & (w["score"] >= least)


def _indexed(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))


def _keyed(words: Column) -> Column:
    """Words with their letters beside them, found once for each."""
    return F.transform(words, lambda w: w.withField("key", word_key(w["text"])))


def _plain(words: Column) -> Column:
    return F.transform(words, lambda w: w.dropFields("key"))


def invalid_words(words: Column) -> Column:
    """Words whose times or score are no finite numbers in range, or that lack a node or letters."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = lambda w: finite(w["start"]) & finite(w["end"]) & finite(w["score"]) & (w["end"] > w["start"]) & w["score"].between(0, 1) & (F.coalesce(w["node"], F.lit("")) != "") & (word_key(w["text"]) != "")
    return F.filter(words, lambda w: ~F.coalesce(good(w), F.lit(False)))


def validated(cases: DataFrame, *, least_score: float = LEAST_SCORE, anchors: int = LEAST_ANCHORS) -> DataFrame:
    """``cases`` with keyed words, failing on a bad gap or word."""
    if not 0 <= least_score <= 1 or anchors < 2:
        raise ValueError("invalid thresholds")
    bad_gap = ~F.coalesce((F.abs("gap_start") < float("inf")) & (F.abs("gap_end") < float("inf")) & (F.col("gap_end") > F.col("gap_start")), F.lit(False))
    bad = F.when(bad_gap, "invalid gap").when(F.size(F.concat(invalid_words(F.col("a")), invalid_words(F.col("b")))) > 0, "invalid aligned word")
    checked = cases.withColumn("a", F.when(bad.isNull(), F.col("a")).otherwise(F.raise_error(bad).cast(cases.schema["a"].dataType)))
    return checked.withColumns({"a": _keyed(F.col("a")), "b": _keyed(F.col("b"))})


def refine_timings(cases: DataFrame, *, least_score: float = LEAST_SCORE, anchors: int = LEAST_ANCHORS) -> DataFrame:
    """Validated ``cases`` with ``refined`` words of A and ``retimings``.

    A word of A takes the times of the one word of B with its letters and nearly its middle, if
    each is the other's only match and two different strong words link their nodes.  All is undone
    if any new overlap or change of order between words of A would result.
    """
    a, b = F.col("a"), F.col("b")
    close = lambda x, y: (F.abs((x["start"] + x["end"] - y["start"] - y["end"]) / 2) <= TOLERANCE_SECONDS) & _same(x, y) & _strong(y, least_score)
    single = F.transform(a, lambda x: F.filter(F.transform(b, lambda y, j: F.when(close(x, y), j)), lambda i: i.isNotNull()))
    staged = cases.withColumn("__one", F.transform(single, lambda m: F.when(F.size(m) == 1, F.get(m, F.lit(0)))))
    one = F.col("__one")
    staged = staged.withColumn("__pair", F.transform(one, lambda j: F.when(F.size(F.filter(one, lambda k: k == j)) == 1, j)))
    pair = F.col("__pair")
    linked = F.filter(F.transform(_indexed(a), lambda x: F.struct(x["w"]["node"].alias("na"), F.get(b, F.get(pair, x["i"]))["node"].alias("nb"), x["w"]["key"].alias("key"), (_strong(x["w"], least_score) & F.get(pair, x["i"]).isNotNull()).alias("ok"))), lambda x: x["ok"])
    staged = staged.withColumn("__links", linked)
    evidence = lambda na, nb: F.size(F.array_distinct(F.transform(F.filter("__links", lambda x: (x["na"] == na) & (x["nb"] == nb)), lambda x: x["key"])))
    near_gap = lambda x: (x["end"] >= F.col("gap_start") - TOLERANCE_SECONDS) & (x["start"] <= F.col("gap_end") + TOLERANCE_SECONDS)

    def moved(x: Column, i: Column) -> Column:
        other = F.get(b, F.get(pair, i))
        go = other.isNotNull() & near_gap(x) & (x["timing"] == TIMED) & (evidence(x["node"], other["node"]) >= anchors)
        return F.when(F.coalesce(go, F.lit(False)), x.withField("start", other["start"]).withField("end", other["end"])).otherwise(x)

    staged = staged.withColumn("__new", F.transform(a, moved))
    new = F.col("__new")
    changed = lambda i: (F.get(new, i)["start"] != F.get(a, i)["start"]) | (F.get(new, i)["end"] != F.get(a, i)["end"])
    shared = lambda x, y: F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])

    def harms(i: Column, j: Column) -> Column:
        wider = shared(F.get(new, i), F.get(new, j)) > F.greatest(F.lit(0.0), shared(F.get(a, i), F.get(a, j))) + 1e-6
        turned = (F.get(a, i)["start"] - F.get(a, j)["start"]) * (F.get(new, i)["start"] - F.get(new, j)["start"]) < 0
        return (i != j) & (wider | turned)

    places = F.transform(a, lambda _, i: i)
    order = lambda w: F.transform(F.array_sort(F.transform(w, lambda x, i: F.struct(x["start"].alias("s"), i.alias("i")))), lambda x: x["i"])
    bad = F.exists(places, lambda i: changed(i) & F.exists(places, lambda j: harms(i, j))) | (order(a) != order(new))
    staged = staged.withColumn("__bad", bad)
    told = F.transform(F.filter(places, changed), lambda i: F.struct(i.alias("a_index"), F.get(pair, i).alias("b_index"), F.get(b, F.get(pair, i))["node"].alias("evidence_node"), F.get(a, i)["start"].alias("from_start"), F.get(a, i)["end"].alias("from_end"), F.get(new, i)["start"].alias("to_start"), F.get(new, i)["end"].alias("to_end")))
    out = staged.withColumns({"refined": F.when(F.col("__bad"), a).otherwise(new), "retimings": F.when(F.col("__bad"), F.slice(told, 1, 0)).otherwise(told)})
    return out.drop("__one", "__pair", "__links", "__new", "__bad")


def reconcile(cases: DataFrame, *, least_score: float = LEAST_SCORE, anchors: int = LEAST_ANCHORS) -> DataFrame:
    """(case_id, status, words, insertions, reasons, retimings, review_candidates).

    Words of B in the gap that A lacks are proposed, with the speaker of A's words that the same B
    node shares.  Any ambiguous, weak, conflicting or competing word makes the case abstain.
    """
    staged = refine_timings(validated(cases, least_score=least_score, anchors=anchors), least_score=least_score, anchors=anchors)
    a, b = F.col("refined"), F.col("b")
    in_gap = lambda w: (w["start"] < F.col("gap_end")) & (w["end"] > F.col("gap_start"))

    def judged(w: Column) -> Column:
        over = F.filter(a, lambda o: _meets(w, o))
        return let(over, lambda o: let(F.filter(o, lambda x: _same(w, x)), lambda match: verdict(w, o, match)))

    def verdict(w: Column, over: Column, match: Column) -> Column:
        twice = (F.size(match) > 1) | F.exists(match, lambda o: F.size(F.filter(b, lambda x: _meets(x, o) & _same(x, o))) > 1)
        weak = F.exists(over, lambda o: ~_strong(o, least_score))
        owned = (F.size(match) > 0) & (F.size(match) == F.size(over)) & _strong(w, least_score)
        known = F.transform(F.filter(match, lambda o: _strong(o, least_score)), lambda o: F.struct(w["node"].alias("node"), w["key"].alias("key"), o["speaker"].alias("speaker")))
        new = ~twice & ~owned & in_gap(w)
        why = F.array_compact(F.array(
            F.when(twice & in_gap(w), "ambiguous_word_match"), F.when(~twice & in_gap(w) & weak, "weak_alignment"),
            F.when(new & ~_strong(w, least_score), "weak_alignment"), F.when(new & (F.size(over) > 0), "conflicting_overlap"),
        ))
        return F.struct(w.alias("w"), new.alias("new"), why.alias("why"), F.when(~twice & owned, known).alias("anchors"))

    staged = staged.withColumn("__judged", F.transform(b, judged))
    by_time = F.array_sort(F.transform(F.filter("__judged", lambda j: j["new"]), lambda j: F.struct(j["w"]["start"].alias("s"), j["w"]["end"].alias("e"), j["w"]["node"].alias("n"), j["w"].alias("w"))))
    staged = staged.withColumn("__candidates", F.transform(by_time, lambda x: x["w"]))
    cand = F.col("__candidates")
    compete = F.exists(F.transform(cand, lambda w, i: F.coalesce((i > 0) & (F.get(cand, i - 1)["end"] > w["start"]), F.lit(False))), lambda x: x)
    reasons = F.concat(F.flatten(F.transform("__judged", lambda j: j["why"])), F.when(compete, F.array(F.lit("competing_b_words"))).otherwise(F.array().cast("array<string>")))
    anchors_of = lambda node: F.filter(F.flatten(F.filter(F.transform("__judged", lambda j: j["anchors"]), lambda x: x.isNotNull())), lambda x: x["node"] == node)

    def speaker(w: Column) -> Column:
        found = anchors_of(w["node"])
        names = F.array_distinct(F.transform(found, lambda x: F.struct(x["speaker"].alias("speaker"))))  # an unknown speaker is one too
        enough = F.size(F.array_distinct(F.transform(found, lambda x: x["key"]))) >= anchors
        return F.when(enough & (F.size(names) == 1), F.get(names, F.lit(0))["speaker"])

    staged = staged.withColumns({"__reasons": F.array_sort(F.array_distinct(reasons)), "__insert": F.transform(cand, lambda w: w.withField("speaker", speaker(w)))})
    stop, insert = F.size("__reasons") > 0, F.col("__insert")
    unsure = F.exists(insert, lambda w: w["speaker"].isNull())
    # A stable sort by start: ordinals of A first, then those of the insertions.
    joined = F.array_sort(F.transform(F.concat(a, insert), lambda w, i: F.struct(w["start"].alias("s"), i.alias("i"), w.alias("w"))))
    none = lambda x: F.slice(x, 1, 0)
    return staged.select(
        "case_id", F.when(stop, "abstained").when(unsure, "needs_review").otherwise("proposed").alias("status"),
        _plain(F.when(stop, F.col("a")).otherwise(F.transform(joined, lambda x: x["w"]))).alias("words"),
        _plain(F.when(stop, none(insert)).otherwise(insert)).alias("insertions"),
        F.when(stop, F.col("__reasons")).when(unsure, F.array(F.lit("unresolved_speaker"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(stop, none(F.col("retimings"))).otherwise(F.col("retimings")).alias("retimings"),
        _plain(F.when(stop, cand).otherwise(none(cand))).alias("review_candidates"),
    )


def propose_passage(cases: DataFrame, *, least_score: float = LEAST_SCORE) -> DataFrame:
    """Whole slices [lo, hi) of B for review: (case_id, status, words, passage, reasons, retimings)."""
    if not 0.5 <= least_score <= 1:
        raise ValueError("the boundary threshold must be at least 0.5")
    bad_span = ~((F.col("lo") >= 0) & (F.col("lo") < F.col("hi")) & (F.col("hi") <= F.size("b")))
    checked = cases.withColumn("b", F.when(bad_span, F.raise_error(F.lit("invalid token span")).cast(cases.schema["b"].dataType)).otherwise(F.col("b")))
    staged = refine_timings(validated(checked, least_score=least_score), least_score=least_score)
    a, b, lo, hi = F.col("a"), F.col("b"), F.col("lo"), F.col("hi")
    staged = staged.withColumn("__part", F.slice(b, lo + 1, hi - lo))
    part = F.col("__part")
    first, last = F.get(part, F.lit(0)), F.element_at(part, -1)
    envelope = lambda w: (w["start"] < last["end"]) & (w["end"] > first["start"])

    def anchor(y: Column) -> Column:
        w = y["w"]
        match = F.filter(a, lambda x: _same(x, w) & _meets(w, x))
        return let(match, lambda found: let(F.get(found, F.lit(0)), lambda mine: judged(y, found, mine)))

    def judged(y: Column, match: Column, mine: Column) -> Column:
        w, j = y["w"], y["i"]
        back = F.size(F.filter(b, lambda o: _same(o, mine) & _meets(o, mine)))
        ask = ((j < lo) | (j >= hi)) & (w["node"] == first["node"]) & _strong(w, least_score)
        unclear = ask & ((F.size(match) > 1) | ((F.size(match) == 1) & (back != 1)))
        good = ask & (F.size(match) == 1) & (back == 1) & _strong(mine, least_score)
        return F.struct(j.alias("j"), unclear.alias("unclear"), F.coalesce(good, F.lit(False)).alias("good"), mine["key"].alias("key"), mine["speaker"].alias("speaker"))

    staged = staged.withColumn("__anchors", F.transform(_indexed(b), anchor))
    good = F.filter("__anchors", lambda x: x["good"])
    others = F.filter(_indexed(b), lambda y: (y["i"] < lo) | (y["i"] >= hi))
    length = last["end"] - first["start"]
    t = TOLERANCE_SECONDS
    outside = ~((first["start"] >= F.col("gap_start") - t) & (first["start"] < F.col("gap_end")) & (last["end"] > F.col("gap_start")) & (last["end"] <= F.col("gap_end") + t) & (length > 0) & (length <= LONGEST_PASSAGE_SECONDS))
    reasons = F.array_compact(F.array(
        F.when(F.exists(F.col("refined"), envelope), "a_owns_passage_audio"), F.when(F.exists("__anchors", lambda x: x["unclear"]), "ambiguous_anchor"),
        F.when(F.exists(others, lambda y: envelope(y["w"])), "competing_b_audio"),
        F.when(F.exists(part, lambda w: (w["start"] < first["start"]) | (w["end"] > last["end"])), "invalid_passage_envelope"),
        F.when(F.size(F.array_distinct(F.transform(part, lambda w: w["node"]))) != 1, "multiple_b_speakers"), F.when(outside, "outside_requested_gap"),
        F.when(~F.exists(good, lambda x: (x["j"] == lo - 1) | (x["j"] == hi)), "unanchored_seam"), F.when(~_strong(first, least_score) | ~_strong(last, least_score), "weak_outer_boundary"),
    ))
    names = F.array_distinct(F.transform(good, lambda x: F.struct(x["speaker"].alias("speaker"))))
    speaker = F.when((F.size(F.array_distinct(F.transform(good, lambda x: x["key"]))) >= LEAST_ANCHORS) & (F.size(names) == 1), F.get(names, F.lit(0))["speaker"])
    passage = F.struct(
        F.transform(part, lambda w: w["text"]).alias("tokens"), F.array_join(F.transform(part, lambda w: w["text"]), " ").alias("text"), first["start"].alias("start"), last["end"].alias("end"),
        first["node"].alias("node"), speaker.alias("speaker"), F.array(lo, hi).alias("source_span"), F.lit("outer_ctc_boundaries").alias("timing"), F.array(first["score"], last["score"]).alias("boundary_scores"),
    )
    staged = staged.withColumns({"__why": reasons, "__passage": passage})
    stop = F.size("__why") > 0
    review = F.array_compact(F.array(F.lit("text_and_internal_timing_unverified"), F.when(F.col("__passage.speaker").isNull(), "unresolved_speaker")))
    return staged.select(
        "case_id", F.when(stop, "abstained").otherwise("needs_review").alias("status"), _plain(F.when(stop, a).otherwise(F.col("refined"))).alias("words"),
        F.when(~stop, F.col("__passage")).alias("passage"), F.when(stop, F.col("__why")).otherwise(review).alias("reasons"),
        F.when(stop, F.slice("retimings", 1, 0)).otherwise(F.col("retimings")).alias("retimings"),
    )

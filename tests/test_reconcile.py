import random

import pytest
from colloquy.operators import alignment, reconcile
from pyspark.sql import functions as F

WORD = "array<struct<text:string,start:double,end:double,node:string,speaker:string,score:double,timing:string>>"
NAMES = ("text", "start", "end", "node", "speaker", "score", "timing")


def a_word(text, start, end, speaker="anna", score=0.9, node="A:1:1", timing="ctc_forced"):
    return (text, float(start), float(end), node, speaker, score, timing)


def b_word(text, start, end, score=0.9, node="B:1:1", timing="ctc_forced"):
    return (text, float(start), float(end), node, None, score, timing)


def cases(spark, *rows):
    return spark.createDataFrame([(f"c{k}", float(g[0]), float(g[1]), a, b, *r) for k, (a, b, g, *r) in enumerate(rows)], f"case_id string, gap_start double, gap_end double, a {WORD}, b {WORD}" + (", lo int, hi int" if len(rows[0]) > 3 else ""))


def run(spark, a, b, gap):
    return reconcile.reconcile(cases(spark, (a, b, gap))).first()


def test_missing_words_are_proposed_with_the_shared_speaker(spark):
    a = [a_word("we", 0, 0.2), a_word("want", 0.3, 0.6), a_word("Later.", 4, 4.4, "ben")]
    b = [b_word("We", 0.01, 0.21), b_word("want", 0.31, 0.61), b_word("more", 1, 1.3), b_word("time.", 1.5, 2)]
    r = run(spark, a, b, (0.7, 3))
    assert r["status"] == "proposed" and [w["text"] for w in r["words"]] == ["we", "want", "more", "time.", "Later."]
    assert [w["speaker"] for w in r["insertions"]] == ["anna", "anna"] and tuple(r["words"][0].asDict().keys()) == NAMES


@pytest.mark.parametrize("a,b,gap,status,reason", [
    ([a_word("plan", 0.8, 1.2)], [b_word("plans", 0.9, 1.3)], (1, 2), "abstained", "conflicting_overlap"),
    ([], [b_word("Hello", 1, 2)], (0, 3), "needs_review", "unresolved_speaker"),
    ([a_word("one", 0, 0.2), a_word("two", 0.3, 0.5, "ben")], [b_word("one", 0, 0.2), b_word("two", 0.3, 0.5), b_word("three", 1, 1.3)], (0.5, 2), "needs_review", "unresolved_speaker"),
    ([a_word("one", 0, 0.2), a_word("two", 0.3, 0.5, None)], [b_word("one", 0, 0.2), b_word("two", 0.3, 0.5), b_word("three", 1, 1.3)], (0.5, 2), "needs_review", "unresolved_speaker"),
    ([a_word("before", 0, 0.5)], [b_word("faint", 1, 2, 0.01)], (0.5, 3), "abstained", "weak_alignment"),
    ([], [b_word("word", 1, 2, timing="interpolated")], (0, 3), "abstained", "weak_alignment"),
    ([a_word("yes", 0, 0.5), a_word("yes", 0.2, 0.7)], [b_word("yes", 0.1, 0.6)], (0.4, 1), "abstained", "ambiguous_word_match"),
    ([a_word("yes", 0, 0.7)], [b_word("yes", 0.1, 0.3), b_word("yes", 0.4, 0.6)], (0.2, 1), "abstained", "ambiguous_word_match"),
    ([], [b_word("left", 1, 2), b_word("right", 1.5, 2.5, node="B:1:2")], (0, 3), "abstained", "competing_b_words"),
])
def test_what_stops_a_case(spark, a, b, gap, status, reason):
    r = run(spark, a, b, gap)
    assert r["status"] == status and reason in r["reasons"]
    if status == "abstained":
        assert [tuple(w) for w in r["words"]] == a and not r["insertions"]


def test_truncated_words_take_better_times(spark):
    a = [a_word("risk", 0, 0.4), a_word("to", 0.5, 0.6), a_word("the", 0.8, 1.1, score=0.3)]
    b = [b_word("risk", 0, 0.4), b_word("to", 0.5, 0.6), b_word("the", 0.65, 0.75), b_word("plan", 0.8, 1.1)]
    r = run(spark, a, b, (0.8, 2))
    assert r["status"] == "proposed" and [w["text"] for w in r["words"]] == ["risk", "to", "the", "plan"]
    assert r["words"][2]["end"] == 0.75 and r["retimings"][0]["evidence_node"] == "B:1:1" and r["retimings"][0]["a_index"] == 2
    twice = [*b[:2], b_word("the", 0.7, 0.8), b_word("the", 1.0, 1.1)]
    assert reconcile.refine_timings(reconcile.validated(cases(spark, (a, twice, (0.6, 1))))).first()["retimings"] == []


def test_lost_runs_come_back(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(25):
        words = [rng.choice(["the", "plan", "I", "agree", "yes"]) for _ in range(24)]
        lo = rng.randrange(4, 18)
        n = rng.randrange(1, 6)
        jitter = lambda k: 0.3 * k + rng.uniform(-0.01, 0.01)
        b = [b_word(w, s := jitter(k), s + 0.12) for k, w in enumerate(words)]
        a = [a_word(w, s := jitter(k), s + 0.12) for k, w in enumerate(words) if not lo <= k < lo + n]
        rows.append((a, b, (0.3 * lo - 0.05, 0.3 * (lo + n) - 0.05)))
    out = {r["case_id"]: r for r in reconcile.reconcile(cases(spark, *rows)).collect()}
    for k, (_, b, _) in enumerate(rows):
        r = out[f"c{k}"]
        if r["status"] == "proposed":
            assert [w["text"] for w in r["words"]] == [w[0] for w in b]
    assert sum(r["status"] == "proposed" for r in out.values()) > 15


def test_bad_input_is_refused(spark):
    for a, gap in (([a_word("x", 1, 1)], (0, 1)), ([a_word("1", 0, 1)], (0, 1)), ([a_word("x", 0, 1, score=2.0)], (0, 1)), ([a_word("x", 0, float("nan"))], (0, 1)), ([a_word("x", 0, 1)], (1, 1))):
        with pytest.raises(Exception, match="invalid"):
            run(spark, a, [], gap)
    with pytest.raises(ValueError, match="thresholds"):
        reconcile.reconcile(cases(spark, ([], [], (0, 1))), anchors=1)


def test_passages(spark):
    a = [a_word("one", 0, 0.2), a_word("two", 0.3, 0.5), a_word("nine", 9, 9.3)]
    b = [b_word("one", 0, 0.2), b_word("two", 0.3, 0.5), b_word("three", 1, 1.3), b_word("four", 1.5, 2, 0.2), b_word("five", 2.2, 2.5)]
    good, lone, owned, weak = (a, b, (0.8, 3), 2, 5), (a, b, (0.8, 3), 3, 5), ([*a, a_word("hm", 1.6, 1.8)], b, (0.8, 3), 2, 5), (a, b, (0.8, 3), 2, 4)
    r = {x["case_id"]: x for x in reconcile.propose_passage(cases(spark, good, lone, owned, weak)).collect()}
    assert r["c0"]["status"] == "needs_review" and r["c0"]["passage"]["text"] == "three four five" and r["c0"]["passage"]["speaker"] == "anna"
    assert r["c0"]["reasons"] == ["text_and_internal_timing_unverified"] and r["c0"]["passage"]["source_span"] == [2, 5]
    assert "unanchored_seam" in r["c1"]["reasons"] and "weak_outer_boundary" in r["c1"]["reasons"] and r["c1"]["passage"] is None
    assert r["c2"]["reasons"] == ["a_owns_passage_audio"] and "weak_outer_boundary" in r["c3"]["reasons"]


def test_paths_to_words(spark):
    schema = "case_id string, words array<string>, targets array<int>, path array<int>, scores array<double>, blank int, delimiter int, frame_seconds double, offset double, node string"
    row = lambda name, path, targets, words, scores=None: (name, words, targets, path, scores or [-0.1] * len(path), 0, 9, 0.02, 5.0, "A:1:1")
    good = row("g", [0, 1, 1, 0, 1, 9, 0, 2, 2], [1, 1, 9, 2], ["aa", "b"])
    out = alignment.path_words(spark.createDataFrame([good], schema)).first()["words"]
    assert [(w["text"], round(w["start"], 4), round(w["end"], 4)) for w in out] == [("aa", 5.02, 5.1), ("b", 5.14, 5.18)] and abs(out[0]["score"] - 0.904837418) < 1e-6
    for bad in (row("b", [1, 1], [1, 1], ["aa"]), row("b", [1, 9], [1, 9], ["a", "b"]), row("b", [1], [1], ["a"], [0.5]), row("b", [1], [1], ["a"], [-1.0, -1.0])):
        with pytest.raises(Exception, match="invalid|incomplete"):
            alignment.path_words(spark.createDataFrame([bad], schema)).collect()
    vocabulary = {"A": 1, "B": 2, "'": 3, "|": 9}
    got = spark.createDataFrame([("a b'",)], "t string").select(alignment.prepared_words(F.col("t"), vocabulary).alias("x")).first()["x"]
    assert got["words"] == ["a", "b'"] and got["targets"] == [1, 9, 2, 3]
    for text in ("", "a 1b", "é", "a z"):
        with pytest.raises(Exception, match="empty|unrepresentable|unsupported"):
            spark.createDataFrame([(text,)], "t string").select(alignment.prepared_words(F.col("t"), vocabulary)).collect()

"""Quality rules: a decision list learned by sequential covering, run as one SQL expression.

Statistics of each text are native column expressions.  A bounded sample of labelled rows goes to
the driver, where rules for the class "reject" are grown (best threshold by information gain),
pruned on rows held back from growing, and kept only if precise.  The list comes back as an
ordered ``CASE WHEN`` expression, so applying it costs no shuffle and no Python.

Defined edge cases: a null text counts as empty (no words, base test fails).  Repeated rows are
judged each for itself.  Labels with a null id or null quality are ignored; if an id bears several
labels the lowest quality counts.  With no usable labels of both classes the list is empty and
only the base test rejects.  Input columns whose names clash with the statistics' stay as they
are in :func:`apply_rules`, which works on a private struct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Most labelled rows that the learner reads; chosen by the hash of the id.
MAX_LABELLED = 20_000
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share")


def with_statistics(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add struct ``out`` with the five counts of ``text`` and ``n_lines``, by native expressions only.

    Windows of five words are compared by a 64-bit hash within one text.  Only texts with a
    repeated window are sorted, which keeps ordinary texts linear.
    """
    words, lines, grams = (free_name(df.columns, f"__{out}_{k}") for k in ("words", "lines", "grams"))
    t = text_or_empty(text)
    staged = df.withColumns(
        {
            words: F.filter(F.split(t, f"{SPACE_CLASS}+"), lambda w: w != ""),
            lines: F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
        }
    )
    w = F.col(words)
    last = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
    staged = staged.withColumn(
        grams, F.transform(F.slice(w, F.lit(1), last), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))
    )
    squeezed = F.translate(t, SPACES, "")
    stats = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
        _covered(F.col(grams)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    return staged.withColumn(out, stats).drop(words, lines, grams)


def _covered(grams: Column) -> Column:
    """Words under windows whose hash occurs at least twice in the text."""

    def count(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        twice = F.filter(pairs, lambda p, j: same(p, F.get(pairs, j - 1)) | same(p, F.get(pairs, j + 1)))
        return _over(F.sort_array(F.transform(twice, lambda p: p["i"])), union_length)

    def union_length(starts: Column) -> Column:
        step = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_over(pairs, count))


def _over(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` computed once: a one-element transform binds it to a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def feature(s: Column, name: str) -> Column:
    """A rate that does not grow with the length of the text, or the number of words."""
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return {
        "n_words": lambda: s["n_words"].cast("double"),
        "mean_word": lambda: ratio(s["word_chars"], s["n_words"]),
        "symbol_share": lambda: ratio(s["n_symbols"], s["word_chars"]),
        "dup_line_share": lambda: ratio(s["n_dup_lines"], s["n_lines"]),
        "repeat_share": lambda: ratio(s["n_repeat_words"], s["n_words"]),
    }[name]()


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, row: tuple) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, s: Column) -> Column:
        x = feature(s, FEATURES[self.feature])
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def learn_rules(rows: list[tuple], *, min_precision: float = 0.9, min_cover: int = 3, max_rules: int = 8, max_conditions: int = 4) -> list[Rule]:
    """Sequential covering over ``(*features, quality)`` rows; each rule rejects.

    Every third row is held back for pruning.  A rule stays if, on all rows not covered so far, it
    covers at least ``min_cover`` rejects with at least ``min_precision`` of rejects among them.
    """
    rows = sorted(rows)
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grow, prune = [r for k, r in enumerate(left) if k % 3], left[::3]
        rule = _prune(_grow(grow, max_conditions), prune)
        hit = [r for r in left if all(c.holds(r) for c in rule)]
        bad = sum(r[-1] == 0 for r in hit)
        if not rule or bad < min_cover or bad < min_precision * len(hit):
            break
        rules.append(rule)
        left = [r for r in left if not all(c.holds(r) for c in rule)]
    return rules


def _grow(rows: list[tuple], max_conditions: int) -> Rule:
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        p0, n0 = sum(r[-1] == 0 for r in rows), sum(r[-1] != 0 for r in rows)
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in range(len(FEATURES)):
            for c, p, n in _cuts(rows, f, p0, n0):
                if p and (gain := p * (math.log2(p / (p + n)) - base)) > best[0]:
                    best = gain, c
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r)]
    return tuple(rule)


def _cuts(rows: list[tuple], f: int, p0: int, n0: int):  # noqa: ANN202
    """Every cut between two unequal values, with the rejects and keepers on either side."""
    ordered = sorted((r[f], r[-1]) for r in rows)
    p = n = 0
    for (x, q), (y, _) in zip(ordered, ordered[1:], strict=False):
        p, n = p + (q == 0), n + (q != 0)
        if x < y:
            at = (x + y) / 2
            yield Condition(f, False, at), p, n
            yield Condition(f, True, at), p0 - p, n0 - n


def _prune(rule: Rule, rows: list[tuple]) -> Rule:
    """The prefix of the rule that is worth most on rows it was not grown on."""

    def worth(r: Rule) -> float:
        hit = [x for x in rows if all(c.holds(x) for c in r)]
        return (2 * sum(x[-1] == 0 for x in hit) - len(hit)) / len(hit) if hit else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def labelled_sample(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> list[tuple]:
    """Statistics of at most ``max_labelled`` labelled documents, one row for each id.

    The sample of ids has a proven bound, so it is broadcast; documents are not shuffled.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    s = F.col("stats")
    values = with_statistics(known, "text", "stats").select("doc_id", "quality", *(feature(s, f).alias(f) for f in FEATURES))
    one = values.groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "quality")).alias("row"))
    return [tuple(r["row"]) for r in one.select("row").toLocalIterator()]


def verdict(s: Column, rules: list[Rule]) -> Column:
    """The ordered conditional expression: false at the first rule that holds."""
    out = F.when(base_failed(s), F.lit(False))
    for rule in rules:
        out = out.when(reduce(lambda a, b: a & b, (c.column(s) for c in rule)), F.lit(False))
    return out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule], *, text: str = "text", out: str = "quality_verdict") -> DataFrame:
    """``docs`` with struct ``out``: the statistics, ``base_failed`` and ``kept``."""
    stats = free_name(docs.columns, "__stats")
    s = F.col(stats)
    judged = F.struct(*(s[k].alias(k) for k in STATISTICS), base_failed(s).alias("base_failed"), verdict(s, rules).alias("kept"))
    return with_statistics(docs, text, stats).withColumn(out, judged).drop(stats)


def learned_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    return learn_rules(labelled_sample(docs, labels))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged = apply_rules(docs.select("doc_id", "text"), learned_rules(docs, labels))
    return judged.select("doc_id", *(F.col("quality_verdict")[k].alias(k) for k in (*STATISTICS, "base_failed", "kept")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the learned list rejects go; columns stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = free_name(docs.columns, "quality_verdict")
    judged = apply_rules(docs, learned_rules(docs, labels), out=out)
    # The optimizer would push the condition below the statistics and compute them once for each
    # mention; it does not move conditions below a column that is not deterministic in name.
    fixed = judged.withColumn(out, F.when(F.monotonically_increasing_id() >= 0, F.col(out)))
    return fixed.where(F.col(out)["kept"]).drop(out)

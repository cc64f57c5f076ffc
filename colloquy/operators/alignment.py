"""Frame paths of an aligner to timed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_key, words_of


def prepared_words(text: Column, vocabulary: dict[str, int]) -> Column:
    """(words, targets): words and the ids of their letters, joined by the delimiter ``|``.

    A word without letters, with a digit or with a letter outside ASCII is an error, as is a letter
    that the vocabulary lacks.
    """
    words = words_of(text)
    keys = F.transform(words, word_key)
    bad = F.exists(words, lambda w: (word_key(w) == "") | w.rlike(r"(?U)\d") | w.rlike(r"[\p{L}&&[^a-zA-Z]]"))
    table = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv))
    letters = F.filter(F.split(F.array_join(keys, "|"), ""), lambda x: x != "")
    ids = F.transform(letters, lambda x: F.try_element_at(table, x))
    why = F.when(F.size(words) == 0, "empty text").when(bad, "unrepresentable word").when(F.exists(ids, lambda x: x.isNull()), "unsupported character")
    return F.struct(F.when(why.isNull(), words).otherwise(F.raise_error(why).cast("array<string>")).alias("words"), ids.alias("targets"))


def path_words(paths: DataFrame) -> DataFrame:
    """(case_id, words): frames grouped at delimiters, with times and mean probability.

    Rows are (case_id, words, targets, path, scores, blank, delimiter, frame_seconds, offset, node).
    The path without blanks and immediate repeats must equal the targets and give as many groups as
    there are words; anything else is an error.
    """
    path, scores = F.col("path"), F.col("scores")
    frames = F.transform(path, lambda t, i: F.struct(t.alias("t"), F.when(i > 0, F.get(path, i - 1)).alias("before"), i.alias("i"), F.get(scores, i).alias("score")))
    staged = paths.withColumn("__f", frames)
    kept = F.filter("__f", lambda f: (f["t"] != F.col("blank")) & ~F.coalesce(f["t"] == f["before"], F.lit(False)))
    zero = F.struct(F.lit(True).alias("open"), F.array().cast("array<array<int>>").alias("groups"))

    def group(s: Column, f: Column) -> Column:
        is_end = f["t"] == F.col("delimiter")
        add = F.array(f["i"])
        fresh = s["open"] | (F.size(s["groups"]) == 0)
        grown = F.when(fresh, F.concat(s["groups"], F.array(add))).otherwise(F.concat(F.slice(s["groups"], F.lit(1), F.greatest(F.size(s["groups"]) - 1, F.lit(0))), F.array(F.concat(F.element_at(s["groups"], F.when(F.size(s["groups"]) > 0, F.size(s["groups"])).otherwise(1)), add))))
        return F.when(is_end, F.struct(F.lit(True).alias("open"), s["groups"].alias("groups"))).when(f["t"] == F.col("blank"), s).otherwise(F.struct(F.lit(False).alias("open"), grown.alias("groups")))

    staged = staged.withColumns({"__kept": F.transform(kept, lambda f: f["t"]), "__groups": F.aggregate("__f", zero, lambda s, f: F.when((F.size(s["groups"]) == 0) & (f["t"] != F.col("delimiter")) & (f["t"] != F.col("blank")), F.struct(F.lit(False).alias("open"), F.array(F.array(f["i"])).alias("groups"))).otherwise(group(s, f)), lambda s: s["groups"])})
    bad_score = F.exists(scores, lambda x: x.isNull() | F.isnan(x) | (x > 0) | (x == float("-inf")))
    why = (
        F.when((F.size("path") != F.size("scores")) | ~F.coalesce((F.col("frame_seconds") > 0) & (F.col("frame_seconds") < float("inf")) & (F.abs("offset") < float("inf")), F.lit(False)), "invalid alignment dimensions")
        .when(bad_score, "invalid aligned log probability").when((F.col("__kept") != F.col("targets")) | (F.size("__groups") != F.size("words")), "incomplete forced alignment")
    )
    mean = lambda g: F.aggregate(g, F.lit(0.0), lambda s, i: s + F.exp(F.get(scores, i)), lambda s: s / F.size(g))
    at = lambda i: F.col("offset") + i * F.col("frame_seconds")
    words = F.transform("__groups", lambda g, k: F.struct(F.get("words", k).alias("text"), at(F.get(g, F.lit(0))).alias("start"), at(F.element_at(g, -1) + 1).alias("end"), F.col("node").alias("node"), F.lit(None).cast("string").alias("speaker"), mean(g).alias("score"), F.lit("ctc_forced").alias("timing")))
    return staged.select("case_id", F.when(why.isNull(), words).otherwise(F.raise_error(why).cast("array<struct<text:string,start:double,end:double,node:string,speaker:string,score:double,timing:string>>")).alias("words"))

import re
from collections import Counter

from colloquy.llm import quality
from pyspark.sql import functions as F

from .fixtures import SCHEMA, awkward, documents


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    hit = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(spark):
    texts = [None, "", " ", "a", "# one\n\n# one\ntwo", "a b c d e f a b c d e f g", "x " * 50, "tab\tnew\x0bline\r\n|<>|", "é è é è é è é è", "a b c d e a b c d e a b c d e\n" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r["s"])[:5] for r in quality.with_statistics(df, "text", "s").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_rules_are_learned_pruned_and_precise():
    rows = [(float(n), 5.0, s / 100, 0.0, 0.0, int(s < 20)) for n in range(20, 60) for s in range(0, 40, 4)]
    rules = quality.learn_rules(rows)
    assert rules and all(any(c.feature == 2 and c.above for c in r) for r in rules)
    assert all((r[-1] == 0) == any(all(c.holds(r) for c in rule) for rule in rules) for r in rows)
    assert quality.learn_rules([r for r in rows if r[-1]]) == [] == quality.learn_rules([])


def test_query_and_edge_cases(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = quality.op9_quality_rules(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    assert Counter((r["doc_id"], *(r[c] for c in quality.STATISTICS)) for r in rows) == Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())
    assert all(not r["kept"] for r in rows if r["base_failed"])
    clashing = awkward(docs)
    kept = quality.quality_stage(spark, clashing, str(tmp_path))
    assert kept.columns == clashing.columns and 0 < kept.count() <= docs.count()
    assert quality.quality_stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_verdict_is_one_conditional_expression(spark):
    df = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    plan = quality.apply_rules(df, [(quality.Condition(0, True, 5.0),)])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "CASE WHEN" in plan
    assert quality.apply_rules(df, []).select(F.col("quality_verdict")["kept"]).first()[0] is False

"""Queries over the driver's tables, one or more for each operator, and their DuckDB SQL.

The tables hold no recordings, so operators run on views derived from them: turns of conversations
as segments (40 centiseconds a word, starts moved so that turns overlap), events of a user as short
turns or frames, embeddings as speaker nodes.  Every query runs over whole tables and texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import math as m
from ..functions import text as t
from ..operators import alignment, grammar, intervals, linking, parsing, reconcile, scoring, turns, windows
from ..sources import benchmark, render
from ..streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH RECURSIVE {VIEWS}\n{sql}"
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def v_seg(spark: SparkSession, d: str) -> DataFrame:
    """(meeting_id, seg_idx, speaker, text, n, start, end)."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = _table(spark, d, "conversations").withColumn("n", n)
    start = F.coalesce(F.sum(40 * F.col("n")).over(earlier), F.lit(0)) - 20 * (F.col("turn") % 3)
    return rows.withColumn("s", start).select(F.col("conv_id").cast("string").alias("meeting_id"), F.col("turn").cast("int").alias("seg_idx"), F.col("role").alias("speaker"), "text", "n", (F.col("s") / 100.0).alias("start"), ((F.col("s") + 40 * F.col("n")) / 100.0).alias("end"))


def v_span(spark: SparkSession, d: str) -> DataFrame:
    """Masked stretches: the second tenth to the half of every third segment."""
    size = F.col("end") - F.col("start")
    return v_seg(spark, d).where("seg_idx % 3 = 1").select("meeting_id", F.round(F.col("start") + 0.1 * size, 2).alias("start"), F.round(F.col("start") + 0.5 * size, 2).alias("end"))


def v_turn(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as short turns: 0.6 s apart, 0.5 s long, 5 s if the value is 0 or less."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kinds = F.dense_rank().over(Window.orderBy("event_type")) - 1
    named = _table(spark, d, "events").select("event_type").distinct().withColumn("gid", kinds)
    rows = _table(spark, d, "events").withColumn("seg_idx", at).join(F.broadcast(named), "event_type")
    return rows.select(F.col("user_id").cast("string").alias("meeting_id"), "seg_idx", "gid", t.speaker_name(F.col("gid")).alias("speaker"), F.round(F.col("seg_idx") * 0.6, 2).alias("start"), F.round(F.col("seg_idx") * 0.6 + 0.5, 2).alias("end"), F.col("event_type").alias("text"))


def v_node(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as nodes: 25 of a meeting in five windows of five speakers; label is the identity."""
    k = F.col("vec_id")
    return _table(spark, d, "embeddings").select(
        F.floor(k / 25).cast("string").alias("meeting_id"), F.floor((k % 25) / 5).cast("int").alias("ci"), (k % 5 + 1).cast("int").alias("lspk"), F.col("label").alias("gid"),
        ((k * 37 % 60) / 10.0).alias("total_dur"), F.col("embedding").cast("array<double>").alias("spine_emb"), F.col("embedding").cast("array<double>").alias("concat_emb"),
    )


def v_pair(spark: SparkSession, d: str) -> DataFrame:
    """Witness pairs of nodes with nodes of a made-up second pass."""
    k = F.col("vec_id")
    return _table(spark, d, "embeddings").select(
        F.floor(k / 25).cast("string").alias("meeting_id"), F.floor((k % 25) / 5).cast("int").alias("ci_a"), (k % 5 + 1).cast("int").alias("l_a"),
        F.floor((k % 25) / 9).cast("int").alias("ci_b"), (k % 4 + 1).cast("int").alias("l_b"), ((k * 13 % 50) / 10.0 + 0.5).alias("co_s"),
    )


VIEWS = r"""
seg0 AS (SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '\S+')) AS n FROM conversations),
seg AS (
  SELECT conv_id::VARCHAR AS meeting_id, turn::INT AS seg_idx, role AS speaker, text, n, s / 100.0::DOUBLE AS start, (s + 40 * n) / 100.0::DOUBLE AS "end"
  FROM (SELECT *, coalesce(sum(40 * n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 20 * (turn % 3) AS s FROM seg0)
),
span AS (SELECT meeting_id, round(start + 0.1::DOUBLE * ("end" - start), 2) AS start, round(start + 0.5::DOUBLE * ("end" - start), 2) AS "end" FROM seg WHERE seg_idx % 3 = 1),
kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS gid FROM (SELECT DISTINCT event_type FROM events)),
turn AS (
  SELECT user_id::VARCHAR AS meeting_id, seg_idx, gid, printf('SPEAKER_%02d', gid) AS speaker, round(seg_idx * 0.6::DOUBLE, 2) AS start, round(seg_idx * 0.6::DOUBLE + 0.5::DOUBLE, 2) AS "end", e.event_type AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx FROM events) e JOIN kinds USING (event_type)
),
node AS (
  SELECT (vec_id // 25)::VARCHAR AS meeting_id, ((vec_id % 25) // 5)::INT AS ci, (vec_id % 5 + 1)::INT AS lspk, label AS gid, (vec_id * 37 % 60) / 10.0::DOUBLE AS total_dur, embedding::DOUBLE[] AS v FROM embeddings
),
pair AS (
  SELECT (vec_id // 25)::VARCHAR AS meeting_id, ((vec_id % 25) // 5)::INT AS ci_a, (vec_id % 5 + 1)::INT AS l_a, ((vec_id % 25) // 9)::INT AS ci_b, (vec_id % 4 + 1)::INT AS l_b, (vec_id * 13 % 50) / 10.0::DOUBLE + 0.5::DOUBLE AS co_s
  FROM embeddings
),
centre AS (
  SELECT meeting_id, gid, list(x ORDER BY i) AS c FROM (
    SELECT meeting_id, gid, i, sum((total_dur + 0.1::DOUBLE) * x) / sum(total_dur + 0.1::DOUBLE) AS x FROM (SELECT meeting_id, gid, total_dur, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM node) GROUP BY ALL) GROUP BY ALL
)"""


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- Turns and rendering --------------------------------------------------------------------

@query("""SELECT meeting_id, speaker, round(sum("end" - start), 2) AS seconds, count(*) AS turns, sum(n)::BIGINT AS words FROM seg GROUP BY ALL""")
def talk_time(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(turns.talk_time(v_seg(spark, d)), "seconds", places=2)


@query("""SELECT s.meeting_id, seg_idx, printf('SPEAKER_%02d', r - 1) AS speaker FROM seg s JOIN (
  SELECT meeting_id, speaker, row_number() OVER (PARTITION BY meeting_id ORDER BY min(seg_idx)) AS r FROM seg GROUP BY meeting_id, speaker) USING (meeting_id, speaker)""")
def relabel_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return turns.name_by_appearance(v_seg(spark, d)).select("meeting_id", "seg_idx", "speaker")


_WORDS = "list_filter(regexp_extract_all(regexp_replace({x}, '\\[[^\\]]+\\]', ' ', 'g'), '\\S+'), lambda w: NOT regexp_full_match(w, '[$%#@]+'))"
_MARKUP = f"""regexp_replace(array_to_string({_WORDS.format(x="regexp_replace(text, '(^|[^A-Za-z0-9_])([A-Z])_', '\\1\\2', 'g')")}, ' '), ' ([.,!?;:])', '\\1', 'g')"""


@query(f"""SELECT meeting_id, speaker, string_agg(clean, ' ' ORDER BY start, seg_idx) AS text FROM (SELECT *, {_MARKUP} AS clean FROM seg) WHERE clean <> '' GROUP BY ALL""")
def speaker_text_concat(spark: SparkSession, d: str) -> DataFrame:
    return scoring.speaker_texts(v_seg(spark, d), "speaker", ["start", "seg_idx"])


@query(f"SELECT conv_id, turn, {_MARKUP} AS stripped FROM conversations")
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", t.strip_markup(F.col("text")).alias("stripped"))


def _re(x: str, *steps: tuple[str, str]) -> str:
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


_LOW = _re("lower(text)", (r"\b([a-z])-([a-z]+)\b", r"\1\2"))
_SPOKEN = _re(f"translate({_LOW}, '’‘ʼ`´', '''''''''''')", (r"(\d)''s\b", r"\1s"), (r"[<\[][^>\]]*[>\]]", ""), (r"\(([^)]+?)\)", ""), (r"\s+''", "''"), (r"(\d),(\d)", r"\1\2"), (r"\.([^0-9]|$)", r" \1"))
_SPOKEN = _re(f"replace(replace(replace(strip_accents({_SPOKEN}), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')", (r"[^\p{L}\p{N}\p{Z}\p{C}.%$¢€£'']", " "), (r"\bokay\b", "ok"), (r"[.$¢€£]([^0-9])", r" \1"), (r"([^0-9])%", r"\1 "), (r"\s+", " "))


@query(f"SELECT conv_id, turn, trim({_SPOKEN}) AS spoken FROM conversations")
def normalize_spoken(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", t.normalize_spoken(F.col("text")).alias("spoken"))


_SRT = "printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"
_srt = lambda x: _SRT.format(ms=f"greatest(0, round({x} * 1000)::BIGINT)")
_vtt = lambda x: f"printf('%02d:%02d:%06.3f', floor({x} / 3600)::INT, floor({x} / 60)::INT % 60, {x} - floor({x} / 60) * 60)"
_END = '"end"'


@query(f"""SELECT meeting_id, string_agg(seg_no || chr(10) || {_srt("start")} || ' --> ' || {_srt(_END)} || chr(10) || speaker || ': ' || replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' ') || chr(10), chr(10) ORDER BY seg_idx) AS body
FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS seg_no FROM seg) GROUP BY ALL""")
def render_srt(spark: SparkSession, d: str) -> DataFrame:
    return render.render(v_seg(spark, d), "srt").select("meeting_id", "body")


@query(f"""SELECT meeting_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_vtt("start")} || ' --> ' || {_vtt(_END)} || chr(10) || '<v ' || speaker || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</v>' || chr(10), chr(10) ORDER BY seg_idx) AS body FROM seg GROUP BY ALL""")
def render_vtt(spark: SparkSession, d: str) -> DataFrame:
    return render.render(v_seg(spark, d), "vtt").select("meeting_id", "body")


@query("""SELECT meeting_id, trim(string_agg(CASE WHEN speaker IS DISTINCT FROM before THEN chr(10) || '[' || speaker || ']' || chr(10) ELSE '' END || text, chr(10) ORDER BY seg_idx), chr(10) || ' ') AS body
FROM (SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS before FROM seg) GROUP BY ALL""")
def render_text(spark: SparkSession, d: str) -> DataFrame:
    return render.render(v_seg(spark, d), "text").select("meeting_id", "body")


@query()
def render_json(spark: SparkSession, d: str) -> DataFrame:
    return render.render(v_seg(spark, d), "json").select("meeting_id", "body")


@query("""SELECT s.meeting_id, k.r::INT AS speaker_idx, s.seg_idx, round(s.start, 2) AS start, round(s."end", 2) AS "end", trim(s.text, ' ' || chr(9) || chr(10) || chr(13)) AS text
FROM seg s JOIN (SELECT meeting_id, speaker, row_number() OVER (PARTITION BY meeting_id ORDER BY since) AS r FROM (SELECT meeting_id, speaker, min(seg_idx) AS since FROM seg GROUP BY meeting_id, speaker)) k ON k.meeting_id = s.meeting_id AND k.speaker = s.speaker""")
def parse_segments(spark: SparkSession, d: str) -> DataFrame:
    seg = v_seg(spark, d)
    first = seg.groupBy("meeting_id", "speaker").agg(F.min("seg_idx").alias("since"))
    rank = first.withColumn("k", F.row_number().over(Window.partitionBy("meeting_id").orderBy("since")))
    tag = F.format_string("<|speaker%d|><|%.2f|> %s<|%.2f|>", "k", "start", "text", "end")
    rows = seg.join(rank, ["meeting_id", "speaker"]).groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", tag.alias("x")))), lambda s: s["x"]), "").alias("decoded"), F.max("end").alias("duration"))
    parsed = parsing.parse_windows(rows.select("meeting_id", F.lit("A").alias("pass"), F.lit(0).alias("ci"), "decoded", "duration"))
    return parsed.select("meeting_id", F.col("lspk").alias("speaker_idx"), F.col("seg_ord").alias("seg_idx"), F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "text")


@query("""SELECT meeting_id, ord, speaker_id, round(begin_time, 2) AS begin_time, round(end_time, 2) AS end_time, text FROM (
  SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) - 1 AS ord, speaker AS speaker_id, start AS begin_time, "end" AS end_time, text FROM seg)""")
def references_from_json(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("seg_idx", F.struct("speaker", "start", "end", "text").alias("u"))
    rows = v_seg(spark, d).groupBy("meeting_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["u"])).alias("utterances_json"))
    return _rounded(benchmark.references(rows), "begin_time", "end_time", places=2)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def limit_per_split(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.limited(_table(spark, d, "documents").select("doc_id", "source"), "source", 3, ["doc_id"])


@query("SELECT doc_id, lang AS code, coalesce(lang, 'auto') AS effective FROM documents")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    code = t.language_code(F.upper("lang"))
    return _table(spark, d, "documents").select("doc_id", code.alias("code"), t.effective_language(code, F.lit("auto")).alias("effective"))


# --- Intervals ---------------------------------------------------------------------------------

@query("""SELECT s.meeting_id, s.seg_idx FROM seg s WHERE NOT EXISTS (SELECT 1 FROM span p WHERE p.meeting_id = s.meeting_id AND s.start < p."end" AND s."end" > p.start)""")
def drop_in_spans(spark: SparkSession, d: str) -> DataFrame:
    return intervals.drop_in_spans(v_seg(spark, d), v_span(spark, d)).select("meeting_id", "seg_idx")


@query("""SELECT meeting_id, seg_idx, string_agg(w, ' ' ORDER BY i) AS words FROM (
  SELECT s.meeting_id, s.seg_idx, i, w FROM (SELECT *, unnest(regexp_extract_all(text, '\\S+')) AS w, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS i FROM seg) s
  WHERE NOT EXISTS (SELECT 1 FROM span p WHERE p.meeting_id = s.meeting_id AND s.start < p."end" AND s."end" > p.start AND s.start + (i - 1 + 0.5::DOUBLE) * ((s."end" - s.start) / s.n) BETWEEN p.start AND p."end")) GROUP BY ALL""".replace("\\\\S", "\\S"))
def mask_words_in_spans(spark: SparkSession, d: str) -> DataFrame:
    return intervals.mask_words(v_seg(spark, d), v_span(spark, d)).select("meeting_id", "seg_idx", F.array_join(t.words_of(F.col("text")), " ").alias("words"))


def _grid(seg: DataFrame, name: str) -> DataFrame:
    """Segments in windows of 30 s, or of 15 s and then 25 s."""
    ci = F.floor(F.col("start") / 30) if name == "A" else F.when(F.col("start") < 15, F.lit(0)).otherwise(F.floor((F.col("start") - 15) / 25) + 1)
    rows = seg.withColumn("ci", ci.cast("int"))
    begin = F.col("ci") * 30.0 if name == "A" else F.when(F.col("ci") == 0, F.lit(0.0)).otherwise(15.0 + (F.col("ci") - 1) * 25)
    size = F.lit(30.0) if name == "A" else F.when(F.col("ci") == 0, F.lit(15.0)).otherwise(F.lit(25.0))
    lspk = F.when(F.col("speaker") == "user", 1).when(F.col("speaker") == "assistant", 2).otherwise(3)
    return rows.select("meeting_id", "ci", lspk.alias("lspk"), "start", "end", begin.alias("window_start"), (begin + size).alias("window_end"))


_GRIDS = """, a AS (SELECT meeting_id, floor(start / 30)::INT AS ci, CASE speaker WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS l, start, "end" FROM seg),
b AS (SELECT meeting_id, CASE WHEN start < 15 THEN 0 ELSE floor((start - 15) / 25)::INT + 1 END AS ci, CASE speaker WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS l, start + 0.37::DOUBLE AS start, "end" + 0.37::DOUBLE AS "end" FROM seg),
co AS (SELECT a.meeting_id, a.ci AS ci_a, a.l AS l_a, b.ci AS ci_b, b.l AS l_b, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS co_s FROM a JOIN b ON a.meeting_id = b.meeting_id AND a.start < b."end" AND a."end" > b.start
  WHERE (CASE WHEN b.ci = 0 THEN 15 ELSE 15 + b.ci * 25 END) > a.ci * 30 AND (CASE WHEN b.ci = 0 THEN 0 ELSE 15 + (b.ci - 1) * 25 END) < a.ci * 30 + 30 GROUP BY ALL)"""


def _co(spark: SparkSession, d: str) -> DataFrame:
    seg = v_seg(spark, d)
    moved = _grid(seg, "B").withColumns({"start": F.col("start") + 0.37, "end": F.col("end") + 0.37})
    return intervals.co_time(_grid(seg, "A"), moved)


@query(f"{_GRIDS}\nSELECT meeting_id, ci_a, l_a, ci_b, l_b, round(co_s, 6) AS co_s FROM co".lstrip())
def window_overlap_co_time(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_co(spark, d), "co_s")


@query()
def witness_pairs(spark: SparkSession, d: str) -> DataFrame:
    nodes = v_node(spark, d)
    return linking.witness_pairs(_co(spark, d), nodes, nodes)


@query("""SELECT meeting_id, lspk, round(start, 2) AS start, round("end", 2) AS "end", is_clean FROM (
  SELECT k.meeting_id, k.lspk, x.start, x."end", coalesce(x.clean, false) AS is_clean, row_number() OVER (PARTITION BY k.meeting_id, k.lspk ORDER BY x.clean DESC NULLS LAST, round(x."end" - x.start, 6) DESC, x.seg_idx, x.start) AS r
  FROM (SELECT DISTINCT meeting_id, speaker AS lspk FROM seg) k LEFT JOIN (
    SELECT meeting_id, speaker AS lspk, seg_idx, start, "end", false AS clean FROM seg WHERE "end" - start >= 0.5
    UNION ALL
    SELECT meeting_id, lspk, seg_idx, f, o, true FROM (
      SELECT meeting_id, lspk, seg_idx, o, greatest(start, coalesce(max(e) OVER (PARTITION BY meeting_id, lspk, seg_idx ORDER BY o, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start)) AS f FROM (
        SELECT s.meeting_id, s.speaker AS lspk, s.seg_idx, s.start, q.start AS o, q."end" AS e FROM seg s JOIN seg q ON s.meeting_id = q.meeting_id AND s.speaker <> q.speaker AND q."end" > s.start AND q.start < s."end"
        UNION ALL SELECT meeting_id, speaker, seg_idx, start, "end", "end" FROM seg)) WHERE o > f AND o - f >= 0.5
  ) x ON x.meeting_id = k.meeting_id AND x.lspk = k.lspk) WHERE r = 1""")
def clean_window(spark: SparkSession, d: str) -> DataFrame:
    seg = v_seg(spark, d).select("meeting_id", F.lit("A").alias("pass"), F.lit(0).alias("ci"), F.col("speaker").alias("lspk"), F.col("seg_idx").alias("seg_ord"), "start", "end")
    return _rounded(intervals.clean_windows(seg).select("meeting_id", "lspk", "start", "end", "is_clean"), "start", "end", places=2)


# --- Nodes -------------------------------------------------------------------------------------

_D = "round(list_cosine_distance({a}, {b}), 6)"


@query(f"""SELECT a.meeting_id, a.ci AS ci_1, a.lspk AS l_1, b.ci AS ci_2, b.lspk AS l_2, {_D.format(a="a.v", b="b.v")} AS d FROM node a JOIN node b ON a.meeting_id = b.meeting_id AND (a.ci, a.lspk) < (b.ci, b.lspk)""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(linking.node_pairs(v_node(spark, d)), "d")


def _weighed(spark: SparkSession, d: str) -> DataFrame:
    return v_node(spark, d).withColumn("weight", F.col("total_dur") + 0.1)


@query("SELECT meeting_id, gid, i::INT AS i, round(x, 6) AS x FROM (SELECT meeting_id, gid, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS i FROM centre)")
def weighted_centroids(spark: SparkSession, d: str) -> DataFrame:
    return linking.centroids(_weighed(spark, d), "gid", weight="weight").select("meeting_id", "gid", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("""SELECT meeting_id, ci, lspk, g1 AS gid, round(d1, 6) AS d1, round(d2, 6) AS d2, d1 <= 0.9 AND coalesce(d2 / greatest(d1, 1e-6) >= 1.3, true) AS passes FROM (
  SELECT meeting_id, ci, lspk, list(gid ORDER BY d, gid)[1] AS g1, list(d ORDER BY d, gid)[1] AS d1, list(d ORDER BY d, gid)[2] AS d2
  FROM (SELECT n.meeting_id, ci, lspk, k.gid, list_cosine_distance(n.v, k.c) AS d FROM node n JOIN centre k ON n.meeting_id = k.meeting_id) GROUP BY ALL)""")
def nearest_centroid_margin(spark: SparkSession, d: str) -> DataFrame:
    centres = linking.centroids(_weighed(spark, d), "gid", weight="weight")
    return _rounded(linking.nearest_two(v_node(spark, d), centres, gate=0.9), "d1", "d2")


@query("""SELECT s.meeting_id, n_same, n_cross, round(least(greatest((q_same + q_cross) / 2, 0.35), 0.95), 6) AS threshold FROM
  (SELECT a.meeting_id, count(*) AS n_same, quantile_cont(list_cosine_distance(a.v, b.v), 0.75) AS q_same FROM node a JOIN node b ON a.meeting_id = b.meeting_id AND (a.ci, a.lspk) < (b.ci, b.lspk) AND a.gid = b.gid GROUP BY ALL) s
  JOIN (SELECT a.meeting_id, count(*) AS n_cross, quantile_cont(list_cosine_distance(a.v, b.v), 0.25) AS q_cross FROM node a JOIN node b ON a.meeting_id = b.meeting_id AND a.ci = b.ci AND a.lspk < b.lspk GROUP BY ALL) x ON s.meeting_id = x.meeting_id""")
def calibrated_threshold(spark: SparkSession, d: str) -> DataFrame:
    node = v_node(spark, d)
    name = node.select("meeting_id", "ci", "lspk", "gid")
    pairs = linking.node_pairs(node)
    own = lambda k: name.select("meeting_id", F.col("ci").alias(f"ci_{k}"), F.col("lspk").alias(f"l_{k}"), F.col("gid").alias(f"g_{k}"))
    same = pairs.join(own(1), ["meeting_id", "ci_1", "l_1"]).join(own(2), ["meeting_id", "ci_2", "l_2"]).where("g_1 = g_2")
    return _rounded(linking.calibrated_threshold(same, pairs.where("ci_1 = ci_2"), 1), "threshold")


@query("SELECT meeting_id, greatest(1, max(k)) AS min_k FROM (SELECT meeting_id, ci, count(DISTINCT CASE WHEN total_dur >= 1 THEN lspk END) AS k FROM node GROUP BY ALL) GROUP BY ALL")
def durable_floor(spark: SparkSession, d: str) -> DataFrame:
    return linking.durable_floor(v_node(spark, d))


@query("""SELECT meeting_id, gid, round(mass, 6) AS mass, windows, weak AND r > greatest(1 - strong, 0) AS weak FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id, weak ORDER BY mass DESC, gid) AS r, sum(CASE WHEN weak THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id) AS strong FROM (
    SELECT meeting_id, gid, sum(total_dur) AS mass, count(*) AS windows, sum(total_dur) < 5 OR count(*) < 2 AS weak FROM node GROUP BY ALL))""")
def cluster_mass_demotion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(linking.weak_identities(linking.identity_mass(v_node(spark, d)), least_mass=c.DEMOTE_MASS_SECONDS, least_windows=c.DEMOTE_WINDOWS), "mass")


_MASS = ", mass AS (SELECT meeting_id, gid, round(sum(total_dur), 6) AS mass FROM node GROUP BY ALL)"


@query(f"""{_MASS} SELECT meeting_id, gid, target FROM (SELECT a.meeting_id, a.gid, b.gid AS target, row_number() OVER (PARTITION BY a.meeting_id, a.gid ORDER BY list_cosine_distance(x.c, y.c), b.gid) AS r
  FROM mass a JOIN centre x USING (meeting_id, gid) JOIN mass b ON a.meeting_id = b.meeting_id AND a.mass < 2 AND b.mass >= 2 JOIN centre y ON y.meeting_id = b.meeting_id AND y.gid = b.gid) WHERE r = 1""".lstrip())
def absorb_low_mass(spark: SparkSession, d: str) -> DataFrame:
    mass = _rounded(linking.identity_mass(v_node(spark, d)), "mass")
    return linking.absorb_low_mass(mass, linking.centroids(_weighed(spark, d), "gid", weight="weight"))


@query(f"""{_MASS}, two AS (SELECT a.meeting_id, a.gid, any_value(a.mass) AS mass, list({{'d': list_cosine_distance(x.c, y.c), 'g': b.gid}} ORDER BY list_cosine_distance(x.c, y.c), b.gid) FILTER (b.gid IS NOT NULL) AS l
  FROM mass a JOIN centre x USING (meeting_id, gid) LEFT JOIN mass b ON a.meeting_id = b.meeting_id AND b.mass >= 10 LEFT JOIN centre y ON y.meeting_id = b.meeting_id AND y.gid = b.gid WHERE a.mass > 0 AND a.mass < 10 GROUP BY a.meeting_id, a.gid)
SELECT meeting_id, gid, mass, CASE WHEN l IS NULL THEN 'keep_no_durable_centroid' WHEN l[1].d <= 0.45 AND coalesce(l[2].d / greatest(l[1].d, 1e-6) >= 1.3, true) THEN 'merge' ELSE 'keep_not_confident' END AS decision, l[1].g AS to_gid, round(l[1].d, 6) AS best, round(l[2].d, 6) AS second FROM two""".lstrip())
def low_mass_merge(spark: SparkSession, d: str) -> DataFrame:
    mass = _rounded(linking.identity_mass(v_node(spark, d)), "mass")
    return _rounded(linking.merge_low_mass(mass, linking.centroids(_weighed(spark, d), "gid", weight="weight")), "best", "second")


@query(""", places AS (SELECT meeting_id, gid, ci, min(lspk) AS l FROM node GROUP BY ALL),
since AS (SELECT meeting_id, gid, min(ci * 100 + l) AS s FROM places GROUP BY ALL),
scored AS (SELECT n.meeting_id, n.ci, n.lspk, p.gid, any_value(s.s) AS s, min(CASE WHEN p.ci <= n.ci THEN n.ci - p.ci END) AS back, min(CASE WHEN p.ci > n.ci THEN p.ci - n.ci END) AS forth, bool_or(p.ci = n.ci) AS here
  FROM node n JOIN places p ON n.meeting_id = p.meeting_id JOIN since s ON s.meeting_id = p.meeting_id AND s.gid = p.gid GROUP BY ALL)
SELECT meeting_id, ci, lspk, gid, round(score, 6) AS score FROM (SELECT *, CASE WHEN back IS NOT NULL AND (forth IS NULL OR back <= forth) THEN back::DOUBLE ELSE forth + 0.1::DOUBLE END AS score, row_number() OVER (PARTITION BY meeting_id, ci, lspk ORDER BY CASE WHEN back IS NOT NULL AND (forth IS NULL OR back <= forth) THEN back::DOUBLE ELSE forth + 0.1::DOUBLE END, s, gid) AS r FROM scored WHERE NOT here) WHERE r = 1""".lstrip())
def asof_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    node = v_node(spark, d)
    return _rounded(linking.nearest_identity_in_time(node, node), "score")


_DURABLE_B = ", held AS (SELECT p.* FROM pair p JOIN (SELECT DISTINCT meeting_id, ci AS ci_b, lspk AS l_b FROM node WHERE total_dur >= 1) n USING (meeting_id, ci_b, l_b))"


@query(f"""{_DURABLE_B} SELECT a.meeting_id, a.ci_a, a.l_a, b.ci_a AS ci_a2, b.l_a AS l_a2, array_to_string(list_sort(list(DISTINCT a.ci_b)), ',') AS windows_b
  FROM held a JOIN held b ON a.meeting_id = b.meeting_id AND a.ci_b = b.ci_b AND a.l_b < b.l_b AND NOT (a.ci_a = b.ci_a AND a.l_a = b.l_a) GROUP BY ALL""".lstrip())
def cannot_links(spark: SparkSession, d: str) -> DataFrame:
    return linking.cannot_links(v_pair(spark, d), v_node(spark, d)).withColumn("windows_b", F.array_join(F.col("windows_b").cast("array<string>"), ","))


@query(""", named AS (SELECT p.*, n.gid FROM pair p LEFT JOIN (SELECT * FROM node WHERE total_dur >= 2) n ON n.meeting_id = p.meeting_id AND n.ci = p.ci_a AND n.lspk = p.l_a),
held AS (SELECT meeting_id, ci_b, l_b, gid, sum(co_s) AS w FROM named WHERE gid IS NOT NULL GROUP BY ALL)
SELECT n.meeting_id, n.ci_a, n.l_a, h.gid, round(sum(least(h.w, n.co_s)), 6) AS vote FROM named n JOIN held h USING (meeting_id, ci_b, l_b) WHERE n.gid IS NULL GROUP BY ALL""".lstrip())
def chain_votes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(linking.chain_votes(v_pair(spark, d), v_node(spark, d).where("total_dur >= 2")), "vote")


def _linked(spark: SparkSession, d: str, **options: object) -> DataFrame:
    node = v_node(spark, d).withColumns({"pass": F.lit("A"), "spk_ord": F.col("lspk"), "is_clean": F.col("total_dur") > 0.5, "window_s": F.col("total_dur")})
    other = node.withColumn("pass", F.lit("B"))
    counts = node.groupBy("meeting_id").agg(F.count_distinct("ci").alias("n_windows"))
    thresholds = calibrated_threshold(spark, d)
    return linking.link(node.unionByName(other), v_pair(spark, d), thresholds, counts, c.LinkOptions(cluster_distance=0.9, **options))


@query()
def linked_identities(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d)


@query()
def linked_identities_single_pass(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d, two_pass=False, strict_spine=True, simplified=True, fewest_speakers=2)


# --- Rewrites and windows of events ----------------------------------------------------------

@query(""", RECURSIVE_turns AS (
  SELECT t.*, lead(speaker) OVER w AS nxt, lead(start) OVER w AS nxt_start FROM turn t WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx)
), walk AS (
  SELECT meeting_id, seg_idx, speaker, "end" FROM RECURSIVE_turns WHERE seg_idx = 0
  UNION ALL
  SELECT t.meeting_id, t.seg_idx, CASE WHEN t.nxt = w.speaker AND t.speaker <> w.speaker AND t."end" - t.start <= 0.75 AND t.start - w."end" BETWEEN -0.05 AND 0.35 AND t.nxt_start - t."end" BETWEEN -0.05 AND 0.35 THEN w.speaker ELSE t.speaker END, t."end"
  FROM walk w JOIN RECURSIVE_turns t ON t.meeting_id = w.meeting_id AND t.seg_idx = w.seg_idx + 1
) SELECT meeting_id, seg_idx, speaker FROM walk""".lstrip())
def bridge_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return turns.smooth_bridges(v_turn(spark, d)).select("meeting_id", "seg_idx", "speaker")


_MASS_OF_TURNS = """, spoken AS (SELECT meeting_id, gid, sum("end" - start) AS mass FROM turn GROUP BY ALL),
near AS (SELECT *, lag(gid) OVER w AS b, lead(gid) OVER w AS f, start - lag("end") OVER w AS gb, lead(start) OVER w - "end" AS gf FROM turn WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx)),
voted AS (SELECT n.meeting_id, n.gid, CASE WHEN p.gid IS NULL THEN q.gid WHEN q.gid IS NULL OR q.gid = p.gid THEN p.gid END AS vote FROM near n
  LEFT JOIN spoken p ON p.meeting_id = n.meeting_id AND p.gid = n.b AND p.mass >= 10 AND n.gb BETWEEN -0.05 AND 1 LEFT JOIN spoken q ON q.meeting_id = n.meeting_id AND q.gid = n.f AND q.mass >= 10 AND n.gf BETWEEN -0.05 AND 1),
counted AS (SELECT meeting_id, gid, vote, count(*) AS n FROM voted WHERE vote IS NOT NULL GROUP BY ALL),
best AS (SELECT meeting_id, gid, arg_max(vote, n * 1000 - vote) AS to_gid, max(n) AS best_votes, sum(n)::BIGINT AS total_votes FROM counted GROUP BY ALL)"""


@query(f"""{_MASS_OF_TURNS}
SELECT s.meeting_id, s.gid, round(s.mass, 2) AS mass, CASE WHEN best_votes IS NULL THEN 'keep_no_context_votes' WHEN best_votes >= 2 AND best_votes / total_votes >= 0.75 THEN 'merge' ELSE 'keep_weak_context' END AS decision, to_gid, best_votes, total_votes
FROM spoken s LEFT JOIN best USING (meeting_id, gid) WHERE s.mass > 0 AND s.mass < 10 AND EXISTS (SELECT 1 FROM spoken x WHERE x.meeting_id = s.meeting_id AND x.mass >= 10)""".lstrip())
def context_votes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(turns.context_votes(v_turn(spark, d)), "mass", places=2)


def _frames(spark: SparkSession, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _table(spark, d, "events").select(F.col("user_id").cast("string").alias("meeting_id"), at.cast("int").alias("frame_idx"), F.col("value").alias("rms"))


@query("SELECT user_id::VARCHAR AS meeting_id, round(quantile_cont(value, 0.25), 6) AS floor FROM events GROUP BY ALL")
def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(windows.noise_floor(_frames(spark, d)), "floor")


@query()
def silence_cuts(spark: SparkSession, d: str) -> DataFrame:
    rms = _frames(spark, d)
    lengths = rms.groupBy("meeting_id").agg((F.count(F.lit(1)) * c.FRAME_SECONDS).alias("duration"))
    return windows.cut_windows(rms, lengths, window=4.0, first_window=3.5)


@query("SELECT time_bucket(INTERVAL 30 SECOND, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(streams.tumbling_counts(_table(spark, d, "events")), "total", places=4)


@query("""SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(_table(spark, d, "events"))


# --- Scores --------------------------------------------------------------------------------------

@query("""SELECT corpus, errs, ref_words, cpwer_pct FROM (
  SELECT *, round(100.0 * errs / ref_words, 2)::DOUBLE AS cpwer_pct FROM (SELECT coalesce(source, 'none') AS corpus, sum(n_chars % 17)::BIGINT AS errs, sum(n_chars)::BIGINT AS ref_words FROM documents GROUP BY ALL))
UNION ALL SELECT 'macro', NULL, NULL, round(avg(p), 2) FROM (SELECT round(100.0 * sum(n_chars % 17) / sum(n_chars), 2)::DOUBLE AS p FROM documents GROUP BY coalesce(source, 'none'))""")
def pooled_cpwer(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("corpus"), (F.col("n_chars") % 17).alias("errs"), F.col("n_chars").alias("ref_words"))
    return scoring.pooled(rows)


@query(r""", said AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '\S+') AS r, lead(regexp_extract_all(lower(text), '\S+')) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations),
cell AS (SELECT conv_id, turn, r, unnest(h) AS w, generate_subscripts(h, 1) AS j FROM said WHERE h IS NOT NULL),
walk AS (
  SELECT conv_id, turn, 0 AS i, j, j::INT AS v, v0 FROM (SELECT conv_id, turn, j, 0 AS v0 FROM cell)
  UNION ALL
  SELECT conv_id, turn, i, j, least(i + j, min(s - j) OVER (PARTITION BY conv_id, turn ORDER BY j) + j)::INT, i FROM (
    SELECT k.conv_id, k.turn, p.i + 1 AS i, k.j, least(p.v + 1, coalesce(lag(p.v) OVER (PARTITION BY k.conv_id, k.turn ORDER BY k.j), p.i) + CASE WHEN k.r[p.i + 1] = k.w THEN 0 ELSE 1 END) AS s
    FROM walk p JOIN cell k ON k.conv_id = p.conv_id AND k.turn = p.turn AND k.j = p.j WHERE p.i < len(k.r))
) SELECT conv_id, turn, v::BIGINT AS errs, len(r)::BIGINT AS ref_words FROM walk w JOIN said s USING (conv_id, turn) WHERE w.i = len(s.r) AND w.j = len(s.h)""".lstrip())
def word_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations").withColumn("hyp", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("hyp IS NOT NULL")
    return scoring.count_word_errors(rows, "text", "hyp", normalize=F.lower).select("conv_id", "turn", "errs", "ref_words")


def _hypothesis(seg: DataFrame) -> DataFrame:
    """Every seventh word lost, two speakers' names swapped."""
    kept = F.filter(t.words_of(F.col("text")), lambda w, i: i % 7 != 6)
    return seg.withColumns({"text": F.array_join(kept, " "), "speaker": F.when(F.col("speaker") == "user", "assistant").when(F.col("speaker") == "assistant", "user").otherwise(F.col("speaker"))})


@query()
def cpwer_by_meeting(spark: SparkSession, d: str) -> DataFrame:
    seg = v_seg(spark, d)
    texts = lambda df: scoring.speaker_texts(df, "speaker", ["start", "seg_idx"])
    return scoring.cpwer(texts(seg), texts(_hypothesis(seg)))


@query()
def scored_meetings(spark: SparkSession, d: str) -> DataFrame:
    seg = v_seg(spark, d)
    refs = seg.select("meeting_id", F.col("seg_idx").alias("ord"), F.col("speaker").alias("speaker_id"), F.col("start").alias("begin_time"), F.col("end").alias("end_time"), "text")
    corpora = seg.select("meeting_id").distinct().withColumn("corpus", F.element_at(F.array(*map(F.lit, c.SPLITS)), (F.col("meeting_id").cast("int") % 3 + 1).cast("int")))
    return scoring.meeting_report(scoring.score_meetings(refs, _hypothesis(seg).select("meeting_id", "seg_idx", "speaker", "start", "end", "text"), v_span(spark, d), corpora))


# --- Words and tokens --------------------------------------------------------------------------

def _word_cases(spark: SparkSession, d: str) -> DataFrame:
    """Turns as cases: A lacks a run of words that B has; times are even.  Words without capital
    letters in their key are left out on both sides; a turn without any gives no case."""
    words = F.filter(t.words_of(F.col("text")), lambda w: t.word_key(w) != "")
    rows = v_seg(spark, d).withColumn("w", words).where(F.size("w") > 0).withColumn("lo", F.floor(F.size("w") / 2).cast("int"))
    at = lambda i: F.col("start") + i * 0.3

    def word(x: Column, i: Column, node: str, speaker: Column) -> Column:
        return F.struct(x.alias("text"), at(i).alias("start"), (at(i) + 0.12).alias("end"), F.lit(node).alias("node"), speaker.alias("speaker"), F.lit(0.9).alias("score"), F.lit("ctc_forced").alias("timing"))

    b = F.transform("w", lambda x, i: word(x, i, "B:0:1", F.lit(None).cast("string")))
    a = F.filter(F.transform("w", lambda x, i: F.struct(word(x, i, "A:0:1", F.col("speaker")).alias("w"), i.alias("i"))), lambda x: (x["i"] < F.col("lo")) | (x["i"] >= F.col("lo") + 3))
    return rows.select(F.concat_ws(":", "meeting_id", "seg_idx").alias("case_id"), (at(F.col("lo")) - 0.05).alias("gap_start"), (at(F.col("lo") + 2) + 0.17).alias("gap_end"), F.transform(a, lambda x: x["w"]).alias("a"), b.alias("b"), "lo", F.least(F.col("lo") + 3, F.size("w")).alias("hi"))


@query()
def reconcile_words(spark: SparkSession, d: str) -> DataFrame:
    out = reconcile.reconcile(_word_cases(spark, d))
    return out.select("case_id", "status", F.array_join("reasons", ",").alias("reasons"), F.size("words").alias("n_words"), F.array_join(F.transform("insertions", lambda w: w["text"]), " ").alias("inserted"))


@query()
def refine_timings(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.refine_timings(reconcile.validated(_word_cases(spark, d))).select("case_id", F.size("refined").alias("n_words"), F.size("retimings").alias("n_retimed"))


@query()
def passage_proposals(spark: SparkSession, d: str) -> DataFrame:
    out = reconcile.propose_passage(_word_cases(spark, d))
    return out.select("case_id", "status", F.array_join("reasons", ",").alias("reasons"), F.col("passage.text").alias("text"), F.col("passage.speaker").alias("speaker"))


@query()
def ctc_words(spark: SparkSession, d: str) -> DataFrame:
    """Each word of an event's type spelled in frames: every letter twice, a blank behind it."""
    rows = _table(spark, d, "events").select(F.col("event_id").cast("string").alias("case_id"), F.split(F.upper(F.regexp_replace("event_type", "[^A-Za-z]+", " ")), " ").alias("words"))
    letters = F.filter(F.split(F.array_join("words", "|"), ""), lambda x: x != "")
    code = F.transform(letters, lambda x: F.when(x == "|", F.lit(1)).otherwise(F.ascii(x)))
    path = F.flatten(F.transform(code, lambda x: F.array(x, x, F.lit(0))))
    staged = rows.withColumns({"targets": code, "path": path})
    staged = staged.withColumns({"scores": F.transform("path", lambda _, i: -(i % 4) / 10.0), "blank": F.lit(0), "delimiter": F.lit(1), "frame_seconds": F.lit(0.02), "offset": F.lit(1.0), "node": F.lit("A:0:1")})
    return alignment.path_words(staged).select("case_id", F.inline("words")).select("case_id", "text", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.round("score", 6).alias("score"))


def _histories(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as token histories: speaker, time, two text tokens, time."""
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    step = F.array(role + c.SPEAKER_TOKENS[0], F.lit(c.TS_FIRST) + F.col("turn") * 10, F.length("text") % 1000, F.length("text") % 777, F.lit(c.TS_FIRST) + F.col("turn") * 10 + 5)
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", step.cast("array<int>").alias("x")))), lambda s: s["x"])).alias("ids"))
    cut = F.explode(F.sequence(F.lit(0), F.size("ids")))
    return rows.withColumn("at", cut).withColumn("ids", F.slice("ids", F.lit(1), F.col("at")))


@query()
def grammar_allowed(spark: SparkSession, d: str) -> DataFrame:
    g = grammar.Grammar(mode="interleaved_on_change", window_token=c.WINDOW_TOKEN, windows=2, monotonic=True)
    ranges = F.array_join(F.transform(grammar.allowed_ranges(F.col("ids"), g), lambda r: F.concat_ws("-", r["lo"], r["hi"])), ",")
    return _histories(spark, d).select("conv_id", "at", ranges.alias("allowed"))


@query(r""", h AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS k, max(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END) OVER (PARTITION BY conv_id ORDER BY turn) AS top FROM conversations)
SELECT conv_id, turn, (SELECT string_agg(51866 + i, ',' ORDER BY i) FROM range(0, top + 2) r(i)) AS each_utterance, (SELECT string_agg(51866 + i, ',' ORDER BY i) FROM range(0, top + 2) r(i) WHERE i <> k) AS on_change, (51866 + top + 1)::VARCHAR AS blocks FROM h""".lstrip())
def next_speakers(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2) + c.SPEAKER_TOKENS[0]
    rows = _table(spark, d, "conversations").withColumn("ids", F.collect_list(role.cast("int")).over(Window.partitionBy("conv_id").orderBy("turn")))
    shown = lambda mode: F.array_join(grammar.next_speakers(F.col("ids"), mode, c.SPEAKER_TOKENS).cast("array<string>"), ",")
    return rows.select("conv_id", "turn", shown("interleaved_each_utterance").alias("each_utterance"), shown("interleaved_on_change").alias("on_change"), shown("speaker_blocks").alias("blocks"))


@query()
def decode_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token histories back to tagged text; one without tokens is empty."""
    rows = _histories(spark, d).select(F.concat_ws(":", "conv_id", "at").alias("row_id"), "ids")
    pieces = spark.range(1000).select(F.col("id").cast("int").alias("token"), F.concat(F.lit(" w"), F.col("id").cast("string")).alias("piece"))
    decoded = parsing.decode_tokens(rows.select("row_id", F.posexplode("ids").alias("pos", "token")), pieces)
    return rows.select("row_id").join(decoded, "row_id", "left").withColumn("decoded", F.coalesce("decoded", F.lit("")))


@query("SELECT conv_id, turn, greatest(0, ceil(len(text) / 30.0)::BIGINT - 1) AS tiles FROM conversations")
def tile_budget(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", m.tiles(F.length("text").cast("double")).cast("long").alias("tiles"))

"""Registered queries: whole projects written as TTML and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SONG_SQL, song_words
from ..sources import project_ttml


def _project(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Timed words of songs as lines of groups, every fifth line with times of its own only, most with a translation and a reading."""
    w = song_words(spark, sf).where("begin_ms is not null")
    word = F.struct("text", "begin_ms", "end_ms", (F.col("word_id") % 13 == 0).alias("explicit"), F.lit(None).cast("string").alias("reading"), F.lit(None).cast("string").alias("joiner"))
    track = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("track") == name, F.struct("word_no", word.alias("w"))))), lambda x: x["w"])
    l = w.groupBy("song", "line_no").agg(track("main").alias("words"), track("bg").alias("bg_words"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms")).where("size(words) > 0")
    plain = F.col("line_no") % 5 == 0
    joined = F.array_join(F.transform("words", lambda x: F.trim(x["text"])), " ")
    part = F.rtrim(F.array_join(F.transform("words", lambda x: F.concat(F.lit("é"), F.trim(x["text"]), F.when(x["text"].endswith(" "), "  ").otherwise(" "))), ""))
    linked = F.col("line_no") % 3 < 2
    lines = l.select(
        "song", "line_no", F.concat(F.lit("v"), (F.col("line_no") % 2 + 1).cast("string")).alias("agent"), "begin_ms", "end_ms", joined.alias("text"), F.when(~plain, F.col("words")).alias("words"), F.when(~plain, F.col("bg_words")).alias("bg_words"),
        F.when(plain & (F.col("line_no") % 2 == 0), "la & la").alias("bg_text"), F.when(linked, "g1").alias("group_id"), F.floor(F.col("line_no") / 3).cast("int").alias("instance"), (F.col("line_no") % 3).cast("int").alias("template_line"), (F.col("line_no") == 4).alias("detached"),
        F.array(F.struct(F.lit("de").alias("language"), F.concat(F.lit("<"), joined, F.lit(">")).alias("text"), F.lit(None).cast("string").alias("background"))).alias("translations"),
        F.when(F.col("line_no") % 4 > 0, F.struct(F.lit("x-Latn").alias("language"), part.alias("text"), F.lit(None).cast("string").alias("background"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("bg_status"))).alias("reading"),
    )
    groups = lines.select("song").distinct().select("song", F.lit("g1").alias("id"), F.concat(F.lit('Part "'), F.col("song").cast("string"), F.lit('"')).alias("label"), F.lit("#123456").alias("color"), F.lit(2).alias("template_version"))
    return lines, groups


def project_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    back = project_ttml.read_project(project_ttml.write_project(*_project(spark, sf)))
    return back.select(
        "song", "line_no", "agent", "begin_ms", "end_ms", F.replace("text", F.lit("|"), F.lit("")).alias("text"), F.expr("coalesce(size(words), 0)").alias("words"), F.expr("size(filter(coalesce(words, array()), w -> w.explicit))").alias("explicit"), F.expr("coalesce(size(bg_words), 0)").alias("bg_words"),
        F.when(F.expr("coalesce(size(bg_words), 0) = 0"), F.col("bg_text")).alias("bg_text"), "bg_source", "group_id", "instance", "template_line", "detached", F.col("translations")[0]["text"].alias("translation"), F.col("reading.text").alias("reading"), F.col("reading.status").alias("status"),
        F.expr("array_join(transform(coalesce(words, array()), w -> coalesce(w.reading, '?')), '/')").alias("parts"),
    )


def project_groups(spark: SparkSession, sf: str) -> DataFrame:
    return project_ttml.read_groups(project_ttml.write_project(*_project(spark, sf)))


def ttml_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, without their spans' times, and without any."""
    docs = project_ttml.write_project(*_project(spark, sf))
    bare = F.regexp_replace("content", r'(<span) begin="[^"]*" end="[^"]*"', "$1")
    text = F.when(F.col("song") % 3 == 0, F.col("content")).when(F.col("song") % 3 == 1, bare).otherwise(F.regexp_replace(bare, r'(<p) begin="[^"]*" end="[^"]*"', "$1"))
    return docs.select("song", project_ttml.sync_of_ttml(text).alias("sync"))


QUERIES = [project_round_trip, project_groups, ttml_sync]

_LINES = f"""WITH {SONG_SQL}, l AS (SELECT song, line_no, min(begin_ms) AS b, max(end_ms) AS e, string_agg(trim(text, ' '), ' ' ORDER BY word_no) FILTER (track = 'main') AS joined, string_agg(text, '' ORDER BY word_no) FILTER (track = 'main') AS shown, rtrim(string_agg('é' || trim(text, ' ') || CASE WHEN text LIKE '% ' THEN '  ' ELSE ' ' END, '' ORDER BY word_no) FILTER (track = 'main'), ' ') AS part,
    string_agg('é' || trim(text, ' '), '/' ORDER BY word_no) FILTER (track = 'main') AS parts, string_agg('?', '/') FILTER (track = 'main') AS none, count(*) FILTER (track = 'main') AS n, count(*) FILTER (track = 'main' AND word_id % 13 = 0) AS x, count(*) FILTER (track = 'bg') AS bg FROM sw WHERE begin_ms IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (track = 'main') > 0)"""
SQL = {
    "project_round_trip": f"""{_LINES} SELECT song, CAST(row_number() OVER (PARTITION BY song ORDER BY line_no) - 1 AS INT) AS line_no, 'v' || (line_no % 2 + 1) AS agent, CASE WHEN line_no % 5 = 0 THEN b END AS begin_ms, CASE WHEN line_no % 5 = 0 THEN e END AS end_ms,
      CASE WHEN line_no % 5 = 0 THEN joined ELSE trim(shown, ' ') END AS text, CASE WHEN line_no % 5 = 0 THEN 0 ELSE n END AS words, CASE WHEN line_no % 5 = 0 THEN 0 ELSE x END AS explicit, CASE WHEN line_no % 10 = 0 THEN 1 WHEN line_no % 5 = 0 THEN 0 ELSE bg END AS bg_words, NULL::VARCHAR AS bg_text,
      CASE WHEN line_no % 10 = 0 OR line_no % 5 > 0 AND bg > 0 THEN 'manual' END AS bg_source, CASE WHEN line_no % 3 < 2 THEN 'g1' END AS group_id, CASE WHEN line_no % 3 < 2 THEN line_no // 3 END AS instance, CASE WHEN line_no % 3 < 2 THEN line_no % 3 END AS template_line, CASE WHEN line_no % 3 < 2 THEN line_no = 4 END AS detached,
      '<' || joined || '>' AS translation, CASE WHEN line_no % 4 > 0 THEN part END AS reading, CASE WHEN line_no % 4 > 0 THEN 'confirmed' END AS status, CASE WHEN line_no % 5 = 0 THEN '' WHEN line_no % 4 > 0 THEN parts ELSE none END AS parts FROM l""",
    "project_groups": f"""{_LINES} SELECT DISTINCT song, 'g1' AS id, 'Part "' || song || '"' AS label, '#123456' AS color, 2 AS template_version FROM l""",
    "ttml_sync": f"{_LINES} SELECT DISTINCT song, CASE song % 3 WHEN 0 THEN 'syllable' WHEN 1 THEN 'line' ELSE 'unsynced' END AS sync FROM l",
}

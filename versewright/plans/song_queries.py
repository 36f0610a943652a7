"""Registered queries: whole lines repaired, and background vocals taken out of parentheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import extraction, line_repair
from ..schema import events_as_words, in_lines, song_words


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Songs' lines with both tracks; a quarter of the words are hardly heard, some of those stray."""
    w = song_words(spark, sf)
    sure = F.when(F.col("word_id") % 4 == 0, F.col("confidence") / 20).otherwise(F.col("confidence"))
    away = F.when((F.col("word_id") % 12 == 0) & (F.col("word_no") == 0), -2000).otherwise(0)
    word = F.struct("text", (F.col("begin_ms") + away).cast("double").alias("begin_ms"), (F.col("end_ms") + away).cast("double").alias("end_ms"), sure.alias("confidence"), F.array().cast("array<string>").alias("flags"))
    track = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("track") == name, F.struct("word_no", word.alias("w"))))), lambda x: x["w"]).alias({"main": "words", "bg": "background"}[name])
    return w.groupBy("song", "line_no").agg(track("main"), track("bg"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"))


def repaired_lines(spark: SparkSession, sf: str) -> DataFrame:
    fixed = line_repair.repaired_lines(_tracks(spark, sf))
    each = fixed.select("song", "line_no", F.explode(F.create_map(F.lit("main"), "words", F.lit("bg"), "background")).alias("track", "w"))
    w = each.select("song", "line_no", "track", F.posexplode("w").alias("word_no", "w"))
    return w.select("song", "line_no", "track", "word_no", F.col("w.begin_ms").cast("bigint").alias("begin_ms"), F.col("w.end_ms").cast("bigint").alias("end_ms"), F.array_join("w.flags", ",").alias("flags"))


def _sung(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of four kinds: plain, with parentheses inside, in parentheses as a whole, and with unbalanced ones; most of them have timed words."""
    w = in_lines(events_as_words(spark, sf), 6)
    kind = (F.col("song") + F.col("line_no")) % 7
    last = F.col("word_no") == 5
    name = F.when(F.col("kind") == "error", F.lit("ooh")).otherwise(F.col("kind"))

    def wrapped(first: Column, end: Column) -> Column:
        return F.concat(F.when(first, "(").otherwise(""), name, F.when(end, ")").otherwise(""))

    inside = wrapped(F.col("word_no") == 2, F.col("word_no") == 3)
    whole = wrapped(F.col("word_no") == 0, last)
    text = F.when(kind.isin(1, 4), inside).when(kind.isin(2, 3, 5), whole).when(kind == 6, F.concat(name, F.when(F.col("word_no") == 1, "(").otherwise(""))).otherwise(name)
    begin = (F.col("line_no") * 6000 + F.col("word_no") * 700).cast("double")
    word = F.struct(F.concat(text, F.when(last, "").otherwise(" ")).alias("text"), begin.alias("begin_ms"), (begin + 600).alias("end_ms"), F.lit(None).cast("string").alias("syllable"))
    whole_lines = w.withColumn("full", F.max("word_no").over(Window.partitionBy("song", "line_no"))).where("full = 5")
    ordered = F.array_sort(F.collect_list(F.struct("word_no", word.alias("w"))))
    l = whole_lines.groupBy("song", "line_no").agg(F.transform(ordered, lambda x: x["w"]).alias("w"))
    timing = F.col("line_no") % 5
    written = F.col("line_no") % 9 == 4
    return l.select(
        "song", "line_no", F.array_join(F.transform("w", lambda x: x["text"]), "").alias("text"), F.when(timing > 1, F.col("w")).alias("words"),
        *[F.when(timing == 1, F.element_at("w", k)[c]).alias(c) for c, k in (("begin_ms", 1), ("end_ms", -1))],
        F.when(written, "la la").alias("bg_text"), F.lit(None).cast(f"array<{extraction.WORD}>").alias("bg_words"), F.when(written, F.when(F.col("song") % 2 == 0, "extraction").otherwise("manual")).alias("bg_source"), (F.col("line_no") % 11 == 3).alias("linked"),
    )


def background_extraction(spark: SparkSession, sf: str) -> DataFrame:
    out = extraction.extracted(_sung(spark, sf), brackets=True)
    return out.select("song", "line_no", "text", F.coalesce(F.size("words"), F.lit(0)).alias("words"), "bg_text", F.expr("coalesce(size(bg_words), 0)").alias("bg_words"), "bg_source", F.expr("cast(round(bg_words[0].begin_ms) as bigint)").alias("bg_begin_ms"))


QUERIES = [repaired_lines, background_extraction]
SQL: dict[str, str] = {}

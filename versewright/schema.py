"""Canonical tables of timed text, and how the driver's tables play their roles.

Times are integer milliseconds from the start of a song; a word without
times is normal data.  Order is explicit: ``line_no`` in a song, ``word_no``
in a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("begin_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
    ]
)
LINES = T.StructType(
    [
        T.StructField("song", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("agent", T.StringType()),
        T.StructField("begin_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("words", T.ArrayType(WORD)),
        T.StructField("background", T.ArrayType(WORD)),
    ]
)
#: Words of a line when events stand for words.
LINE_WORDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as timed words: song, word_id, kind, begin_ms, end_ms, confidence, at (by time)."""
    e = table(spark, sf_dir, "events")
    begin = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("song"),
        F.col("event_id").alias("word_id"),
        F.col("event_type").alias("kind"),
        begin.alias("begin_ms"),
        (begin + F.round(F.col("value") * 1000).cast("bigint")).alias("end_ms"),
        F.col("value").alias("value"),
        (F.col("value") / 500).alias("confidence"),
    )


def in_lines(words: DataFrame, size: int = LINE_WORDS) -> DataFrame:
    """Words with ``line_no`` and ``word_no``: each song's words by time, ``size`` to a line."""
    at = F.row_number().over(Window.partitionBy("song").orderBy("begin_ms", "word_id")) - 1
    return words.withColumn("at", at).withColumn("line_no", F.floor(F.col("at") / size).cast("int")).withColumn("word_no", F.col("at") % size)


def song_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as words of songs on two tracks, with times from the song's begin; some words have none.

    Columns: song, line_no, track (main, bg), word_no (in line and track), word_id, text, begin_ms, end_ms, confidence.
    """
    w = in_lines(events_as_words(spark, sf_dir))
    first = F.min("begin_ms").over(Window.partitionBy("song"))
    begin = F.floor((F.col("begin_ms") - first) / 10_000).cast("bigint")
    track = F.when(F.col("word_id") % 5 == 0, "bg").otherwise("main")
    text = F.concat("kind", F.when(F.col("word_id") % 3 == 0, "").otherwise(" "))
    timed = F.col("word_id") % 11 != 0
    w = w.select("song", "line_no", "at", track.alias("track"), "word_id", text.alias("text"), "confidence", F.when(timed, begin).alias("begin_ms"), F.when(timed, begin + F.round(F.col("value") * 30).cast("bigint")).alias("end_ms"))
    number = F.row_number().over(Window.partitionBy("song", "line_no", "track").orderBy("at")) - 1
    return w.withColumn("word_no", number.cast("int")).drop("at")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as lines of text: doc_id, source, line_no, line."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


#: The same mappings for DuckDB.
WORDS_SQL = """words AS (
  SELECT user_id AS song, event_id AS word_id, event_type AS kind, epoch_us(ts) // 1000 AS begin_ms,
         epoch_us(ts) // 1000 + CAST(round(value * 1000) AS BIGINT) AS end_ms, value, value / 500 AS confidence FROM events
)"""
LINED_SQL = WORDS_SQL + """, lined AS (
  SELECT *, CAST(floor(pos / 8) AS INT) AS line_no, CAST(pos % 8 AS INT) AS word_no FROM (
    SELECT *, row_number() OVER (PARTITION BY song ORDER BY begin_ms, word_id) - 1 AS pos FROM words) q
)"""
SONG_SQL = LINED_SQL + """, sw AS (
  SELECT song, line_no, track, CAST(row_number() OVER (PARTITION BY song, line_no, track ORDER BY pos) - 1 AS INT) AS word_no, word_id, text, confidence,
         CASE WHEN word_id % 11 <> 0 THEN b END AS begin_ms, CASE WHEN word_id % 11 <> 0 THEN b + CAST(round(value * 30) AS BIGINT) END AS end_ms
  FROM (SELECT *, CASE WHEN word_id % 5 = 0 THEN 'bg' ELSE 'main' END AS track, kind || CASE WHEN word_id % 3 = 0 THEN '' ELSE ' ' END AS text,
               (begin_ms - min(begin_ms) OVER (PARTITION BY song)) // 10000 AS b FROM lined) q
)"""
DOC_LINES_SQL = """doc_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL
)"""

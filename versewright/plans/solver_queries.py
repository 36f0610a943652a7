"""Registered queries: words placed on frames of probabilities; vectors stand for frames, cut into songs of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import placement
from ..schema import table

FRAME_MS = 100
#: Ids of vectors of a song (a label has about a tenth of them), frames of a word, words of a line.
SONG_IDS, WORD_FRAMES, LINE_WORDS = 8000, 12, 5


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """``song, frame, logp`` of all usable vectors: a song is a label's vectors in a run of ids; the first component is silence."""
    v = table(spark, sf, "embeddings").where("label is not null and vec_id is not null and coalesce(forall(embedding, x -> x is not null and not isnan(x)), false) and size(embedding) > 1")
    v = v.select((F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / SONG_IDS)).cast("bigint").alias("song"), "vec_id", F.transform("embedding", lambda x: x.cast("double") * 12).alias("x"))
    at = F.row_number().over(Window.partitionBy("song").orderBy("vec_id")) - 1
    v = v.select("song", at.alias("frame"), "x")
    quiet = (F.col("frame") % WORD_FRAMES >= 2) & (F.col("frame") % 7 > 0)  # words are two frames, with some noise between
    v = v.withColumn("x", F.when(quiet, F.transform("x", lambda x, i: F.when(i == 0, 6.0).otherwise(x))).otherwise(F.col("x")))
    total = F.ln(F.aggregate("x", F.lit(0.0), lambda s, x: s + F.exp(x)))
    return v.select("song", "frame", F.transform("x", lambda x: x - total).alias("logp"))


def sung_lines(heard: DataFrame) -> DataFrame:
    """Words as they are heard, two sounds each, in lines; the source's times are off by a constant in even songs and drift in odd ones."""
    loudest = lambda c: F.array_position(F.slice(c, 2, 10_000), F.array_max(F.slice(c, 2, 10_000))).cast("int")
    each = heard.select("song", "frame", loudest("logp").alias("token"))
    marked = each.where(F.col("frame") % WORD_FRAMES < 2).select("song", F.floor(F.col("frame") / WORD_FRAMES).alias("word"), F.struct("frame", "token").alias("s"))
    words = marked.groupBy("song", "word").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["token"]).alias("tokens"), F.min("s.frame").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "tokens")))
    lines = words.groupBy("song", F.floor(F.col("word") / LINE_WORDS).cast("int").alias("line_no")).agg(F.transform(ordered, lambda w: w["tokens"]).alias("words"), F.min("at").alias("at"))
    true = F.col("at") * FRAME_MS
    source = F.when(F.col("song") % 2 == 0, true - 1200).otherwise(F.floor(true * 0.97))
    ended = source + WORD_FRAMES * LINE_WORDS * FRAME_MS
    return lines.select("song", "line_no", "words", source.cast("bigint").alias("begin_ms"), ended.cast("bigint").alias("end_ms"))


def place_words(spark: SparkSession, sf: str) -> DataFrame:
    """All words, on the graph with gaps between lines, by the best of the priors."""
    heard = frames(spark, sf)
    placed = placement.place_songs(heard, sung_lines(heard), FRAME_MS, filler=3.0)
    return placed.select("song", "line_no", "word_no", "begin_ms", "end_ms", F.round("score", 6).alias("score"), "mode", "offset_ms")


def place_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The last two words of every third line are a block that may be left out; no source times."""
    heard = frames(spark, sf)
    lines = sung_lines(heard).drop("begin_ms", "end_ms").withColumn("optional_from", F.when(F.col("line_no") % 3 == 2, F.greatest(F.lit(1), F.size("words") - 2)))
    placed = placement.place_songs(heard, lines, FRAME_MS)
    return placed.select("song", "line_no", "word_no", "begin_ms", "end_ms", F.round("score", 6).alias("score"))


def realigned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each line placed anew between its own times only, a line with its frames being one row."""
    heard = frames(spark, sf)
    return placement.realign_lines(heard, sung_lines(heard), FRAME_MS, pad_ms=1500)


def padded_words(spark: SparkSession, sf: str) -> DataFrame:
    """Each line on the frames around it, with wildcards at both ends."""
    heard = frames(spark, sf)
    return placement.padded_lines(heard, sung_lines(heard), FRAME_MS, pad_ms=1500)


QUERIES = [place_words, place_blocks, realigned_lines, padded_words]
SQL: dict[str, str] = {}

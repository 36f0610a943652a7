"""Registered queries: words moved and pasted, readings dealt over syllables, numbers in words, sung syllables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import readings, sung, tracks
from ..schema import SONG_SQL, events_as_words, song_words, table

DURATION, MOVE, PASTE, PASTE_END = 250_000, 3_000, 50_000, 200_000


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).where("begin_ms is not null")
    return w.withColumn("syllable", F.when(F.col("word_id") % 4 < 2, F.concat(F.lit("s"), F.col("line_no").cast("string"))))


def reorder_track(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh word of each track is dragged three seconds on."""
    w = _timed(spark, sf)
    out = tracks.reordered(w, F.col("word_id") % 7 == 0, F.lit(MOVE), F.lit(DURATION))
    return out.select("word_id", F.col("word_no").cast("bigint").alias("word_no"), "text", "begin_ms", "end_ms", "syllable")


def _clipboard(spark: SparkSession, sf: str) -> DataFrame:
    """Even words of each song's first two lines, to be pasted at line 3, and in every third song at a line that is not there."""
    w = _timed(spark, sf).where("line_no < 2 and word_id % 2 = 0")
    paste = F.when(F.col("song") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    w = w.withColumn("paste", F.explode(paste)).withColumn("target_line", F.when(F.col("paste") == 0, 3).otherwise(99_999))
    return w.select("song", "paste", "target_line", F.lit(PASTE).alias("delta_ms"), F.lit(PASTE_END).alias("duration_ms"), F.col("line_no").alias("line_offset"), "track", "word_no", "text", "begin_ms", "end_ms", "syllable")


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.paste_targets(_clipboard(spark, sf), song_words(spark, sf).select("song", "line_no"))


def paste_words(spark: SparkSession, sf: str) -> DataFrame:
    out = tracks.pasted(_timed(spark, sf), _targets(spark, sf))
    return out.select("song", "line_no", "track", F.col("word_no").cast("bigint").alias("word_no"), "text", "begin_ms", "end_ms", "syllable", "incoming")


def paste_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.paste_overlaps(_targets(spark, sf), _timed(spark, sf))


def align_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines' words with readings of four kinds: as many parts as words, with dashes, as one word, and too short."""
    w = song_words(spark, sf)
    word = F.struct("text", F.lit(None).cast("string").alias("reading"), F.lit(None).cast("string").alias("joiner"))
    l = w.groupBy("song", "line_no", "track").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", word.alias("w")))), lambda x: x["w"]).alias("words"))
    plain = F.transform("words", lambda x: F.translate(F.trim(x["text"]), "aeiou", "eioua"))
    kind = F.col("line_no") % 4
    reading = F.when(kind == 0, F.array_join(plain, "  ")).when(kind == 1, F.array_join(plain, "-")).when(kind == 2, F.array_join(plain, "")).otherwise("é")
    text = F.array_join(F.transform("words", lambda x: x["text"]), "")
    out = readings.aligned_readings(l.select("song", "line_no", "track", "words", text.alias("text"), F.when(F.col("song") % 9 > 0, reading).alias("reading")))
    return out.select("song", "line_no", "track", "status", F.array_join(F.transform("words", lambda x: F.coalesce(x["reading"], F.lit("?"))), "|").alias("parts"), F.array_join(F.transform("words", lambda x: F.coalesce(x["joiner"], F.lit("?"))), "|").alias("joiners"))


def number_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys in words, in four languages by turns."""
    o = table(spark, sf, "orders").select("o_orderkey")
    code = F.element_at(F.array(*[F.lit(c) for c in numbers.SPELLERS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", code.alias("language"), numbers.number_words(F.col("o_orderkey"), code).alias("words"))


def alignment_text(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of the documents of each language in an aligner's letters: how many words, spellings and letters."""
    d = table(spark, sf, "documents").where("text is not null").select("lang", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    spelled = d.distinct().withColumn("letters", numbers.alignment_text(F.col("word"), F.col("lang")))
    return spelled.groupBy("lang").agg(F.count("*").alias("words"), F.count_distinct("letters").alias("spellings"), F.sum(F.length("letters")).alias("letters"))


def sung_syllables(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of events as words whose letters are sung as sounds; a third of them fast, a third in capitals."""
    w = events_as_words(spark, sf)
    kind = F.col("word_id") % 3
    sounds = F.filter(F.split("kind", ""), lambda c: c != "")
    step = F.when(kind == 0, 15).otherwise(70)
    first = F.col("begin_ms") % 1_000_000
    w = w.select("word_id", F.when(kind == 1, F.upper("kind")).otherwise(F.col("kind")).alias("text"), first.alias("begin_ms"), (first + F.size(sounds) * step).alias("end_ms"), sounds.alias("sounds"), F.transform(sounds, lambda c, i: (first + i * step).cast("double")).alias("begins"))
    return sung.split_sung(w)


QUERIES = [reorder_track, paste_words, paste_overlaps, align_readings, number_spelling, alignment_text, sung_syllables]

_TIMED = f"""WITH {SONG_SQL}, t AS (SELECT song, line_no, track, word_no, word_id, text, begin_ms AS b, end_ms AS e, CASE WHEN word_id % 4 < 2 THEN 's' || line_no END AS syl FROM sw WHERE begin_ms IS NOT NULL)"""
_MERGE = """, k AS (SELECT *, coalesce(syl = lag(syl) OVER (PARTITION BY song, line_no, track, inc ORDER BY word_no), false) AS same FROM m
  ), r AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY song, line_no, track, inc ORDER BY word_no) AS run FROM k
  ), u AS (SELECT *, first_value(b) OVER (PARTITION BY song, line_no, track, inc, run ORDER BY word_no) AS pos FROM r
  ), o AS (SELECT *, row_number() OVER w - 1 AS n, lead(inc) OVER w AS follows, bool_or(inc) OVER (PARTITION BY song, line_no, track) AS touched FROM u WINDOW w AS (PARTITION BY song, line_no, track ORDER BY pos, inc, run, word_no)
  ), x AS (SELECT *, CASE WHEN NOT touched THEN text WHEN follows IS NULL THEN rtrim(text, ' ') WHEN follows <> inc AND NOT ends_with(text, ' ') THEN text || ' ' ELSE text END AS shown, CASE WHEN inc THEN 'new ' || syl ELSE syl END AS syllable FROM o)"""
_CLIP = f"""{_TIMED}, c AS (SELECT song, paste, CASE paste WHEN 0 THEN 3 ELSE 99999 END + line_no AS line_no, track, word_no, text, syl, greatest(0, b + {PASTE}) AS b, least({PASTE_END}, e + {PASTE}) AS e
    FROM (SELECT *, unnest(CASE WHEN song % 3 = 0 THEN [0, 1] ELSE [0] END) AS paste FROM t WHERE line_no < 2 AND word_id % 2 = 0) q
  ), g AS (SELECT *, bool_and(EXISTS (SELECT 1 FROM sw WHERE sw.song = c.song AND sw.line_no = c.line_no)) OVER (PARTITION BY song, paste) AS known FROM c)"""

SQL = {
    "reorder_track": f"""{_TIMED}, m AS (SELECT song, line_no, track, word_no, word_id, text, syl, word_id % 7 = 0 AS inc, CASE WHEN word_id % 7 = 0 THEN greatest(0, least({DURATION} - (e - b), b + {MOVE})) ELSE b END AS b, e - b AS len FROM t){_MERGE}
      , l AS (SELECT *, sum(len) OVER (PARTITION BY song, line_no, track ORDER BY n) AS upto FROM x
      ), p AS (SELECT *, upto + max(b - upto + len) OVER (PARTITION BY song, line_no, track ORDER BY n) AS ne, lead(n) OVER (PARTITION BY song, line_no, track ORDER BY n) IS NULL AS final FROM l)
      SELECT word_id, n AS word_no, shown AS text, CAST(CASE WHEN final AND ne > {DURATION} THEN greatest(0, {DURATION} - len) ELSE ne - len END AS BIGINT) AS begin_ms, CAST(CASE WHEN final AND ne > {DURATION} THEN {DURATION} ELSE ne END AS BIGINT) AS end_ms, syllable FROM p""",
    "paste_words": f"""{_CLIP}, m AS (SELECT song, line_no, track, word_no, text, syl, b, e, true AS inc FROM g WHERE known UNION ALL SELECT song, line_no, track, word_no, text, syl, b, e, false FROM t WHERE EXISTS (SELECT 1 FROM g WHERE known AND g.song = t.song AND g.line_no = t.line_no AND g.track = t.track)){_MERGE}
      SELECT song, line_no, track, n AS word_no, shown AS text, b AS begin_ms, e AS end_ms, syllable, inc AS incoming FROM x""",
    "paste_overlaps": f"{_CLIP} SELECT song, paste, bool_or(NOT known OR e <= b OR EXISTS (SELECT 1 FROM t WHERE t.song = g.song AND t.line_no = g.line_no AND t.track = g.track AND g.b < t.e AND g.e > t.b)) AS overlaps FROM g GROUP BY song, paste",
}

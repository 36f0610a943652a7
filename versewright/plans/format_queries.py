"""Registered queries: formats in and out with heads, tracks, voices and words, on ``events`` as songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import LINED_SQL, table
from ..sources import formats
from .stream_queries import _song_lines, _song_words


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as songs' metadata."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("song"), F.concat("p_name", F.lit(" & <co>")).alias("title"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.lit('a "b"'))).alias("artists"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("album"), F.array(F.col("p_brand")).alias("songwriters"), F.when(F.col("p_size") % 5 != 0, "en").alias("language"), (F.col("p_size") * 1000).cast("bigint").alias("duration_ms"))


def ttml_head(spark: SparkSession, sf: str) -> DataFrame:
    meta = _meta(spark, sf)
    words = meta.select("song", F.lit(0).alias("line_no"), F.lit(0).alias("word_no"), F.lit("la").alias("text"), F.lit(0).cast("bigint").alias("begin_ms"), F.lit(500).cast("bigint").alias("end_ms"))
    agents = meta.select("song", F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("id"), F.lit("person").alias("kind")).withColumn("name", F.when(F.col("id") == "v1", F.lit("A & B")))
    back = formats.read_ttml_head(formats.write_ttml(words, meta=meta, agents=agents))
    voices = F.array_join(F.transform("agents", lambda a: F.concat_ws("/", a["id"], a["kind"], a["name"])), ",")
    return back.select("song", "title", F.array_join("artists", ";").alias("artists"), "album", F.array_join("songwriters", ";").alias("songwriters"), "language", "duration_ms", voices.alias("agents"))


def _tracked(spark: SparkSession, sf: str) -> DataFrame:
    w = _song_words(spark, sf)
    return w.withColumns({"track": F.when((F.col("word_no") > 4) & (F.col("line_no") % 2 == 0), "bg").otherwise("main"), "agent": F.concat(F.lit("v"), F.col("line_no") % 2 + 1)})


def ttml_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with two tracks and two voices, written and read again."""
    back = formats.read_ttml(formats.write_ttml(_tracked(spark, sf)))
    return back.groupBy("song", "line_no", "track", "agent").agg(F.count("*").alias("words"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), "").alias("text"))


def enhanced_lrc(spark: SparkSession, sf: str) -> DataFrame:
    docs = formats.write_lrc_words(_song_words(spark, sf))
    return formats.lrc_words(formats.read_lrc(docs)).select("song", "line_no", F.col("word_no").cast("bigint").alias("word_no"), "begin_ms", "end_ms", F.trim("text").alias("text"))


def lyric_headers(spark: SparkSession, sf: str) -> DataFrame:
    p = _meta(spark, sf).withColumn("content", F.concat(F.lit("[ti: "), "title", F.lit("]\n[ar:"), F.coalesce("album", F.lit("")), F.lit("]\n[offset:"), "duration_ms", F.lit("]\n[00:01.00]la\n")))
    c = F.col("content")
    return p.select("song", formats.header(c, "ti").alias("title"), formats.header(c, "ar").alias("artist"), formats.header(c, "al").alias("album"), formats.offset_ms(c).alias("offset_ms"))


def qrc_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    """Lyrics inside an XML attribute come out as they went in."""
    docs = formats.write_qrc(_song_words(spark, sf))
    inner = F.replace(X.escape_xml(F.col("content"), quotes=True), F.lit("\n"), F.lit("&#10;"))
    wrapped = F.concat(F.lit('<?xml version="1.0"?><QrcInfos><Lyric_1 LyricContent="'), inner, F.lit('"/></QrcInfos>'))
    return docs.select("song", F.md5(formats.qrc_body(wrapped)).alias("body")).join(docs.select("song", F.md5("content").alias("own")), "song").select("song", (F.col("body") == F.col("own")).alias("same"))


def format_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Every song in every format, each read by its own reader."""
    docs = formats.write_all(_song_words(spark, sf), _song_lines(spark, sf)).where("format <> 'elrc'")
    lines = formats.read_any(docs.select(F.concat_ws("-", "song", "format").alias("song"), "format", "content"))
    return lines.groupBy("song", "format").agg(F.count("*").alias("lines"), F.min("begin_ms").alias("begin_ms"), F.min_by("text", "line_no").alias("first"))


def multi_format_export(spark: SparkSession, sf: str) -> DataFrame:
    docs = formats.write_all(_song_words(spark, sf), _song_lines(spark, sf))
    return docs.groupBy("format").agg(F.count("*").alias("songs"), F.count_if(F.length("content") > 0).alias("filled"))


QUERIES = [ttml_head, ttml_tracks, enhanced_lrc, lyric_headers, qrc_unwrap, format_dispatch, multi_format_export]

_W = f"""WITH {LINED_SQL}, w AS (SELECT song, line_no, word_no, kind, line_no * 4000 + word_no * 400 AS b, max(word_no) OVER (PARTITION BY song, line_no) AS last FROM lined)"""
_FIRST = f"SELECT song, count(DISTINCT line_no) AS lines, string_agg(kind, ' ' ORDER BY word_no) FILTER (line_no = 0) AS first FROM w GROUP BY song"

SQL = {
    "ttml_head": """SELECT p_partkey AS song, p_name || ' & <co>' AS title, CASE WHEN p_size % 2 = 0 THEN p_brand || ';a "b"' ELSE '' END AS artists, CASE WHEN p_size % 3 <> 0 THEN p_type END AS album, p_brand AS songwriters,
      CASE WHEN p_size % 5 <> 0 THEN 'en' END AS language, p_size * 1000 AS duration_ms, 'v1/person/A & B,v2/person' AS agents FROM part""",
    "ttml_tracks": f"""{_W}, t AS (SELECT *, CASE WHEN word_no > 4 AND line_no % 2 = 0 THEN 'bg' ELSE 'main' END AS track FROM w), u AS (SELECT *, max(word_no) OVER (PARTITION BY song, line_no, track) AS final FROM t)
      SELECT song, line_no, track, 'v' || (line_no % 2 + 1) AS agent, count(*) AS words, min(b) AS begin_ms, max(b) + 300 AS end_ms, string_agg(kind || CASE WHEN word_no < final THEN ' ' ELSE '' END, '' ORDER BY word_no) AS text FROM u GROUP BY 1, 2, 3, 4""",
    "enhanced_lrc": f"{_W} SELECT song, line_no, word_no, b AS begin_ms, CASE WHEN word_no < last THEN b + 400 ELSE b + 300 END AS end_ms, kind AS text FROM w",
    "lyric_headers": "SELECT p_partkey AS song, p_name || ' & <co>' AS title, CASE WHEN p_size % 3 <> 0 THEN p_type END AS artist, NULL AS album, p_size * 1000 AS offset_ms FROM part",
    "qrc_unwrap": "SELECT DISTINCT user_id AS song, true AS same FROM events",
    "format_dispatch": f"""{_W}, f AS ({_FIRST}) SELECT song || '-' || format AS song, format, lines, CASE WHEN format IN ('lrc', 'srt') THEN song * 10 ELSE 0 END AS begin_ms, first FROM f, (SELECT unnest(['lrc', 'srt', 'qrc', 'ttml']) AS format) q""",
    "multi_format_export": "SELECT format, count(DISTINCT user_id) AS songs, count(DISTINCT user_id) AS filled FROM events, (SELECT unnest(['lrc', 'srt', 'qrc', 'ttml', 'elrc']) AS format) q GROUP BY format",
}

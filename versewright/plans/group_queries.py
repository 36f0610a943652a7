"""Registered queries: linked repeats, selections, deletions, explicit terms and syllables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.syllables import split_syllables
from ..operators import groups, timing
from ..schema import LINED_SQL, events_as_words, in_lines, table


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of songs; lines 0 to 1 and 4 to 5 are two instances of one group."""
    w = in_lines(events_as_words(spark, sf))
    l = w.groupBy("song", "line_no").agg(F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), F.min_by("kind", "word_no").alias("text"))
    hit = F.col("line_no").isin(0, 1, 4, 5)
    return l.withColumns({"group_id": F.when(hit, "g1"), "instance_idx": F.when(hit, F.floor(F.col("line_no") / 4).cast("int")), "template_line": F.when(hit, (F.col("line_no") % 4).cast("int")), "detached": (F.col("song") % 10 == 0) & (F.col("line_no") == 5)})


def group_from_selection(spark: SparkSession, sf: str) -> DataFrame:
    out = groups.group_from_selection(_lines(spark, sf), F.col("line_no").isin(2, 3))
    return out.where("group_id is not null").groupBy("song", "group_id").agg(F.count("*").alias("n"), F.max("template_line").cast("bigint").alias("last"))


def template_times(spark: SparkSession, sf: str) -> DataFrame:
    return groups.template_of(_lines(spark, sf))


def unlink_lines(spark: SparkSession, sf: str) -> DataFrame:
    return groups.unlinked(_lines(spark, sf), F.col("line_no") == 1).groupBy("song").agg(F.count("group_id").alias("linked"))


def linked_edits(spark: SparkSession, sf: str) -> DataFrame:
    l = _lines(spark, sf)
    edits = l.where("line_no in (0, 5)").select("song", "line_no", F.concat(F.lit("new "), F.col("line_no").cast("string")).alias("text"), F.col("line_no").alias("version"))
    return groups.propagated(l, edits).select("song", "line_no", "text")


def conform_lines(spark: SparkSession, sf: str) -> DataFrame:
    l = _lines(spark, sf)
    starts = F.when(F.col("instance_idx") == 1, F.lit(1_705_000_000_000))
    return groups.conformed(l.withColumn("start_ms", starts), groups.template_of(l)).select("song", "line_no", "begin_ms", "end_ms")


def _syllables(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("kind", F.when(F.col("word_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("")))
    return timing.syllable_groups(in_lines(events_as_words(spark, sf)).withColumn("text", text))


def expanded_selection(spark: SparkSession, sf: str) -> DataFrame:
    return groups.expanded_selection(_syllables(spark, sf), F.col("kind") == "view").where("selected").select("word_id")


def merge_syllables(spark: SparkSession, sf: str) -> DataFrame:
    return groups.merged_groups(_syllables(spark, sf))


def delete_words(spark: SparkSession, sf: str) -> DataFrame:
    return groups.deleted_words(in_lines(events_as_words(spark, sf)), F.col("kind") == "error").select("word_id", F.col("word_no").cast("bigint").alias("word_no"))


def move_to_background(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf)).withColumn("track", F.lit("main"))
    return groups.moved_to_background(w, F.col("kind") == "error").select("word_id", "track", F.col("word_no").cast("bigint").alias("word_no"))


def explicit_scan(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("word_no", "text"))
    terms = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("term"))
    return groups.explicit_hits(words, terms).groupBy("conv_id", "turn").agg(F.count("*").alias("hits"), F.min("word_no").cast("bigint").alias("first"))


def syllable_split(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf).select("word_id", F.col("kind").alias("text"), "begin_ms", "end_ms")
    return split_syllables(w).select("word_id", "part_no", "part")


QUERIES = [group_from_selection, template_times, unlink_lines, linked_edits, conform_lines, expanded_selection, merge_syllables, delete_words, move_to_background, explicit_scan, syllable_split]

_L = f"""WITH {LINED_SQL}, l AS (SELECT song, line_no, min(begin_ms) AS begin_ms, max(end_ms) AS end_ms, arg_min(kind, word_no) AS text, line_no IN (0, 1, 4, 5) AS hit, line_no // 4 AS inst, line_no % 4 AS tl, song % 10 = 0 AND line_no = 5 AS detached FROM lined GROUP BY song, line_no
  ), t AS (SELECT song, tl, begin_ms - min(begin_ms) OVER (PARTITION BY song) AS rb, end_ms - min(begin_ms) OVER (PARTITION BY song) AS re FROM l WHERE hit AND inst = 0)"""
_S = f"""WITH {LINED_SQL}, grp AS (
  SELECT *, coalesce(sum(CASE WHEN word_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY song, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS group_no FROM lined)"""

SQL = {
    "group_from_selection": _L + """, a AS (SELECT song, 'g1' AS group_id, count(*) AS n, CAST(max(tl) AS BIGINT) AS last FROM l WHERE hit GROUP BY song), b AS (SELECT song, 'g2' AS group_id, count(*) AS n, CAST(max(line_no) - min(line_no) AS BIGINT) AS last FROM l WHERE line_no IN (2, 3) GROUP BY song)
      SELECT * FROM a UNION ALL SELECT * FROM b""",
    "template_times": _L + " SELECT song, 'g1' AS group_id, CAST(tl AS INT) AS template_line, rb AS rel_begin, re AS rel_end FROM t",
    "unlink_lines": _L + " SELECT song, count(*) FILTER (hit AND line_no <> 1) AS linked FROM l GROUP BY song",
    "linked_edits": _L + """, e AS (SELECT song, tl, line_no FROM l WHERE line_no IN (0, 5)) SELECT l.song, l.line_no, CASE WHEN l.line_no IN (0, 5) THEN 'new ' || l.line_no
      WHEN hit AND NOT detached AND e.line_no IS NOT NULL THEN 'new ' || e.line_no ELSE text END AS text FROM l LEFT JOIN e ON hit AND e.song = l.song AND e.tl = l.tl""",
    "conform_lines": _L + """ SELECT l.song, line_no, CASE WHEN hit AND inst = 1 AND rb IS NOT NULL THEN 1705000000000 + rb ELSE begin_ms END AS begin_ms, CASE WHEN hit AND inst = 1 AND rb IS NOT NULL THEN 1705000000000 + re ELSE end_ms END AS end_ms FROM l LEFT JOIN t ON t.song = l.song AND t.tl = l.tl""",
    "expanded_selection": _S + " SELECT word_id FROM (SELECT word_id, bool_or(kind = 'view') OVER (PARTITION BY song, line_no, group_no) AS s FROM grp) q WHERE s",
    "merge_syllables": _S + " SELECT song, line_no, group_no, string_agg(kind || CASE WHEN word_id % 3 = 0 THEN ' ' ELSE '' END, '' ORDER BY word_no) AS text, arg_min(begin_ms, word_no) AS begin_ms, arg_max(end_ms, word_no) AS end_ms FROM grp GROUP BY song, line_no, group_no",
    "delete_words": f"WITH {LINED_SQL} SELECT word_id, row_number() OVER (PARTITION BY song, line_no ORDER BY word_no) - 1 AS word_no FROM lined WHERE kind <> 'error'",
    "move_to_background": f"WITH {LINED_SQL} SELECT word_id, CASE kind WHEN 'error' THEN 'bg' ELSE 'main' END AS track, row_number() OVER (PARTITION BY song, line_no, kind = 'error' ORDER BY begin_ms, word_id) - 1 AS word_no FROM lined",
    "explicit_scan": r"""WITH k AS (SELECT DISTINCT regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS k FROM (SELECT unnest(string_split(text, ' ')) AS text FROM benchmark) b), w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\s+')) AS t, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) - 1 AS i FROM conversations WHERE text IS NOT NULL)
      SELECT conv_id, turn, count(*) AS hits, min(i) AS first FROM w WHERE regexp_replace(lower(t), '[^\p{L}\p{N}]+', '', 'g') IN (SELECT k FROM k WHERE k <> '') GROUP BY conv_id, turn""",
}

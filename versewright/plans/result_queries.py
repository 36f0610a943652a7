"""Registered queries: corrections by the source, results and questions, selections and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corrections, results, selection, shapes
from ..schema import SONG_SQL, song_words, table
from ..streaming import progress


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Songs' main lines as placed, their source's times beside them: off by the line, a third of the lines unsure."""
    w = song_words(spark, sf).where("track = 'main'")
    unsure = F.when(F.col("line_no") % 3 == 0, F.col("confidence") / 10).otherwise(F.col("confidence"))
    word = F.struct("text", F.col("begin_ms").cast("double").alias("begin_ms"), F.col("end_ms").cast("double").alias("end_ms"), unsure.alias("confidence"), F.array().cast("array<string>").alias("flags"))
    l = w.groupBy("song", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", word.alias("w")))), lambda x: x["w"]).alias("words"), F.min("begin_ms").alias("_b"), F.max("end_ms").alias("_e"))
    off = F.col("line_no") * 7 % 5 * 600
    return l.select("song", "line_no", "words", (F.col("_b") - off).alias("begin_ms"), (F.col("_e") - off - F.col("line_no") % 4 * 500).alias("end_ms"), (F.col("line_no") % 2 * 300).alias("local_ms"), F.lit(100).alias("song_ms"), F.lit(240_000).alias("duration_ms"))


def corrected_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = corrections.corrected_lines(_placed(spark, sf))
    return out.select("song", "line_no", "from_source", F.posexplode("words").alias("word_no", "w")).select("song", "line_no", "word_no", "from_source", F.round("w.begin_ms").cast("bigint").alias("begin_ms"), F.round("w.end_ms").cast("bigint").alias("end_ms"), F.array_join("w.flags", ",").alias("flags"))


def results_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Songs' scores stored as JSON with their mean and read again."""
    w = song_words(spark, sf)
    scores = w.groupBy("song").agg(F.round(F.avg("confidence"), 6).alias("aae"), F.round(F.avg((F.col("confidence") < 0.2).cast("int")), 6).alias("within"))
    path = progress.passing_folder(spark, "results")
    results.save_results(results.with_mean(scores, ("aae", "within")), path)
    return spark.read.schema("song string, aae double, within double").json(path).select("song", F.round("aae", 3).alias("aae"), F.round("within", 3).alias("within"))


def publish_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as jobs: three of four have been checked, reports keep what they had."""
    c = table(spark, sf, "customer")
    jobs = c.select(F.col("c_custkey").alias("job"), F.lit("done").alias("status"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit('{"audio":"'), "c_name", F.lit('","sync":"old"}'))).alias("report"), F.when(F.col("c_custkey") % 2 == 0, "word").otherwise("line").alias("sync"))
    checks = c.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 7).cast("bigint").alias("flagged_words"), (F.col("c_custkey") % 90).cast("bigint").alias("total_words"))
    files = c.select(F.col("c_custkey").alias("job"), F.explode(F.array(F.lit("ttml"), F.lit("lrc"))).alias("format")).withColumn("name", F.concat("job", F.lit("."), "format"))
    reports, done = results.published(jobs, checks, files, F.lit(1_700_000_000))
    field = lambda k: F.get_json_object("report", f"$.{k}")
    return reports.join(done, "job").select("job", field("audio").alias("audio"), field("sync").alias("report_sync"), field("published").alias("published"), F.get_json_object(field("output"), "$.lrc").alias("lrc"), "flagged_words", "total_words")


def review_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as songs: every third turn has two options, every fifth a missing line behind it."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("song"), F.col("turn").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"), "role")
    options = F.array(F.struct("text", F.array(F.lit("chosen")).alias("supporters")), F.struct(F.concat(F.lit("* "), "text").alias("text"), F.array("role", F.lit("other")).alias("supporters")))
    variants = t.where("line_no % 3 = 1").select("song", "line_no", options.alias("options"))
    missing = t.where("line_no % 5 = 0").select("song", (F.col("line_no") - 1).alias("after"), F.concat(F.lit("new "), F.col("line_no").cast("string")).alias("text"), F.array("role").alias("supporters"))
    return results.review_questions(t, variants, missing)


def project_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as projects, saved twice; the second version holds every third and replaces itself."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("project"), F.col("o_orderstatus").alias("state"))
    path = progress.passing_folder(spark, "projects")
    results.save_projects(o, path, 1)
    for state in ("x", "y"):
        results.save_projects(o.where("project % 3 = 0").withColumn("state", F.lit(state)), path, 2)
    return results.newest_projects(spark, path, o.schema)


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.syllable_groups(song_words(spark, sf)).withColumn("explicit", F.col("word_id") % 3 == 0)


def explicit_toggle(spark: SparkSession, sf: str) -> DataFrame:
    w = _grouped(spark, sf)
    return selection.explicit_toggle(w, w.where("word_id % 6 = 0 and song % 2 = 0 or word_id % 5 = 0 and song % 2 = 1").select("song", "line_no", "track", "word_no")).select("song", "line_no", "track", "word_no", "value")


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of lines as instances of one of two groups."""
    l = song_words(spark, sf).select("song", "line_no").distinct()
    return l.select("song", "line_no", F.concat(F.lit("g"), (F.col("line_no") % 4 >= 2).cast("int").cast("string")).alias("group_id"), F.floor(F.col("line_no") / 4).cast("int").alias("instance"))


def words_in_instance(spark: SparkSession, sf: str) -> DataFrame:
    l = _instances(spark, sf)
    asked = l.where("instance % 2 = 1").select("song", "group_id", "instance")
    return selection.words_in_instance(song_words(spark, sf), l, asked).select("song", "group_id", "instance", "line_no", "track", "word_no", F.col("place").cast("bigint").alias("place"))


def sequence_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of two orders of a customer with the same status and priority one by one, counted."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    blocks = o.withColumn("k", k).withColumn("block", F.floor(F.col("k") / 2))
    keys = selection.sequence_keys(blocks, ("o_custkey", "block"), "k", ("o_orderstatus", "o_orderpriority"))
    return keys.groupBy("key").agg(F.count("*").alias("blocks"), F.min("o_custkey").alias("first")).select("blocks", "first")


def same_words(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's words against themselves, shifted in every fourth line and renamed in every fifth."""
    w = song_words(spark, sf).where("begin_ms is not null")
    word = lambda t, d: F.struct(t.alias("text"), (F.col("begin_ms") + d).cast("double").alias("begin_ms"), (F.col("end_ms") + d).cast("double").alias("end_ms"))
    other = word(F.when(F.col("line_no") % 5 == 0, F.upper("text")).otherwise(F.col("text")), F.when(F.col("line_no") % 4 == 0, 1).otherwise(0))
    lists = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("word_id", c.alias("w")))), lambda x: x["w"])
    l = w.groupBy("song", "line_no").agg(lists(word(F.col("text"), F.lit(0))).alias("a"), lists(other).alias("b"))
    return l.select("song", "line_no", selection.same_word_lists(F.col("a"), F.col("b")).alias("same"))


def cross_line_moves(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).where("begin_ms is not null")
    picked = w.where("word_id % 4 = 0").select("song", "line_no", "track", "word_no", (F.col("line_no") + 1).alias("to_line"), F.when(F.col("track") == "bg", "main").otherwise("bg").alias("to_track"))
    return selection.cross_line_moves(w, picked, F.lit(-20_000), F.lit(200_000))


def manual_background(spark: SparkSession, sf: str) -> DataFrame:
    return selection.manual_background(song_words(spark, sf).where("track = 'bg'"))


QUERIES = [corrected_lines, results_mean, publish_jobs, review_questions, project_versions, explicit_toggle, words_in_instance, sequence_equality, same_words, cross_line_moves, manual_background]

_GROUPED = f"""WITH {SONG_SQL}, g AS (SELECT *, coalesce(sum((text LIKE '% ')::INT) OVER (PARTITION BY song, line_no, track ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS group_no FROM sw)"""
SQL = {
    "results_mean": f"""WITH {SONG_SQL}, s AS (SELECT song::VARCHAR AS song, round(avg(confidence), 6) AS aae, round(avg((confidence < 0.2)::INT), 6) AS within FROM sw GROUP BY song)
      SELECT song, round(aae, 3) AS aae, round(within, 3) AS within FROM s UNION ALL SELECT '_mean', round(avg(aae), 3), round(avg(within), 3) FROM s""",
    "publish_jobs": """SELECT c_custkey AS job, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS audio, CASE WHEN c_custkey % 4 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'word' ELSE 'line' END WHEN c_custkey % 3 > 0 THEN 'old' END AS report_sync,
      CASE WHEN c_custkey % 4 > 0 THEN '1700000000' END AS published, CASE WHEN c_custkey % 4 > 0 THEN c_custkey || '.lrc' END AS lrc, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 7 END AS flagged_words, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 90 END AS total_words FROM customer""",
    "review_questions": """WITH t AS (SELECT conv_id AS song, turn AS line_no, coalesce(text, '') AS text, role FROM conversations
      ), l AS (SELECT song, 'Lines' || chr(10) || string_agg(line_no || ': ' || text, chr(10) ORDER BY line_no) AS a FROM t GROUP BY song
      ), v AS (SELECT song, 'Variants' || chr(10) || string_agg('V' || k || ' at line ' || line_no || chr(10) || '  0: ' || text || ' [chosen]' || chr(10) || '  1: * ' || text || ' [' || role || ', other]', chr(10) ORDER BY line_no) AS b FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY line_no) AS k FROM t WHERE line_no % 3 = 1) q GROUP BY song
      ), i AS (SELECT song, 'Missing lines' || chr(10) || string_agg('I' || k || CASE WHEN line_no = 0 THEN ' before the first line' ELSE ' behind line ' || (line_no - 1) END || ': new ' || line_no || ' [' || role || ']', chr(10) ORDER BY line_no) AS c FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY line_no) AS k FROM t WHERE line_no % 5 = 0) q GROUP BY song)
      SELECT l.song, concat_ws(chr(10) || chr(10), a, b, c) AS question FROM l LEFT JOIN v ON v.song = l.song LEFT JOIN i ON i.song = l.song""",
    "project_versions": "SELECT o_orderkey AS project, CASE WHEN o_orderkey % 3 = 0 THEN 'y' ELSE o_orderstatus END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM orders",
    "explicit_toggle": f"""{_GROUPED}, s AS (SELECT *, bool_or(word_id % 6 = 0 AND song % 2 = 0 OR word_id % 5 = 0 AND song % 2 = 1) OVER (PARTITION BY song, line_no, track, group_no) AS hit FROM g)
      SELECT song, line_no, track, word_no, bool_or(word_id % 3 <> 0) OVER (PARTITION BY song) AS value FROM s WHERE hit""",
    "words_in_instance": f"""WITH {SONG_SQL} SELECT song, 'g' || (line_no % 4 >= 2)::INT AS group_id, line_no // 4 AS instance, line_no, track, word_no, row_number() OVER (PARTITION BY song, line_no // 4, line_no % 4 >= 2 ORDER BY line_no, track <> 'main', word_no) - 1 AS place FROM sw WHERE line_no // 4 % 2 = 1""",
    "sequence_equality": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders), b AS (SELECT o_custkey, k // 2 AS block, string_agg(o_orderstatus || ':' || o_orderpriority, ',' ORDER BY k) AS key FROM o GROUP BY 1, 2)
      SELECT count(*) AS blocks, min(o_custkey) AS first FROM b GROUP BY key""",
    "same_words": f"WITH {SONG_SQL} SELECT song, line_no, NOT (line_no % 4 = 0 OR line_no % 5 = 0) AS same FROM sw WHERE begin_ms IS NOT NULL GROUP BY 1, 2",
    "cross_line_moves": f"""WITH {SONG_SQL} SELECT song, line_no, track, word_no, line_no + 1 AS to_line, CASE track WHEN 'bg' THEN 'main' ELSE 'bg' END AS to_track, greatest(0, begin_ms - 20000) AS new_begin, least(200000, end_ms - 20000) AS new_end
      FROM sw WHERE word_id % 4 = 0 AND begin_ms IS NOT NULL AND least(200000, end_ms - 20000) > greatest(0, begin_ms - 20000)""",
    "manual_background": f"""WITH {SONG_SQL}, m AS (SELECT *, max(word_no) OVER (PARTITION BY song, line_no) AS last FROM sw WHERE track = 'bg')
      SELECT song, line_no, string_agg(text || CASE WHEN word_no < last AND text NOT LIKE '% ' THEN '|' ELSE '' END, '' ORDER BY word_no) AS bg_text, 'manual' AS bg_source FROM m GROUP BY 1, 2""",
}

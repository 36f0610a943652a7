"""Registered queries: streams over ``events``, formats round trips, and relational coverage of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import LINED_SQL, WORDS_SQL, events_as_words, in_lines, table
from ..sources import formats
from ..streaming import progress


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return progress.event_stream(spark, f"{sf}/events.parquet")


def stream_stage_view(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("value") < 300, "running").when(F.col("value") < 450, "done").otherwise("failed")
    e = _stream(spark, sf).select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), status.alias("status"), F.unix_millis("ts").alias("at"), "event_id")
    return progress.run_once(progress.stage_view(e))


def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = progress.run_once(progress.tumbling(_stream(spark, sf), "1 hour", "event_type"))
    return out.select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n", "cents")


def sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = progress.run_once(progress.sliding(_stream(spark, sf), "2 hours", "1 hour"))
    return out.select(F.unix_seconds("window.start").alias("start_s"), "n")


def session(spark: SparkSession, sf: str) -> DataFrame:
    out = progress.run_once(progress.sessions(_stream(spark, sf), "1 hour", "user_id"))
    return out.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def dedup_watermark(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf)
    return progress.run_once(progress.deduplicated(e.select("event_id", "ts").union(e.select("event_id", "ts")), "event_id"), mode="append").select("event_id")


def throttle(spark: SparkSession, sf: str) -> DataFrame:
    out = progress.run_once(progress.throttled(_stream(spark, sf), "6 hours"))
    return out.select("user_id", F.unix_seconds("window.start").alias("start_s"), F.col("last.event_id").alias("event_id"))


def stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that have not moved for two minutes before the newest event of all."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    newest = table(spark, sf, "events").agg(F.max("ts").alias("newest")).withColumn("one", F.lit(1))
    met = last.withColumn("one", F.lit(1)).join(F.broadcast(newest), "one")  # a single row
    return met.where(F.col("last") < F.col("newest") - F.expr("interval 120 seconds")).select("user_id")


def _song_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of kinds with times of 10 ms steps from the song's start."""
    w = in_lines(events_as_words(spark, sf))
    l = w.groupBy("song", "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "kind"))), lambda p: p["kind"]), " ").alias("text"))
    return l.select("song", "line_no", "text", (F.col("line_no") * 4000 + F.col("song") * 10).cast("bigint").alias("begin_ms"), (F.col("line_no") * 4000 + F.col("song") * 10 + 4000).cast("bigint").alias("end_ms"))


def _song_words(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf))
    begin = F.col("line_no") * 4000 + F.col("word_no") * 400
    last = F.max("word_no").over(Window.partitionBy("song", "line_no"))
    return w.withColumn("last", last).select("song", "line_no", F.col("word_no").cast("int").alias("word_no"), F.concat("kind", F.when(F.col("word_no") < F.col("last"), " ").otherwise("")).alias("text"), begin.cast("bigint").alias("begin_ms"), (begin + 300).cast("bigint").alias("end_ms"))


def lrc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    back = formats.read_lrc(formats.write_lrc(_song_lines(spark, sf)))
    return back.select("song", F.col("line_no").cast("bigint").alias("line_no"), "begin_ms", "text")


def srt_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return formats.read_srt(formats.write_srt(_song_lines(spark, sf))).select("song", F.col("line_no").cast("bigint").alias("line_no"), "begin_ms", "end_ms", "text")


def qrc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return formats.read_qrc(formats.write_qrc(_song_words(spark, sf))).select("song", F.col("line_no").cast("bigint").alias("line_no"), F.col("word_no").cast("bigint").alias("word_no"), "begin_ms", "end_ms", "text")


def ttml_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return formats.read_ttml(formats.write_ttml(_song_words(spark, sf))).select("song", F.col("line_no").cast("bigint").alias("line_no"), F.col("word_no").cast("bigint").alias("word_no"), "begin_ms", "end_ms", "text")


def plain_read(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("song"), F.col("text").alias("content"))
    return formats.read_plain(d).groupBy("song").agg(F.count("*").alias("lines"), F.max("line_no").cast("bigint").alias("last"))


def cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), [F.col("c_nationkey"), F.col("c_mktsegment")]
    return c.groupingSets([[k[0]], [k[1]], []], *k).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def intersect(spark: SparkSession, sf: str) -> DataFrame:
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).intersect(s.select("s_nationkey"))


def except_all(spark: SparkSession, sf: str) -> DataFrame:
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).exceptAll(s.select("s_nationkey")).groupBy("nation").agg(F.count("*").alias("n"))


def left_semi(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(li.where("l_returnflag = 'R'"), o.o_orderkey == li.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def left_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent order."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority like '1%'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def full_outer(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return d.join(l, d.doc_id == l.id, "full_outer").select(F.coalesce("doc_id", "id").alias("doc_id"), "lang", "quality")


def broadcast_join(spark: SparkSession, sf: str) -> DataFrame:
    """Nations and regions are fixed tables of 25 and 5 rows."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count("*").alias("n"))


def range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders placed within two days before another event of the same customer's key, by day buckets."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("a"), F.to_date("o_orderdate").alias("d"))
    left = o.withColumn("b", F.explode(F.array(F.datediff("d", F.lit("1990-01-01")), F.datediff("d", F.lit("1990-01-01")) + 1, F.datediff("d", F.lit("1990-01-01")) + 2)))
    right = o.select("k", F.col("a").alias("other"), F.datediff("d", F.lit("1990-01-01")).alias("b"))
    return left.join(right, ["k", "b"]).where("a <> other").select("a", "other")


def ntile_rank(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.ntile(4).over(w).cast("bigint").alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"))


def approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 2).cast("double").alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


QUERIES = [
    stream_stage_view, tumbling, sliding, session, dedup_watermark, throttle, stale_jobs, lrc_round_trip, srt_round_trip, qrc_round_trip, ttml_round_trip, plain_read,
    cube, rollup, grouping_sets, intersect, except_all, left_semi, left_anti, full_outer, broadcast_join, range_join, ntile_rank, approx_distinct, pricing_summary,
]

_LINES = f"""WITH {LINED_SQL}, l AS (SELECT song, line_no, string_agg(kind, ' ' ORDER BY word_no) AS text, line_no * 4000 + song * 10 AS begin_ms FROM lined GROUP BY song, line_no)"""
_WORDS = f"""WITH {LINED_SQL} SELECT song, line_no, word_no, line_no * 4000 + word_no * 400 AS begin_ms, line_no * 4000 + word_no * 400 + 300 AS end_ms, kind || CASE WHEN word_no < max(word_no) OVER (PARTITION BY song, line_no) THEN ' ' ELSE '' END AS text FROM lined"""

SQL = {
    "stream_stage_view": """WITH j AS (SELECT user_id AS job, event_type AS stage, CASE WHEN value < 300 THEN 'running' WHEN value < 450 THEN 'done' ELSE 'failed' END AS status, epoch_us(ts) // 1000 AS at_ms, event_id FROM events
      ), r AS (SELECT *, row_number() OVER (PARTITION BY job, stage ORDER BY at_ms DESC, event_id DESC) AS k FROM j) SELECT job, stage, any_value(status) FILTER (k = 1) AS last_status, min(at_ms) AS started, count(*) AS events FROM r GROUP BY job, stage""",
    "tumbling": "SELECT epoch_us(ts) // 3600000000 * 3600 AS start_s, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "sliding": "SELECT h * 3600 AS start_s, count(*) AS n FROM (SELECT unnest([epoch_us(ts) // 3600000000, epoch_us(ts) // 3600000000 - 1]) AS h FROM events) q GROUP BY 1",
    "session": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS s FROM events
      ), i AS (SELECT user_id, t, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS i FROM g) SELECT user_id, min(t) AS start_us, count(*) AS n FROM i GROUP BY user_id, i""",
    "dedup_watermark": "SELECT event_id FROM events",
    "throttle": "SELECT user_id, epoch_us(ts) // 21600000000 * 21600 AS start_s, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "stale_jobs": "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id FROM l WHERE last < (SELECT max(last) FROM l) - INTERVAL 120 SECOND",
    "lrc_round_trip": _LINES + " SELECT song, line_no, begin_ms, text FROM l",
    "srt_round_trip": _LINES + " SELECT song, line_no, begin_ms, begin_ms + 4000 AS end_ms, text FROM l",
    "qrc_round_trip": _WORDS,
    "ttml_round_trip": _WORDS,
    "plain_read": r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))), ' ') AS line FROM documents WHERE text IS NOT NULL)
      SELECT doc_id AS song, count(*) AS lines, count(*) - 1 AS last FROM l WHERE line <> '' AND NOT regexp_matches(line, '^\s*\[[^\]]*\]\s*$') GROUP BY doc_id""",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)",
    "grouping_sets": "SELECT c_nationkey, c_mktsegment, count(*) AS n, grouping(c_nationkey) * 2 + grouping(c_mktsegment) AS level FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())",
    "intersect": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except_all": "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) q GROUP BY nation",
    "left_semi": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "left_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')",
    "full_outer": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "broadcast_join": "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "range_join": "SELECT x.o_orderkey AS a, y.o_orderkey AS other FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey AND CAST(y.o_orderdate AS DATE) - CAST(x.o_orderdate AS DATE) BETWEEN 0 AND 2",
    "ntile_rank": "SELECT p_partkey, ntile(4) OVER w AS quartile, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
}

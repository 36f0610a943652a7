"""Registered queries: nested lines, predicates and greedy folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import folds, lines
from ..schema import LINED_SQL, WORDS_SQL, events_as_words, in_lines, table


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with main words (all kinds but error) and background words (errors); every word but the last has its space."""
    w = in_lines(events_as_words(spark, sf))
    word = F.struct("word_no", F.concat("kind", F.lit(" ")).alias("text"), "begin_ms", F.when(F.col("value") >= 5, F.col("end_ms")).alias("end_ms"))
    of = lambda c: F.sort_array(F.collect_list(F.when(c, word)))
    return w.groupBy("song", "line_no").agg(of(F.col("kind") != "error").alias("words"), of(F.col("kind") == "error").alias("background"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"))


def line_display(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf).select("song", "line_no", lines.display(F.col("words"), F.col("background")).alias("shown"))


def word_timed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf).groupBy("song").agg(F.count_if(lines.all_timed(F.col("words"))).alias("timed"), F.count("*").alias("n"))


def song_sync(spark: SparkSession, sf: str) -> DataFrame:
    return lines.sync_type(_nested(spark, sf))


def line_synced(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_synced(in_lines(events_as_words(spark, sf)))


def content_spans(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf)).withColumn("text", F.concat("kind", F.lit(" ")))
    return lines.content_spans(w).select("word_id", "from_char", "to_char")


def effective_words(spark: SparkSession, sf: str) -> DataFrame:
    n = _nested(spark, sf)
    e = lines.effective_words(F.col("words"), F.lit("(all)"), F.col("begin_ms"), F.col("end_ms"))
    return n.select("song", "line_no", F.explode(e).alias("w")).select("song", "line_no", "w.text", "w.begin_ms")


def describe_flags(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf)
    flags = F.array_compact(F.array(F.when(F.col("value") < 50, "low-confidence"), F.when(F.col("value") > 400, "too-long"), F.when(F.col("kind") == "error", "odd")))
    return w.select("word_id", lines.describe_flags(flags).alias("shown"), lines.needs_review(flags).alias("review"))


def boundary_flush(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf)).withColumn("end_ms", F.col("end_ms") + 3_600_000)
    return lines.boundary_flush(w).select("word_id", "flush_before", "flush_after")


def contiguous_selection(spark: SparkSession, sf: str) -> DataFrame:
    return lines.contiguous(table(spark, sf, "lineitem").where("l_quantity > 10"), "l_orderkey", "l_linenumber")


def valid_times(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.col("value") - 100).alias("t"))
    t = t.select("user_id", lines.valid_times(F.col("t")).alias("t"))
    return t.select("user_id", F.size("t").cast("bigint").alias("n"), F.round(F.get("t", F.lit(0)), 6).alias("first"))  # a song may have none


def distribute_characters(spark: SparkSession, sf: str) -> DataFrame:
    t = in_lines(events_as_words(spark, sf)).groupBy("song", "line_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "kind"))), lambda p: p["kind"]).alias("w"))
    d = lines.distribute_by_characters(F.col("w"), F.lit(1000), F.lit(9000))
    return t.select("song", "line_no", F.posexplode(d).alias("word_no", "x")).select("song", "line_no", F.col("word_no").cast("bigint").alias("word_no"), "x.begin_ms", "x.end_ms")


def even_shares(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 + 1).cast("int").alias("n"))
    return o.select("o_orderkey", F.posexplode(lines.even_shares(F.col("n"), F.lit(0), F.lit(10_000))).alias("i", "x")).select("o_orderkey", F.col("i").cast("bigint").alias("i"), "x.begin_ms", "x.end_ms")


def distance_to_gap(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.round(F.col("value") * 1000).cast("bigint")
    return table(spark, sf, "events").select("event_id", lines.distance_to_gap(ms, F.lit(100_000), F.lit(200_000)).cast("bigint").alias("far"))


def metadata_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return lines.metadata_pairs(table(spark, sf, "part"), "p_partkey", ("p_name", "p_brand", "p_type"))


def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    incoming = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.lit(""))
    return p.select("p_partkey", lines.metadata_merge(F.col("p_name"), F.col("p_size") % 2 == 0, incoming, F.lit("none")).alias("name"))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").where("text is not null")
    at = F.instr("text", "the") - 1
    return t.where(at >= 0).select("conv_id", "turn", lines.snippet(F.col("text"), at, at + 3, 8).alias("snippet"))


def cycle_match(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").where("role = 'user'")
    return lines.cycle_next(t, "conv_id", "turn").select("conv_id", "turn", "next")


def group_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return folds.group_pieces(events_as_words(spark, sf), gap=7_200_000, longest=36_000_000)


def heard_lines(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf).withColumn("text", F.concat("kind", F.when(F.col("word_id") % 9 == 0, F.lit(". ")).otherwise(F.lit(" "))))
    return folds.heard_lines(w, pause=36_000_000, most=3).select("song", F.col("line_no").cast("bigint").alias("line_no"), "word_id")


def training_windows(spark: SparkSession, sf: str) -> DataFrame:
    return folds.windows_of(events_as_words(spark, sf), longest=28_800_000).groupBy("song").agg(F.count("*").alias("windows"), F.max("n").alias("most"))


def quietest_cut(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf), 1)
    hops = w.select("song", F.col("line_no").alias("hop"), F.col("value").alias("rms"))
    pieces = w.where("line_no % 20 = 0").select("song", F.col("line_no").alias("first_hop"))
    return folds.split_at_quietest(hops, pieces)


def loudest_window(spark: SparkSession, sf: str) -> DataFrame:
    """Begin of the five consecutive values of each song with the largest sum."""
    w = in_lines(events_as_words(spark, sf), 1)
    total = F.sum(F.round(F.col("value") * 100).cast("bigint")).over(Window.partitionBy("song").orderBy("line_no").rowsBetween(0, 4))
    s = w.withColumn("total", total)
    return s.groupBy("song").agg(F.max_by(F.struct("line_no", "total"), F.struct("total", (-F.col("line_no")).alias("k"))).alias("b")).select("song", F.col("b.line_no").cast("bigint").alias("start"), "b.total")


def held_out_split(spark: SparkSession, sf: str) -> DataFrame:
    """A fold of each customer that depends on its key only: the first two hex digits of a digest."""
    fold = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 2), 16, 10).cast("bigint") % 20
    return table(spark, sf, "customer").select("c_custkey", fold.alias("fold"), (fold == 0).alias("held_out"))


def alternating_split(spark: SparkSession, sf: str) -> DataFrame:
    """Songs in order, every other one in the second half.

    Songs are numbered inside ranges of ids, and each range goes on where the
    one before it ended, so no task numbers all of them.
    """
    s = table(spark, sf, "events").select("user_id").distinct().withColumn("part", F.floor(F.col("user_id") / 100))
    before = s.groupBy("part").agg(F.count("*").alias("n"))
    before = before.withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # one row per range
    n = F.row_number().over(Window.partitionBy("part").orderBy("user_id")) - 1
    return s.withColumn("k", n).join(before, "part").select("user_id", ((F.col("k") + F.col("start")) % 2).cast("bigint").alias("half"))


def job_list(spark: SparkSession, sf: str) -> DataFrame:
    """All jobs, the one that started last first, with their number of events."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("created"), F.count("*").alias("events"))
    return e.withColumn("place", F.rank().over(Window.partitionBy(F.to_date("created")).orderBy(F.desc("created"), "user_id"))).orderBy(F.desc("created"), "user_id").select("user_id", "events", F.to_date("created").cast("string").alias("day"), F.col("place").cast("bigint").alias("place"))


QUERIES = [
    line_display, word_timed_lines, song_sync, line_synced, content_spans, effective_words, describe_flags, boundary_flush, contiguous_selection, valid_times, distribute_characters,
    even_shares, distance_to_gap, metadata_pairs, metadata_merge, snippets, cycle_match, group_pieces, heard_lines, training_windows, quietest_cut, loudest_window, held_out_split,
    alternating_split, job_list,
]

_GREEDY = """, r AS (
    SELECT song, n, begin_ms AS b, end_ms AS e, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS grp FROM o WHERE n = 1
    UNION ALL SELECT o.song, o.n,
      CASE WHEN o.begin_ms - r.e <= {gap} AND o.end_ms - r.b <= {longest} THEN r.b ELSE o.begin_ms END,
      CASE WHEN o.begin_ms - r.e <= {gap} AND o.end_ms - r.b <= {longest} THEN greatest(o.end_ms, r.e) ELSE o.end_ms END,
      CASE WHEN o.begin_ms - r.e <= {gap} AND o.end_ms - r.b <= {longest} THEN r.k + 1 ELSE 1 END,
      CASE WHEN o.begin_ms - r.e <= {gap} AND o.end_ms - r.b <= {longest} THEN r.grp ELSE r.grp + 1 END
    FROM r JOIN o ON o.song = r.song AND o.n = r.n + 1
  ), g AS (SELECT song, grp, min(b) AS begin_ms, max(e) AS end_ms, max(k) AS n FROM r GROUP BY song, grp)"""
_ORDERED = f"WITH RECURSIVE {WORDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY begin_ms, end_ms) AS n FROM words)"

SQL = {
    "line_display": f"""WITH {LINED_SQL}, l AS (SELECT song, line_no, coalesce(string_agg(kind, ' ' ORDER BY word_no) FILTER (kind <> 'error'), '') AS m, string_agg(kind, ' ' ORDER BY word_no) FILTER (kind = 'error') AS b FROM lined GROUP BY song, line_no)
      SELECT song, line_no, CASE WHEN b IS NULL THEN m ELSE trim(m || ' (' || b || ')', ' ') END AS shown FROM l""",
    "word_timed_lines": f"""WITH {LINED_SQL}, l AS (SELECT song, line_no, count(*) FILTER (kind <> 'error') > 0 AND count(*) FILTER (kind <> 'error' AND value < 5) = 0 AS t FROM lined GROUP BY song, line_no) SELECT song, count(*) FILTER (t) AS timed, count(*) AS n FROM l GROUP BY song""",
    "song_sync": f"""WITH {LINED_SQL}, l AS (SELECT song, line_no, count(*) FILTER (kind <> 'error') > 0 AND count(*) FILTER (kind <> 'error' AND value < 5) = 0 AS t FROM lined GROUP BY song, line_no) SELECT song, CASE WHEN bool_and(t) THEN 'word' ELSE 'line' END AS sync FROM l GROUP BY song""",
    "line_synced": f"WITH {LINED_SQL}, s AS (SELECT song, line_no, min(begin_ms) AS begin_ms FROM lined GROUP BY song, line_no) SELECT song, line_no, begin_ms, lead(begin_ms) OVER (PARTITION BY song ORDER BY line_no) AS end_ms FROM s",
    "content_spans": f"WITH {LINED_SQL}, u AS (SELECT word_id, length(kind) + 1 AS n, CAST(sum(length(kind) + 1) OVER (PARTITION BY song, line_no ORDER BY word_no) AS BIGINT) AS to_char FROM lined) SELECT word_id, to_char - n AS from_char, to_char FROM u",
    "effective_words": f"""WITH {LINED_SQL} SELECT song, line_no, kind || ' ' AS text, begin_ms FROM lined WHERE kind <> 'error' UNION ALL SELECT song, line_no, '(all)', min(begin_ms) FROM lined GROUP BY song, line_no HAVING bool_and(kind = 'error')""",
    "describe_flags": f"""WITH {WORDS_SQL} SELECT word_id, concat_ws(' · ', CASE WHEN value < 50 THEN 'low confidence' END, CASE WHEN value > 400 THEN 'very long' END, CASE WHEN kind = 'error' THEN 'odd' END) AS shown, value < 50 AS review FROM words""",
    "boundary_flush": f"""WITH {LINED_SQL} SELECT word_id, coalesce(lag(end_ms) OVER w + 3600000 >= begin_ms, false) AS flush_before, coalesce(lead(begin_ms) OVER w <= end_ms + 3600000, false) AS flush_after FROM lined WINDOW w AS (PARTITION BY song, line_no ORDER BY word_no)""",
    "contiguous_selection": "SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AS contiguous FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey",
    "valid_times": "SELECT user_id, count(*) FILTER (value - 100 >= 0) AS n, round(min(CASE WHEN value - 100 >= 0 THEN value - 100 END), 6) AS first FROM events GROUP BY user_id",
    "distribute_characters": f"""WITH {LINED_SQL}, u AS (SELECT song, line_no, word_no, length(kind) AS n, sum(length(kind)) OVER (PARTITION BY song, line_no ORDER BY word_no) AS upto, sum(length(kind)) OVER (PARTITION BY song, line_no) AS total FROM lined)
      SELECT song, line_no, word_no::BIGINT AS word_no, CAST(1000 + floor(CAST(8000 * (upto - n) AS DOUBLE) / total) AS BIGINT) AS begin_ms, CAST(1000 + floor(CAST(8000 * upto AS DOUBLE) / total) AS BIGINT) AS end_ms FROM u""",
    "even_shares": """WITH o AS (SELECT o_orderkey, o_orderkey % 5 + 1 AS n, unnest(range(o_orderkey % 5 + 1)) AS i FROM orders) SELECT o_orderkey, i, 10000 * i // n AS begin_ms, 10000 * (i + 1) // n AS end_ms FROM o""",
    "distance_to_gap": "SELECT event_id, greatest(0, 100000 - CAST(round(value * 1000) AS BIGINT), CAST(round(value * 1000) AS BIGINT) - 200000) AS far FROM events",
    "metadata_pairs": "SELECT p_partkey, 'p_name' AS key, p_name AS value FROM part WHERE p_name <> '' UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part WHERE p_brand <> '' UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE p_type <> ''",
    "metadata_merge": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_type <> '' THEN p_type WHEN p_size % 2 = 0 THEN 'none' ELSE p_name END AS name FROM part",
    "snippets": """WITH t AS (SELECT conv_id, turn, text, instr(text, 'the') - 1 AS a FROM conversations WHERE instr(text, 'the') > 0)
      SELECT conv_id, turn, CASE WHEN a > 8 THEN '…' ELSE '' END || substr(text, greatest(0, a - 8) + 1, least(length(text), a + 11) - greatest(0, a - 8)) || CASE WHEN a + 11 < length(text) THEN '…' ELSE '' END AS snippet FROM t""",
    "cycle_match": "SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), min(turn) OVER (PARTITION BY conv_id)) AS next FROM conversations WHERE role = 'user'",
    "group_pieces": _ORDERED + _GREEDY.format(gap=7_200_000, longest=36_000_000) + " SELECT song, begin_ms, end_ms, n FROM g",
    "training_windows": _ORDERED + _GREEDY.format(gap=28_800_000, longest=28_800_000) + " SELECT song, count(*) AS windows, max(n) AS most FROM g GROUP BY song",
    "heard_lines": f"""WITH RECURSIVE {WORDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY begin_ms, word_id) AS n FROM words
      ), r AS (SELECT song, n, word_id, end_ms AS e, word_id % 9 = 0 AS stop, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS line_no FROM o WHERE n = 1
        UNION ALL SELECT o.song, o.n, o.word_id, o.end_ms, o.word_id % 9 = 0, CASE WHEN r.k >= 3 OR r.stop OR o.begin_ms - r.e >= 36000000 THEN 1 ELSE r.k + 1 END, CASE WHEN r.k >= 3 OR r.stop OR o.begin_ms - r.e >= 36000000 THEN r.line_no + 1 ELSE r.line_no END
        FROM r JOIN o ON o.song = r.song AND o.n = r.n + 1) SELECT song, line_no, word_id FROM r""",
    "quietest_cut": f"""WITH {WORDS_SQL}, h AS (SELECT song, row_number() OVER (PARTITION BY song ORDER BY begin_ms, word_id) - 1 AS hop, value FROM words
      ), m AS (SELECT a.song, a.hop AS first_hop, b.hop, row_number() OVER (PARTITION BY a.song, a.hop ORDER BY b.value, b.hop) AS k FROM h a JOIN h b ON a.song = b.song AND a.hop % 20 = 0 AND b.hop BETWEEN a.hop + 5 AND a.hop + 20) SELECT song, first_hop, hop AS cut FROM m WHERE k = 1""",
    "loudest_window": f"""WITH {WORDS_SQL}, h AS (SELECT song, row_number() OVER (PARTITION BY song ORDER BY begin_ms, word_id) - 1 AS start, value, begin_ms, word_id FROM words
      ), s AS (SELECT song, start, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY song ORDER BY start ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS BIGINT) AS total FROM h
      ), k AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY total DESC, start) AS k FROM s) SELECT song, start, total FROM k WHERE k = 1""",
    "held_out_split": "SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 2))::BIGINT % 20 AS fold, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 2))::BIGINT % 20 = 0 AS held_out FROM customer",
    "alternating_split": "SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) % 2 AS half FROM (SELECT DISTINCT user_id FROM events) q",
    "job_list": "SELECT user_id, n AS events, c::DATE::VARCHAR AS day, rank() OVER (PARTITION BY c::DATE ORDER BY c DESC, user_id) AS place FROM (SELECT user_id, count(*) AS n, min(ts) AS c FROM events GROUP BY user_id) q",
}

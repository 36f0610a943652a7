"""Registered queries: kernels, repeats and edits on ``events``, ``embeddings`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, edits, timing
from ..schema import LINED_SQL, WORDS_SQL, events_as_words, in_lines, table


def viterbi_align(spark: SparkSession, sf: str) -> DataFrame:
    """A label's vectors in a run of ids as frames of one song, with a word of two tokens for every five frames."""
    v = table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    total = F.ln(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") * 4)))
    frames = v.select((F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 8000)).cast("bigint").alias("song"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double") * 4 - total).alias("logp"))
    words = frames.groupBy("song").agg(F.count("*").alias("n")).select("song", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 5).cast("int"))).alias("word_no"))
    words = words.withColumn("tokens", F.array(1 + (F.col("word_no") * 3 + F.col("song") % 1009) % 63, 1 + (F.col("word_no") * 5 + 2) % 63))
    return align.align_songs(frames, words, 35)


def borrow_rhythm(spark: SparkSession, sf: str) -> DataFrame:
    """Each song's words in lines of three, of three texts; a third of the lines is sure."""
    w = in_lines(events_as_words(spark, sf), 3)
    text = F.element_at(F.array(F.lit("Hey"), F.lit("now, "), F.lit("go! ")), (F.col("word_no") + F.col("line_no") % 3).cast("int") % 3 + 1)
    begin = F.col("line_no") * 5000 + F.col("word_no") * 400 + F.floor(F.col("value")) % 130
    sure = F.when(F.col("line_no") % 4 < 2, 0.98).otherwise(F.col("value") / 500)
    w = w.select("song", "line_no", "word_no", text.alias("text"), begin.cast("bigint").alias("begin_ms"), (begin + 300).cast("bigint").alias("end_ms"), sure.alias("confidence"))
    return align.borrow_rhythm(w).select("song", "line_no", F.col("word_no").cast("bigint").alias("word_no"), "begin_ms", "end_ms", "borrowed")


def repeating_sections(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf), 1).select("song", "line_no", "kind")
    return align.repeating_sections(w, "kind").groupBy("song").agg(F.count_distinct("section").alias("sections"), F.count("*").alias("lines"))


def _line_arrays(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf))
    return w.groupBy("song", "line_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "kind", "begin_ms", "end_ms"))), lambda p: F.struct(p["kind"].alias("text"), p["begin_ms"].alias("begin_ms"), p["end_ms"].alias("end_ms"))).alias("words"))


def remap_text(spark: SparkSession, sf: str) -> DataFrame:
    l = _line_arrays(spark, sf)
    text = F.concat_ws(" ", F.transform(F.slice("words", 1, 4), lambda w: w["text"]), F.lit("added word"))
    out = edits.remap_text(l.withColumn("new_text", text))
    return out.select("song", "line_no", F.size("remapped").cast("bigint").alias("n"), F.element_at("remapped", -1)["end_ms"].alias("last_end"))


def tidy_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = timing.tidy_fold(_line_arrays(spark, sf))
    return out.select("song", "line_no", F.posexplode("tidied").alias("word_no", "w")).select("song", "line_no", "word_no", "w.begin_ms", "w.end_ms")


def resolve_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    out = timing.resolve_overlaps(_line_arrays(spark, sf))
    return out.select("song", "line_no", F.posexplode("resolved").alias("word_no", "w")).select("song", "line_no", "word_no", "w.begin_ms", "w.end_ms")


def split_word(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf)).withColumn("text", F.col("kind"))
    out = edits.split_word(w, F.when(F.col("word_id") % 2 == 0, F.lit(2)).otherwise(F.lit(0)))
    return out.select("song", "line_no", F.col("word_no").cast("bigint").alias("word_no"), "text", "begin_ms", "end_ms")


def stretch(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf)
    return edits.stretch(w, F.col("kind") == "view", F.lit(1_704_000_000_000), F.lit(2)).select("word_id", "begin_ms", "end_ms")


def set_boundary(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf)).withColumn("new_begin", F.when(F.col("word_id") % 5 == 0, F.col("begin_ms") - 90_000))
    return edits.set_boundary(w).select("word_id", "begin_ms", "end_ms")


def apply_template(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf))
    first = w.where("line_no = 0")
    lo = first.groupBy("song").agg(F.min("begin_ms").alias("lo"))
    template = first.join(lo, "song").select(F.col("song").alias("grp"), F.col("word_no").alias("template_line"), (F.col("begin_ms") - F.col("lo")).alias("rel_begin"), (F.col("end_ms") - F.col("lo")).alias("rel_end"))
    starts = w.where("word_no = 0 and line_no > 0").select(F.col("song").alias("grp"), F.col("line_no").alias("instance"), F.col("begin_ms").alias("start_ms"))
    return edits.apply_template(starts, template)


def merge_tracks(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf)).select("song", "line_no", "word_id", "kind", "begin_ms")
    return edits.merge_tracks(w.where("kind = 'click'"), w.where("kind = 'view'")).select("word_id", F.col("word_no").cast("bigint").alias("word_no"), "track")


def background_place(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf))
    g = w.groupBy("song", "line_no").agg(*[f(F.when(c, F.col(x))).alias(n) for n, f, x, c in (("mb", F.min, "begin_ms", F.col("kind") != "error"), ("me", F.max, "end_ms", F.col("kind") != "error"), ("bb", F.min, "begin_ms", F.col("kind") == "error"), ("be", F.max, "end_ms", F.col("kind") == "error"))])
    return g.where("mb is not null and bb is not null").select("song", "line_no", edits.background_place(F.col("mb"), F.col("me"), F.col("bb"), F.col("be")).alias("place"))


def history_cap(spark: SparkSession, sf: str) -> DataFrame:
    return edits.history(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 3).select("o_custkey", "o_orderkey")


QUERIES = [viterbi_align, borrow_rhythm, repeating_sections, remap_text, tidy_fold, resolve_overlaps, split_word, stretch, set_boundary, apply_template, merge_tracks, background_place, history_cap]

SQL = {
    "borrow_rhythm": f"""WITH {WORDS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY begin_ms, word_id) - 1 AS pos FROM words
      ), w AS (SELECT song, pos // 3 AS line_no, pos % 3 AS word_no, ['Hey', 'now, ', 'go! '][(pos % 3 + pos // 3 % 3) % 3 + 1] AS text, pos // 3 * 5000 + pos % 3 * 400 + CAST(floor(value) AS BIGINT) % 130 AS b, CASE WHEN pos // 3 % 4 < 2 THEN 0.98 ELSE value / 500 END AS c FROM p
      ), l AS (SELECT song, line_no, count(*) AS n, string_agg(regexp_replace(lower(text), '[^a-z]', '', 'g'), ' ' ORDER BY word_no) AS key, avg(c) >= 0.97 AS sure, count(*) FILTER (c < 0.92) >= 0.3 * count(*) AS doubtful, min(b) FILTER (word_no = 0) AS first, arg_min(word_no, (-c, word_no)) AS a FROM w GROUP BY song, line_no HAVING count(*) >= 3
      ), m AS (SELECT song, key, word_no, median(b - first) AS pb, median(b + 300 - first) AS pe, greatest(median(b - first) - min(b - first), max(b - first) - median(b - first)) AS apart FROM w JOIN l USING (song, line_no) WHERE sure GROUP BY song, key, word_no
      ), g AS (SELECT song, key FROM m GROUP BY song, key HAVING max(apart) <= 200
      ), s AS (SELECT l.song, l.line_no, key, w.b - m.pb AS start FROM l JOIN g USING (song, key) JOIN w ON w.song = l.song AND w.line_no = l.line_no AND w.word_no = l.a JOIN m USING (song, key) WHERE m.word_no = l.a AND doubtful AND NOT sure)
      SELECT w.song, w.line_no, w.word_no, CAST(coalesce(floor(start + pb), b) AS BIGINT) AS begin_ms, CAST(coalesce(floor(start + pe), b + 300) AS BIGINT) AS end_ms, start IS NOT NULL AS borrowed
      FROM w LEFT JOIN s ON s.song = w.song AND s.line_no = w.line_no LEFT JOIN m ON m.song = s.song AND m.key = s.key AND m.word_no = w.word_no""",
    "split_word": f"""WITH {LINED_SQL}, c AS (SELECT *, CASE WHEN word_id % 2 = 0 AND length(kind) > 2 THEN begin_ms + CAST(floor(CAST((end_ms - begin_ms) * 2 AS DOUBLE) / length(kind)) AS BIGINT) END AS m FROM lined
      ), p AS (SELECT song, line_no, word_no, 0 AS i, CASE WHEN m IS NULL THEN kind ELSE substr(kind, 1, 2) END AS text, begin_ms, coalesce(m, end_ms) AS end_ms FROM c UNION ALL SELECT song, line_no, word_no, 1, substr(kind, 3), m, end_ms FROM c WHERE m IS NOT NULL)
      SELECT song, line_no, row_number() OVER (PARTITION BY song, line_no ORDER BY word_no, i) - 1 AS word_no, text, begin_ms, end_ms FROM p""",
    "stretch": f"WITH {LINED_SQL} SELECT word_id, CASE WHEN kind = 'view' THEN greatest(0, 1704000000000 + (begin_ms - 1704000000000) * 2) ELSE begin_ms END AS begin_ms, CASE WHEN kind = 'view' THEN greatest(0, 1704000000000 + (end_ms - 1704000000000) * 2) ELSE end_ms END AS end_ms FROM lined",
    "set_boundary": f"""WITH {LINED_SQL}, n AS (SELECT *, CASE WHEN word_id % 5 = 0 THEN greatest(coalesce(lag(begin_ms) OVER w + 50, 0), least(begin_ms - 90000, end_ms - 50)) END AS nb FROM lined WINDOW w AS (PARTITION BY song, line_no ORDER BY word_no)
      ), e AS (SELECT *, lead(nb) OVER w AS nn, lead(begin_ms) OVER w AS no FROM n WINDOW w AS (PARTITION BY song, line_no ORDER BY word_no))
      SELECT word_id, coalesce(nb, begin_ms) AS begin_ms, CASE WHEN nn IS NOT NULL AND (end_ms >= no OR end_ms > nn) THEN nn ELSE end_ms END AS end_ms FROM e""",
    "apply_template": f"""WITH {LINED_SQL}, t AS (SELECT song, word_no, begin_ms - min(begin_ms) OVER (PARTITION BY song) AS b, end_ms - min(begin_ms) OVER (PARTITION BY song) AS e FROM lined WHERE line_no = 0)
      SELECT s.song AS grp, s.line_no AS instance, t.word_no AS template_line, s.begin_ms + b AS begin_ms, s.begin_ms + e AS end_ms FROM lined s JOIN t ON s.song = t.song WHERE s.word_no = 0 AND s.line_no > 0""",
    "merge_tracks": f"WITH {LINED_SQL}, m AS (SELECT song, line_no, word_id, begin_ms, CASE kind WHEN 'click' THEN 0 ELSE 1 END AS track FROM lined WHERE kind IN ('click', 'view')) SELECT word_id, row_number() OVER (PARTITION BY song, line_no ORDER BY begin_ms, track, word_id) - 1 AS word_no, track FROM m",
    "background_place": f"""WITH {LINED_SQL}, g AS (SELECT song, line_no, min(begin_ms) FILTER (kind <> 'error') AS mb, max(end_ms) FILTER (kind <> 'error') AS me, min(begin_ms) FILTER (kind = 'error') AS bb FROM lined GROUP BY song, line_no)
      SELECT song, line_no, CASE WHEN bb < mb THEN 'front' WHEN bb >= me THEN 'end' ELSE 'inside' END AS place FROM g WHERE mb IS NOT NULL AND bb IS NOT NULL""",
    "history_cap": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) q WHERE k <= 3",
    "resolve_overlaps": f"""WITH RECURSIVE {LINED_SQL}, r AS (
        SELECT song, line_no, word_no, begin_ms AS b, end_ms AS e FROM lined WHERE word_no = 0
        UNION ALL SELECT l.song, l.line_no, l.word_no, greatest(l.begin_ms, r.e), greatest(l.begin_ms, r.e) + l.end_ms - l.begin_ms FROM r JOIN lined l ON l.song = r.song AND l.line_no = r.line_no AND l.word_no = r.word_no + 1)
      SELECT song, line_no, word_no, b AS begin_ms, e AS end_ms FROM r""",
}

"""Registered queries: validation and ordered-neighbour operators on ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import timing, validate
from ..schema import LINED_SQL, SONG_SQL, WORDS_SQL, events_as_words, in_lines, song_words, table

DURATION = 2_591_000_000_000  # a song end that no event reaches; ``past_end`` uses its own


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return validate.word_issues(song_words(spark, sf))


def validate_report(spark: SparkSession, sf: str) -> DataFrame:
    return validate.report(_checked(spark, sf))


def validate_flags(spark: SparkSession, sf: str) -> DataFrame:
    return validate.flagged_totals(_checked(spark, sf))


def too_long_short(spark: SparkSession, sf: str) -> DataFrame:
    w = _checked(spark, sf)
    return w.where(F.arrays_overlap("issues", F.array(F.lit("too-long"), F.lit("too-short")))).select("word_id", (F.col("end_ms") - F.col("begin_ms")).alias("length_ms"))


def overlap_gap(spark: SparkSession, sf: str) -> DataFrame:
    w = _checked(spark, sf)
    return w.groupBy("song").agg(F.count_if(F.array_contains("issues", "overlap")).alias("overlaps"), F.count_if(F.array_contains("issues", "big-gap")).alias("big_gaps"))


def past_end(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf)
    last = w.groupBy("song").agg(F.max("begin_ms").alias("duration"))
    return validate.word_issues(w.join(last, "song"), F.col("duration")).where(F.array_contains("issues", "past-end")).select("word_id", "song")


def out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """A line begins with its surest word, which may be any."""
    lines = song_words(spark, sf).groupBy("song", "line_no").agg(F.max_by("begin_ms", F.struct("confidence", "word_id")).alias("begin_ms"))
    jumped = lines.withColumn("begin_ms", F.when(F.col("line_no") % 3 == 1, F.col("begin_ms") - 60_000).otherwise(F.col("begin_ms")))
    return validate.out_of_order(jumped).select("song", "line_no", "begin_ms")


def _line_starts(spark: SparkSession, sf: str) -> DataFrame:
    return in_lines(events_as_words(spark, sf)).groupBy("song", "line_no").agg(F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"), F.min("value").alias("value"), F.min("word_id").alias("word_id"))


def local_offsets(spark: SparkSession, sf: str) -> DataFrame:
    lines = in_lines(events_as_words(spark, sf), 1).withColumn("offset", F.when(F.col("confidence") >= 0.5, F.round(F.col("value") * 100).cast("bigint")))
    return timing.local_offsets(lines).select("song", "line_no", F.col("local_offset").cast("double").alias("local_offset"))


def enforce_order(spark: SparkSession, sf: str) -> DataFrame:
    return timing.enforce_order(events_as_words(spark, sf), ("word_id",)).select("song", "word_id", "kept_begin")


def interpolate(spark: SparkSession, sf: str) -> DataFrame:
    lines = _line_starts(spark, sf).withColumn("begin_ms", F.when(F.col("value") >= 20, F.col("begin_ms")))
    return timing.interpolate(lines).select("song", "line_no", "begin_filled")


def spread_by_length(spark: SparkSession, sf: str) -> DataFrame:
    lined = in_lines(events_as_words(spark, sf))
    spans = lined.groupBy("song", "line_no").agg(F.min("begin_ms").alias("lo"), F.max("end_ms").alias("hi"))
    words = lined.join(spans, ["song", "line_no"])
    return timing.spread(words, ("song", "line_no"), "lo", "hi", F.length("kind").cast("bigint")).select("word_id", "spread_begin", "spread_end")


def islands(spark: SparkSession, sf: str) -> DataFrame:
    return timing.islands(events_as_words(spark, sf), bridge=3_600_000, shortest=60_000, pad=200)


def close_gaps(spark: SparkSession, sf: str) -> DataFrame:
    frames = in_lines(events_as_words(spark, sf), 1).select("song", F.col("line_no").alias("frame"), (F.col("value") >= 40).alias("voiced"))
    return timing.close_runs(frames, 2).select("song", "frame", "voiced", "closed")


def _syllables(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("kind", F.when(F.col("word_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("")))
    return in_lines(events_as_words(spark, sf)).withColumn("text", text)


def syllable_groups(spark: SparkSession, sf: str) -> DataFrame:
    return timing.syllable_groups(_syllables(spark, sf)).select("word_id", "group_no", F.col("in_group").cast("bigint").alias("in_group"), "group_size")


def syllable_position(spark: SparkSession, sf: str) -> DataFrame:
    return timing.syllable_groups(_syllables(spark, sf)).groupBy("song", "position").agg(F.count("*").alias("n"))


def whole_words(spark: SparkSession, sf: str) -> DataFrame:
    return timing.whole_words(_syllables(spark, sf))


def next_line_end(spark: SparkSession, sf: str) -> DataFrame:
    return timing.line_ends(_line_starts(spark, sf)).select("song", "line_no", "line_end")


def instance_position(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("grp"), "turn").distinct()
    return timing.instance_positions(t, "grp", "turn").select("grp", "turn", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("instances").cast("bigint").alias("instances"))


def next_free_index(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.floor(F.col("value") / 10).cast("bigint").alias("idx"))
    return timing.next_free_index(e, "user_id", "idx")


def row_bands(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    return timing.row_bands(t, ("role",), "turn", ("conv_id",)).select("conv_id", "turn", "band")


def nudge_headroom(spark: SparkSession, sf: str) -> DataFrame:
    return timing.nudge_headroom(events_as_words(spark, sf), F.col("kind") == "click", ("begin_ms", "word_id"))


def line_breaks_at_pause(spark: SparkSession, sf: str) -> DataFrame:
    w = timing.breaks_at_pause(events_as_words(spark, sf), 7_200_000, ("begin_ms", "word_id"))
    return w.groupBy("song", "broken_line").agg(F.count("*").alias("n"), F.min("word_id").alias("first_word"))


def fill_untimed(spark: SparkSession, sf: str) -> DataFrame:
    """Two fifths of the words are untimed; every other line has bounds of its own."""
    w = song_words(spark, sf)
    line = Window.partitionBy("song", "line_no")
    bounds = {f"line_{n}": F.when(F.col("line_no") % 2 == 0, f(c).over(line)) for n, f, c in (("begin", F.min, "begin_ms"), ("end", F.max, "end_ms"))}
    kept = F.col("word_id") * 7 % 5 < 3
    w = w.withColumns(bounds).withColumns({c: F.when(kept, F.col(c)) for c in ("begin_ms", "end_ms")})
    return timing.fill_untimed(w, line_begin="line_begin", line_end="line_end").select("word_id", "fill_begin", "fill_end")


def follow_voice(spark: SparkSession, sf: str) -> DataFrame:
    """Each word goes on to the end of its voiced island, at most to the next begin and four seconds further."""
    w = events_as_words(spark, sf)
    isles = timing.islands(w, bridge=600_000).select("song", F.col("begin_ms").alias("isle_begin"), F.col("end_ms").alias("isle_end"))
    on = w.withColumn("next_begin", F.lead("begin_ms").over(timing.song_window("begin_ms", "word_id")))
    met = on.join(isles, (on.song == isles.song) & (on.begin_ms >= isles.isle_begin) & (on.begin_ms <= isles.isle_end)).drop(isles.song)
    cap = F.least(F.col("isle_end"), F.coalesce("next_begin", "isle_end"), F.col("end_ms") + 4000)
    return met.select("word_id", F.greatest("end_ms", cap).alias("voice_end"))


def line_window(spark: SparkSession, sf: str) -> DataFrame:
    """The span between a line's bounded neighbours, a second wider."""
    lines = _line_starts(spark, sf)
    w = timing.song_window("line_no")
    return lines.select("song", "line_no", (F.lag("end_ms").over(w) - 1000).alias("from_ms"), (F.lead("begin_ms").over(w) + 1000).alias("to_ms"))


def gap_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Widest gap of each song and its middle."""
    w = events_as_words(spark, sf)
    gaps = w.select("song", "word_id", F.col("end_ms").alias("gap_from"), F.lead("begin_ms").over(timing.song_window("begin_ms", "word_id")).alias("gap_to"))
    gaps = gaps.where("gap_to > gap_from").withColumn("wide", F.col("gap_to") - F.col("gap_from"))
    best = gaps.groupBy("song").agg(F.max(F.struct("wide", (-F.col("word_id")).alias("k"), "gap_from")).alias("b"))
    return best.select("song", F.col("b.wide").alias("wide"), (F.col("b.gap_from") + F.floor(F.col("b.wide") / 2)).cast("bigint").alias("middle"))


def absorb_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted pieces lend their end to the last surviving piece before them in their group."""
    w = timing.syllable_groups(_syllables(spark, sf)).withColumn("gone", F.col("kind") == "error")
    from pyspark.sql import Window

    g = Window.partitionBy("song", "line_no", "group_no").orderBy("word_no")
    keep = F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(g)
    w = w.withColumn("survivor", keep).where("survivor > 0")
    return w.groupBy("song", "line_no", "group_no", "survivor").agg(F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


QUERIES = [
    validate_report, validate_flags, too_long_short, overlap_gap, past_end, out_of_order, local_offsets, enforce_order, interpolate, spread_by_length, islands, close_gaps,
    syllable_groups, syllable_position, whole_words, next_line_end, instance_position, next_free_index, row_bands, nudge_headroom, line_breaks_at_pause, fill_untimed,
    follow_voice, line_window, gap_slots, absorb_deleted,
]

_ISSUES = f"""WITH {SONG_SQL}, near AS (
  SELECT *, lag(end_ms) OVER (PARTITION BY song, line_no, track ORDER BY word_no) AS before FROM sw
), checked AS (
  SELECT *, coalesce(end_ms - begin_ms > 6000, false) AS too_long, coalesce(end_ms - begin_ms < 30, false) AS too_short, coalesce(begin_ms - before < -10, false) AS overlap, coalesce(begin_ms - before > 4000, false) AS big_gap FROM near
)"""
_STARTS = f"WITH {LINED_SQL}, starts AS (SELECT song, line_no, min(begin_ms) AS begin_ms, max(end_ms) AS end_ms, count(*) AS n_words, min(value) AS value FROM lined GROUP BY song, line_no)"
_SYLL = f"""WITH {LINED_SQL}, syl AS (SELECT *, kind || CASE WHEN word_id % 3 = 0 THEN ' ' ELSE '' END AS text FROM lined
), grp AS (
  SELECT *, coalesce(sum(CASE WHEN text LIKE '% ' THEN 1 ELSE 0 END) OVER (PARTITION BY song, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS group_no FROM syl
), pos AS (
  SELECT *, row_number() OVER (PARTITION BY song, line_no, group_no ORDER BY word_no) AS in_group, count(*) OVER (PARTITION BY song, line_no, group_no) AS group_size FROM grp
)"""

SQL = {
    "validate_report": _ISSUES + """ SELECT issue, count(*) AS n FROM (
        SELECT 'too-long' AS issue FROM checked WHERE too_long UNION ALL SELECT 'too-short' FROM checked WHERE too_short
        UNION ALL SELECT 'overlap' FROM checked WHERE overlap UNION ALL SELECT 'big-gap' FROM checked WHERE big_gap) q GROUP BY issue""",
    "validate_flags": _ISSUES + """ SELECT song, count(*) AS words, count(*) FILTER (too_long OR too_short OR overlap OR big_gap) AS flagged,
        CAST(sum(too_long::INT + too_short::INT + overlap::INT + big_gap::INT) AS BIGINT) AS problems FROM checked GROUP BY song""",
    "too_long_short": _ISSUES + " SELECT word_id, end_ms - begin_ms AS length_ms FROM checked WHERE too_long OR too_short",
    "overlap_gap": _ISSUES + " SELECT song, count(*) FILTER (overlap) AS overlaps, count(*) FILTER (big_gap) AS big_gaps FROM checked GROUP BY song",
    "past_end": f"WITH {SONG_SQL} SELECT word_id, song FROM (SELECT *, max(begin_ms) OVER (PARTITION BY song) AS duration FROM sw) q WHERE end_ms > duration + 500",
    "out_of_order": f"""WITH {SONG_SQL}, l AS (SELECT song, line_no, arg_max(CASE WHEN begin_ms IS NULL THEN -1 ELSE begin_ms END, (confidence, word_id)) AS b FROM sw GROUP BY 1, 2
      ), j AS (SELECT song, line_no, CASE WHEN b < 0 THEN NULL WHEN line_no % 3 = 1 THEN b - 60000 ELSE b END AS begin_ms FROM l)
      SELECT song, line_no, begin_ms FROM (SELECT *, last_value(begin_ms IGNORE NULLS) OVER (PARTITION BY song ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j) q WHERE begin_ms < before - 1000""",
    "local_offsets": f"""WITH {WORDS_SQL}, o AS (
        SELECT song, row_number() OVER (PARTITION BY song ORDER BY begin_ms, word_id) - 1 AS line_no, CASE WHEN confidence >= 0.5 THEN CAST(round(value * 100) AS BIGINT) END AS off FROM words)
      SELECT song, CAST(line_no AS INT) AS line_no, CAST(CASE WHEN count(off) OVER (PARTITION BY song) >= 3 THEN
        CASE WHEN count(off) OVER w >= 2 THEN quantile_cont(off, 0.5) OVER w ELSE quantile_cont(off, 0.5) OVER (PARTITION BY song) END END AS DOUBLE) AS local_offset
      FROM o WINDOW w AS (PARTITION BY song ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""",
    "enforce_order": f"""WITH {WORDS_SQL}, m AS (SELECT *, max(begin_ms) OVER (PARTITION BY song ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM words)
      SELECT song, word_id, CASE WHEN so_far IS NULL OR begin_ms >= so_far THEN begin_ms END AS kept_begin FROM m""",
    "interpolate": _STARTS + """, k AS (
        SELECT song, line_no, CASE WHEN value >= 20 THEN begin_ms END AS b, coalesce(sum(n_words) OVER (PARTITION BY song ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM starts
      ), n AS (
        SELECT *, last_value(CASE WHEN b IS NOT NULL THEN b END IGNORE NULLS) OVER p AS ab, last_value(CASE WHEN b IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS apos,
          first_value(CASE WHEN b IS NOT NULL THEN b END IGNORE NULLS) OVER f AS bb, first_value(CASE WHEN b IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS bpos
        FROM k WINDOW p AS (PARTITION BY song ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY song ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
      SELECT song, line_no, CAST(CASE WHEN b IS NOT NULL THEN b WHEN ab IS NOT NULL AND bb IS NOT NULL THEN ab + floor((bb - ab)::DOUBLE * (pos - apos) / (bpos - apos))
        WHEN ab IS NOT NULL THEN ab + 600 * (pos - apos) WHEN bb IS NOT NULL THEN greatest(0, bb - 600 * (bpos - pos)) END AS BIGINT) AS begin_filled FROM n""",
    "spread_by_length": f"""WITH {LINED_SQL}, s AS (
        SELECT *, min(begin_ms) OVER l AS lo, max(end_ms) OVER l AS hi, length(kind) AS w, sum(length(kind)) OVER l AS total, sum(length(kind)) OVER (PARTITION BY song, line_no ORDER BY word_no) AS upto
        FROM lined WINDOW l AS (PARTITION BY song, line_no))
      SELECT word_id, CAST(lo + floor(CAST((hi - lo) * (upto - w) AS DOUBLE) / total) AS BIGINT) AS spread_begin, CAST(lo + floor(CAST((hi - lo) * upto AS DOUBLE) / total) AS BIGINT) AS spread_end FROM s""",
    "islands": f"""WITH {WORDS_SQL}, r AS (
        SELECT *, max(end_ms) OVER (PARTITION BY song ORDER BY begin_ms, end_ms, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words
      ), m AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR begin_ms - reach > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY begin_ms, end_ms, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM r)
      SELECT song, island, greatest(0, min(begin_ms) - 200) AS begin_ms, max(end_ms) + 200 AS end_ms, count(*) AS n FROM m GROUP BY song, island HAVING max(end_ms) - min(begin_ms) >= 60000""",
    "close_gaps": f"""WITH {WORDS_SQL}, f AS (SELECT song, CAST(row_number() OVER (PARTITION BY song ORDER BY begin_ms, word_id) - 1 AS INT) AS frame, value >= 40 AS voiced FROM words
      ), t AS (SELECT *, CASE WHEN voiced <> lag(voiced) OVER (PARTITION BY song ORDER BY frame) THEN 1 ELSE 0 END AS turn FROM f
      ), r AS (SELECT *, sum(turn) OVER (PARTITION BY song ORDER BY frame) AS run FROM t)
      SELECT song, frame, voiced, voiced OR (run > 0 AND run < max(run) OVER (PARTITION BY song) AND count(*) OVER (PARTITION BY song, run) < 2) AS closed FROM r""",
    "syllable_groups": _SYLL + " SELECT word_id, group_no, in_group, group_size FROM pos",
    "syllable_position": _SYLL + """ SELECT song, CASE WHEN group_size = 1 THEN 'none' WHEN in_group = 1 THEN 'first' WHEN in_group = group_size THEN 'last' ELSE 'middle' END AS position, count(*) AS n FROM pos GROUP BY ALL""",
    "whole_words": _SYLL + """ SELECT song, line_no, group_no, string_agg(text, '' ORDER BY word_no) AS text, arg_min(begin_ms, word_no) AS begin_ms, arg_max(end_ms, word_no) AS end_ms, count(*) AS pieces FROM pos GROUP BY song, line_no, group_no""",
    "next_line_end": _STARTS + " SELECT song, line_no, coalesce(lead(begin_ms) OVER (PARTITION BY song ORDER BY line_no), begin_ms + greatest(2000, n_words * 600)) AS line_end FROM starts",
    "instance_position": "SELECT grp, turn, dense_rank() OVER (PARTITION BY grp ORDER BY turn) AS ordinal, count(*) OVER (PARTITION BY grp) AS instances FROM (SELECT DISTINCT conv_id AS grp, turn FROM conversations) q",
    "next_free_index": """WITH u AS (SELECT DISTINCT user_id, CAST(floor(value / 10) AS BIGINT) AS idx FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1 AS pos FROM u)
      SELECT user_id, coalesce(min(CASE WHEN pos <> idx THEN pos END), count(*)) AS next_index FROM r GROUP BY user_id""",
    "row_bands": """WITH c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT conv_id, turn, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS band FROM c""",
    "nudge_headroom": f"""WITH {WORDS_SQL}, r AS (
        SELECT *, last_value(CASE WHEN kind <> 'click' THEN end_ms END IGNORE NULLS) OVER (PARTITION BY song ORDER BY begin_ms, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
          first_value(CASE WHEN kind <> 'click' THEN begin_ms END IGNORE NULLS) OVER (PARTITION BY song ORDER BY begin_ms, word_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM words)
      SELECT song, min(greatest(0, begin_ms - coalesce(l, 0))) AS left_ms, min(CASE WHEN r IS NOT NULL THEN greatest(0, r - end_ms) ELSE 0 END) AS right_ms, count(*) AS selected FROM r WHERE kind = 'click' GROUP BY song""",
    "line_breaks_at_pause": f"""WITH {WORDS_SQL}, g AS (SELECT *, CASE WHEN begin_ms - lag(end_ms) OVER (PARTITION BY song ORDER BY begin_ms, word_id) >= 7200000 THEN 1 ELSE 0 END AS b FROM words
      ), l AS (SELECT *, CAST(sum(b) OVER (PARTITION BY song ORDER BY begin_ms, word_id) AS BIGINT) AS broken_line FROM g)
      SELECT song, broken_line, count(*) AS n, min(word_id) AS first_word FROM l GROUP BY song, broken_line""",
    "fill_untimed": f"""WITH {SONG_SQL}, t AS (
        SELECT song, line_no, track, word_no, word_id, greatest(1, length(trim(text, ' '))) AS w, CASE WHEN line_no % 2 = 0 THEN min(begin_ms) OVER l END AS lb, CASE WHEN line_no % 2 = 0 THEN max(end_ms) OVER l END AS le,
          begin_ms IS NOT NULL AND word_id * 7 % 5 < 3 AS timed, CASE WHEN word_id * 7 % 5 < 3 THEN begin_ms END AS b, CASE WHEN word_id * 7 % 5 < 3 THEN end_ms END AS e FROM sw WINDOW l AS (PARTITION BY song, line_no)
      ), r AS (SELECT *, sum(timed::INT) OVER o AS run, last_value(e IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
          first_value(b IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM t WINDOW o AS (PARTITION BY song, line_no, track ORDER BY word_no)
      ), u AS (SELECT *, count(*) OVER p AS n, sum(w) OVER q AS upto, sum(w) OVER p AS total FROM r WINDOW p AS (PARTITION BY song, line_no, track, run, timed), q AS (PARTITION BY song, line_no, track, run, timed ORDER BY word_no)
      ), s AS (SELECT *, CASE WHEN a IS NOT NULL THEN a WHEN z IS NOT NULL THEN greatest(0, z - 300 * n) ELSE lb END AS f, CASE WHEN z IS NOT NULL THEN z WHEN a IS NOT NULL THEN a + 300 * n WHEN le IS NOT NULL THEN le ELSE lb + 300 * n END AS g FROM u)
      SELECT word_id, CAST(CASE WHEN timed THEN b ELSE f + floor(CAST(greatest(50 * n, g - f) * (upto - w) AS DOUBLE) / total) END AS BIGINT) AS fill_begin,
        CAST(CASE WHEN timed THEN e ELSE f + floor(CAST(greatest(50 * n, g - f) * upto AS DOUBLE) / total) END AS BIGINT) AS fill_end FROM s""",
    "follow_voice": f"""WITH {WORDS_SQL}, r AS (
        SELECT *, max(end_ms) OVER (PARTITION BY song ORDER BY begin_ms, end_ms, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words
      ), m AS (SELECT *, sum(CASE WHEN reach IS NULL OR begin_ms - reach > 600000 THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY begin_ms, end_ms, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r
      ), x AS (SELECT *, max(end_ms) OVER (PARTITION BY song, island) AS isle_end, lead(begin_ms) OVER (PARTITION BY song ORDER BY begin_ms, word_id) AS nb FROM m)
      SELECT word_id, greatest(end_ms, least(isle_end, coalesce(nb, isle_end), end_ms + 4000)) AS voice_end FROM x""",
    "line_window": _STARTS + " SELECT song, line_no, lag(end_ms) OVER w - 1000 AS from_ms, lead(begin_ms) OVER w + 1000 AS to_ms FROM starts WINDOW w AS (PARTITION BY song ORDER BY line_no)",
    "gap_slots": f"""WITH {WORDS_SQL}, g AS (SELECT song, word_id, end_ms AS f, lead(begin_ms) OVER (PARTITION BY song ORDER BY begin_ms, word_id) AS t FROM words
      ), b AS (SELECT *, t - f AS wide, row_number() OVER (PARTITION BY song ORDER BY t - f DESC, word_id) AS k FROM g WHERE t > f)
      SELECT song, wide, CAST(f + floor(wide / 2) AS BIGINT) AS middle FROM b WHERE k = 1""",
    "absorb_deleted": _SYLL + """, k AS (SELECT *, CAST(sum(CASE WHEN kind = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY song, line_no, group_no ORDER BY word_no) AS BIGINT) AS survivor FROM pos)
      SELECT song, line_no, group_no, survivor, min(begin_ms) AS begin_ms, max(end_ms) AS end_ms, count(*) AS n FROM k WHERE survivor > 0 GROUP BY ALL""",
}

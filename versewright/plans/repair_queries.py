"""Registered queries: timing repair, anchoring and reviewed decisions, on ``events`` as songs and ``conversations`` as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import repair
from ..schema import SONG_SQL, song_words, table


def reanchor(spark: SparkSession, sf: str) -> DataFrame:
    return repair.reanchored(song_words(spark, sf)).select("word_id", "begin_ms", "end_ms", "moved")


def transcript_times(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).where("track = 'main'")
    lines = w.groupBy("song", "line_no").agg(F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"))
    return repair.transcript_times(w, lines).select("song", "line_no", "word_no", "key", F.round("heard_ms", 6).alias("heard_ms"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines of the song that is their conversation."""
    return table(spark, sf, "conversations").where("text is not null").select(F.col("conv_id").alias("song"), F.col("turn").cast("int").alias("line_no"), "text")


def anchor_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns placed by a transcript that lacks every third word and has others wrong."""
    lines = _turns(spark, sf)
    words = lines.select("song", "line_no", F.posexplode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("word_no", "text"))
    heard = words.withColumn("heard_ms", (F.col("line_no") * 20_000 + F.col("word_no") * 400).cast("double")).where("word_no % 3 <> 2")
    heard = heard.withColumn("key", repair.anchor_key(F.when(F.col("word_no") % 7 == 3, F.reverse("text")).otherwise(F.col("text"))))
    out = repair.anchored_lines(lines.select("song", "line_no", F.lit(400_000).alias("duration_ms")), words, heard)
    return out.select("song", "line_no", F.round("begin_ms", 3).alias("begin_ms"), F.round("end_ms", 3).alias("end_ms"), "matched")


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("song", F.concat(F.lit("V"), "line_no").alias("id"), "line_no", F.array("text", F.concat(F.lit("a "), "text"), F.concat("text", F.lit(" b"))).alias("options"))


def apply_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Choices of each turn, some out of range and some for variants that were not offered."""
    asked = _turns(spark, sf).select("song", F.concat(F.lit("V"), F.col("line_no") + F.when(F.col("song") % 5 == 0, 1).otherwise(0)).alias("id"), ((F.col("song") + F.col("line_no")) % 5 - 1).cast("int").alias("choice"))
    return repair.checked_choices(asked, _variants(spark, sf)).select("song", "id", "choice", "kind", F.md5("to").alias("digest"))


def _words_of_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("song", "line_no", F.posexplode(F.split("text", " ")).alias("word_no", "text"))


def _spellings(spark: SparkSession, sf: str) -> DataFrame:
    """For each song its longest word turned into an ending that some songs have and some have not."""
    w = _words_of_turns(spark, sf).where("text rlike '^[a-z]+$'")
    longest = w.groupBy("song").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("src"))
    return longest.withColumn("dst", F.when(F.col("song") % 2 == 0, F.initcap("src")).otherwise(F.concat("src", F.lit("q"))))


def apply_spelling(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = _words_of_turns(spark, sf).select("song", F.col("text").alias("word")).distinct()
    return repair.checked_spellings(_spellings(spark, sf), vocabulary).select("song", "src", "dst", "kind")


def respell_words(spark: SparkSession, sf: str) -> DataFrame:
    w = _words_of_turns(spark, sf).withColumn("text", F.when(F.col("word_no") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    asked = _spellings(spark, sf)
    return repair.respelled(w, asked).groupBy("song").agg(F.count_if("edited").alias("edited"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "word_no", "text"))), lambda x: x["text"]), " ")).alias("digest"))


def _removals(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).where("line_no % 5 = 1 or (song % 3 = 0 and line_no % 2 = 0)").select("song", "line_no")


def apply_removals(spark: SparkSession, sf: str) -> DataFrame:
    return repair.checked_removals(_removals(spark, sf), _turns(spark, sf))


def apply_notes(spark: SparkSession, sf: str) -> DataFrame:
    lines = _turns(spark, sf)
    notes = lines.select("song", (F.col("line_no") + F.col("song") % 3).cast("int").alias("line_no"), F.when(F.col("line_no") % 4 == 0, "").otherwise(F.concat(F.lit("note "), "line_no")).alias("note"), F.col("line_no").alias("at"))
    gone = repair.checked_removals(_removals(spark, sf), lines).where("kind = 'remove'")
    return repair.kept_notes(notes, lines, gone, "at").select("song", "line_no", "note")


def rebuild_song(spark: SparkSession, sf: str) -> DataFrame:
    lines = _turns(spark, sf)
    gone = repair.checked_removals(_removals(spark, sf), lines).where("kind = 'remove'")
    new = lines.where("line_no % 3 = 0").select("song", (F.col("line_no") - 1).alias("after"), F.concat(F.lit("new "), "line_no").alias("text"))
    return repair.rebuilt(lines, gone, new).select("song", "line_no", "inserted", F.md5("text").alias("digest"))


def retime_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """New words: as many as before in even lines, one less in odd ones."""
    w = song_words(spark, sf).where("track = 'main'")
    new = w.where("line_no % 2 = 0 or word_no > 0").select("song", "line_no", (F.col("word_no") - F.col("line_no") % 2).cast("int").alias("word_no"), F.concat(F.lit("x"), "text").alias("text"))
    out = repair.retimed(new, w)
    return out.select("song", "line_no", "word_no", F.round("begin_ms", 6).alias("begin_ms"), F.round("end_ms", 6).alias("end_ms"), "spread")


def offset_decision(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("song")).agg((F.sum(F.floor("value")) % 700 - 350).alias("offset"), (F.sum(F.floor("value")) % 311).alias("spread"), (F.count("*") % 40).alias("words"))
    return repair.offset_decision(e).select("song", "reason", "applied")


QUERIES = [
    reanchor, transcript_times, anchor_lines, apply_variants, apply_spelling, respell_words, apply_removals, apply_notes, rebuild_song, retime_by_position, offset_decision,
]

_T = "t AS (SELECT conv_id AS song, turn::INT AS line_no, text FROM conversations WHERE text IS NOT NULL)"
_W = _T + ", w AS (SELECT song, line_no, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS word_no FROM t)"
_S = _W + """, l AS (SELECT song, arg_max(text, (length(text), text)) AS src FROM w WHERE regexp_matches(text, '^[a-z]+$') GROUP BY song
  ), s AS (SELECT song, src, CASE WHEN song % 2 = 0 THEN upper(src[1]) || substr(src, 2) ELSE src || 'q' END AS dst FROM l)"""
_R = _T + """, r AS (SELECT song, line_no, count(*) OVER (PARTITION BY song) AS d FROM t WHERE line_no % 5 = 1 OR (song % 3 = 0 AND line_no % 2 = 0)
  ), n AS (SELECT song, count(*) AS n FROM t GROUP BY song), c AS (SELECT r.song, line_no, CASE WHEN d > 0.25 * n THEN 'rejected' ELSE 'remove' END AS kind FROM r JOIN n ON n.song = r.song)"""

SQL = {
    "reanchor": f"""WITH {SONG_SQL}, n AS (SELECT *, begin_ms IS NOT NULL AND coalesce(confidence, 0) < 0.05 AS weak, lead(begin_ms) OVER w AS nb, lag(end_ms) OVER w AS pe, lag(begin_ms IS NOT NULL AND coalesce(confidence, 0) < 0.05) OVER w AS pw FROM sw WINDOW w AS (PARTITION BY song, line_no, track ORDER BY word_no)
      ), m AS (SELECT *, least(end_ms - begin_ms, 400) AS len, coalesce(weak AND nb - end_ms > 500, false) AS f, coalesce(weak AND nb IS NULL AND CASE WHEN pw AND begin_ms - pe > 500 THEN 0 ELSE begin_ms - pe END > 500, false) AS b FROM n)
      SELECT word_id, CASE WHEN f THEN nb - len WHEN b THEN pe ELSE begin_ms END AS begin_ms, CASE WHEN f THEN nb WHEN b THEN pe + len ELSE end_ms END AS end_ms, f OR b AS moved FROM m""",
    "transcript_times": f"""WITH {SONG_SQL}, k AS (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_'']', '', 'g') AS key FROM sw WHERE track = 'main'
      ), a AS (SELECT *, bool_and(begin_ms IS NOT NULL) OVER l AS whole, min(begin_ms) OVER l AS lb, max(end_ms) OVER l AS le, sum(greatest(1, length(key))) OVER l AS total, sum(greatest(1, length(key))) OVER (PARTITION BY song, line_no ORDER BY word_no) - greatest(1, length(key)) AS before FROM k WINDOW l AS (PARTITION BY song, line_no)
      ), h AS (SELECT song, line_no, word_no, key, CASE WHEN whole THEN begin_ms::DOUBLE ELSE lb + (le - lb) * before / total END AS heard_ms FROM a) SELECT song, line_no, word_no, key, round(heard_ms, 6) AS heard_ms FROM h WHERE heard_ms IS NOT NULL AND key <> ''""",
    "apply_variants": f"""WITH {_T}, a AS (SELECT song, 'V' || (line_no + CASE WHEN song % 5 = 0 THEN 1 ELSE 0 END) AS id, ((song + line_no) % 5 - 1)::INT AS choice FROM t), v AS (SELECT song, 'V' || line_no AS id, [text, 'a ' || text, text || ' b'] AS options FROM t)
      SELECT a.song, a.id, choice, CASE WHEN options IS NULL OR choice < 0 OR choice > 2 THEN 'rejected' WHEN choice = 0 THEN 'kept' ELSE 'variant' END AS kind, CASE WHEN options IS NOT NULL AND choice IN (1, 2) THEN md5(options[choice + 1]) END AS digest FROM a LEFT JOIN v ON v.song = a.song AND v.id = a.id""",
    "apply_spelling": f"WITH {_S} SELECT song, src, dst, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.song = s.song AND lower(w.text) = lower(dst)) THEN 'spelling' ELSE 'rejected' END AS kind FROM s",
    "respell_words": rf"""WITH {_S}, m AS (SELECT song, line_no, word_no, CASE WHEN word_no % 2 = 0 THEN text || '!' ELSE text END AS text FROM w
      ), b AS (SELECT m.*, regexp_replace(rtrim(text, ' '), '^[.,!?;:"'']+|[.,!?;:"'']+$', '', 'g') AS bare, src, dst FROM m LEFT JOIN s ON s.song = m.song
      ), e AS (SELECT *, coalesce(lower(bare) = lower(src) AND bare <> dst, false) AS edited FROM b)
      SELECT song, count(*) FILTER (edited) AS edited, md5(string_agg(CASE WHEN edited THEN replace(text, bare, dst) ELSE text END, ' ' ORDER BY line_no, word_no)) AS digest FROM e GROUP BY song""",
    "apply_removals": f"WITH {_R} SELECT song, line_no, kind FROM c",
    "apply_notes": f"""WITH {_R}, o AS (SELECT song, (line_no + song % 3)::INT AS line_no, CASE WHEN line_no % 4 = 0 THEN '' ELSE 'note ' || line_no END AS note, row_number() OVER (PARTITION BY song ORDER BY line_no) AS k FROM t)
      SELECT song, line_no, note FROM o WHERE k <= 10 AND note <> '' AND (song, line_no) IN (SELECT song, line_no FROM t) AND (song, line_no) NOT IN (SELECT song, line_no FROM c WHERE kind = 'remove')""",
    "rebuild_song": f"""WITH {_R}, u AS (SELECT song, line_no AS place, 0 AS k, text, false AS inserted FROM t WHERE (song, line_no) NOT IN (SELECT song, line_no FROM c WHERE kind = 'remove') UNION ALL SELECT song, line_no - 1, 1, 'new ' || line_no, true FROM t WHERE line_no % 3 = 0)
      SELECT song, (row_number() OVER (PARTITION BY song ORDER BY place, k) - 1)::INT AS line_no, inserted, md5(text) AS digest FROM u""",
    "retime_by_position": f"""WITH {SONG_SQL}, o AS (SELECT * FROM sw WHERE track = 'main'), g AS (SELECT song, line_no, count(*) AS n, arg_min(begin_ms, word_no) FILTER (begin_ms IS NOT NULL) AS b, arg_max(end_ms, word_no) FILTER (begin_ms IS NOT NULL) AS e FROM o GROUP BY 1, 2
      ), x AS (SELECT song, line_no, word_no - line_no % 2 AS word_no, 'x' || text AS text FROM o WHERE line_no % 2 = 0 OR word_no > 0), z AS (SELECT *, count(*) OVER l AS m, length(trim(text, ' ')) AS wt, sum(length(trim(text, ' '))) OVER l AS total, sum(length(trim(text, ' '))) OVER (PARTITION BY song, line_no ORDER BY word_no) AS upto FROM x WINDOW l AS (PARTITION BY song, line_no))
      SELECT z.song, z.line_no, z.word_no, round(CASE WHEN m = n THEN o.begin_ms::DOUBLE ELSE b + (e - b) * (upto - wt) / total END, 6) AS begin_ms, round(CASE WHEN m = n THEN o.end_ms::DOUBLE ELSE b + (e - b) * upto / total END, 6) AS end_ms, m <> n AND b IS NOT NULL AS spread
      FROM z JOIN g ON g.song = z.song AND g.line_no = z.line_no LEFT JOIN o ON o.song = z.song AND o.line_no = z.line_no AND o.word_no = z.word_no""",
    "offset_decision": """WITH c AS (SELECT user_id AS song, sum(floor(value))::BIGINT % 700 - 350 AS off, sum(floor(value))::BIGINT % 311 AS spread, count(*) % 40 AS words FROM events GROUP BY 1
      ), r AS (SELECT song, CASE WHEN words < 10 THEN 'few words' WHEN abs(off) < 120 THEN 'close' WHEN spread > 150 THEN 'words disagree' ELSE 'shifted' END AS reason FROM c) SELECT song, reason, reason = 'shifted' AS applied FROM r""",
}

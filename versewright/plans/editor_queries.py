"""Registered queries: edits of lines, groups and projects, on ``events`` as songs, ``conversations`` as lines and ``part`` as projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import editing, shapes
from ..schema import SONG_SQL, song_words, table


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("text is not null").select(F.col("conv_id").alias("song"), F.col("turn").cast("int").alias("line_no"), "text")


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a group in four of five, two lines to an instance."""
    w = song_words(spark, sf)
    l = w.groupBy("song", "line_no").agg(F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"))
    group = F.when(F.col("line_no") % 5 != 0, F.concat(F.lit("g"), F.col("line_no") % 2))
    return l.withColumns({"group_id": group, "instance": F.when(group.isNotNull(), F.floor(F.col("line_no") / 2).cast("int")), "agent": F.concat(F.lit("v"), (F.col("song") + F.col("line_no")) % 4)})


def bracket_words(spark: SparkSession, sf: str) -> DataFrame:
    return editing.bracketed(song_words(spark, sf).where("track = 'bg'")).select("word_id", "text")


def background_from_text(spark: SparkSession, sf: str) -> DataFrame:
    l = _linked(spark, sf).where("begin_ms is not null").withColumns({"background": F.concat(F.lit("ooh "), "agent", F.lit(" aah")), "at_ms": F.when(F.col("line_no") % 2 == 0, F.col("end_ms") - 700)})
    return editing.background_words(l).select("song", "line_no", "word_no", "text", F.round("word_begin", 6).alias("begin_ms"), F.round("word_end", 6).alias("end_ms"))


def fill_empty_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = _linked(spark, sf).withColumn("n_words", F.when(F.col("line_no") % 3 == 0, F.col("n_words")).otherwise(0))
    rows = _turns(spark, sf).select("song", F.col("line_no").alias("row"), "text").withColumns({"paste": F.floor(F.col("row") / 2), "line_no": (F.col("row") * 5 % 11).cast("int")})
    pasted = editing.filled(rows.withColumn("paste", F.concat_ws("-", "song", "paste")), lines)
    return pasted.select("song", "row", "line_no", "ok")


def agent_merge(spark: SparkSession, sf: str) -> DataFrame:
    songs = _linked(spark, sf)
    voices = songs.select("song").distinct().withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(6)])))
    existing = voices.where("k < 4").select("song", F.concat(F.lit("v"), "k").alias("id"), F.concat(F.lit("voice "), "k").alias("name"), F.lit("person").alias("kind"))
    declared = voices.where("(k + song) % 3 = 0").select("song", F.concat(F.lit("v"), "k").alias("id"), F.concat(F.lit("new "), "k").alias("name"), F.lit("group").alias("kind"))
    return editing.merged_agents(existing, declared, songs.where("line_no % 3 = 1").select("song", "agent"))


def unknown_agents(spark: SparkSession, sf: str) -> DataFrame:
    l = _linked(spark, sf)
    agents = l.select("song").distinct().withColumn("id", F.explode(F.array(F.lit("v1"), F.lit("v2"))))
    return editing.known_agents(l.select("song", "line_no", "agent"), agents)


def detach_instances(spark: SparkSession, sf: str) -> DataFrame:
    l = _linked(spark, sf)
    hit = l.where("n_words < 3 and group_id is not null").select("song", "group_id", "instance")
    return editing.detached(l, hit).select("song", "line_no", "group_id", "instance", "linked")


def trim_last_space(spark: SparkSession, sf: str) -> DataFrame:
    return editing.without_last_space(song_words(spark, sf)).select("word_id", "text")


def slot_counts(spark: SparkSession, sf: str) -> DataFrame:
    texts = shapes.joined(song_words(spark, sf), shapes.LINE, "word_id", mark="|").join(_linked(spark, sf).select("song", "line_no", (F.col("n_words") - 1).alias("n_words")), ["song", "line_no"])
    return editing.slot_counts(texts).select("song", "line_no", F.col("slots").cast("bigint").alias("slots"), F.col("timed_slots").cast("bigint").alias("timed_slots"))


def explicit_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).join(_linked(spark, sf).select("song", "line_no", "group_id"), ["song", "line_no"]).withColumn("template_line", F.col("line_no") % 2)
    return editing.explicit_fingerprints(w).select("word_id", "fingerprint")


def edited_text(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    new = t.where("line_no % 3 = 1").withColumn("text", F.concat(F.lit("edited "), "line_no"))
    return editing.edited_text(t, new).select("song", F.md5("text").alias("digest"))


def matched_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An edited text that lacks its second row, has blank ones and one more at the end."""
    t = _turns(spark, sf)
    kept = t.where("line_no <> 1").select("song", (F.col("line_no") * 2).alias("row_no"), F.when(F.col("line_no") == 3, "changed").otherwise(F.col("text")).alias("text"))
    blank = t.select("song", (F.col("line_no") * 2 + 1).alias("row_no"), F.lit(" ").alias("text"))
    more = t.select("song").distinct().select("song", F.lit(10_000).alias("row_no"), F.lit("one").alias("text")).unionByName(t.select("song").distinct().select("song", F.lit(10_001).alias("row_no"), F.lit("two").alias("text")))
    return editing.matched_rows(kept.unionByName(blank).unionByName(more), t).select("song", "row_no", "line_no", "change")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Pasted instances and edited texts with what becomes of them."""
    l = _linked(spark, sf)
    paste = editing.paste_decision(F.when(F.col("line_no") % 4 != 0, F.col("line_no")), F.col("n_words") % 5, F.lit(2))
    edit = editing.edit_decision(F.col("n_words") % 3 != 0, F.col("line_no") % 2 == 0, F.col("group_id").isNotNull())
    return l.select("song", "line_no", paste.alias("paste"), edit.alias("edit"))


def line_extremes(spark: SparkSession, sf: str) -> DataFrame:
    lines = _linked(spark, sf).select("song", "line_no", "begin_ms", "end_ms")
    return editing.line_extremes(song_words(spark, sf).where("word_no % 3 = 0"), lines)


def effective_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return editing.effective_bounds(song_words(spark, sf))


def word_position(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.transform(F.sort_array(F.collect_list(F.struct("word_id", F.trim("text").alias("t")))), lambda x: x["t"])
    l = song_words(spark, sf).groupBy("song", "line_no").agg(keys.alias("keys"))
    kinds = ("click", "view", "purchase", "scroll", "login")
    return l.select("song", "line_no", *[editing.word_position(F.col("keys"), F.lit(k)).cast("bigint").alias(k) for k in kinds])


def even_spread(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf)
    return editing.evenly_spread(w, F.col("line_no") * 1000.0, F.col("line_no") * 1000.0 + F.col("song") % 7 * 100 - 100).select("word_id", F.round("begin_ms", 6).alias("begin_ms"), F.round("end_ms", 6).alias("end_ms"))


def syllable_ids(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).withColumn("syllable_id", F.when((F.col("line_no") % 4 == 0) & (F.col("word_no") == 0), "old"))
    return editing.fresh_ids(editing.syllable_ids(w), "paste").join(editing.syllable_ids(w).select("word_id", F.col("syllable_id").alias("inferred")), "word_id").select("word_id", "inferred", F.col("syllable_id").alias("fresh"))


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).where("begin_ms is not null")
    moves = w.where("word_id % 4 = 1").select("song", "line_no", "track", F.when(F.col("word_id") % 8 == 1, F.col("word_no") + 50).otherwise(F.col("word_no")).alias("word_no"), (F.col("line_no") + F.when(F.col("line_no") % 2 == 0, 1).otherwise(3)).alias("to_line"))
    lines = _linked(spark, sf).select("song", "line_no", F.floor(F.col("line_no") / 4).alias("instance"), (F.col("line_no") % 7 == 3).alias("line_synced"))
    return editing.planned_moves(moves, w, lines)


def move_words(spark: SparkSession, sf: str) -> DataFrame:
    return _moves(spark, sf)


def move_plan(spark: SparkSession, sf: str) -> DataFrame:
    return editing.move_plan(_moves(spark, sf)).select("song", "line_no", "track", F.array_join("removals", ",").alias("removals"), "inserts")


def apply_spans(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf)
    spans = w.groupBy("song", "line_no").agg(F.count("*").alias("n")).select("song", "line_no", F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(2))).alias("index")).withColumn("span_ms", F.col("line_no") * 100 + F.col("index"))
    return editing.applied_spans(w, spans).select("word_id", F.col("span_ms").cast("bigint").alias("span_ms"))


def mapped_reading(spark: SparkSession, sf: str) -> DataFrame:
    l = song_words(spark, sf).groupBy("song", "line_no").agg(F.sort_array(F.collect_list(F.struct("word_id", F.when(F.col("word_id") % 17 != 0, F.trim("text")).alias("text"), F.when(F.col("word_id") % 2 == 0, "-").alias("joiner")))).alias("parts"))
    reading = editing.mapped_reading(F.col("parts"))
    grouped = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("x"))), "  ")
    return l.select("song", "line_no", reading.alias("reading"), editing.timed_prefix(grouped, F.lit(3)).alias("prefix"))


def project_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as stored projects of an older format: metadata, malformed fields and file keys."""
    p = table(spark, sf, "part")
    meta = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_brand"), F.lit(" "))).alias("artists"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("artist"), F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.col("p_name")).alias("album"), F.lit("EN").alias("language"), "p_size", "p_retailprice")
    bad = editing.malformed_fields({"title": F.trim("album") != "", "size": F.col("p_size") < 40, "artist": F.col("artists").isNotNull()})
    done = editing.normalised_metadata(meta.withColumn("bad", bad))
    key = F.when(F.col("p_size") % 4 == 0, "..").when(F.col("p_size") % 4 == 1, "a/b").when(F.col("p_size") % 4 == 2, "").otherwise("song-1.json")
    return done.select("p_partkey", F.array_join("artists", ";").alias("artists"), "album", "language", F.array_join("bad", ",").alias("bad"), editing.safe_key(key).alias("safe"))


def unprime(spark: SparkSession, sf: str) -> DataFrame:
    return editing.unprimed(song_words(spark, sf), F.lit(2112), F.col("song") % 3 == 0).select("word_id", "begin_ms", "end_ms")


def stem_names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    file = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("(mix) "), "p_name", F.lit("_("), F.initcap("p_type"), F.lit(")_model.wav")))
    return p.select("p_partkey", editing.stem_name(file).alias("stem"))


def character_tokens(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "part").select("p_partkey", editing.character_tokens(F.col("p_name"), "etaoinshrdlucmfwypvbgkjqxz'").alias("ids"))
    return w.select("p_partkey", F.array_join("ids", " ").alias("ids"))


def patch_words(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf)
    p = w.where("word_id % 3 = 1").select("song", "line_no", "track", "word_no", F.when(F.col("word_id") % 2 == 0, "patched").alias("text"), F.lit(5).cast("bigint").alias("begin_ms"), F.lit(None).cast("bigint").alias("end_ms"))
    return editing.patched(w, p).select("word_id", "text", "begin_ms", "end_ms")


def split_identical(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).where("begin_ms is not null")
    return editing.identical_split(w, (F.col("line_no") == 0) & (F.col("word_no") == 0) & (F.col("track") == "main"), 3)


QUERIES = [
    bracket_words, background_from_text, fill_empty_lines, agent_merge, unknown_agents, detach_instances, trim_last_space, slot_counts, explicit_fingerprints, edited_text, matched_rows, decisions,
    line_extremes, effective_bounds, word_position, even_spread, syllable_ids, move_words, move_plan, apply_spans, mapped_reading, project_fields, unprime, stem_names, character_tokens, patch_words,
    split_identical,
]

_T = "t AS (SELECT conv_id AS song, turn::INT AS line_no, text FROM conversations WHERE text IS NOT NULL)"
_L = f"""WITH {SONG_SQL}, l AS (SELECT song, line_no, min(begin_ms) AS begin_ms, max(end_ms) AS end_ms, count(*) AS n_words, CASE WHEN line_no % 5 <> 0 THEN 'g' || line_no % 2 END AS group_id,
  CASE WHEN line_no % 5 <> 0 THEN line_no // 2 END AS instance, 'v' || (song + line_no) % 4 AS agent FROM sw GROUP BY 1, 2)"""
_MOVES = f"""{_L}, w AS (SELECT * FROM sw WHERE begin_ms IS NOT NULL), m AS (SELECT song, line_no, track, CASE WHEN word_id % 8 = 1 THEN word_no + 50 ELSE word_no END AS word_no, line_no + CASE WHEN line_no % 2 = 0 THEN 1 ELSE 3 END AS to_line FROM w WHERE word_id % 4 = 1
  ), s AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.song = w.song AND m.line_no = w.line_no AND m.track = w.track AND m.word_no = w.word_no)
  ), p AS (SELECT m.*, CASE WHEN w.begin_ms IS NULL THEN 'missing word' WHEN x.song IS NULL THEN 'missing line' WHEN m.line_no // 4 <> m.to_line // 4 THEN 'other instance' WHEN m.to_line % 7 = 3 THEN 'line-synced target'
    WHEN EXISTS (SELECT 1 FROM s WHERE s.song = m.song AND s.line_no = m.to_line AND s.track = m.track AND s.begin_ms < w.end_ms AND s.end_ms > w.begin_ms) THEN 'overlap' END AS refused
  FROM m LEFT JOIN w ON w.song = m.song AND w.line_no = m.line_no AND w.track = m.track AND w.word_no = m.word_no LEFT JOIN l x ON x.song = m.song AND x.line_no = m.to_line)"""
_IDS = f"""WITH {SONG_SQL}, p AS (SELECT *, coalesce(lag(text LIKE '% ') OVER w, true) AS st, CASE WHEN line_no % 4 = 0 AND word_no = 0 THEN 'old' END AS given FROM sw WINDOW w AS (PARTITION BY song, line_no, track ORDER BY word_no)
  ), r AS (SELECT *, max(CASE WHEN st THEN word_no END) OVER (PARTITION BY song, line_no, track ORDER BY word_no) AS start FROM p
  ), i AS (SELECT *, CASE WHEN bool_or(given IS NOT NULL) OVER (PARTITION BY song, line_no, track) THEN given WHEN count(*) OVER (PARTITION BY song, line_no, track, start) > 1 THEN song || '-' || line_no || '-' || track || '-' || start END AS inferred FROM r)"""

SQL = {
    "bracket_words": f"""WITH {SONG_SQL}, b AS (SELECT *, max(word_no) OVER (PARTITION BY song, line_no) AS last FROM sw WHERE track = 'bg')
      SELECT word_id, CASE WHEN word_no = 0 THEN '(' ELSE '' END || CASE WHEN word_no = last THEN rtrim(text, ' ') || ')' || CASE WHEN text LIKE '% ' THEN ' ' ELSE '' END ELSE text END AS text FROM b""",
    "background_from_text": f"""{_L}, b AS (SELECT song, line_no, begin_ms, end_ms, CASE WHEN line_no % 2 = 0 THEN end_ms - 700 END AS a, unnest(['ooh', agent, 'aah']) AS text, unnest([0, 1, 2]) AS word_no FROM l WHERE begin_ms IS NOT NULL
      ), h AS (SELECT *, (begin_ms + end_ms) / 2 AS half FROM b) SELECT song, line_no, word_no, text, round(CASE WHEN a IS NULL THEN half + (end_ms - half) / 3 * word_no ELSE least(end_ms, a + 300 * word_no) END, 6) AS begin_ms,
      round(CASE WHEN a IS NULL THEN half + (end_ms - half) / 3 * (word_no + 1) ELSE least(end_ms, a + 300 * (word_no + 1)) END, 6) AS end_ms FROM h""",
    "fill_empty_lines": f"""{_L}, {_T}, r AS (SELECT song, line_no AS "row", line_no // 2 AS paste, line_no * 5 % 11 AS line_no FROM t)
      SELECT r.song, "row", r.line_no, bool_and(coalesce(l.n_words IS NOT NULL AND l.group_id IS NULL AND r.line_no % 3 <> 0, false)) OVER (PARTITION BY r.song, paste) AS ok FROM r LEFT JOIN l ON l.song = r.song AND l.line_no = r.line_no""",
    "agent_merge": f"""{_L}, v AS (SELECT DISTINCT song, k FROM l, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) q), j AS (SELECT song, 'v' || k AS id, k, k < 4 AS e, (k + song) % 3 = 0 AS d FROM v)
      SELECT song, id, CASE WHEN d THEN 'new ' || k ELSE 'voice ' || k END AS name, CASE WHEN d THEN 'group' ELSE 'person' END AS kind, CASE WHEN NOT e THEN 'added' WHEN d THEN 'updated' ELSE 'kept' END AS state FROM j
      WHERE d OR (e AND EXISTS (SELECT 1 FROM l WHERE l.song = j.song AND l.agent = j.id AND l.line_no % 3 = 1))""",
    "unknown_agents": f"{_L} SELECT song, line_no, CASE WHEN agent IN ('v1', 'v2') THEN agent ELSE 'v1' END AS agent FROM l",
    "detach_instances": f"""{_L}, h AS (SELECT DISTINCT song, group_id, instance FROM l WHERE n_words < 3 AND group_id IS NOT NULL), d AS (SELECT l.*, h.group_id IS NOT NULL AS off FROM l LEFT JOIN h ON h.song = l.song AND h.group_id = l.group_id AND h.instance = l.instance)
      SELECT song, line_no, CASE WHEN NOT off THEN group_id END AS group_id, CASE WHEN NOT off THEN instance END AS instance, NOT off AND group_id IS NOT NULL AS linked FROM d""",
    "trim_last_space": f"WITH {SONG_SQL} SELECT word_id, CASE WHEN word_no = max(word_no) OVER (PARTITION BY song, line_no, track) THEN rtrim(text, ' ') ELSE text END AS text FROM sw",
    "slot_counts": f"{_L} SELECT song, line_no, n_words AS slots, n_words - 1 AS timed_slots FROM l",
    "explicit_fingerprints": f"""{_L} SELECT word_id, CASE WHEN group_id IS NOT NULL THEN 'g:' || group_id || ':' || sw.line_no % 2 ELSE 'l:' || sw.line_no END || ':' || track || ':' || word_no || ':' || trim(text, ' ') AS fingerprint
      FROM sw JOIN l ON l.song = sw.song AND l.line_no = sw.line_no""",
    "edited_text": f"WITH {_T} SELECT song, md5(string_agg(CASE WHEN line_no % 3 = 1 THEN 'edited ' || line_no ELSE text END, chr(10) ORDER BY line_no)) AS digest FROM t GROUP BY song",
    "matched_rows": f"""WITH {_T}, p AS (SELECT song, line_no * 2 AS row_no, CASE WHEN line_no = 3 THEN 'changed' ELSE text END AS text FROM t WHERE line_no <> 1 AND trim(text, ' ') <> '' UNION ALL SELECT DISTINCT song, 10000, 'one' FROM t UNION ALL SELECT DISTINCT song, 10001, 'two' FROM t
      ), a AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY row_no) AS k FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY line_no) AS k FROM t WHERE trim(text, ' ') <> '')
      SELECT a.song, row_no, s.line_no, CASE WHEN s.line_no IS NULL THEN 'new' WHEN s.text = a.text THEN 'same' ELSE 'changed' END AS change FROM a LEFT JOIN s ON s.song = a.song AND s.k = a.k""",
    "decisions": f"""{_L} SELECT song, line_no, CASE WHEN line_no % 4 = 0 THEN 'no-target' WHEN n_words % 5 >= 2 THEN 'fill' ELSE 'confirm-insert' END AS paste,
      CASE WHEN n_words % 3 = 0 THEN 'noop' WHEN line_no % 2 = 0 AND group_id IS NOT NULL THEN 'needs-confirm' WHEN group_id IS NOT NULL THEN 'apply-to-linked' ELSE 'apply' END AS edit FROM l""",
    "line_extremes": f"{_L} SELECT sw.song, min(coalesce(sw.begin_ms, l.begin_ms)) AS begin_ms, max(coalesce(sw.end_ms, l.end_ms)) AS end_ms, count(*) AS n FROM sw JOIN l ON l.song = sw.song AND l.line_no = sw.line_no WHERE word_no % 3 = 0 GROUP BY 1",
    "effective_bounds": f"""WITH {SONG_SQL}, b AS (SELECT song, line_no, min(begin_ms) FILTER (track = 'main') AS mb, max(end_ms) FILTER (track = 'main') AS me, min(begin_ms) FILTER (track = 'bg') AS bg_begin, max(end_ms) FILTER (track = 'bg') AS bg_end FROM sw GROUP BY 1, 2)
      SELECT song, line_no, bg_begin, bg_end, CASE WHEN mb IS NOT NULL THEN least(mb, bg_begin) END AS begin_ms, CASE WHEN mb IS NOT NULL THEN greatest(me, bg_end) END AS end_ms FROM b""",
    "word_position": f"""WITH {SONG_SQL}, l AS (SELECT song, line_no, list(trim(text, ' ') ORDER BY word_id) AS k FROM sw GROUP BY 1, 2)
      SELECT song, line_no, greatest(coalesce(list_position(k, 'click'), 0) - 1, 0)::BIGINT AS click, greatest(coalesce(list_position(k, 'view'), 0) - 1, 0)::BIGINT AS view, greatest(coalesce(list_position(k, 'purchase'), 0) - 1, 0)::BIGINT AS purchase,
        greatest(coalesce(list_position(k, 'scroll'), 0) - 1, 0)::BIGINT AS scroll, greatest(coalesce(list_position(k, 'login'), 0) - 1, 0)::BIGINT AS login FROM l""",
    "even_spread": f"""WITH {SONG_SQL}, s AS (SELECT *, greatest(0.0, (song % 7 * 100 - 100) / count(*) OVER (PARTITION BY song, line_no, track)) AS step FROM sw) SELECT word_id, round(line_no * 1000.0 + step * word_no, 6)::DOUBLE AS begin_ms, round(line_no * 1000.0 + step * (word_no + 1), 6)::DOUBLE AS end_ms FROM s""",
    "syllable_ids": f"{_IDS} SELECT word_id, inferred, CASE WHEN inferred IS NOT NULL THEN substr(md5('paste|' || song || '|' || line_no || '|' || inferred), 1, 12) END AS fresh FROM i",
    "move_words": f"{_MOVES} SELECT song, line_no, track, word_no, to_line, refused FROM p",
    "move_plan": f"""{_MOVES}, u AS (SELECT song, line_no, track, word_no AS o, NULL AS i FROM p WHERE refused IS NULL UNION ALL SELECT song, to_line, track, NULL, word_no FROM p WHERE refused IS NULL)
      SELECT song, line_no, track, coalesce(string_agg(DISTINCT o::VARCHAR, ',' ORDER BY o::VARCHAR), '') AS removals, count(i) AS inserts FROM u GROUP BY 1, 2, 3""",
    "apply_spans": f"WITH {SONG_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY song, line_no ORDER BY track DESC, word_no) - 1 AS i FROM sw) SELECT word_id, CASE WHEN i % 2 = 0 THEN line_no * 100 + i END AS span_ms FROM n",
    "mapped_reading": f"""WITH {SONG_SQL} SELECT song, line_no, CASE WHEN bool_and(word_id % 17 <> 0) THEN string_agg(trim(text, ' ') || CASE WHEN word_id % 2 = 0 THEN '-' ELSE '' END, '' ORDER BY word_id) END AS reading,
      array_to_string(list(CASE WHEN word_id % 17 = 0 THEN 'x' ELSE trim(text, ' ') END ORDER BY word_id)[1:3], '  ') AS prefix FROM sw GROUP BY 1, 2""",
    "project_fields": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 3 <> 0 THEN p_type END AS artists, CASE WHEN p_size % 5 <> 0 THEN p_name END AS album, 'en' AS language,
      concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'title' END, CASE WHEN p_size >= 40 THEN 'size' END, CASE WHEN p_size % 2 <> 0 THEN 'artist' END) AS bad, p_size % 4 = 3 AS safe FROM part""",
    "unprime": f"WITH {SONG_SQL} SELECT word_id, CASE WHEN song % 3 = 0 OR begin_ms IS NULL THEN begin_ms ELSE greatest(0, begin_ms - 2112) END AS begin_ms, CASE WHEN song % 3 = 0 OR end_ms IS NULL THEN end_ms ELSE greatest(0, end_ms - 2112) END AS end_ms FROM sw",
    "stem_names": "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN lower(p_type) END AS stem FROM part",
    "character_tokens": """WITH c AS (SELECT p_partkey, unnest(string_split(lower(p_name), '')) AS c, generate_subscripts(string_split(lower(p_name), ''), 1) AS i FROM part), k AS (SELECT *, instr('etaoinshrdlucmfwypvbgkjqxz''', c) AS id FROM c)
      SELECT p_partkey, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY i) FILTER (id > 0), '') AS ids FROM k GROUP BY 1""",
    "patch_words": f"WITH {SONG_SQL} SELECT word_id, CASE WHEN word_id % 6 = 4 THEN 'patched' ELSE text END AS text, CASE WHEN word_id % 3 = 1 THEN 5 ELSE begin_ms END AS begin_ms, end_ms FROM sw",
    "split_identical": f"""WITH {SONG_SQL}, w AS (SELECT *, trim(text, ' ') AS t FROM sw WHERE begin_ms IS NOT NULL), c AS (SELECT DISTINCT song, t FROM w WHERE line_no = 0 AND word_no = 0 AND track = 'main'
      ), m AS (SELECT w.*, c.t IS NOT NULL AND length(w.t) > 3 AS cut, begin_ms + (end_ms - begin_ms) * 3 // length(w.t) AS mid FROM w LEFT JOIN c ON c.song = w.song AND c.t = w.t
      ), e AS (SELECT song, line_no, track, word_no, 0 AS k, CASE WHEN cut THEN substr(text, 1, 3) ELSE text END AS text, begin_ms, CASE WHEN cut THEN mid ELSE end_ms END AS end_ms FROM m UNION ALL SELECT song, line_no, track, word_no, 1, substr(text, 4), mid, end_ms FROM m WHERE cut)
      SELECT song, line_no, track, (row_number() OVER (PARTITION BY song, line_no, track ORDER BY word_no, k) - 1)::INT AS word_no, text, begin_ms, end_ms FROM e""",
}

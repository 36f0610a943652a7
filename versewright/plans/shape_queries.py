"""Registered queries: text, shape and selection of lines and words, on ``events`` as songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timecode as C
from ..operators import shapes, validate
from ..schema import DOC_LINES_SQL, SONG_SQL, document_lines, song_words, table



def line_text(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.joined(song_words(spark, sf), shapes.TRACK)


def derived_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text of words with the split mark at syllable joints."""
    return shapes.joined(song_words(spark, sf), shapes.TRACK, mark="|")


def plain_text(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.plain_text(song_words(spark, sf)).select("song", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n"))


def flatten_words(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.flattened(song_words(spark, sf)).select("song", "word_id", F.col("place").cast("bigint").alias("place"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of four shapes: words, times of the line, neither, words."""
    w = song_words(spark, sf)
    main = F.col("track") == "main"
    shape = F.col("line_no") % 4
    l = w.groupBy("song", "line_no").agg(F.count_if(main).alias("m"), F.count_if(~main).alias("n_background"), F.min(F.when(main, F.col("begin_ms"))).alias("b"), F.max(F.when(main, F.col("end_ms"))).alias("e"))
    has = shape.isin(0, 3)
    return l.select("song", "line_no", F.when(F.col("m") > 0, F.concat(F.lit("line "), "line_no")).otherwise("|").alias("text"), F.when(has, F.col("m")).otherwise(0).alias("n_words"), "n_background", F.when(shape != 2, F.col("b")).alias("begin_ms"), F.when(shape != 2, F.col("e")).alias("end_ms"))


def line_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.with_shape(_lines(spark, sf)).select("song", "line_no", "word_synced", "line_synced", "any_timing", "has_main")


def effective_lines(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.with_shape(_lines(spark, sf)).select("song", "line_no", "source", F.col("n_effective").cast("bigint").alias("n_effective"))


def line_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.with_shape(_lines(spark, sf)).select("song", "line_no", "begin_ms", "end_ms")


def relative_template(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).withColumn("instance", F.floor(F.col("line_no") / 2).cast("int"))
    return shapes.relative(w, ("song", "instance")).select("word_id", "rel_begin", "rel_end", "template_ms")


def group_shift_clamp(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).withColumn("instance", F.floor(F.col("line_no") / 2).cast("int"))
    return shapes.clamped_shift(w, ("song", "instance"), -90_000)


def preview_syllables(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).withColumn("agent", F.concat(F.lit("v"), F.col("song") % 4))
    return w.select("word_id", (~F.endswith("text", F.lit(" "))).alias("part_of_word"), F.col("agent").isin(*shapes.OPPOSITE).alias("opposite"))


def timed_content(spark: SparkSession, sf: str) -> DataFrame:
    """Timed words of each song, and lines that hold a word on either track."""
    return song_words(spark, sf).groupBy("song").agg(F.count_if(shapes.timed()).alias("timed"), F.count_distinct("line_no").alias("lines"))


def sync_complete(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf)
    return w.groupBy("song", "line_no").agg(F.every(shapes.timed()).alias("whole")).groupBy("song").agg(F.every("whole").alias("complete"), F.count_if("whole").alias("whole_lines"))


def title_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Opening lines that only name the song."""
    p = table(spark, sf, "part").withColumn("line", F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" - ", "p_name", "p_brand")).otherwise(F.concat_ws(" ", "p_name", "p_brand")))
    return p.where(X.names_title(F.col("line"), F.col("p_name"))).select("p_partkey", "line")


def ghost_words(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).withColumn("text", F.when(F.col("word_id") % 7 == 0, " ").otherwise(F.col("text")))
    return shapes.heard_words(w, 500, 90).select("word_id", "begin_ms", "end_ms")


def review_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words and lines that carry a flag of the review screen."""
    w = validate.word_issues(song_words(spark, sf)).withColumn("review", shapes.needs_review(F.col("issues")))
    return w.groupBy("song", "line_no").agg(F.count_if("review").alias("words"), F.some("review").alias("line"))


def alignment_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = validate.word_issues(song_words(spark, sf))
    flags = [F.count_if(F.array_contains("issues", i)).alias(i.replace("-", "_")) for i in ("too-long", "too-short", "overlap", "big-gap")]
    return w.groupBy("song").agg(*flags, F.round(F.avg("confidence"), 9).alias("confidence"))


def structural_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a song with the same texts, counted."""
    k = shapes.structure_key(song_words(spark, sf))
    return k.groupBy("song", "structure").agg(F.count("*").alias("lines"), F.min("line_no").alias("first"))


def block_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Two lines in a row, with all their words on both tracks."""
    k = shapes.structure_key(song_words(spark, sf))
    return shapes.block_fingerprints(k, 2).where("block is not null").groupBy("song", "block").agg(F.count("*").alias("n"))


def source_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "benchmark")
    return d.select("item_id", X.source_fingerprint(F.col("text"), F.concat(F.lit("b|"), F.col("item_id").cast("string"))).alias("fingerprint"))


def empty_after_deletion(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf)
    return w.groupBy("song", "line_no").agg(F.every(F.startswith("text", F.lit("c")) | (F.col("word_no") % 2 == 0)).alias("empty"))


def window_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Training windows: a second of sound, and two frames of 20 ms for each letter."""
    l = song_words(spark, sf).groupBy("song", "line_no").agg(F.min("begin_ms").alias("b"), F.max("end_ms").alias("e"), F.sum(F.length(F.trim("text"))).alias("tokens"))
    return l.where((F.col("e") - F.col("b") >= 1000) & (F.floor((F.col("e") - F.col("b")) / 20) >= 2 * F.col("tokens"))).select("song", "line_no", "tokens")


def selection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.selection_summary(song_words(spark, sf).where("confidence > 0.2"))


def stretch_limits(spark: SparkSession, sf: str) -> DataFrame:
    s = shapes.stretch_limits(song_words(spark, sf), 30)
    return s.select("song", "line_no", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), "feasible")


def close_group_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.closed_groups(shapes.syllable_groups(song_words(spark, sf))).select("word_id", "group_no", "end_ms", "gap")


def adjacent_points(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.adjacent_points(song_words(spark, sf), "begin_ms")


def union_anchors(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf)
    starts = w.select("song", F.col("begin_ms").alias("at"), F.lit("word").alias("kind"))
    lines = w.groupBy("song", "line_no").agg(F.min("begin_ms").alias("at")).select("song", "at", F.lit("line").alias("kind"))
    custom = w.select("song", (F.floor(F.col("end_ms") / 5000) * 5000).cast("bigint").alias("at"), F.lit("custom").alias("kind"))
    return shapes.union_anchors(starts, lines, custom).select("song", "at", "kinds", F.col("place").cast("bigint").alias("place"))


def mark_explicit(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).withColumn("explicit", F.col("line_no") % 3 == 0)
    return shapes.explicit_marked(w, F.col("word_id") % 4 == 0).select("word_id", "explicit")


def ui_time(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).where("begin_ms is not null")
    return w.select("word_id", *[C.display(F.col("begin_ms"), p).alias(f"p{p}") for p in (0, 2, 3)])


def frame_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 20 ms: the nearest, the one that holds a time, and the first not before it."""
    t = F.col("begin_ms") / 20
    return song_words(spark, sf).where("begin_ms is not null").select("word_id", F.floor(t + 0.5).alias("nearest"), F.floor(t).alias("inside"), F.ceil(t).alias("after"))


def token_clean(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(spark, sf).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5(X.token_clean(F.col("line"))).alias("digest"))


def split_marks(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").withColumn("marked", F.replace("text", F.lit("a"), F.lit("a|")))
    return b.select("item_id", F.posexplode(X.split_marked(F.col("marked"))).alias("place", "w")).select("item_id", F.col("place").cast("bigint").alias("place"), "w.text", "w.spaced")


def clean_marks(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").withColumn("marked", F.replace(F.replace("text", F.lit("a"), F.lit("||a|")), F.lit("e "), F.lit("e|| ")))
    return b.select("item_id", F.md5(X.clean_marks(F.col("marked"))).alias("cleaned"), (X.clean_marks(F.col("marked"), strip=True) == F.col("text")).alias("same"))


def transliteration_groups(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").withColumn("t", F.replace("text", F.lit("e "), F.lit("e   ")))
    return b.select("item_id", F.md5(X.transliteration_text(F.col("t"))).alias("digest"), F.size(X.transliteration_groups(F.col("t"))).cast("bigint").alias("groups"))


def separator_runs(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").withColumn("t", F.replace("text", F.lit("e "), F.lit("e - ")))
    runs = b.select("item_id", F.explode(X.separator_runs(F.col("t"))).alias("run"))
    return runs.groupBy("item_id", "run.kind").agg(F.count("*").alias("n"), F.sum("run.size").cast("bigint").alias("size"))


def language_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("_", "lang", F.when(F.col("doc_id") % 3 == 0, "LATN"), F.when(F.col("doc_id") % 2 == 0, "us"), F.when(F.col("doc_id") % 5 == 0, "!")).alias("raw"))
    return d.select("doc_id", X.language_tag(F.col("raw")).alias("tag"))


def han_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Two Han letters set into each third word show the cuts."""
    b = table(spark, sf, "benchmark").withColumn("t", F.replace(F.replace("text", F.lit("a"), F.lit("漢字")), F.lit("e "), F.lit("e。")))
    return b.select("item_id", F.size(X.han_pieces(F.col("t"))).cast("bigint").alias("pieces"), F.md5(F.array_join(X.han_pieces(F.col("t")), "/")).alias("digest"))


QUERIES = [
    line_text, derived_text, plain_text, flatten_words, line_shapes, effective_lines, line_reconcile, relative_template, group_shift_clamp, preview_syllables, timed_content, sync_complete,
    title_lines, ghost_words, review_lines, alignment_stats, structural_equality, block_fingerprint, source_fingerprint, empty_after_deletion, window_filter, selection_summary, stretch_limits,
    close_group_gaps, adjacent_points, union_anchors, mark_explicit, ui_time, frame_seconds, token_clean, split_marks, clean_marks, transliteration_groups, separator_runs, language_tags, han_pieces,
]

_JOIN = "trim(string_agg(text{}, '' ORDER BY word_no), ' ')"
_MARKED = _JOIN.format(" || CASE WHEN word_no < last AND text NOT LIKE '% ' THEN '|' ELSE '' END")
_LASTS = f"WITH {SONG_SQL}, m AS (SELECT *, max(word_no) OVER (PARTITION BY song, line_no, track) AS last FROM sw)"
_DISPLAY = f"""WITH {SONG_SQL}, t AS (SELECT song, line_no, track, nullif({_JOIN.format('')}, '') AS text FROM sw GROUP BY 1, 2, 3
  ), d AS (SELECT song, line_no, concat_ws(' ', max(text) FILTER (track = 'main'), '(' || max(text) FILTER (track = 'bg') || ')') AS display FROM t GROUP BY 1, 2)"""
_SHAPES = f"""WITH {SONG_SQL}, l AS (SELECT song, line_no, count(*) FILTER (track = 'main') AS m, count(*) FILTER (track = 'bg') AS bg, min(begin_ms) FILTER (track = 'main') AS b, max(end_ms) FILTER (track = 'main') AS e FROM sw GROUP BY 1, 2
  ), s AS (SELECT song, line_no, m, bg, CASE WHEN line_no % 4 IN (0, 3) THEN m ELSE 0 END AS n, CASE WHEN line_no % 4 <> 2 THEN b END AS b, CASE WHEN line_no % 4 <> 2 THEN e END AS e FROM l
  ), f AS (SELECT *, n > 0 AS word_synced, n = 0 AND b IS NOT NULL AND e IS NOT NULL AS line_synced FROM s)"""
_INSTANCE = f"WITH {SONG_SQL}, i AS (SELECT *, line_no // 2 AS instance FROM sw)"
_CHECKED = f"""WITH {SONG_SQL}, near AS (SELECT *, end_ms - begin_ms AS len, begin_ms - lag(end_ms) OVER (PARTITION BY song, line_no, track ORDER BY word_no) AS gap FROM sw)"""
_BAD = "coalesce(len > 6000 OR len < 30, false) OR coalesce(gap < -10 OR gap > 4000, false)"
_GROUPS = f"""WITH {SONG_SQL}, g AS (SELECT *, coalesce(sum((text LIKE '% ')::INT) OVER (PARTITION BY song, line_no, track ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS group_no FROM sw)"""
_STRUCT = "s AS (SELECT song, line_no, md5(string_agg(track || chr(1) || text, chr(2) ORDER BY track || chr(1) || text)) AS structure FROM t GROUP BY 1, 2)"

SQL = {
    "line_text": f"WITH {SONG_SQL} SELECT song, line_no, track, {_JOIN.format('')} AS text FROM sw GROUP BY 1, 2, 3",
    "derived_text": f"{_LASTS} SELECT song, line_no, track, {_MARKED} AS text FROM m GROUP BY 1, 2, 3",
    "plain_text": f"{_DISPLAY} SELECT song, md5(string_agg(display, chr(10) ORDER BY line_no)) AS digest, length(string_agg(display, chr(10) ORDER BY line_no)) AS n FROM d GROUP BY song",
    "flatten_words": f"WITH {SONG_SQL} SELECT song, word_id, row_number() OVER (PARTITION BY song ORDER BY line_no, track DESC, word_no) - 1 AS place FROM sw",
    "line_shapes": f"{_SHAPES} SELECT song, line_no, word_synced, line_synced, word_synced OR line_synced OR bg > 0 AS any_timing, m > 0 AS has_main FROM f",
    "effective_lines": f"{_SHAPES} SELECT song, line_no, CASE WHEN word_synced THEN 'words' WHEN line_synced THEN 'line' ELSE 'none' END AS source, CASE WHEN word_synced THEN n WHEN line_synced THEN 1 ELSE 0 END AS n_effective FROM f",
    "line_reconcile": f"{_SHAPES} SELECT song, line_no, CASE WHEN NOT word_synced THEN b END AS begin_ms, CASE WHEN NOT word_synced THEN e END AS end_ms FROM f",
    "relative_template": f"{_INSTANCE} SELECT word_id, begin_ms - min(begin_ms) OVER w AS rel_begin, end_ms - min(begin_ms) OVER w AS rel_end, max(end_ms) OVER w - min(begin_ms) OVER w AS template_ms FROM i WINDOW w AS (PARTITION BY song, instance)",
    "group_shift_clamp": f"{_INSTANCE} SELECT song, instance, greatest(-90000, -min(begin_ms)) AS delta FROM i GROUP BY 1, 2",
    "preview_syllables": f"WITH {SONG_SQL} SELECT word_id, text NOT LIKE '% ' AS part_of_word, song % 4 = 2 AS opposite FROM sw",
    "timed_content": f"WITH {SONG_SQL} SELECT song, count(begin_ms) AS timed, count(DISTINCT line_no) AS lines FROM sw GROUP BY song",
    "sync_complete": f"WITH {SONG_SQL}, l AS (SELECT song, line_no, bool_and(begin_ms IS NOT NULL) AS whole FROM sw GROUP BY 1, 2) SELECT song, bool_and(whole) AS complete, count(*) FILTER (whole) AS whole_lines FROM l GROUP BY song",
    "title_lines": "SELECT p_partkey, p_name || ' - ' || p_brand AS line FROM part WHERE p_partkey % 3 = 0",
    "ghost_words": f"WITH {SONG_SQL} SELECT word_id, begin_ms + 500 AS begin_ms, end_ms + 500 AS end_ms FROM sw WHERE word_id % 7 <> 0 AND end_ms - begin_ms >= 90",
    "review_lines": f"{_CHECKED} SELECT song, line_no, count(*) FILTER ({_BAD}) AS words, bool_or({_BAD}) AS line FROM near GROUP BY 1, 2",
    "alignment_stats": f"""{_CHECKED} SELECT song, count(*) FILTER (len > 6000) AS too_long, count(*) FILTER (len < 30) AS too_short, count(*) FILTER (begin_ms IS NOT NULL AND gap < -10) AS overlap, count(*) FILTER (gap > 4000) AS big_gap,
      round(avg(confidence), 9) AS confidence FROM near GROUP BY song""",
    "structural_equality": f"{_LASTS}, t AS (SELECT song, line_no, track, {_MARKED} AS text FROM m GROUP BY 1, 2, 3), {_STRUCT} SELECT song, structure, count(*) AS lines, min(line_no) AS first FROM s GROUP BY 1, 2",
    "block_fingerprint": f"""{_LASTS}, t AS (SELECT song, line_no, track, {_MARKED} AS text FROM m GROUP BY 1, 2, 3), {_STRUCT},
      b AS (SELECT song, md5(structure || ',' || lead(structure) OVER (PARTITION BY song ORDER BY line_no)) AS block FROM s) SELECT song, block, count(*) AS n FROM b WHERE block IS NOT NULL GROUP BY 1, 2""",
    "source_fingerprint": "SELECT item_id, md5(replace(text, '|', '') || chr(0) || 'b' || item_id) AS fingerprint FROM benchmark",
    "empty_after_deletion": f"WITH {SONG_SQL} SELECT song, line_no, bool_and(text LIKE 'c%' OR word_no % 2 = 0) AS empty FROM sw GROUP BY 1, 2",
    "window_filter": f"WITH {SONG_SQL}, l AS (SELECT song, line_no, min(begin_ms) AS b, max(end_ms) AS e, sum(length(trim(text, ' '))) AS tokens FROM sw GROUP BY 1, 2) SELECT song, line_no, tokens::BIGINT AS tokens FROM l WHERE e - b >= 1000 AND (e - b) // 20 >= 2 * tokens",
    "selection_summary": f"WITH {SONG_SQL} SELECT song, count(*) AS words, count(DISTINCT line_no) AS lines, min(begin_ms) AS begin_ms, max(end_ms) AS end_ms FROM sw WHERE confidence > 0.2 GROUP BY song HAVING count(*) > 1 AND min(begin_ms) IS NOT NULL",
    "stretch_limits": f"""WITH {SONG_SQL}, s AS (SELECT song, line_no, min(begin_ms) AS pin, max(end_ms) AS stop, max(30 / nullif(end_ms - begin_ms, 0)) AS lower FROM sw WHERE begin_ms IS NOT NULL GROUP BY 1, 2
      ), u AS (SELECT *, (lead(pin) OVER (PARTITION BY song ORDER BY line_no) - pin) / nullif(stop - pin, 0) AS upper FROM s) SELECT song, line_no, round(lower, 9) AS lower, round(upper, 9) AS upper, coalesce(lower <= upper, true) AS feasible FROM u""",
    "close_group_gaps": f"""{_GROUPS}, n AS (SELECT *, lead(begin_ms) OVER (PARTITION BY song, line_no, track, group_no ORDER BY word_no) AS nx FROM g)
      SELECT word_id, group_no, coalesce(nx, end_ms) AS end_ms, bool_or(coalesce(nx > end_ms, false)) OVER (PARTITION BY song, line_no, track, group_no) AS gap FROM n""",
    "adjacent_points": f"WITH {SONG_SQL}, p AS (SELECT DISTINCT song, begin_ms FROM sw WHERE begin_ms IS NOT NULL) SELECT song, begin_ms, lead(begin_ms) OVER w AS after, lag(begin_ms) OVER w AS before FROM p WINDOW w AS (PARTITION BY song ORDER BY begin_ms)",
    "union_anchors": f"""WITH {SONG_SQL}, a AS (SELECT song, begin_ms AS "at", 'word' AS kind FROM sw UNION ALL SELECT song, min(begin_ms), 'line' FROM sw GROUP BY song, line_no UNION ALL SELECT song, end_ms // 5000 * 5000, 'custom' FROM sw
      ), o AS (SELECT song, "at", string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM a WHERE "at" IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY song ORDER BY "at") AS place FROM o""",
    "mark_explicit": f"""{_GROUPS}, e AS (SELECT *, bool_or(word_id % 4 = 0) OVER (PARTITION BY song, line_no, track, group_no) AS grown FROM g) SELECT word_id, CASE WHEN grown THEN line_no % 3 <> 0 ELSE line_no % 3 = 0 END AS explicit FROM e""",
    "ui_time": f"""WITH {SONG_SQL} SELECT word_id, (begin_ms // 60000) || ':' || lpad((begin_ms // 1000 % 60)::VARCHAR, 2, '0') AS p0, (begin_ms // 60000) || ':' || lpad((begin_ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((begin_ms % 1000 // 10)::VARCHAR, 2, '0') AS p2,
      (begin_ms // 60000) || ':' || lpad((begin_ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((begin_ms % 1000)::VARCHAR, 3, '0') AS p3 FROM sw WHERE begin_ms IS NOT NULL""",
    "frame_seconds": f"WITH {SONG_SQL} SELECT word_id, (begin_ms + 10) // 20 AS nearest, begin_ms // 20 AS inside, (begin_ms + 19) // 20 AS after FROM sw WHERE begin_ms IS NOT NULL",
    "token_clean": rf"WITH {DOC_LINES_SQL} SELECT doc_id, line_no, md5(regexp_replace(line, '[^\p{{L}}\p{{N}}'']', '', 'g')) AS digest FROM doc_lines",
    "split_marks": """WITH m AS (SELECT item_id, list_filter(regexp_split_to_array(replace(text, 'a', 'a|'), '\\s+'), lambda t: t <> '') AS w FROM benchmark
      ), p AS (SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM m
      ), q AS (SELECT item_id, n, i, list_filter(string_split(t, '|'), lambda x: x <> '') AS s FROM p), r AS (SELECT item_id, n, i, len(s) AS k, unnest(s) AS text, generate_subscripts(s, 1) AS j FROM q)
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i, j) - 1 AS place, text, j = k AND i < n AS spaced FROM r""",
    "clean_marks": """WITH m AS (SELECT item_id, text, replace(replace(text, 'a', '||a|'), 'e ', 'e|| ') AS t FROM benchmark)
      SELECT item_id, md5(regexp_replace(regexp_replace(t, '[|]+', '|', 'g'), '(^|\\s)[|]|[|]($|\\s)', '\\1\\2', 'g')) AS cleaned, true AS same FROM m""",
    "transliteration_groups": r"""WITH m AS (SELECT item_id, trim(regexp_replace(regexp_replace(replace(text, 'e ', 'e   '), '\s\s+', chr(1), 'g'), '\s', ' ', 'g'), ' ' || chr(1)) AS t FROM benchmark)
      SELECT item_id, md5(replace(t, chr(1), '  ')) AS digest, len(list_filter(string_split(t, chr(1)), lambda x: x <> '')) AS groups FROM m""",
    "separator_runs": r"""WITH m AS (SELECT item_id, unnest(regexp_extract_all(replace(text, 'e ', 'e - '), '[\s-]+')) AS r FROM benchmark)
      SELECT item_id, CASE WHEN contains(r, '-') THEN 'dash' ELSE 'space' END AS kind, count(*) AS n, sum(length(r))::BIGINT AS size FROM m GROUP BY 1, 2""",
    "language_tags": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR lang IS NULL THEN NULL ELSE concat_ws('-', lang, CASE WHEN doc_id % 3 = 0 THEN 'Latn' END, CASE WHEN doc_id % 2 = 0 THEN 'US' END) END AS tag FROM documents",
    "han_pieces": r"""WITH m AS (SELECT item_id, regexp_extract_all(replace(replace(text, 'a', '漢字'), 'e ', 'e。'), '(?:\p{Han}|[^\s\p{Han}\p{P}]+)\p{P}*|\p{P}+') AS p FROM benchmark)
      SELECT item_id, len(p) AS pieces, md5(array_to_string(p, '/')) AS digest FROM m""",
}

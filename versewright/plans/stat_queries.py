"""Registered queries: joins, statistics, arithmetic and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins, stats
from ..schema import DOC_LINES_SQL, LINED_SQL, WORDS_SQL, document_lines, events_as_words, in_lines, table


def _kind(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return events_as_words(spark, sf).where(F.col("kind") == kind)


def positional_pairs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a, b = li.where("l_orderkey % 2 = 0").withColumn("k", F.col("l_orderkey")), li.where("l_orderkey % 2 = 1").withColumn("k", F.col("l_orderkey") - 1)
    return joins.positional(a.drop("l_orderkey"), b.drop("l_orderkey"), ("k", "l_linenumber"))


def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return joins.nearest(_kind(spark, sf, "click").select("song", "word_id", "begin_ms"), _kind(spark, sf, "view"), "begin_ms", "begin_ms").select("word_id", "near")


def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    return joins.asof(_kind(spark, sf, "click").select("song", "word_id", "begin_ms"), _kind(spark, sf, "view"), "begin_ms", "begin_ms", "word_id").select("word_id", "as_of")


def interval_stab(spark: SparkSession, sf: str) -> DataFrame:
    points = _kind(spark, sf, "error").select("song", F.col("word_id").alias("point"), F.col("begin_ms").alias("t"))
    return joins.interval_stab(points, _kind(spark, sf, "view").select("song", "word_id", "begin_ms", (F.col("end_ms") + 3_600_000).alias("end_ms")), "t", "begin_ms", "end_ms").select("point", "word_id")


def overlap_semi(spark: SparkSession, sf: str) -> DataFrame:
    wide = lambda k: _kind(spark, sf, k).select("song", "word_id", "begin_ms", (F.col("end_ms") + 600_000).alias("end_ms"))
    return joins.overlaps(wide("click"), wide("purchase")).select("word_id")


def snap_band(spark: SparkSession, sf: str) -> DataFrame:
    return joins.snap(_kind(spark, sf, "click").select("song", "word_id", "begin_ms"), _kind(spark, sf, "view"), "begin_ms", "begin_ms", 3_600_000).select("word_id", "near")


def identical_words(spark: SparkSession, sf: str) -> DataFrame:
    return joins.identical_words(events_as_words(spark, sf), F.concat_ws(":", "kind", F.floor(F.col("value")))).select("word_id", "others")


def sibling_propagate(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    edits = c.where("c_custkey % 10 = 0").select("c_nationkey", "c_custkey", "c_mktsegment")
    return joins.propagate(edits, c.select("c_custkey", "c_nationkey", "c_mktsegment"), ("c_nationkey",), "c_custkey", ("c_mktsegment",))


def claim_text(spark: SparkSession, sf: str) -> DataFrame:
    e = events_as_words(spark, sf).select("song", "kind", "word_id")
    return joins.claim_by_text(e.where("word_id % 2 = 0"), e.where("word_id % 2 = 1"), "kind", "word_id", ("song",)).select("word_id", "claimed")


def decision_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Answers whose id no offered option has."""
    return table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents").where("source = 'src0'").select("doc_id"), "doc_id", "left_anti")


def line_respell(spark: SparkSession, sf: str) -> DataFrame:
    """Words of turns that a benchmark item spells alike once punctuation is stripped, counted by turn."""
    known = table(spark, sf, "benchmark").select(F.explode(F.split(X.word_key(F.col("text")), " ")).alias("w")).distinct()
    words = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.explode(F.split(X.word_key(F.col("text")), " ")).alias("w"))
    return words.join(known, "w").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


def word_offset_mad(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf).withColumn("heard", F.col("begin_ms") + F.floor(F.col("value") * 10).cast("bigint"))
    return stats.offset_and_spread(w, "begin_ms", "heard")


def theil_sen(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf), 1).select("song", (F.col("line_no") * 4000).cast("double").alias("x"), (F.col("line_no") * 40 + F.floor(F.col("value"))).cast("double").alias("y"))
    return stats.theil_sen(w, "x", "y").select("song", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


def repeat_pattern(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf).select("kind", (F.col("song") % 5).alias("word_no"), (F.floor(F.col("value")) + (F.col("song") % 5) * 100).cast("bigint").alias("rel_begin"))
    return stats.repeat_pattern(w.withColumn("sure", F.col("rel_begin") % 10 > 2), ("kind",), "word_no", 480, "sure")


def line_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Mean confidence of a line if all its words are timed, else 0, and the share of doubtful words."""
    w = in_lines(events_as_words(spark, sf)).withColumn("timed", F.col("value") >= 5)
    g = w.groupBy("song", "line_no").agg(F.when(F.bool_and("timed"), F.avg("confidence")).otherwise(0.0).alias("c"), F.avg((F.col("confidence") < 0.2).cast("int")).alias("d"))
    return g.select("song", "line_no", F.round("c", 9).alias("confidence"), F.round("d", 9).alias("doubtful"))


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return in_lines(events_as_words(spark, sf)).select("song", "line_no", F.floor(F.col("value") - F.col("word_no") * 10).cast("bigint").alias("error"))


def benchmark_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.benchmark_metrics(_errors(spark, sf))
    return m.select("song", F.round("aae", 6).alias("aae"), F.round("within_100", 6).alias("within_100"), F.round("within_300", 6).alias("within_300"), "words", "worst_drift")


def macro_mean(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.macro_mean(stats.benchmark_metrics(_errors(spark, sf)), ["aae", "within_100", "worst_drift"])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").select((F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000).alias("score"), F.col("quality").alias("is_right"))
    s = stats.threshold_sweep(d, "score", "is_right", [0.1, 0.25, 0.5, 0.75, 0.92])
    return s.select("threshold", "flagged", "caught", *[F.round(c, 6).alias(c) for c in ("share", "recall", "precision")])


def rms_energy(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    g = v.groupBy("vec_id", F.floor(F.col("i") / 16).alias("hop")).agg(F.sqrt(F.avg(F.col("x").cast("double") * F.col("x").cast("double"))).alias("rms"))
    return g.select("vec_id", "hop", F.round("rms", 5).alias("rms"))


def energy_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Six hundredths of the 95th percentile of each song's values."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.percentile("value", F.lit(0.95)) * 0.06, 6).alias("threshold"))


def _job_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    status = F.when(F.col("value") < 300, "running").when(F.col("value") < 450, "done").otherwise("failed")
    return e.select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), status.alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id")


def stage_view(spark: SparkSession, sf: str) -> DataFrame:
    return stats.stage_view(_job_events(spark, sf))


def sync_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Lines all of whose words are timed, of all lines."""
    w = in_lines(events_as_words(spark, sf)).withColumn("timed", F.col("value") >= 20)
    l = w.groupBy("song", "line_no").agg(F.bool_and("timed").alias("done"))
    return l.groupBy("song").agg(F.count_if("done").alias("done"), F.count("*").alias("total"), F.bool_and("done").alias("complete"))


def instance_bounds(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf))
    return w.groupBy("song", "line_no").agg(F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), (F.max("end_ms") - F.min("begin_ms")).alias("duration"))


def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf)
    return w.groupBy("song").agg(F.round(F.sum(F.col("confidence") * F.length("kind")) / F.sum(F.length("kind")), 6).alias("score"))


def surest_word(spark: SparkSession, sf: str) -> DataFrame:
    return events_as_words(spark, sf).groupBy("song").agg(F.max_by("word_id", F.struct("confidence", (-F.col("word_id")).alias("k"))).alias("word_id"))


def script_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the words' lengths per kind."""
    w = events_as_words(spark, sf).withColumn("n", F.col("end_ms") - F.col("begin_ms"))
    g = w.groupBy("kind").agg(F.percentile("n", F.array(F.lit(0.5), F.lit(0.9))).alias("p"), F.avg((F.col("n") <= 100_000).cast("int")).alias("s"))
    return g.select("kind", F.round(F.col("p")[0], 3).alias("median"), F.round(F.col("p")[1], 3).alias("p90"), F.round("s", 6).alias("within"))


def judge_probability(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf)
    f = stats.judge_features(F.col("confidence"), F.col("value") / 100, F.lit(0.0), F.col("word_id") % 2 == 0, F.col("value") / 50)
    p = stats.logistic(f, [1.0, -0.8, -0.5, 0.7, -0.9], 2.0)
    return w.select("word_id", F.round(p, 6).alias("probability"), (p < stats.JUDGE_THRESHOLD).alias("flagged"))


def log_mean_exp(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").where("embedding is not null")
    both = F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda a, b: stats.log_mean_exp(a.cast("double"), b.cast("double")))
    return v.select("vec_id", F.round(F.aggregate(both, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def affine_stretch(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a line scaled by 1.25 about the line's begin."""
    w = in_lines(events_as_words(spark, sf))
    a = F.min("begin_ms").over(Window.partitionBy("song", "line_no"))
    w = w.withColumn("a", a)
    at = lambda c: (F.col("a") + F.floor((F.col(c) - F.col("a")) * 5 / 4)).cast("bigint")
    return w.select("word_id", at("begin_ms").alias("begin_ms"), at("end_ms").alias("end_ms"))


def proportional_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's words mapped into ten seconds."""
    l = Window.partitionBy("song", "line_no")
    w = in_lines(events_as_words(spark, sf)).withColumn("a", F.min("begin_ms").over(l)).withColumn("b", F.max("end_ms").over(l))
    return w.where("b > a").select("word_id", F.floor((F.col("begin_ms") - F.col("a")) * 10000 / (F.col("b") - F.col("a"))).cast("bigint").alias("at_ms"))


def shift_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """Words moved by -250 s, not below 0, from their song's first begin."""
    w = events_as_words(spark, sf)
    first = F.min("begin_ms").over(Window.partitionBy("song"))
    from ..operators import timing

    rel = w.withColumn("f", first).withColumn("begin_ms", F.col("begin_ms") - F.col("f")).withColumn("end_ms", F.col("end_ms") - F.col("f"))
    return timing.shifted(rel, F.lit(-250_000)).select("word_id", "begin_ms", "end_ms")


def sine_ease(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(F.sin(F.least(F.col("value") / 500, F.lit(1.0)) * F.pi() / 2), 6).alias("eased"))


def props_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("top"), F.count(k).alias("n"))


def flags_union(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of each song's words, each once, in order of name."""
    w = events_as_words(spark, sf)
    flags = F.array_union(F.array("kind"), F.when(F.col("value") > 400, F.array(F.lit("loud"))).otherwise(F.array().cast("array<string>")))
    g = w.select("song", F.explode(flags).alias("flag")).groupBy("song").agg(F.array_sort(F.collect_set("flag")).alias("f"))
    return g.select("song", F.array_join("f", ",").alias("flags"))


def map_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A map of languages where the later entry of a key wins."""
    d = table(spark, sf, "documents").groupBy("source").agg(F.max_by("doc_id", F.when(F.col("lang") == "en", F.col("doc_id"))).alias("en"), F.max_by("doc_id", F.when(F.col("lang") == "fr", F.col("doc_id"))).alias("fr"))
    a, b = F.create_map(F.lit("x"), F.lit(-1).cast("bigint"), F.lit("en"), F.lit(0).cast("bigint")), F.create_map(F.lit("en"), F.col("en"), F.lit("fr"), F.col("fr"))
    merged = F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    return d.select("source", merged["x"].alias("x"), merged["en"].alias("en"), merged["fr"].alias("fr"))


def rebuild_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns without every fifth, and a new line after every fourth, renumbered."""
    t = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("double").alias("pos"), "role")
    kept = t.where("pos % 5 <> 4")
    added = t.where("pos % 4 = 3").select("conv_id", (F.col("pos") + 0.5).alias("pos"), F.lit("added").alias("role"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1
    return kept.union(added).withColumn("line_no", n.cast("bigint")).select("conv_id", "line_no", "role")


def words_to_struct(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as arrays of word structs, as JSON."""
    w = in_lines(events_as_words(spark, sf))
    words = F.transform(F.sort_array(F.collect_list(F.struct("word_no", "kind", "begin_ms"))), lambda p: F.struct(p["kind"].alias("t"), p["begin_ms"].alias("b")))
    return w.groupBy("song", "line_no").agg(F.md5(F.to_json(words)).alias("digest"))


def strip_timing(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf))
    words = F.sort_array(F.collect_list(F.struct("word_no", "kind", "begin_ms")))
    bare = F.transform(words, lambda p: F.struct(p["kind"].alias("t"), F.lit(None).cast("bigint").alias("b")))
    g = w.groupBy("song", "line_no").agg(bare.alias("w"))
    return g.select("song", "line_no", F.size(F.filter("w", lambda p: p["b"].isNotNull())).cast("bigint").alias("timed"), F.array_join(F.transform("w", lambda p: p["t"]), " ").alias("text"))


def reply_json(spark: SparkSession, sf: str) -> DataFrame:
    """The outermost braces of a reply, parsed."""
    made = F.concat(F.lit("Sure! "), "props", F.lit(" done."))
    found = F.regexp_extract(made, r"(?s)\{.*\}", 0)
    return table(spark, sf, "events").select("event_id", F.from_json(found, "k bigint")["k"].alias("k"))


QUERIES = [
    positional_pairs, asof_nearest, asof_backward, interval_stab, overlap_semi, snap_band, identical_words, sibling_propagate, claim_text, decision_anti, line_respell, word_offset_mad,
    theil_sen, repeat_pattern, line_confidence, benchmark_metrics, macro_mean, threshold_sweep, rms_energy, energy_threshold, stage_view, sync_progress, instance_bounds, weighted_score,
    surest_word, script_shares, judge_probability, log_mean_exp, affine_stretch, proportional_remap, shift_clamp, sine_ease, props_json, flags_union, map_merge, rebuild_lines,
    words_to_struct, strip_timing, reply_json,
]

_NEAR = f"""WITH {WORDS_SQL}, c AS (SELECT * FROM words WHERE kind = 'click'), v AS (SELECT song, begin_ms AS p FROM words WHERE kind = 'view'),
  b AS (SELECT c.word_id, max(v.p) AS b FROM c JOIN v ON c.song = v.song AND v.p <= c.begin_ms GROUP BY 1), a AS (SELECT c.word_id, min(v.p) AS a FROM c JOIN v ON c.song = v.song AND v.p >= c.begin_ms GROUP BY 1),
  n AS (SELECT c.word_id, c.begin_ms, CASE WHEN b IS NULL THEN a WHEN a IS NULL OR a - c.begin_ms > c.begin_ms - b THEN b ELSE a END AS near FROM c LEFT JOIN b USING (word_id) LEFT JOIN a USING (word_id))"""
_ERR = f"""WITH {LINED_SQL}, e AS (SELECT song, line_no, CAST(floor(value - word_no * 10) AS BIGINT) AS error FROM lined
  ), m AS (SELECT *, error - median(error) OVER (PARTITION BY song) AS e FROM e
  ), d AS (SELECT song, max(d) AS worst_drift FROM (SELECT song, line_no, abs(median(e)) AS d FROM m GROUP BY song, line_no) q GROUP BY song
  ), s AS (SELECT song, avg(abs(e)) AS aae, avg((abs(e) <= 100)::INT) AS within_100, avg((abs(e) <= 300)::INT) AS within_300, count(*) AS words FROM m GROUP BY song)"""
_JOBS = "WITH j AS (SELECT user_id AS job, event_type AS stage, CASE WHEN value < 300 THEN 'running' WHEN value < 450 THEN 'done' ELSE 'failed' END AS status, epoch_us(ts) // 1000 AS at_ms, event_id FROM events)"

SQL = {
    "positional_pairs": "SELECT a.l_orderkey AS k, a.l_linenumber, a.l_quantity AS a_l_quantity, b.l_quantity AS b_l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey % 2 = 0 AND b.l_orderkey = a.l_orderkey + 1 AND a.l_linenumber = b.l_linenumber",
    "asof_nearest": _NEAR + " SELECT word_id, near FROM n",
    "asof_backward": f"""WITH {WORDS_SQL}, p AS (SELECT c.word_id, v.word_id AS v, row_number() OVER (PARTITION BY c.word_id ORDER BY v.begin_ms DESC, v.word_id DESC) AS k FROM words c LEFT JOIN words v ON v.kind = 'view' AND c.song = v.song AND v.begin_ms <= c.begin_ms WHERE c.kind = 'click')
      SELECT word_id, v AS as_of FROM p WHERE k = 1""",
    "interval_stab": f"WITH {WORDS_SQL} SELECT p.word_id AS point, s.word_id FROM words p JOIN words s ON p.kind = 'error' AND s.kind = 'view' AND p.song = s.song AND p.begin_ms >= s.begin_ms AND p.begin_ms < s.end_ms + 3600000",
    "overlap_semi": f"WITH {WORDS_SQL}, w AS (SELECT song, word_id, kind, begin_ms AS b, end_ms + 600000 AS e FROM words) SELECT word_id FROM w a WHERE kind = 'click' AND EXISTS (SELECT 1 FROM w p WHERE p.kind = 'purchase' AND p.song = a.song AND a.b < p.e AND a.e > p.b)",
    "snap_band": _NEAR + " SELECT word_id, near FROM n WHERE abs(near - begin_ms) <= 3600000",
    "identical_words": f"WITH {WORDS_SQL} SELECT word_id, count(*) OVER (PARTITION BY song, kind, floor(value)) - 1 AS others FROM words",
    "sibling_propagate": """WITH l AS (SELECT c_nationkey, arg_max(c_mktsegment, c_custkey) AS s FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1) SELECT c_custkey, c.c_nationkey, coalesce(s, c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN l ON c.c_nationkey = l.c_nationkey""",
    "claim_text": f"""WITH {WORDS_SQL}, n AS (SELECT song, kind, word_id, word_id % 2 AS odd, row_number() OVER (PARTITION BY song, kind, word_id % 2 ORDER BY word_id) AS n FROM words)
      SELECT a.word_id, b.word_id AS claimed FROM n a LEFT JOIN n b ON b.odd = 1 AND a.song = b.song AND a.kind = b.kind AND a.n = b.n WHERE a.odd = 0""",
    "decision_anti": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')",
    "line_respell": r"""WITH k AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), ' ')) AS w FROM benchmark),
      t AS (SELECT conv_id, turn, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), ' ')) AS w FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, count(*) AS n FROM t JOIN k USING (w) GROUP BY 1, 2""",
    "word_offset_mad": f"""WITH {WORDS_SQL}, d AS (SELECT song, CAST(floor(value * 10) AS BIGINT) AS d FROM words), m AS (SELECT song, d, median(d) OVER (PARTITION BY song) AS o, count(*) OVER (PARTITION BY song) AS n FROM d)
      SELECT song, any_value(o) AS "offset", median(abs(d - o)) AS spread, any_value(n) AS words FROM m WHERE n >= 10 GROUP BY song""",
    "theil_sen": f"""WITH {WORDS_SQL}, p AS (SELECT song, (pos * 4000)::DOUBLE AS x, (pos * 40 + floor(value))::DOUBLE AS y FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY begin_ms, word_id) - 1 AS pos FROM words) q
      ), s AS (SELECT a.song, median((b.y - a.y) / (b.x - a.x)) AS s FROM p a JOIN p b ON a.song = b.song AND b.x - a.x > 1000 GROUP BY a.song
      ), k AS (SELECT p.*, s.s, count(*) OVER w AS n, max(x) OVER w - min(x) OVER w AS span FROM p LEFT JOIN s ON p.song = s.song WINDOW w AS (PARTITION BY p.song)
      ), f AS (SELECT *, CASE WHEN n < 6 OR s IS NULL OR abs(s * span) <= 250 THEN 0.0 ELSE s END AS slope FROM k)
      SELECT song, round(any_value(slope), 9) AS slope, round(median(y - slope * x), 6) AS intercept FROM f GROUP BY song""",
    "repeat_pattern": f"""WITH {WORDS_SQL}, r AS (SELECT kind, song % 5 AS word_no, CAST(floor(value) + (song % 5) * 100 AS BIGINT) AS r FROM words WHERE CAST(floor(value) + (song % 5) * 100 AS BIGINT) % 10 > 2), m AS (SELECT *, median(r) OVER (PARTITION BY kind, word_no) AS p, count(*) OVER (PARTITION BY kind, word_no) AS n FROM r
      ), k AS (SELECT *, max(abs(r - p)) OVER (PARTITION BY kind) AS worst FROM m) SELECT kind, word_no, any_value(p) AS pattern, any_value(n) AS repeats FROM k WHERE worst <= 480 GROUP BY kind, word_no""",
    "line_confidence": f"WITH {LINED_SQL} SELECT song, line_no, round(CASE WHEN bool_and(value >= 5) THEN avg(confidence) ELSE 0 END, 9) AS confidence, round(avg((confidence < 0.2)::INT), 9) AS doubtful FROM lined GROUP BY song, line_no",
    "benchmark_metrics": _ERR + " SELECT s.song, round(aae, 6) AS aae, round(within_100, 6) AS within_100, round(within_300, 6) AS within_300, words, worst_drift FROM s JOIN d ON s.song = d.song",
    "macro_mean": _ERR + " SELECT round(avg(aae), 6) AS aae, round(avg(within_100), 6) AS within_100, round(avg(worst_drift), 6) AS worst_drift FROM s JOIN d ON s.song = d.song",
    "threshold_sweep": """WITH d AS (SELECT (doc_id * 7919 % 1000) / 1000 AS score, quality FROM labels), t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.92])::DOUBLE AS threshold)
      SELECT threshold, count(*) FILTER (score < threshold) AS flagged, count(*) FILTER (score < threshold AND quality = 0) AS caught, round(count(*) FILTER (score < threshold) / count(*), 6) AS share,
        round(count(*) FILTER (score < threshold AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0), 6) AS recall, round(count(*) FILTER (score < threshold AND quality = 0) / nullif(count(*) FILTER (score < threshold), 0), 6) AS precision FROM d, t GROUP BY threshold""",
    "rms_energy": "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, CAST(i // 16 AS BIGINT) AS hop, round(sqrt(avg(x * x)), 5) AS rms FROM v GROUP BY 1, 2",
    "energy_threshold": "SELECT user_id, round(quantile_cont(value, 0.95) * 0.06, 6) AS threshold FROM events GROUP BY user_id",
    "stage_view": _JOBS + """, r AS (SELECT *, row_number() OVER (PARTITION BY job, stage ORDER BY at_ms DESC, event_id DESC) AS k FROM j)
      SELECT job, stage, any_value(status) FILTER (k = 1) AS last_status, min(at_ms) AS started, min(CASE WHEN status <> 'running' THEN at_ms END) AS ended, count(*) AS events, min(CASE WHEN status <> 'running' THEN at_ms END) - min(at_ms) AS took FROM r GROUP BY job, stage""",
    "sync_progress": f"WITH {LINED_SQL}, l AS (SELECT song, line_no, bool_and(value >= 20) AS done FROM lined GROUP BY song, line_no) SELECT song, count(*) FILTER (done) AS done, count(*) AS total, bool_and(done) AS complete FROM l GROUP BY song",
    "instance_bounds": f"WITH {LINED_SQL} SELECT song, line_no, min(begin_ms) AS begin_ms, max(end_ms) AS end_ms, max(end_ms) - min(begin_ms) AS duration FROM lined GROUP BY song, line_no",
    "weighted_score": f"WITH {WORDS_SQL} SELECT song, round(sum(confidence * length(kind)) / sum(length(kind)), 6) AS score FROM words GROUP BY song",
    "surest_word": f"WITH {WORDS_SQL} SELECT song, word_id FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY confidence DESC, word_id) AS k FROM words) q WHERE k = 1",
    "script_shares": f"WITH {WORDS_SQL}, n AS (SELECT kind, end_ms - begin_ms AS n FROM words) SELECT kind, round(quantile_cont(n, 0.5), 3) AS median, round(quantile_cont(n, 0.9), 3) AS p90, round(avg((n <= 100000)::INT), 6) AS within FROM n GROUP BY kind",
    "judge_probability": f"""WITH {WORDS_SQL}, z AS (SELECT word_id, 1 / (1 + exp(-(2.0::DOUBLE + ln(greatest(confidence, 1e-4)) - 0.8 * least(value / 100, 3.0) + 0.7 * (word_id % 2 = 0)::INT - 0.9 * abs(ln(greatest(value / 50, 1e-2)))))) AS p FROM words)
      SELECT word_id, round(p, 6) AS probability, p < 0.92 AS flagged FROM z""",
    "log_mean_exp": """WITH v AS (SELECT vec_id, unnest(embedding[1:32])::DOUBLE AS a, unnest(embedding[33:64])::DOUBLE AS b FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, round(sum(greatest(a, b) + ln(1 + exp(-abs(a - b))) - ln(2.0)), 5) AS total FROM v GROUP BY vec_id""",
    "affine_stretch": f"WITH {LINED_SQL}, a AS (SELECT *, min(begin_ms) OVER (PARTITION BY song, line_no) AS a FROM lined) SELECT word_id, a + (begin_ms - a) * 5 // 4 AS begin_ms, a + (end_ms - a) * 5 // 4 AS end_ms FROM a",
    "proportional_remap": f"WITH {LINED_SQL}, a AS (SELECT *, min(begin_ms) OVER l AS a, max(end_ms) OVER l AS b FROM lined WINDOW l AS (PARTITION BY song, line_no)) SELECT word_id, CAST(floor(CAST((begin_ms - a) * 10000 AS DOUBLE) / (b - a)) AS BIGINT) AS at_ms FROM a WHERE b > a",
    "shift_clamp": f"WITH {WORDS_SQL}, f AS (SELECT *, min(begin_ms) OVER (PARTITION BY song) AS f FROM words) SELECT word_id, greatest(0, begin_ms - f - 250000) AS begin_ms, greatest(0, end_ms - f - 250000) AS end_ms FROM f",
    "sine_ease": "SELECT event_id, round(sin(least(value / 500, 1.0) * pi() / 2), 6) AS eased FROM events",
    "props_json": "SELECT event_type, sum(k)::BIGINT AS total, max(k) AS top, count(k) AS n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) q GROUP BY event_type",
    "flags_union": f"""WITH {WORDS_SQL}, f AS (SELECT DISTINCT song, kind AS flag FROM words UNION SELECT DISTINCT song, 'loud' FROM words WHERE value > 400) SELECT song, string_agg(flag, ',' ORDER BY flag) AS flags FROM f GROUP BY song""",
    "map_merge": "SELECT source, -1 AS x, max(CASE WHEN lang = 'en' THEN doc_id END) AS en, max(CASE WHEN lang = 'fr' THEN doc_id END) AS fr FROM documents GROUP BY source",
    "rebuild_lines": """WITH r AS (SELECT conv_id, turn::DOUBLE AS pos, role FROM conversations WHERE turn % 5 <> 4 UNION ALL SELECT conv_id, turn + 0.5, 'added' FROM conversations WHERE turn % 4 = 3) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS line_no, role FROM r""",
    "words_to_struct": f"""WITH {LINED_SQL} SELECT song, line_no, md5('[' || string_agg('{{"t":"' || kind || '","b":' || begin_ms || '}}', ',' ORDER BY word_no) || ']') AS digest FROM lined GROUP BY song, line_no""",
    "strip_timing": f"WITH {LINED_SQL} SELECT song, line_no, 0 AS timed, string_agg(kind, ' ' ORDER BY word_no) AS text FROM lined GROUP BY song, line_no",
    "reply_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}

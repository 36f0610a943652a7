"""Registered queries: matches with truth, frames and templates, on ``events`` as songs, ``embeddings`` as frames and ``part`` as uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import matches, shapes, stats
from ..schema import SONG_SQL, WORDS_SQL, events_as_words, song_words, table


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Songs as an aligner gives them: begins moved, every fifth line without its last word."""
    w = song_words(spark, sf)
    last = F.max("word_no").over(Window.partitionBy("song", "line_no", "track"))
    w = w.withColumn("last", last).where("not (line_no % 5 = 2 and word_no = last)").drop("last")
    return w.withColumn("begin_ms", F.col("begin_ms") + F.col("word_id") % 13 * 50 - 100)


def truth_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs, missing = matches.truth_pairs(song_words(spark, sf), _aligned(spark, sf))
    counted = pairs.groupBy("song").agg(F.count("*").alias("paired"), F.count("error").alias("timed"), F.sum("error").cast("bigint").alias("error"))
    return counted.join(missing.groupBy("song").agg(F.count("*").alias("missing")), "song", "left").select("song", "paired", "timed", "error", F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"))


def syllable_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = matches.syllable_errors(song_words(spark, sf), _aligned(spark, sf))
    total = F.aggregate("errors", F.lit(0.0), lambda s, x: s + x)
    return e.groupBy("song").agg(F.count("*").alias("split_words"), F.count_if("matched").alias("split_matched"), F.round(F.sum(total) / F.sum(F.size("errors")), 6).alias("aae"))


def evidence_labels(spark: SparkSession, sf: str) -> DataFrame:
    return matches.evidence_labels(_aligned(spark, sf), song_words(spark, sf)).select("word_id", "right")


def length_join(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads of even number with the lyrics of odd number of the same brand that are closest in length, within two seconds."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return matches.closest_within(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_brand", "p_retailprice", "p_partkey", 2.0).select("p_partkey", "match")


def voiced_near(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf).select("song", F.col("word_id").alias("frame"), (F.col("value") >= 100).alias("voiced"))
    return matches.voiced_near(w, 2).select("frame", "near")


def notes_inside(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).where("begin_ms is not null")
    notes = w.where("track = 'bg'").select("song", F.col("begin_ms").alias("at"))
    return matches.notes_inside(w, notes, "word_id").select("word_id", "notes")


def combined_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as frames of one stem, the next vector of the label as the other's."""
    v = table(spark, sf, "embeddings").where("embedding is not null and label is not null").select(F.col("label").alias("song"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double") - 1).alias("logp"))
    other = v.withColumn("frame", F.col("frame") - 10)
    out = matches.combined_stems(v, other, ("song", "frame"), "logp")
    return out.select("song", "frame", F.round(F.aggregate("logp", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def boundary_target(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).where("begin_ms is not null")
    edges = w.where("track = 'bg'").select("song", "word_id", (F.col("begin_ms") + 700).alias("at")).withColumnRenamed("word_id", "edge")
    return matches.boundary_target(edges, w.where("track = 'main'"), "edge").select("edge", "target", "inside")


def template_matches(spark: SparkSession, sf: str) -> DataFrame:
    k = shapes.block_fingerprints(shapes.structure_key(song_words(spark, sf)), 1)
    blocks = k.where("line_no % 2 = 1").select("song", "line_no", "block")
    return matches.template_matches(blocks, k.where("line_no % 2 = 0").select("song", "block", F.col("line_no").alias("instance"))).select("song", "line_no", "instance")


def song_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Median of the lines' median offsets."""
    w = song_words(spark, sf).withColumn("offset", F.floor(F.col("confidence") * 1000))
    lines = w.groupBy("song", "line_no").agg(F.median("offset").alias("offset"))
    return lines.groupBy("song").agg(F.median("offset").alias("offset"))


def report_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    pairs, _ = matches.truth_pairs(song_words(spark, sf), _aligned(spark, sf))
    e = pairs.where("error is not null").select("song", F.abs("error").alias("e"))
    return e.groupBy("song").agg(F.median("e").alias("median"), F.percentile("e", F.lit(0.9)).alias("p90"), F.avg((F.col("e") < 250).cast("int")).alias("within_250"), F.avg((F.col("e") < 500).cast("int")).alias("within_500"))


def judge_features(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf)
    f = stats.judge_features(F.col("confidence"), F.col("value") / 20, F.col("value") / 50 - 1, F.col("word_id") % 2 == 0, F.col("value") / 30)
    return w.select("word_id", *[F.round(c, 9).alias(f"f{i}") for i, c in enumerate(f)])


def best_hearing(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of each song with the best mean score; kinds without words score -1."""
    kinds = events_as_words(spark, sf).select("kind").distinct()
    songs = events_as_words(spark, sf).select("song").distinct().withColumn("n", F.lit(1))
    scores = events_as_words(spark, sf).groupBy("song", "kind").agg(F.avg("confidence").alias("score"))
    every = songs.join(F.broadcast(kinds.withColumn("n", F.lit(1))), "n").join(scores, ["song", "kind"], "left")  # five kinds, whatever the data
    best = F.max_by(F.struct("kind", F.coalesce("score", F.lit(-1.0)).alias("s")), F.struct(F.coalesce("score", F.lit(-1.0)), "kind"))
    return every.groupBy("song").agg(best.alias("b")).select("song", F.col("b.kind").alias("kind"), F.round("b.s", 9).alias("score"))


def best_timed_file(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source and language the document whose timing is finest, chosen before anything of it is fetched."""
    d = table(spark, sf, "documents").where("lang is not null")
    return d.groupBy("source", "lang").agg(F.max_by("doc_id", F.struct(F.col("doc_id") % 4, -F.col("doc_id"))).alias("doc_id"))


def single_words(spark: SparkSession, sf: str) -> DataFrame:
    w = song_words(spark, sf).where("begin_ms is not null").withColumn("text", F.when(F.col("word_id") % 4 == 0, F.concat("text", F.lit("and more"))).otherwise(F.col("text")))
    return matches.single_words(w).select("word_id", F.col("piece").cast("bigint").alias("piece"), "text", "begin_ms", "end_ms")


def inherited_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = shapes.syllable_groups(song_words(spark, sf))
    after = F.lead("group_no").over(Window.partitionBy("song", "line_no", "track").orderBy("word_no"))
    return g.withColumn("after", after).select("word_id", matches.inherited_group(F.col("group_no"), F.col("after")).alias("group_no"))


QUERIES = [
    truth_pairs, syllable_errors, evidence_labels, length_join, voiced_near, notes_inside, combined_stems, boundary_target, template_matches, song_offset, report_percentiles, judge_features,
    best_hearing, best_timed_file, single_words, inherited_groups,
]

_G = """{0}g AS (SELECT *, coalesce(sum((text LIKE '% ')::INT) OVER (PARTITION BY song, line_no, track ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM {1}),
  {0}u AS (SELECT song, line_no, track, grp, count(*) AS n, arg_min(coalesce(begin_ms, -9999999), word_no) AS b, list(begin_ms ORDER BY word_no) AS begins, bool_and(begin_ms IS NOT NULL) AS whole FROM {0}g GROUP BY 1, 2, 3, 4)"""
_ALIGNED = f"""WITH {SONG_SQL}, al AS (SELECT song, line_no, track, word_no, word_id, text, end_ms, begin_ms + word_id % 13 * 50 - 100 AS begin_ms FROM (SELECT *, max(word_no) OVER (PARTITION BY song, line_no, track) AS last FROM sw) q WHERE NOT (line_no % 5 = 2 AND word_no = last)),
  {_G.format('t', 'sw')}, {_G.format('a', 'al')}, p AS (SELECT tu.song, au.song IS NOT NULL AS hit, CASE WHEN tu.b > -9999999 AND au.b > -9999999 THEN au.b - tu.b END AS error FROM tu LEFT JOIN au ON au.song = tu.song AND au.line_no = tu.line_no AND au.track = tu.track AND au.grp = tu.grp)"""

SQL = {
    "truth_pairs": f"{_ALIGNED} SELECT song, count(*) FILTER (hit) AS paired, count(error) AS timed, sum(error)::BIGINT AS error, count(*) FILTER (NOT hit) AS missing FROM p GROUP BY song HAVING count(*) FILTER (hit) > 0",
    "syllable_errors": f"""{_ALIGNED}, tn AS (SELECT *, count(*) OVER (PARTITION BY song, line_no, track) AS k FROM tu), an AS (SELECT *, count(*) OVER (PARTITION BY song, line_no, track) AS k FROM au
      ), m AS (SELECT t.song, t.n = a.n AND t.whole AND a.whole AS ok, CASE WHEN t.n = a.n AND t.whole AND a.whole THEN list_transform(range(2, t.n + 1), lambda i: abs(a.begins[i] - t.begins[i])) END AS errs FROM tn t JOIN an a ON a.song = t.song AND a.line_no = t.line_no AND a.track = t.track AND a.grp = t.grp AND a.k = t.k WHERE t.n > 1)
      SELECT song, count(*) AS split_words, count(*) FILTER (ok) AS split_matched, round(sum(list_sum(errs)) / sum(len(errs)), 6)::DOUBLE AS aae FROM m GROUP BY song""",
    "evidence_labels": f"""{_ALIGNED}, x AS (SELECT *, count(*) OVER (PARTITION BY song, line_no, track) AS k FROM sw), y AS (SELECT *, count(*) OVER (PARTITION BY song, line_no, track) AS k FROM al)
      SELECT y.word_id, abs(y.begin_ms - x.begin_ms) <= 300 AS "right" FROM y JOIN x ON x.song = y.song AND x.line_no = y.line_no AND x.track = y.track AND x.word_no = y.word_no AND x.k = y.k WHERE x.begin_ms IS NOT NULL AND y.begin_ms IS NOT NULL""",
    "length_join": """SELECT a.p_partkey, arg_min(b.p_partkey, (abs(a.p_retailprice - b.p_retailprice), b.p_partkey)) AS match FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_retailprice - b.p_retailprice) <= 2 WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 GROUP BY 1""",
    "voiced_near": f"WITH {WORDS_SQL} SELECT word_id AS frame, bool_or(value >= 100) OVER (PARTITION BY song ORDER BY word_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM words",
    "notes_inside": f"WITH {SONG_SQL} SELECT w.word_id, (SELECT count(*) FROM sw n WHERE n.song = w.song AND n.track = 'bg' AND n.begin_ms > w.begin_ms AND n.begin_ms < w.end_ms) AS notes FROM sw w WHERE w.begin_ms IS NOT NULL",
    "combined_stems": """WITH v AS (SELECT label, vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)
      SELECT a.label AS song, a.vec_id AS frame, round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: ln((exp(a.e[i]::DOUBLE - 1) + exp(b.e[i]::DOUBLE - 1)) / 2))), 6) AS total FROM v a JOIN v b ON a.label = b.label AND b.vec_id = a.vec_id + 10""",
    "boundary_target": f"""WITH {SONG_SQL}, m AS (SELECT * FROM sw WHERE track = 'main' AND begin_ms IS NOT NULL), e AS (SELECT song, word_id AS edge, begin_ms + 700 AS p FROM sw WHERE track = 'bg' AND begin_ms IS NOT NULL
      ), j AS (SELECT e.edge, m.word_id, m.begin_ms, m.end_ms > e.p AND m.begin_ms <= e.p AS held, abs(m.begin_ms - e.p) AS d FROM e LEFT JOIN m ON m.song = e.song)
      SELECT edge, coalesce(arg_max(word_id, (begin_ms, -word_id)) FILTER (held), arg_min(word_id, (d, -begin_ms, word_id))) AS target, coalesce(bool_or(held), false) AS inside FROM j GROUP BY edge""",
    "template_matches": f"""WITH {SONG_SQL}, m AS (SELECT *, max(word_no) OVER (PARTITION BY song, line_no, track) AS last FROM sw), t AS (SELECT song, line_no, track, trim(string_agg(text || CASE WHEN word_no < last AND text NOT LIKE '% ' THEN '|' ELSE '' END, '' ORDER BY word_no), ' ') AS text FROM m GROUP BY 1, 2, 3
      ), s AS (SELECT song, line_no, string_agg(track || chr(1) || text, chr(2) ORDER BY track || chr(1) || text) AS k FROM t GROUP BY 1, 2)
      SELECT a.song, a.line_no, min(b.line_no) AS instance FROM s a JOIN s b ON a.song = b.song AND a.k = b.k WHERE a.line_no % 2 = 1 AND b.line_no % 2 = 0 GROUP BY 1, 2""",
    "song_offset": f"WITH {SONG_SQL}, l AS (SELECT song, line_no, median(floor(confidence * 1000)) AS m FROM sw GROUP BY 1, 2) SELECT song, median(m) AS offset FROM l GROUP BY song",
    "report_percentiles": f"{_ALIGNED}, e AS (SELECT song, abs(error) AS e FROM p WHERE error IS NOT NULL) SELECT song, median(e) AS median, quantile_cont(e, 0.9) AS p90, avg((e < 250)::INT) AS within_250, avg((e < 500)::INT) AS within_500 FROM e GROUP BY song",
    "judge_features": f"WITH {WORDS_SQL} SELECT word_id, round(ln(greatest(confidence, 1e-4)), 9) AS f0, round(least(value / 20, 3), 9) AS f1, round(least(value / 50 - 1, 3), 9) AS f2, (word_id % 2 = 0)::DOUBLE AS f3, round(abs(ln(greatest(value / 30, 1e-2))), 9) AS f4 FROM words",
    "best_hearing": f"""WITH {WORDS_SQL}, s AS (SELECT song, kind, avg(confidence) AS score FROM words GROUP BY 1, 2) SELECT song, arg_max(kind, (score, kind)) AS kind, round(max(score), 9) AS score FROM s GROUP BY song""",
    "best_timed_file": "SELECT source, lang, arg_max(doc_id, (doc_id % 4, -doc_id)) AS doc_id FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2",
    "single_words": f"""WITH {SONG_SQL}, w AS (SELECT word_id, begin_ms, end_ms, CASE WHEN word_id % 4 = 0 THEN text || 'and more' ELSE text END AS t FROM sw WHERE begin_ms IS NOT NULL
      ), p AS (SELECT *, unnest(regexp_extract_all(t, '\\S+\\s*')) AS text, generate_subscripts(regexp_extract_all(t, '\\S+\\s*'), 1) - 1 AS piece FROM w
      ), s AS (SELECT *, sum(length(text)) OVER (PARTITION BY word_id ORDER BY piece) AS upto FROM p)
      SELECT word_id, piece, text, (begin_ms + (end_ms - begin_ms) * (upto - length(text)) // length(t))::BIGINT AS begin_ms, (begin_ms + (end_ms - begin_ms) * upto // length(t))::BIGINT AS end_ms FROM s""",
    "inherited_groups": f"""WITH {SONG_SQL}, {_G.format('t', 'sw')}, n AS (SELECT word_id, grp, lead(grp) OVER (PARTITION BY song, line_no, track ORDER BY word_no) AS nx FROM tg) SELECT word_id, CASE WHEN grp = nx THEN grp::INT END AS group_no FROM n""",
}

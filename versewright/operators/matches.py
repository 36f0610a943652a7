"""Matches of aligned output with truth, frames with words and templates with candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shapes import LINE, TRACK, syllable_groups


def whole_words(words: DataFrame) -> DataFrame:
    """Syllables merged into words: ``word_at`` is the place among the line's words of a track."""
    parts = F.sort_array(F.collect_list(F.struct("word_no", "text", "begin_ms", "end_ms")))
    g = syllable_groups(words).groupBy(*TRACK, "group_no").agg(parts.alias("_p"))
    g = g.select(*TRACK, F.col("group_no").alias("word_at"), F.size("_p").alias("pieces"), F.trim(F.array_join(F.transform("_p", lambda p: p["text"]), "")).alias("text"), F.col("_p")[0]["begin_ms"].alias("begin_ms"), F.element_at("_p", -1)["end_ms"].alias("end_ms"), F.transform("_p", lambda p: p["begin_ms"]).alias("begins"))
    return g


def truth_pairs(truth: DataFrame, aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole words of both sides at the same place, and the true words that have no partner."""
    t, a = whole_words(truth), whole_words(aligned)
    key = [*TRACK, "word_at"]
    pairs = t.select(*key, F.col("begin_ms").alias("true_ms")).join(a.select(*key, F.col("begin_ms").alias("aligned_ms")), key)
    return pairs.withColumn("error", F.col("aligned_ms") - F.col("true_ms")), t.join(a.select(*key), key, "left_anti")


def syllable_errors(truth: DataFrame, aligned: DataFrame) -> DataFrame:
    """Start errors of inner syllables: only in lines with equally many words on both sides, of words that both split into equally many timed pieces."""
    t, a = whole_words(truth), whole_words(aligned)
    count = F.count("*").over(Window.partitionBy(*TRACK))
    t, a = t.withColumn("_n", count), a.withColumn("_n", count)
    met = t.select(*TRACK, "word_at", "_n", "pieces", "begins").join(a.select(*TRACK, "word_at", "_n", F.col("pieces").alias("_pieces"), F.col("begins").alias("_begins")), [*TRACK, "word_at", "_n"])
    split = met.where("pieces > 1")
    timed = lambda c: F.forall(c, lambda x: x.isNotNull())
    matched = (F.col("pieces") == F.col("_pieces")) & timed("begins") & timed("_begins")
    each = split.withColumn("matched", matched)
    errors = F.when(F.col("matched"), F.transform(F.slice(F.zip_with("begins", "_begins", lambda x, y: F.abs(y - x)), F.lit(2), F.col("pieces") - 1), lambda e: e.cast("double")))
    return each.withColumn("errors", errors).select(*TRACK, "word_at", "matched", "errors")


def evidence_labels(evidence: DataFrame, truth: DataFrame, right_ms: int = 300) -> DataFrame:
    """Evidence of aligned words with ``right``: whether the true begin is within ``right_ms``; lines whose word counts differ are left out."""
    count = F.count("*").over(Window.partitionBy(*TRACK))
    e, t = evidence.withColumn("_n", count), truth.withColumn("_n", count).select(*TRACK, "word_no", "_n", F.col("begin_ms").alias("true_ms"))
    met = e.join(t, [*TRACK, "word_no", "_n"]).where("true_ms is not null and begin_ms is not null")
    return met.withColumn("right", F.abs(F.col("begin_ms") - F.col("true_ms")) <= right_ms).drop("_n")


def closest_within(left: DataFrame, right: DataFrame, by: str, value: str, unique: str, within: float) -> DataFrame:
    """Each left row with the closest right row of its key at most ``within`` apart; ties go to the smallest ``unique``.

    No pairs are made: right rows of one value are one mark, marks are listed under the buckets
    of values that they reach, and in a bucket two sorts with running values carry the last
    mark below and above along.
    """
    bucket = lambda v: F.floor(v / (8 * within))
    reach = within * (1 + 1e-9)
    marks = right.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.min(unique).alias("_u"))
    marks = marks.withColumn("_k", F.explode(F.sequence(bucket(F.col("_v") - reach), bucket(F.col("_v") + reach))))
    rows = left.distinct().where(F.col(by).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(by).alias("_by"), F.col(value).alias("_v"), bucket(F.col(value)).alias("_k"), F.struct(*left.columns).alias("_row"))
    line = rows.unionByName(marks, allowMissingColumns=True)
    mark = F.when(F.col("_row").isNull(), F.struct("_v", "_u"))
    near = lambda order: F.last(mark, ignorenulls=True).over(Window.partitionBy("_by", "_k").orderBy(order, F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    line = line.withColumns({"_below": near(F.asc("_v")), "_above": near(F.desc("_v"))}).where("_row is not null")
    apart = lambda m: F.when(F.col(m).isNotNull(), F.struct(F.abs(F.col("_v") - F.col(f"{m}._v")).alias("apart"), F.col(f"{m}._u").alias("match")))
    met = line.select("_row", F.least(apart("_below"), apart("_above")).alias("_m")).where(F.col("_m.apart") <= within)
    return met.select("_row.*", "_m.match", "_m.apart")


def voiced_near(frames: DataFrame, reach: int, by: str = "song", at: str = "frame") -> DataFrame:
    """Frames with ``near``: whether any frame within ``reach`` of them is voiced."""
    w = Window.partitionBy(by).orderBy(at).rowsBetween(-reach, reach)
    return frames.withColumn("near", F.max("voiced").over(w))


def notes_inside(spans: DataFrame, notes: DataFrame, unique: str, by: str = "song", bucket: int = 4096) -> DataFrame:
    """How many note starts lie strictly inside each span; a join on (song, bucket of time), combined before its last shuffle."""
    s = spans.where("end_ms > begin_ms").withColumn("_k", F.explode(F.sequence(F.floor(F.col("begin_ms") / bucket), F.floor(F.col("end_ms") / bucket))))
    n = notes.groupBy(F.col(by), F.col("at")).agg(F.count("*").alias("_c")).withColumn("_k", F.floor(F.col("at") / bucket))
    hits = s.join(n, [by, "_k"]).where((F.col("at") > F.col("begin_ms")) & (F.col("at") < F.col("end_ms"))).groupBy(unique).agg(F.sum("_c").alias("notes"))
    return spans.join(hits, unique, "left").withColumn("notes", F.coalesce("notes", F.lit(0)).cast("bigint"))


def combined_stems(a: DataFrame, b: DataFrame, keys: tuple[str, ...], logp: str) -> DataFrame:
    """Two matrices of log-probabilities, frame by frame: the logarithm of the mean probability; frames only one has are left out."""
    met = a.select(*keys, F.col(logp).alias("_a")).join(b.select(*keys, F.col(logp).alias("_b")), list(keys))
    mean = F.zip_with("_a", "_b", lambda x, y: F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))) - F.ln(F.lit(2.0)))
    return met.select(*keys, mean.alias(logp))


def boundary_target(edges: DataFrame, words: DataFrame, unique: str, bucket: int = 4096) -> DataFrame:
    """The word whose boundary an edge (song, at) moves: the latest that contains it, else the nearest begin; ties go to the smaller word.

    Containment is a join on (song, bucket); nearness one sort with running
    values over both sides.
    """
    from .joins import interval_stab, nearest

    inside = interval_stab(edges, words.select("song", F.col("word_id").alias("_w"), F.col("begin_ms").alias("_b"), F.col("end_ms").alias("_e")), "at", "_b", "_e", bucket=bucket)
    held = inside.groupBy(unique).agg(F.max(F.struct(F.col("_b"), (-F.col("_w")).alias("_w"))).alias("_in")).select(unique, (-F.col("_in._w")).alias("held"))
    near = nearest(edges, words.select("song", "begin_ms"), "at", "begin_ms").join(words.groupBy("song", F.col("begin_ms").alias("near")).agg(F.min("word_id").alias("_near")), ["song", "near"], "left")
    return near.join(held, unique, "left").withColumns({"target": F.coalesce("held", "_near"), "inside": F.col("held").isNotNull()}).drop("held", "_near", "near")


def template_matches(blocks: DataFrame, instances: DataFrame) -> DataFrame:
    """Candidate blocks (song, block key) with the first instance of a group that has the same structure."""
    first = instances.groupBy("song", "block").agg(F.min("instance").alias("instance"))
    return blocks.join(first, ["song", "block"])


def single_words(words: DataFrame) -> DataFrame:
    """Words that hold several words cut at their spaces, times shared by length of the pieces with their space."""
    pieces = F.regexp_extract_all("text", F.lit(r"\S+\s*"), 0)
    w = words.withColumns({"_p": pieces, "_total": F.length(F.ltrim("text"))}).select(*words.columns, "_total", F.posexplode("_p").alias("piece", "part"), "_p")
    before = F.aggregate(F.slice("_p", F.lit(1), F.col("piece")), F.lit(0), lambda s, x: s + F.length(x))
    span = F.col("end_ms") - F.col("begin_ms")
    at = lambda n: F.col("begin_ms") + F.floor(span * n / F.col("_total"))
    out = w.withColumns({"_b": at(before), "_e": at(before + F.length("part"))})
    return out.withColumns({"text": F.col("part"), "begin_ms": F.col("_b"), "end_ms": F.col("_e")}).drop("_p", "_total", "part", "_b", "_e")


def inherited_group(before: Column, after: Column) -> Column:
    """The syllable group of a word put between two others: theirs if both have the same one."""
    return F.when(before == after, before)

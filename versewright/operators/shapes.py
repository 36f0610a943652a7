"""Projections and predicates of lines and words: text, timing shape, templates, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE, TRACK = ("song", "line_no"), ("song", "line_no", "track")
#: Flags that send a word to review; voices shown on the opposite side.
REVIEW_FLAGS = ("low-confidence", "interpolated", "reanchored", "overlap", "big-gap", "too-long", "too-short", "past-end", "out-of-order", "llm-edit", "llm-insert", "llm-note")
OPPOSITE = ("v2", "v2000")
EPSILON_MS = 0.1


def joined(words: DataFrame, by: tuple[str, ...], order: str = "word_no", text: str = "text", mark: str = "") -> DataFrame:
    """Text of each group of words in order, trimmed; ``mark`` stands where a word runs on without a space."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    last = F.size("_p") - 1
    piece = F.transform("_p", lambda p, i: F.concat(p["t"], F.when((i < last) & ~F.endswith(p["t"], F.lit(" ")), F.lit(mark)).otherwise("")))
    return words.groupBy(*by).agg(parts.alias("_p")).select(*by, F.trim(F.array_join(piece, "")).alias("text"))


def displays(words: DataFrame) -> DataFrame:
    """Each line as shown: the main words, then the background in brackets."""
    texts = joined(words, TRACK)
    side = lambda t: F.max(F.when(F.col("track") == t, F.nullif(F.col("text"), F.lit(""))))
    both = texts.groupBy(*LINE).agg(side("main").alias("_m"), side("bg").alias("_b"))
    return both.select(*LINE, F.concat_ws(" ", "_m", F.concat(F.lit("("), "_b", F.lit(")"))).alias("display"))


def plain_text(words: DataFrame) -> DataFrame:
    """A song's lines as shown, one under another."""
    lines = F.sort_array(F.collect_list(F.struct("line_no", "display")))
    return displays(words).groupBy("song").agg(F.array_join(F.transform(lines, lambda x: x["display"]), "\n").alias("text"))


def flattened(words: DataFrame) -> DataFrame:
    """Words with their ``place`` in the song: line by line, main words before background."""
    order = Window.partitionBy("song").orderBy("line_no", F.desc("track"), "word_no")
    return words.withColumn("place", F.row_number().over(order) - 1)


def timed(prefix: str = "") -> Column:
    return F.col(f"{prefix}begin_ms").isNotNull() & F.col(f"{prefix}end_ms").isNotNull()


def with_shape(lines: DataFrame) -> DataFrame:
    """Lines (text, n_words, n_background, begin_ms, end_ms) with their shape; words win over the line's own times, which are dropped then."""
    word_synced = F.col("n_words") > 0
    line_synced = ~word_synced & timed()
    return lines.withColumns({
        "word_synced": word_synced,
        "line_synced": line_synced,
        "any_timing": word_synced | line_synced | (F.col("n_background") > 0),
        "has_main": F.length(F.trim(F.regexp_replace("text", r"\|", ""))) > 0,
        "source": F.when(word_synced, "words").when(line_synced, "line").otherwise("none"),
        "n_effective": F.when(word_synced, F.col("n_words")).when(line_synced, 1).otherwise(0),
        "begin_ms": F.when(~word_synced, F.col("begin_ms")),
        "end_ms": F.when(~word_synced, F.col("end_ms")),
    })


def relative(words: DataFrame, instance: tuple[str, ...]) -> DataFrame:
    """Times from the instance's first begin, and the ``template_ms`` they span."""
    first = words.groupBy(*instance).agg(F.min("begin_ms").alias("_f"), (F.max("end_ms") - F.min("begin_ms")).alias("template_ms"))
    return words.join(first, list(instance)).withColumns({"rel_begin": F.col("begin_ms") - F.col("_f"), "rel_end": F.col("end_ms") - F.col("_f")}).drop("_f")


def clamped_shift(words: DataFrame, group: tuple[str, ...], delta: int) -> DataFrame:
    """A group's shift, stopped where its earliest begin reaches zero."""
    return words.groupBy(*group).agg(F.greatest(F.lit(delta), -F.min("begin_ms")).alias("delta"))


def needs_review(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(x) for x in REVIEW_FLAGS]))


def heard_words(words: DataFrame, offset_ms: int, least_ms: int = 20) -> DataFrame:
    """Words of a transcriber without ghosts: empty, untimed or shorter than ``least_ms``; times are moved by ``offset_ms``."""
    kept = words.where((F.trim("text") != "") & timed() & (F.col("end_ms") - F.col("begin_ms") >= least_ms))
    return kept.withColumns({c: F.col(c) + offset_ms for c in ("begin_ms", "end_ms")})


def structure_key(words: DataFrame) -> DataFrame:
    """A key per line that is equal for lines with the same texts on both tracks, whatever their times."""
    texts = joined(words, TRACK, mark="|")
    parts = F.sort_array(F.collect_list(F.concat_ws("\x01", "track", "text")))
    return texts.groupBy(*LINE).agg(F.md5(F.array_join(parts, "\x02")).alias("structure"))


def block_fingerprints(keys: DataFrame, size: int) -> DataFrame:
    """For each line the key of the ``size`` lines that begin with it; lines too near the end have none."""
    w = Window.partitionBy("song").orderBy("line_no")
    following = [F.lead("structure", i).over(w) for i in range(size)]
    return keys.withColumn("block", F.when(following[-1].isNotNull(), F.md5(F.concat_ws(",", *following))))


def selection_summary(selected: DataFrame) -> DataFrame:
    """Words, lines and span of each song's selection; a single word has no summary."""
    s = selected.groupBy("song").agg(F.count("*").alias("words"), F.count_distinct("line_no").alias("lines"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"))
    return s.where("words > 1 and begin_ms is not null")


def stretch_limits(words: DataFrame, least_ms: int) -> DataFrame:
    """Smallest and largest factor by which a line's words can be stretched from its begin: no word shorter than ``least_ms``, none past the next line."""
    span = words.where(timed()).groupBy(*LINE).agg(F.min("begin_ms").alias("pin"), F.max("end_ms").alias("stop"), F.max(F.lit(least_ms) / F.nullif(F.col("end_ms") - F.col("begin_ms"), F.lit(0))).alias("lower"))
    after = F.lead("pin").over(Window.partitionBy("song").orderBy("line_no"))
    span = span.withColumn("upper", (after - F.col("pin")) / F.nullif(F.col("stop") - F.col("pin"), F.lit(0)))
    return span.withColumn("feasible", F.coalesce(F.col("lower") <= F.col("upper"), F.lit(True)))


def syllable_groups(words: DataFrame) -> DataFrame:
    """Words with ``group_no`` in their line and track: a group ends with a word that has a space behind it."""
    ends = F.sum(F.when(F.endswith("text", F.lit(" ")), 1).otherwise(0)).over(Window.partitionBy(*TRACK).orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("group_no", F.coalesce(ends, F.lit(0)).cast("int"))


def closed_groups(words: DataFrame) -> DataFrame:
    """Inside a syllable group a word ends where the next one begins; ``gap`` marks groups that had a gap."""
    w = Window.partitionBy(*TRACK, "group_no")
    after = F.lead("begin_ms").over(w.orderBy("word_no"))
    gap = F.coalesce(after > F.col("end_ms"), F.lit(False))
    marked = words.withColumns({"_after": after, "_gap": gap})
    return marked.withColumns({"gap": F.max("_gap").over(w), "end_ms": F.coalesce("_after", "end_ms")}).drop("_after", "_gap")


def adjacent_points(points: DataFrame, at: str, by: str = "song") -> DataFrame:
    """Each distinct point with the next and the previous one."""
    w = Window.partitionBy(by).orderBy(at)
    return points.where(F.col(at).isNotNull()).select(by, at).distinct().withColumns({"after": F.lead(at).over(w), "before": F.lag(at).over(w)})


def union_anchors(*anchors: DataFrame) -> DataFrame:
    """Anchors (song, at, kind) of all sources, one for each time, with their place in the song; kinds are listed in order."""
    every = anchors[0]
    for more in anchors[1:]:
        every = every.unionByName(more)
    one = every.where("at is not null").groupBy("song", "at").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("song").orderBy("at")))


def explicit_marked(words: DataFrame, chosen: Column, clear: bool = False) -> DataFrame:
    """Words with ``explicit`` set for the whole syllable groups of those chosen; if all of a line's chosen groups are marked already, the mark is taken off."""
    group = Window.partitionBy(*TRACK, "group_no")
    grown = syllable_groups(words).withColumn("_in", F.max(chosen).over(group))
    all_marked = F.min(F.when(F.col("_in"), F.col("explicit"))).over(Window.partitionBy(*LINE))
    return grown.withColumn("explicit", F.when(F.col("_in"), ~F.coalesce(all_marked, F.lit(False))).otherwise(F.col("explicit"))).drop("_in")

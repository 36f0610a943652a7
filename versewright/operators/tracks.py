"""Words moved within a track and pasted into tracks, as windows over each track.

Incoming words are merged by begin: syllables of one word stay together, what was
there comes first at equal begins, and wherever old and new words meet there is a space.
Overlaps are then resolved forward.  With ``L`` as the running sum of lengths a word
that may not begin before the end in front of it ends at ``L_i + max over j <= i
of (begin_j - L_(j-1))``, so the cascade is a running maximum and no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ("song", "line_no", "track")


def _units(words: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """``_at``: the begin of the syllable run that a word is in; a word without a group is a run of its own."""
    w = Window.partitionBy(*by).orderBy(order)
    same = F.coalesce(F.col("syllable") == F.lag("syllable").over(w), F.lit(False))
    marked = words.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    return marked.withColumn("_at", F.first("begin_ms").over(Window.partitionBy(*by, "_run").orderBy(order)))


def merged_track(words: DataFrame, by: tuple[str, ...] = TRACK, order: str = "word_no") -> DataFrame:
    """Tracks with their incoming words (``incoming``) put in by begin, renumbered from 0.

    Columns: ``by``, ``order`` (within the old or the new words), text,
    begin_ms, end_ms, syllable, incoming.  Groups of incoming syllables get
    names of their own; a track without incoming words keeps its texts.
    """
    placed = _units(words, (*by, "incoming"), order)
    w = Window.partitionBy(*by).orderBy("_at", "incoming", "_run", order)
    joint = F.lead("incoming").over(w)
    text = F.when(joint.isNotNull() & (joint != F.col("incoming")) & ~F.col("text").endswith(" "), F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    touched = F.bool_or("incoming").over(Window.partitionBy(*by))
    text = F.when(touched & joint.isNull(), F.regexp_replace("text", " +$", "")).when(touched, text).otherwise(F.col("text"))
    out = placed.withColumns({"_no": F.row_number().over(w) - 1, "_text": text, "syllable": F.when(F.col("incoming"), F.concat(F.lit("new "), "syllable")).otherwise(F.col("syllable"))})
    return out.withColumns({"text": F.col("_text"), order: F.col("_no").cast(words.schema[order].dataType)}).drop("_at", "_run", "_no", "_text")


def pushed_forward(words: DataFrame, duration: Column, by: tuple[str, ...] = TRACK, order: str = "word_no") -> DataFrame:
    """Words that overlap the one before are moved behind it, and so on; a last word past ``duration`` is moved back to end there."""
    w = Window.partitionBy(*by).orderBy(order)
    length = F.col("end_ms") - F.col("begin_ms")
    words = words.withColumn("_l", F.sum(length).over(w))
    words = words.withColumn("_e", F.col("_l") + F.max(F.col("begin_ms") - F.col("_l") + length).over(w))
    late = F.lead(order).over(w).isNull() & (F.col("_e") > duration)
    begin = F.when(late, F.greatest(F.lit(0), duration - length)).otherwise(F.col("_e") - length)
    return words.withColumns({"_b": begin, "_e": F.when(late, duration).otherwise(F.col("_e"))}).withColumns({"begin_ms": F.col("_b"), "end_ms": F.col("_e")}).drop("_l", "_b", "_e")


def reordered(words: DataFrame, dragged: Column, delta_ms: Column, duration: Column, by: tuple[str, ...] = TRACK, order: str = "word_no") -> DataFrame:
    """Tracks after their ``dragged`` words were moved by ``delta_ms``, inside 0 and ``duration``; ``incoming`` tells those words.  Words are timed."""
    length = F.col("end_ms") - F.col("begin_ms")
    moved = F.greatest(F.lit(0), F.least(duration - length, F.col("begin_ms") + delta_ms))
    tagged = words.withColumn("incoming", F.coalesce(dragged, F.lit(False))).withColumn("_b", F.when(F.col("incoming"), moved).otherwise(F.col("begin_ms")))
    tagged = tagged.withColumns({"end_ms": F.col("_b") + length, "begin_ms": F.col("_b")}).drop("_b")
    return pushed_forward(merged_track(tagged, by, order), duration, by, order)


def paste_targets(clipboard: DataFrame, lines: DataFrame) -> DataFrame:
    """Copied words at the lines and times where they would be pasted, with ``known``: whether all lines of the paste exist.

    ``clipboard``: song, paste, target_line, delta_ms, duration_ms,
    line_offset, track, word_no, text, begin_ms, end_ms, syllable; ``lines``:
    song, line_no.
    """
    moved = clipboard.withColumn("line_no", (F.col("target_line") + F.col("line_offset")).cast(lines.schema["line_no"].dataType))
    moved = moved.withColumns({"begin_ms": F.greatest(F.lit(0), F.col("begin_ms") + F.col("delta_ms")), "end_ms": F.least("duration_ms", F.col("end_ms") + F.col("delta_ms"))})
    met = moved.join(lines.select("song", "line_no", F.lit(True).alias("_there")).distinct(), ["song", "line_no"], "left")
    return met.withColumn("known", F.every(F.col("_there").isNotNull()).over(Window.partitionBy("song", "paste"))).drop("_there")


def paste_overlaps(targets: DataFrame, words: DataFrame) -> DataFrame:
    """``song, paste, overlaps``: whether a paste lacks a line, has a word without length, or meets a word that is there."""
    at = targets.select("song", "paste", "line_no", "track", "known", F.col("begin_ms").alias("_b"), F.col("end_ms").alias("_e"))
    there = words.where("begin_ms is not null and end_ms is not null").select(*TRACK, F.col("begin_ms").alias("_ob"), F.col("end_ms").alias("_oe"))
    met = at.join(there, (at.song == there.song) & (at.line_no == there.line_no) & (at.track == there.track) & (F.col("_b") < F.col("_oe")) & (F.col("_e") > F.col("_ob")), "left").select(at.song, at.paste, "known", "_b", "_e", "_ob")
    return met.groupBy("song", "paste").agg(F.bool_or(~F.col("known") | (F.col("_e") <= F.col("_b")) | F.col("_ob").isNotNull()).alias("overlaps"))


def pasted(words: DataFrame, targets: DataFrame) -> DataFrame:
    """The tracks that pastes touch, with their words; pastes that lack a line change nothing."""
    new = targets.where("known").select(*TRACK, "word_no", "text", "begin_ms", "end_ms", "syllable", F.lit(True).alias("incoming"))
    old = words.join(new.select(*TRACK).distinct(), list(TRACK), "left_semi").select(*TRACK, "word_no", "text", "begin_ms", "end_ms", "syllable", F.lit(False).alias("incoming"))
    return merged_track(old.unionByName(new))

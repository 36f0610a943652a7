"""Small questions about selected words, instances and sequences of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ["song", "line_no", "track"]
SAME_MS = 1e-6


def explicit_toggle(words: DataFrame, selection: DataFrame) -> DataFrame:
    """The words that a toggle marks or clears: the selected ones with their syllable groups, and ``value``, false only if all of a song's targets are marked.

    ``words``: TRACK, word_no, group_no, explicit; ``selection``: TRACK,
    word_no.  Selected words that are not there count for nothing.
    """
    chosen = selection.select(*TRACK, "word_no").distinct().withColumn("_s", F.lit(True))
    met = words.join(chosen, [*TRACK, "word_no"], "left")
    whole = F.coalesce(F.bool_or("_s").over(Window.partitionBy(*TRACK, "group_no")), F.lit(False))
    targets = met.withColumn("_w", whole).where("_w")
    value = F.bool_or(~F.coalesce(F.col("explicit"), F.lit(False))).over(Window.partitionBy("song"))
    return targets.select(*TRACK, "word_no", value.alias("value"))


def words_in_instance(words: DataFrame, lines: DataFrame, instances: DataFrame) -> DataFrame:
    """The words of all lines of the asked instances (song, group_id, instance), main track first."""
    asked = lines.join(instances.select("song", "group_id", "instance").distinct(), ["song", "group_id", "instance"]).select("song", "line_no", "group_id", "instance")
    place = F.row_number().over(Window.partitionBy("song", "group_id", "instance").orderBy("line_no", F.col("track") != "main", "word_no")) - 1
    return words.join(asked, ["song", "line_no"]).select("song", "group_id", "instance", "line_no", "track", "word_no", place.alias("place"))


def sequence_keys(lines: DataFrame, by: tuple[str, ...], order: str, content: tuple[str, ...]) -> DataFrame:
    """``by, n, key``: equal for sequences of lines that are the same line by line in ``content`` (null texts count as empty)."""
    part = F.sha2(F.concat_ws("\x02", *[F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in content]), 256)
    rows = lines.select(*by, order, part.alias("_k"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_k"))), lambda x: x["_k"]), ","), 256).alias("key"))


def same_word_lists(a: Column, b: Column) -> Column:
    """Whether two lists of words have the same texts and times; two nulls do."""
    equal = lambda x, y: (x["text"].eqNullSafe(y["text"])) & (F.abs(x["begin_ms"] - y["begin_ms"]) <= SAME_MS) & (F.abs(x["end_ms"] - y["end_ms"]) <= SAME_MS)
    both = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, equal), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)


def cross_line_moves(words: DataFrame, selection: DataFrame, delta_ms: Column, duration: Column) -> DataFrame:
    """Words dragged onto another line or track, at their new times; ``selection`` has TRACK, word_no, to_line and to_track.  Words left without length are not moved."""
    met = words.join(selection, [*TRACK, "word_no"])
    moved = met.withColumns({"new_begin": F.greatest(F.lit(0), F.col("begin_ms") + delta_ms), "new_end": F.least(duration, F.col("end_ms") + delta_ms)})
    return moved.where("new_end > new_begin").select(*TRACK, "word_no", "to_line", "to_track", "new_begin", "new_end")


def manual_background(words: DataFrame, mark: str = "|") -> DataFrame:
    """``song, line_no, bg_text, bg_source``: what an edit of background words leaves, the text made from the words and the source manual."""
    last = F.max("word_no").over(Window.partitionBy("song", "line_no"))
    piece = F.concat("text", F.when((F.col("word_no") < last) & ~F.col("text").endswith(" "), mark).otherwise(""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", F.col("_p").alias("t")))), lambda x: x["t"]), "")
    return words.withColumn("_p", piece).groupBy("song", "line_no").agg(joined.alias("bg_text")).withColumn("bg_source", F.when(F.trim("bg_text") != "", "manual"))

"""Linked repeats: groups of line instances that share a template, and edits that keep them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_from_selection(lines: DataFrame, selected: Column, song: str = "song", order: str = "line_no") -> DataFrame:
    """Songs whose selected lines are contiguous and ungrouped get a group: ``group_id`` (smallest free ``gN``), ``instance_idx`` 0, ``template_line``."""
    marked = lines.withColumn("_sel", selected)
    w = Window.partitionBy(song)
    number = F.regexp_extract("group_id", r"^g(\d+)$", 1).try_cast("int")
    picked = marked.groupBy(song).agg(
        F.count_if("_sel").alias("_n"),
        F.min(F.when(F.col("_sel"), F.col(order))).alias("_lo"),
        F.max(F.when(F.col("_sel"), F.col(order))).alias("_hi"),
        F.bool_or(F.col("_sel") & F.col("group_id").isNotNull()).alias("_taken"),
        F.array_sort(F.collect_set(number)).alias("_used"),
    )
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("_used") + 1), F.col("_used")))
    good = picked.where((F.col("_n") > 0) & (F.col("_hi") - F.col("_lo") + 1 == F.col("_n")) & ~F.col("_taken")).select(song, "_lo", F.concat(F.lit("g"), free.cast("string")).alias("_id"))
    met = marked.join(good, song, "left")
    hit = F.col("_sel") & F.col("_id").isNotNull()
    out = met.withColumn("group_id", F.when(hit, F.col("_id")).otherwise(F.col("group_id")))
    out = out.withColumn("instance_idx", F.when(hit, 0).otherwise(F.col("instance_idx"))).withColumn("template_line", F.when(hit, F.col(order) - F.col("_lo")).otherwise(F.col("template_line")))
    return out.drop("_sel", "_lo", "_id")


def template_of(lines: DataFrame, group: str = "group_id", instance: str = "instance_idx") -> DataFrame:
    """Each group's template from its lowest instance: times relative to that instance's begin."""
    keys = ["song", group]
    first = lines.where(f"{group} is not null").groupBy(*keys).agg(F.min(instance).alias("_i"))
    own = lines.join(first, keys).where(F.col(instance) == F.col("_i"))
    start = own.groupBy(*keys).agg(F.min("begin_ms").alias("_s"))
    return own.join(start, keys).select(*keys, "template_line", (F.col("begin_ms") - F.col("_s")).alias("rel_begin"), (F.col("end_ms") - F.col("_s")).alias("rel_end"))


def unlinked(lines: DataFrame, which: Column) -> DataFrame:
    """Lines taken out of their groups."""
    empty = lambda c: F.when(~which, F.col(c))
    return lines.withColumns({c: empty(c) for c in ("group_id", "instance_idx", "template_line")})


def propagated(lines: DataFrame, edits: DataFrame, field: str = "text") -> DataFrame:
    """Edited lines' field on all linked siblings that are not detached; the latest edit of a template line wins.

    ``edits``: song, line_no, ``field``, version.
    """
    linked = lines.select("song", "line_no", "group_id", "template_line").where("group_id is not null")
    last = edits.join(linked, ["song", "line_no"]).groupBy("song", "group_id", "template_line").agg(F.max_by(field, "version").alias("_shared"))
    own = edits.groupBy("song", "line_no").agg(F.max_by(field, "version").alias("_own"))
    met = lines.join(last, ["song", "group_id", "template_line"], "left").join(own, ["song", "line_no"], "left")
    shared = F.when(~F.coalesce(F.col("detached"), F.lit(False)), F.col("_shared"))
    return met.withColumn(field, F.coalesce("_own", shared, field)).select(*lines.columns)


def conformed(lines: DataFrame, template: DataFrame, start: str = "start_ms") -> DataFrame:
    """Lines with a place in a template (``group_id``, ``template_line``, ``start_ms``) take its times."""
    met = lines.join(template, ["song", "group_id", "template_line"], "left")
    return met.withColumn("begin_ms", F.coalesce(F.col(start) + F.col("rel_begin"), "begin_ms")).withColumn("end_ms", F.coalesce(F.col(start) + F.col("rel_end"), "end_ms")).drop("rel_begin", "rel_end")


def expanded_selection(words: DataFrame, selected: Column, group: str = "group_no", line: tuple[str, ...] = ("song", "line_no")) -> DataFrame:
    """Whether each word's syllable group has a selected word: a selection grows to whole groups."""
    return words.withColumn("selected", F.bool_or(selected).over(Window.partitionBy(*line, group)))


def deleted_words(words: DataFrame, gone: Column, line: tuple[str, ...] = ("song", "line_no"), order: str = "word_no") -> DataFrame:
    """What is left after a deletion, renumbered; lines without words are gone with them."""
    n = F.row_number().over(Window.partitionBy(*line).orderBy(order)) - 1
    return words.where(~gone).withColumn("_n", n).withColumn(order, F.col("_n").cast(words.schema[order].dataType)).drop("_n")


def moved_to_background(words: DataFrame, which: Column) -> DataFrame:
    """Words on the background track; each track is numbered by begin again."""
    moved = words.withColumn("track", F.when(which, "bg").otherwise(F.col("track")))
    n = F.row_number().over(Window.partitionBy("song", "line_no", "track").orderBy("begin_ms", "word_id")) - 1
    return moved.withColumn("word_no", n.cast("int"))


def merged_groups(words: DataFrame, line: tuple[str, ...] = ("song", "line_no"), group: str = "group_no", order: str = "word_no") -> DataFrame:
    """Syllable groups as single words: joined text, begin of the first piece, end of the last."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return words.groupBy(*line, group).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.min_by("begin_ms", order).alias("begin_ms"), F.max_by("end_ms", order).alias("end_ms"))


def explicit_hits(words: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Words that equal a listed term once case, punctuation and repeated marks are dropped; one row per hit."""
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    known = terms.select(key(F.col("term")).alias("_k")).where("_k <> ''").distinct()
    return words.withColumn("_k", key(F.col(text))).join(known, "_k", "left_semi").drop("_k")

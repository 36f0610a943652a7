"""Judging, ranking and choosing among candidates, and set operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank of a sync type; preference of lyrics sources, first best (others come after them).
SYNC_RANK = {"syllable": 3, "word": 2, "line": 1, "unsynced": 0}
SOURCE_PREFERENCE = ("boidu", "binimum", "portato", "lrclib")
LEAST_WORDS, DURATION_SLACK = 12, 3.0


def judge(candidates: DataFrame, audio_seconds: Column) -> DataFrame:
    """Candidates judged; reasons and notes are codes with their numbers.

    ``rejected`` with a ``reason`` under 12 words; ``text_only`` with a ``note`` when the length is off by more than three seconds or timed words end after the audio.

    ``candidates`` have ``n_words``, ``duration``, ``last_end``, ``sync`` (as
    parsed) and ``declared``.  ``mismatch`` marks a declared word timing that
    was not found.
    """
    few = F.coalesce(F.col("n_words"), F.lit(0)) < LEAST_WORDS
    off = F.coalesce(F.abs(F.col("duration") - audio_seconds) > DURATION_SLACK, F.lit(False))
    late = F.coalesce((F.col("sync") != "unsynced") & (F.col("last_end") > audio_seconds + DURATION_SLACK), F.lit(False))
    word_level = lambda c: F.col(c).isin("word", "syllable")
    whole = lambda c: F.round(c).cast("bigint").cast("string")
    note = F.when(few, None).when(off, F.concat_ws(":", F.lit("duration"), whole(F.col("duration")), whole(audio_seconds))).when(
        late, F.concat_ws(":", F.lit("late_end"), whole(F.col("last_end")), whole(audio_seconds)))
    return candidates.withColumns({
        "rejected": few,
        "reason": F.when(few, F.concat_ws(":", F.lit("words"), F.coalesce(F.col("n_words"), F.lit(0)).cast("string"))),
        "text_only": ~few & (off | late),
        "note": note,
        "mismatch": F.coalesce(~few & word_level("declared") & ~word_level("sync"), F.lit(False)),
    })


def candidate_order(audio_seconds: Column, preference: tuple[str, ...] = SOURCE_PREFERENCE) -> list[Column]:
    """Sort keys of usable candidates, best first: finer usable sync, finer parsed sync, preferred source, closest length."""
    place = F.array_position(F.array(*[F.lit(s) for s in preference]), F.col("source"))
    usable = effective_sync(F.col("sync"), F.col("declared"), F.col("text_only"))
    return [-sync_rank(usable), -sync_rank(F.col("sync")), F.when(place > 0, place).otherwise(len(preference) + 1), F.abs(F.coalesce(F.col("duration"), audio_seconds) - audio_seconds)]


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """One row per candidate for a report: what it is, how it was judged and what it may be used for."""
    usable = effective_sync(F.col("sync"), F.col("declared"), F.col("text_only"))
    return candidates.withColumns({"usable": ~F.col("rejected") & (F.col("n_words") > 0), "effective_sync": usable, "notes": F.array_compact(F.array("note", F.when(F.col("mismatch"), F.concat_ws(":", F.lit("mismatch"), "declared", "sync"))))})


def effective_sync(parsed: Column, declared: Column, text_only: Column) -> Column:
    return F.when(text_only, "unsynced").otherwise(F.coalesce(parsed, declared, F.lit("unsynced")))


def sync_rank(sync: Column) -> Column:
    out = None
    for name, rank in SYNC_RANK.items():
        out = F.when(sync == name, rank) if out is None else out.when(sync == name, rank)
    return out.otherwise(0)


def ranked(candidates: DataFrame, keys: list[Column], by: tuple[str, ...]) -> DataFrame:
    """Candidates with their ``rank`` within ``by``; the last key must be unique."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def best(candidates: DataFrame, order: Column, by: tuple[str, ...], columns: list[str]) -> DataFrame:
    """The row with the largest ``order`` of each group, by an aggregation that combines before its shuffle."""
    picked = candidates.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("_b"))
    return picked.select(*by, "_b.*")


def removal_cap(lines: DataFrame, drop: Column, by: tuple[str, ...], share: float = 0.25) -> DataFrame:
    """Lines without those to drop, unless they are more than ``share`` of the group: then all stay."""
    counts = lines.groupBy(*by).agg(F.count_if(drop).alias("_d"), F.count("*").alias("_n"))
    marked = lines.withColumn("_drop", drop).join(counts, list(by))
    return marked.where(~F.col("_drop") | (F.col("_d") > F.col("_n") * share)).drop("_drop", "_d", "_n")


def fallback_union(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """Rows of ``first``, and those of ``second`` for keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(by).distinct(), by, "left_anti"))


def toggled(selection: DataFrame, clicked: DataFrame) -> DataFrame:
    """Symmetric difference of two selections."""
    return selection.exceptAll(clicked).union(clicked.exceptAll(selection))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key: added, removed or changed, and which fields differ."""
    a, b = before.select(F.col(key).alias("_a"), *[F.col(f).alias(f"a_{f}") for f in fields]), after.select(F.col(key).alias("_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size("differ") > 0, "changed").otherwise("same")
    return both.withColumn("differ", differ).select(F.coalesce("_a", "_b").alias(key), kind.alias("change"), F.array_join("differ", ",").alias("fields")).where("change <> 'same'")


def three_way_merge(base: Column, mine: Column, theirs: Column) -> Column:
    """A field's merged value as ``(value, conflict)``: the side that moved, or a conflict if both moved apart."""
    return F.when(mine.eqNullSafe(theirs) | theirs.eqNullSafe(base), F.struct(mine.alias("value"), F.lit(False).alias("conflict"))).when(mine.eqNullSafe(base), F.struct(theirs.alias("value"), F.lit(False).alias("conflict"))).otherwise(F.struct(mine.alias("value"), F.lit(True).alias("conflict")))

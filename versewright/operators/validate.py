"""Timing checks of a finished document, over neighbouring words and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the word checks, in milliseconds.
TOO_LONG, TOO_SHORT, OVERLAP, BIG_GAP, PAST_END, OUT_OF_ORDER = 6000, 30, 10, 4000, 500, 1000


def word_issues(words: DataFrame, duration: Column | None = None, track: tuple[str, ...] = ("song", "line_no", "track"), order: str = "word_no") -> DataFrame:
    """Words with ``issues``: too-long, too-short, past-end, and overlap or big-gap against the word just before.

    A word is compared with the one before it in the same line and track, in
    the document's order, and only if that one is timed.  Words without times
    have no issue.
    """
    timed = F.col("begin_ms").isNotNull() & F.col("end_ms").isNotNull()
    before = F.lag(F.when(timed, F.col("end_ms"))).over(Window.partitionBy(*track).orderBy(order))
    length, gap = F.col("end_ms") - F.col("begin_ms"), F.col("begin_ms") - F.col("_before")
    checks = [F.when(length > TOO_LONG, "too-long"), F.when(length < TOO_SHORT, "too-short")]
    if duration is not None:
        checks.append(F.when(F.col("end_ms") > duration + PAST_END, "past-end"))
    checks.append(F.when(gap < -OVERLAP, "overlap").when(gap > BIG_GAP, "big-gap"))
    found = F.when(timed, F.array_compact(F.array(*checks))).otherwise(F.array().cast("array<string>"))
    return words.withColumn("_before", before).withColumn("issues", found).drop("_before")


def out_of_order(lines: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Lines that begin more than a second before the bounded line before them; every bounded line moves the mark."""
    before = F.last("begin_ms", ignorenulls=True).over(Window.partitionBy("song").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("_before", before).where(F.col("begin_ms") < F.col("_before") - OUT_OF_ORDER).drop("_before")


def flagged_totals(checked: DataFrame, by: tuple[str, ...] = ("song",)) -> DataFrame:
    """Words, flagged words and problems of each song."""
    return checked.groupBy(*by).agg(F.count("*").alias("words"), F.count_if(F.size("issues") > 0).alias("flagged"), F.sum(F.size("issues")).cast("bigint").alias("problems"))


def report(checked: DataFrame) -> DataFrame:
    """How often each issue occurs."""
    return checked.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))

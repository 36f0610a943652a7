"""What a song leaves in storage: its lines as JSON, cached hearings, raw candidates, and sets of songs with their truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LINES


def save_lyrics(lines: DataFrame, path: str) -> None:
    """Lines (the columns of the canonical table) as JSON, a folder for each ``bucket`` of songs."""
    lines.write.mode("overwrite").partitionBy("bucket").json(path)


def load_lyrics(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """Stored lines by their schema; with ``checked`` only those that fit it, with a song and a place.

    A field that does not fit makes the whole line unreadable; such lines are
    dropped, as a song without its lines is better than a wrong one.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*LINES.fields, StructField("_corrupt", StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where("_corrupt is null and song is not null and line_no is not null") if checked else rows
    return rows.drop("_corrupt")


def fresh_cache(wanted: DataFrame, cache: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Wanted items whose cached value is as new as their source, with the value, and those to make again.

    ``wanted``: ``key`` and ``modified`` (of the source); ``cache``: ``key``,
    ``made`` and ``value``.  Of several cached values the newest counts, the largest of those as new.
    """
    newest = cache.groupBy(*key).agg(F.max("made").alias("made"), F.max_by("value", F.struct("made", "value")).alias("value"))
    met = wanted.join(newest, list(key), "left").withColumn("_fresh", F.coalesce(F.col("made") >= F.col("modified"), F.lit(False)))
    return met.where("_fresh").select(*key, "value"), met.where("not _fresh").select(*key, "modified")


def benchmark_songs(meta: DataFrame, truth: DataFrame, song: str = "song") -> DataFrame:
    """Songs that have both a description and a true placement; the rest can't be scored."""
    return meta.join(truth, song)


def save_candidates(candidates: DataFrame, path: str) -> None:
    """Raw candidate documents (job, number, content), a folder per job; saving a job's again replaces them."""
    candidates.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").parquet(path)


def can_search(needs: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a query has what a source needs: one column at least of each of ``needs``, neither null, empty nor 0."""
    there = lambda c: F.coalesce(~F.col(c).cast("string").isin("", "0", "0.0"), F.lit(False))
    every = F.lit(True)
    for either in needs:
        one = F.lit(False)
        for c in either:
            one = one | there(c)
        every = every & one
    return every


def payloads(events: DataFrame, subscribers: DataFrame, kind: Column) -> DataFrame:
    """What each subscriber of a job is sent: an event as it is, a status with its error, progress with its share in four digits.

    ``events``: job, seq, stage, status, error, label, fraction, detail;
    ``subscribers``: job, subscriber.
    """
    event = F.struct(F.lit("event").alias("type"), F.struct("stage", "status", F.col("label").alias("message")).alias("event"))
    status = F.struct(F.lit("status").alias("type"), "status", "error")
    moved = F.struct(F.lit("progress").alias("type"), "stage", "label", F.round("fraction", 4).alias("fraction"), F.coalesce("detail", F.lit("")).alias("detail"))
    keep = {"ignoreNullFields": "false"}
    told = F.when(kind == "status", F.to_json(status, keep)).when(kind == "progress", F.to_json(moved, keep)).otherwise(F.to_json(event, keep))
    return events.withColumn("payload", told).join(subscribers, "job").select("subscriber", "job", "seq", "payload")


def answered_language(answer: Column, current: Column) -> tuple[Column, Column]:
    """The language after an answer, and whether it changed: only two small letters are one."""
    valid = F.coalesce(answer.rlike("^[a-z]{2}$"), F.lit(False))
    return F.when(valid, answer).otherwise(current), valid & ~answer.eqNullSafe(current)


def split_reading(words: Column, at: Column, parts: Column) -> tuple[Column, Column]:
    """The reading of a line after one word (index ``at``) was split into ``parts``, and its status; null if a piece has no reading.

    Words are structs of text, reading and joiner; without a joiner two spaces stand
    behind a word's end, one inside it.
    """
    all_ = F.concat(F.slice(words, F.lit(1), at), parts, F.slice(words, at + 2, F.size(words)))
    piece = lambda w, i: F.concat(w["reading"], F.when(i + 1 < F.size(all_), F.coalesce(w["joiner"], F.when(w["text"].endswith(" "), "  ").otherwise(" "))).otherwise(""))
    text = F.when(F.forall(all_, lambda w: w["reading"].isNotNull()), F.array_join(F.transform(all_, piece), ""))
    return text, F.when(text.isNotNull(), "confirmed")

"""Projections and predicates on nested lines (``words`` and ``background`` arrays of word structs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of the review flags.
FLAG_LABELS = {"low-confidence": "low confidence", "overlap": "overlaps", "big-gap": "long pause", "too-long": "very long", "too-short": "very short", "past-end": "after the end"}
REVIEW = ("low-confidence", "overlap", "past-end")


def joined(words: Column) -> Column:
    """Words' texts as one string."""
    return F.trim(F.array_join(F.transform(words, lambda w: w["text"]), ""))


def display(words: Column, background: Column) -> Column:
    """The line's text with its background in one pair of parentheses."""
    extra = F.regexp_replace(joined(background), r"^\((.*)\)$", "$1")
    return F.when(F.coalesce(F.size(background), F.lit(0)) > 0, F.trim(F.concat(joined(words), F.lit(" ("), extra, F.lit(")")))).otherwise(joined(words))


def all_timed(words: Column) -> Column:
    return (F.size(words) > 0) & F.forall(words, lambda w: w["begin_ms"].isNotNull() & w["end_ms"].isNotNull())


def sync_type(lines: DataFrame, song: str = "song") -> DataFrame:
    """Per song: syllable if all lines are word-timed and a word but the last lacks its space, word, line if all lines are bounded, else unsynced."""
    split = F.exists(F.slice("words", 1, F.greatest(F.lit(0), F.size("words") - 1)), lambda w: ~w["text"].endswith(" "))
    bounded = (F.col("begin_ms").isNotNull() & F.col("end_ms").isNotNull()) | all_timed(F.col("words"))
    g = lines.groupBy(song).agg(F.bool_and(all_timed(F.col("words"))).alias("w"), F.bool_or(split).alias("s"), F.bool_and(bounded).alias("b"))
    return g.select(song, F.when(F.col("w") & F.col("s"), "syllable").when(F.col("w"), "word").when(F.col("b"), "line").otherwise("unsynced").alias("sync"))


def line_synced(words: DataFrame, song: str = "song") -> DataFrame:
    """Word timing reduced to line begins; a line ends where the next one begins."""
    starts = words.groupBy(song, "line_no").agg(F.min("begin_ms").alias("begin_ms"))
    return starts.withColumn("end_ms", F.lead("begin_ms").over(Window.partitionBy(song).orderBy("line_no")))


def content_spans(words: DataFrame, line: tuple[str, ...] = ("song", "line_no"), text: str = "text", order: str = "word_no") -> DataFrame:
    """Character range of each word in its line: ``from_char``, ``to_char``."""
    upto = F.sum(F.length(text)).over(Window.partitionBy(*line).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return words.withColumn("to_char", upto).withColumn("from_char", F.col("to_char") - F.length(text))


def effective_words(words: Column, text: Column, begin: Column, end: Column) -> Column:
    """The words, or for a line timed as a whole one word that stands for it."""
    pseudo = F.array(F.struct(text.alias("text"), begin.alias("begin_ms"), end.alias("end_ms")))
    return F.when(F.size(words) > 0, F.transform(words, lambda w: F.struct(w["text"].alias("text"), w["begin_ms"].alias("begin_ms"), w["end_ms"].alias("end_ms")))).when(begin.isNotNull(), pseudo).otherwise(F.array().cast("array<struct<text:string,begin_ms:bigint,end_ms:bigint>>"))


def describe_flags(flags: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in FLAG_LABELS.items() for x in kv])
    return F.array_join(F.transform(flags, lambda f: F.coalesce(F.element_at(names, f), f)), " · ")


def needs_review(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(f) for f in REVIEW]))


def boundary_flush(words: DataFrame, line: tuple[str, ...] = ("song", "line_no"), order: str = "word_no") -> DataFrame:
    """Whether a word touches or overlaps the one before and the one after it."""
    w = Window.partitionBy(*line).orderBy(order)
    return words.withColumn("flush_before", F.coalesce(F.lag("end_ms").over(w) >= F.col("begin_ms"), F.lit(False))).withColumn("flush_after", F.coalesce(F.lead("begin_ms").over(w) <= F.col("end_ms"), F.lit(False)))


def contiguous(selection: DataFrame, by: str, index: str) -> DataFrame:
    """Whether each group's distinct selected indices form one run."""
    g = selection.groupBy(by).agg(F.count_distinct(index).alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    return g.select(by, (F.col("hi") - F.col("lo") + 1 == F.col("n")).alias("contiguous"))


def valid_times(times: Column) -> Column:
    """Finite times from 0, sorted."""
    return F.array_sort(F.filter(times, lambda t: t.isNotNull() & ~F.isnan(t) & (t >= 0) & (t < float("inf"))))


def distribute_by_characters(words: Column, begin: Column, end: Column) -> Column:
    """Words (strings) over a span, each by its share of characters; whole milliseconds, floored."""
    total = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
    fold = F.aggregate(
        words,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<text:string,begin_ms:bigint,end_ms:bigint>>").alias("out")),
        lambda acc, w: F.struct(
            (acc["n"] + F.length(w)).alias("n"),
            F.concat(acc["out"], F.array(F.struct(w.alias("text"), (begin + F.floor((end - begin) * acc["n"] / total)).cast("bigint").alias("begin_ms"), (begin + F.floor((end - begin) * (acc["n"] + F.length(w)) / total)).cast("bigint").alias("end_ms")))).alias("out"),
        ),
    )
    return fold["out"]


def even_shares(n: Column, begin: Column, end: Column) -> Column:
    """``n`` equal spans."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((begin + F.floor((end - begin) * i / n)).cast("bigint").alias("begin_ms"), (begin + F.floor((end - begin) * (i + 1) / n)).cast("bigint").alias("end_ms")))


def distance_to_gap(at: Column, begin: Column, end: Column) -> Column:
    """0 inside a gap, else how far its nearer edge is."""
    return F.greatest(F.lit(0), begin - at, at - end)


def metadata_pairs(songs: DataFrame, song: str, fields: tuple[str, ...]) -> DataFrame:
    """Metadata columns as ``(song, key, value)`` rows, empty ones left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields]))
    return songs.select(song, pairs.alias("p")).select(song, "p.key", "p.value").where("value is not null and value <> ''")


def metadata_merge(current: Column, previous_import: Column, incoming: Column, default: Column) -> Column:
    """A field after an import: a non-empty incoming value wins, one set by the import before falls back to its default."""
    return F.when(F.coalesce(incoming, F.lit("")) != "", incoming).when(previous_import, default).otherwise(current)


def snippet(text: Column, begin: Column, end: Column, around: int) -> Column:
    """A character range with ``around`` characters on either side and an ellipsis where the text goes on."""
    lo, hi = F.greatest(F.lit(0), begin - around), F.least(F.length(text), end + around)
    return F.concat(F.when(lo > 0, F.lit("…")).otherwise(F.lit("")), F.substring(text, lo + 1, hi - lo), F.when(hi < F.length(text), F.lit("…")).otherwise(F.lit("")))


def cycle_next(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The next row of each group, the first after the last."""
    w = Window.partitionBy(by)
    return rows.withColumn("next", F.coalesce(F.lead(order).over(w.orderBy(order)), F.min(order).over(w)))

"""Document edits as DataFrame transforms; word-level kernels see one line at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remap_words(old: list[str], begin: list, end: list, new: list[str]) -> list[tuple]:
    """Times for an edited word list: equal counts keep them by position, else common words keep theirs and the rest share the gaps evenly."""
    if len(old) == len(new):
        return list(zip(begin, end))
    import difflib

    times: list = [None] * len(new)
    for a, b, size in difflib.SequenceMatcher(None, [w.strip() for w in old], [w.strip() for w in new], autojunk=False).get_matching_blocks():
        for k in range(size):
            times[b + k] = (begin[a + k], end[a + k])
    k = 0
    while k < len(new):
        if times[k] is None:
            stop = k
            while stop < len(new) and times[stop] is None:
                stop += 1
            lo = times[k - 1][1] if k else begin[0]
            hi = times[stop][0] if stop < len(new) else end[-1]
            hi = max(hi, lo)
            n = stop - k
            for x in range(n):
                times[k + x] = (lo + (hi - lo) * x // n, lo + (hi - lo) * (x + 1) // n)
            k = stop
        else:
            k += 1
    return times


def remap_text(lines: DataFrame, words: str = "words", text: str = "new_text") -> DataFrame:
    """Lines' words after their text was edited: ``remapped`` keeps the timing that the old words had."""
    keep = [f for f in lines.schema.fields if f.name not in (words, text)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for old, new in zip(batch[words], batch[text]):
                fresh = new.split()
                times = remap_words([w["text"] for w in old], [w["begin_ms"] for w in old], [w["end_ms"] for w in old], fresh) if len(old) else [(None, None)] * len(fresh)
                made.append([{"text": w, "begin_ms": b, "end_ms": e} for w, (b, e) in zip(fresh, times)])
            yield batch[names].assign(remapped=made)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return lines.select(*names, words, text).mapInPandas(run, schema + "remapped array<struct<text: string, begin_ms: bigint, end_ms: bigint>>")


def split_word(words: DataFrame, at: Column, order: str = "word_no", line: tuple[str, ...] = ("song", "line_no"), text: str = "text") -> DataFrame:
    """Words with a cut after ``at`` characters become two, their time shared by characters; words are renumbered."""
    size = F.length(text)
    cut = (at > 0) & (at < size)
    middle = (F.col("begin_ms") + F.floor((F.col("end_ms") - F.col("begin_ms")) * at / size)).cast("bigint")
    piece = lambda t, b, e: F.struct(t.alias("t"), b.cast("bigint").alias("b"), e.cast("bigint").alias("e"))
    both = F.array(piece(F.substring(text, F.lit(1), at), F.col("begin_ms"), middle), piece(F.substring(text, at + 1, size), middle, F.col("end_ms")))
    whole = F.array(piece(F.col(text), F.col("begin_ms"), F.col("end_ms")))
    out = words.select("*", F.posexplode(F.when(cut, both).otherwise(whole)).alias("_i", "_p"))
    n = F.row_number().over(Window.partitionBy(*line).orderBy(order, "_i")) - 1
    return out.withColumn("_n", n).withColumn(text, F.col("_p.t")).withColumn("begin_ms", F.col("_p.b")).withColumn("end_ms", F.col("_p.e")).withColumn(order, F.col("_n").cast(words.schema[order].dataType)).drop("_i", "_p", "_n")


def stretch(words: DataFrame, selected: Column, anchor: Column, factor: Column) -> DataFrame:
    """Selected words scaled about an anchor, not below 0."""
    at = lambda c: F.when(selected, F.greatest(F.lit(0), (anchor + F.floor((F.col(c) - anchor) * factor)).cast("bigint"))).otherwise(F.col(c))
    return words.withColumn("_b", at("begin_ms")).withColumn("_e", at("end_ms")).withColumn("begin_ms", F.col("_b")).withColumn("end_ms", F.col("_e")).drop("_b", "_e")


def set_boundary(words: DataFrame, order: str = "word_no", line: tuple[str, ...] = ("song", "line_no"), least: int = 50) -> DataFrame:
    """Words with a wanted begin (``new_begin``) take it, between the word before's begin and their own end less ``least``; a word before that touched or passed it ends there."""
    w = Window.partitionBy(*line).orderBy(order)
    floor = F.coalesce(F.lag("begin_ms").over(w) + least, F.lit(0))
    words = words.withColumn("_new", F.when(F.col("new_begin").isNotNull(), F.greatest(floor, F.least(F.col("new_begin"), F.col("end_ms") - least))))
    next_new, next_old = F.lead("_new").over(w), F.lead("begin_ms").over(w)
    flush = next_new.isNotNull() & ((F.col("end_ms") >= next_old) | (F.col("end_ms") > next_new))
    words = words.withColumn("_end", F.when(flush, next_new).otherwise(F.col("end_ms")))
    return words.withColumn("begin_ms", F.coalesce("_new", "begin_ms")).withColumn("end_ms", F.col("_end")).drop("_new", "_end")


def apply_template(instances: DataFrame, template: DataFrame, group: str = "grp") -> DataFrame:
    """Lines of new instances: a group's relative template laid at each start (``start_ms``)."""
    return instances.join(template, group).select(group, "instance", "template_line", (F.col("start_ms") + F.col("rel_begin")).alias("begin_ms"), (F.col("start_ms") + F.col("rel_end")).alias("end_ms"))


def merge_tracks(main: DataFrame, incoming: DataFrame, line: tuple[str, ...] = ("song", "line_no")) -> DataFrame:
    """Two tracks of words as one by begin, the first track first at ties, renumbered."""
    both = main.withColumn("track", F.lit(0)).unionByName(incoming.withColumn("track", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*line).orderBy("begin_ms", "track", "word_id")) - 1
    return both.withColumn("word_no", n.cast("int"))


def background_place(main_begin: Column, main_end: Column, bg_begin: Column, bg_end: Column) -> Column:
    """front if the background begins before the line, end if after it, else inside."""
    return F.when(bg_begin < main_begin, "front").when(bg_begin >= main_end, "end").otherwise("inside")


def history(edits: DataFrame, key: str, version: str, cap: int) -> DataFrame:
    """The newest ``cap`` versions of each document."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return edits.withColumn("_k", k).where(F.col("_k") <= cap).drop("_k")

"""Spoken syllables of words as a table function: one word, one row per piece."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

VOWELS = "aeiouyäöüáàâéèêëíìîïóòôúùûœæ"
#: Consonant pairs that stay together, and pairs that close a syllable.
TOGETHER = ("ch", "sh", "th", "ph", "qu", "sch", "gh", "wh", "tr", "dr", "br", "cr", "fr", "gr", "pr", "bl", "cl", "fl", "gl", "pl")
CLOSING = ("ng", "ck")


def syllables(word: str) -> list[str]:
    """Pieces of a word that join to it: each has one vowel group, and a single consonant opens the next piece."""
    groups = list(re.finditer(f"[{VOWELS}]+", word, re.I))
    cuts = []
    for a, b in zip(groups, groups[1:]):
        between = word[a.end() : b.start()].lower()
        if between in CLOSING or not between.isalpha():
            cut = a.end() + len(between)
        elif len(between) == 1 or between in TOGETHER:
            cut = a.end()
        else:
            last = next((t for t in TOGETHER if between.endswith(t)), between[-1:])
            cut = b.start() - len(last)
        cuts.append(cut)
    if cuts and word[cuts[-1] :].lower() == word[groups[-1].start() :].lower() == "e":
        cuts.pop()  # a closing silent e
    return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]


@udtf(returnType="part_no: int, part: string, begin_ms: bigint, end_ms: bigint")
class SyllableSplit:
    """``(text, begin_ms, end_ms)`` to pieces that share the time by letters, at least 40 ms each where there is room."""

    def eval(self, text: str, begin_ms: int, end_ms: int) -> Iterator[tuple]:
        if text is None:
            return
        parts = syllables(text)
        if begin_ms is None or end_ms is None:
            yield from ((i, p, None, None) for i, p in enumerate(parts))
            return
        total, at, span = sum(map(len, parts)) or 1, 0, end_ms - begin_ms
        floor = 40 if span >= 40 * len(parts) else 0
        rest = span - floor * len(parts)
        for i, p in enumerate(parts):
            lo = begin_ms + floor * i + rest * at // total
            at += len(p)
            yield i, p, lo, begin_ms + floor * (i + 1) + rest * at // total


def register(spark: SparkSession) -> None:
    spark.udtf.register("syllable_split", SyllableSplit)


def split_syllables(words: DataFrame, text: str = "text") -> DataFrame:
    """Words' pieces by a lateral join with the table function."""
    return words.lateralJoin(SyllableSplit(F.col(text).outer(), F.col("begin_ms").outer(), F.col("end_ms").outer()))

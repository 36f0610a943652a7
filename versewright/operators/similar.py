"""Which lines of a text have a similar line in another version of it.

Similarity is the share of characters in matching blocks.  Two upper bounds come
first: lengths may differ by 7 to 3 at most, and the characters that two lines have
in common, as counts of 64 classes, bound the matching blocks.  Lines meet by classes of
length and are tested by counts in the join itself, so no pair beyond the bounds
is shuffled.  What is left is verified in order, and the first hit of a line ends
its search.  Matching blocks are a common subsequence, so the length of the longest
one, found by whole numbers as bit rows, is a third bound; blocks are searched only
for pairs within it.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Similarity of two lines that are one line in two versions, and share of lines that makes two versions of one text.
ALIKE, SAME_STRUCTURE = 0.6, 0.5
CLASSES = 64


def places(text: str) -> dict[str, int]:
    """For each character of ``text`` its places as bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << i
    return at


def common_length(at: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of ``other`` and the text of ``n`` characters with the :func:`places` ``at``."""
    whole = (1 << n) - 1
    row = whole
    for c in other:
        if hit := row & at.get(c, 0):
            row = (row + hit | row - hit) & whole
    return n - row.bit_count()


def ratio_at_least(matcher: difflib.SequenceMatcher, a: str, b: str, alike: float, at: dict[str, int] | None = None) -> bool:
    """Whether two texts are alike; ``at``: the :func:`places` of ``a``, where they are known."""
    if a == b:
        return True
    if 2 * min(len(a), len(b)) < alike * (len(a) + len(b)):
        return False
    if 2 * common_length(places(a) if at is None else at, len(a), b) < (alike - 1e-9) * (len(a) + len(b)):
        return False
    matcher.set_seqs(a, b)
    return matcher.ratio() >= alike


def _with_counts(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` with ``_n``, the length of ``key``, and ``_c``, how many of its characters fall into each class."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [np.frombuffer(k.encode("utf-32-le"), np.uint32) for k in batch[key]]
            yield batch.astype(object).assign(_n=[len(c) for c in codes], _c=[np.bincount(c % CLASSES, minlength=CLASSES) for c in codes])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in lines.schema.fields)
    return lines.mapInPandas(count, schema + "_n int, _c array<int>")


def similar_lines(lines: DataFrame, others: DataFrame, by: tuple[str, ...] = ("song",), version: str = "version", key: str = "key", alike: float = ALIKE) -> DataFrame:
    """``by, version, line_no`` of the lines that have a similar line in that version.

    ``lines``: ``by``, line_no, ``key``; ``others``: ``by``, ``version``,
    line_no, ``key``.  A null key is an empty line, which is like another empty
    line only.
    """
    text = F.coalesce(F.col(key), F.lit("")).alias("key")
    others = others.select(*by, version, F.col("line_no").alias("other"), text).where(F.col(version).isNotNull())
    asked = lines.select(*by, "line_no", text).join(others.select(*by, version).distinct(), list(by))
    place = [*by, version, "line_no"]
    equal = asked.join(others.select(*by, version, "key").distinct(), [*by, version, "key"], "left_semi").select(*place)
    rest = _with_counts(asked.join(equal, place, "left_anti").where("key <> ''"), "key")
    # A class of length reaches to 7/3 of its start: a partner is in the same class or next to it.
    step = float(np.log((2 - alike) / alike)) * (1 + 1e-6)
    size = F.floor(F.log(F.col("_n").cast("double")) / step)
    left = rest.withColumn("_s", F.explode(F.array(size - 1, size, size + 1)))
    right = _with_counts(others.where("key <> ''"), "key").select(*by, version, "other", F.col("key").alias("okey"), F.col("_n").alias("_on"), F.col("_c").alias("_oc"), size.alias("_s"))
    common = F.aggregate(F.zip_with("_c", "_oc", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    most = F.lit(alike / 2 - 1e-9) * (F.col("_n") + F.col("_on"))
    met = left.join(right, [*by, version, "_s"]).where((F.least("_n", "_on") >= most) & (common >= most))
    ordered = met.select(*place, "other", "key", "okey").repartition(*place).sortWithinPartitions(*place, "other")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, hit, asked, bits = difflib.SequenceMatcher(), None, None, {}
        for batch in batches:
            keep = []
            for row in batch.itertuples(index=False):
                at = row[: len(place)]
                if row.key != asked:
                    asked, bits = row.key, places(row.key)
                found = at != hit and ratio_at_least(matcher, row.key, row.okey, alike, bits)
                hit = at if found else hit
                keep.append(found)
            yield batch.loc[keep, place].astype(object)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields if f.name in place)
    return equal.unionByName(ordered.mapInPandas(verify, schema))


def structure_match(lines: DataFrame, others: DataFrame, by: tuple[str, ...] = ("song",), version: str = "version", key: str = "key", alike: float = ALIKE) -> DataFrame:
    """Per version, how many lines of the text have a similar one in it, and the share: ``by, version, hits, lines, share``."""
    hits = similar_lines(lines, others, by, version, key, alike).groupBy(*by, version).agg(F.count("*").alias("hits"))
    total = lines.groupBy(*by).agg(F.count("*").alias("lines"))
    met = others.select(*by, version).distinct().join(total, list(by)).join(hits, [*by, version], "left")
    return met.withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("share", F.col("hits") / F.col("lines")).select(*by, version, "hits", "lines", "share")

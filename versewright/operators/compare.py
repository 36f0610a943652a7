"""Versions of one text from several sources: grouping, vocabulary, variants and insertions."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def grouped_versions(versions: DataFrame, key: Column, label: str = "label") -> DataFrame:
    """One row per distinct text: ``key``, ``label`` like ``A ×2 + B``, ``copies``.  Labels combine by count before texts are joined."""
    per = versions.groupBy(key.alias("key"), label).agg(F.count("*").alias("n"))
    shown = F.when(F.col("n") > 1, F.concat(F.col(label), F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col(label))
    parts = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), shown.alias("s"))))
    return per.groupBy("key").agg(F.array_join(F.transform(parts, lambda p: p["s"]), " + ").alias("label"), F.sum("n").alias("copies"))


def vocabulary(texts: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct lower-cased words of all texts."""
    words = texts.select(*by, F.explode(F.split(X.word_key(F.col(text)), " ")).alias("word")).where("word <> ''")
    return words.distinct()


def allowed_spellings(candidates: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    """Spellings that some source has, case aside."""
    known = words.select(F.lower(word).alias("_k")).distinct()
    return candidates.withColumn("_k", F.lower(word)).join(known, "_k", "left_semi").drop("_k")


def insertion_support(insertions: DataFrame, versions: int, at: str = "after", key: str = "key", label: str = "label") -> DataFrame:
    """Insertions by place and key with how many labels have them: two at least when there are three versions or more."""
    found = insertions.groupBy(at, key).agg(F.count_distinct(label).alias("support"))
    return found.where(F.col("support") >= (2 if versions >= 3 else 1))


def line_break_variant(lines: DataFrame, option: Column, order: str = "line_no", by: tuple[str, ...] = ("song",), key: str = "key") -> DataFrame:
    """Whether ``option`` says no more than the line with its neighbour, or is a short end of the line: only the break differs."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after, own = F.lag(key).over(w), F.lead(key).over(w), F.col(key)
    joined = (option == F.concat_ws(" ", own, after)) | (option == F.concat_ws(" ", before, own))
    short = (F.length(option) < F.length(own) * 0.8) & (F.startswith(own, option) | F.endswith(own, option))
    return lines.withColumn("break_only", F.coalesce(joined, F.lit(False)) | F.coalesce(short, F.lit(False)))


#: Ratio from which a line is a variant of another.
ALIKE = 0.6


def _most_alike(a: list[list[str]], b: list[str]) -> int | None:
    """The first of the lines of ``a`` with the highest ratio to ``b`` of ``ALIKE`` or more; upper bounds of the ratio spare long lines the comparison, without a change of the result."""
    best, place = 0.0, None
    matcher = difflib.SequenceMatcher(None, autojunk=False)
    for i, line in enumerate(a):
        if 2 * min(len(line), len(b)) < ALIKE * (len(line) + len(b)):
            continue
        if not line and not b:
            ratio = 1.0
        else:
            common = (Counter(line) & Counter(b)).total()
            if (bound := 2 * common / (len(line) + len(b))) < ALIKE or bound <= best:
                continue
            matcher.set_seqs(line, b)
            ratio = matcher.ratio()
        if ratio >= ALIKE and ratio > best:
            best, place = ratio, i
    return place


def version_decisions(pairs: DataFrame, chosen: str = "chosen", other: str = "other") -> DataFrame:
    """Line-level differences of two versions: ``kind`` (variant or insertion), ``line_no`` and ``text``.

    ``chosen`` and ``other`` are arrays of lines.  Equal lines align by the
    longest matching blocks; in a replaced block every other line goes to
    the most alike chosen line (ratio 0.6 or more, first wins), else it is an
    insertion after the line before the block.  A pair is one song and one
    other version, so the kernel sees two texts at a time.
    """
    keys = [f for f in pairs.columns if f not in (chosen, other)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                a, b = list(row[chosen]), list(row[other])
                ka, kb = [x.lower().split() for x in a], [x.lower().split() for x in b]
                blocks = difflib.SequenceMatcher(None, [" ".join(x) for x in ka], [" ".join(x) for x in kb], autojunk=False).get_opcodes()
                for tag, i, j, k, m in blocks:
                    for y in range(k, m) if tag in ("replace", "insert") else ():
                        best = _most_alike(ka[i:j], kb[y])
                        if best is not None:
                            out.append({**{c: row[c] for c in keys}, "kind": "variant", "line_no": i + best, "text": b[y]})
                        else:
                            out.append({**{c: row[c] for c in keys}, "kind": "insertion", "line_no": i - 1, "text": b[y]})
            yield pd.DataFrame(out, columns=[*keys, "kind", "line_no", "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pairs.schema.fields if f.name in keys)
    return pairs.mapInPandas(run, schema + "kind string, line_no int, text string")


class _Lcs:
    """Lengths of the longest common subsequences of all pairs of suffixes, a bit per element and a number per row.

    Row ``k`` is for the last ``k`` elements of ``a``; its zeros among the lowest ``l``
    bits count what they have in common with the last ``l`` elements of ``b``.
    """

    def __init__(self, a: list, b: list) -> None:
        where: dict = {}
        for i, y in enumerate(reversed(b)):
            where[y] = where.get(y, 0) | 1 << i
        full = (1 << len(b)) - 1
        row, self.rows, self.sizes = full, [full], (len(a), len(b))
        for x in reversed(a):
            hit = row & where.get(x, 0)
            row = (row + hit | row & ~hit) & full
            self.rows.append(row)

    def after(self, i: int, j: int) -> int:
        """Of ``a`` from ``i`` on and ``b`` from ``j`` on."""
        size = self.sizes[1] - j
        return size - (self.rows[self.sizes[0] - i] & (1 << size) - 1).bit_count()


def lcs_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Index pairs ``(i, j)`` of a longest common subsequence of two arrays; of equal choices the earlier ``a`` moves first.

    Arrays of n and m elements take n x m / 8 bytes and n x m / 64 steps: 100,000
    lines against as many are 1.2 GB, so longer texts are cut at lines that both have
    once.
    """
    keys = [c for c in pairs.columns if c not in (a, b)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                x, y = list(row[a]), list(row[b])
                best, i, j = _Lcs(x, y), 0, 0
                while i < len(x) and j < len(y):
                    if x[i] == y[j]:
                        out.append({**{c: row[c] for c in keys}, "i": i, "j": j})
                        i, j = i + 1, j + 1
                    elif best.after(i + 1, j) >= best.after(i, j + 1):
                        i += 1
                    else:
                        j += 1
            yield pd.DataFrame(out, columns=[*keys, "i", "j"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pairs.schema.fields if f.name in keys)
    return pairs.mapInPandas(run, schema + "i int, j int")

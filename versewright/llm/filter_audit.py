"""How text filters act together: survivors of every subset of filters, per part and label.

A document fails some of the filters.  Its *survival word* is the truth table
of that: bit ``S`` of 2^n bits is set if the document survives when exactly
the filters of subset ``S`` are applied.  Adding up the words bit by bit gives
the survivors of all subsets at once, and every figure of the audit, for every
order of the filters, is a difference of two of these counts.

The bits are added by carry-save adders: three words become a sum word and a
carry word of twice the weight, for all bit positions together, until two
words of each weight are left.  Tasks give out counts for the (part, label)
pairs they have seen, so a part with a third of all rows is no larger
than another at the shuffle.

Filters (fixed by the audit's contract), words being maximal runs without ASCII white space:
A under 200 words; B 100 x distinct words < 50 x words; C 100 x ``[A-Z]`` >
2 x code points; D holds one of ``#$%&*|``; E the same text as a smaller
doc_id anywhere in the table.  Texts are compared by SHA-256.

Defined results: a null text is empty; a null part is the empty string; a row
with a null doc_id, and repeated rows of one doc_id, are documents of their own,
which have no label or share one, and never fail E because of each other; of
several label rows of a document any 1 counts; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen, utf8_values

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))
MARKS = re.compile(rb"[#$%&*|]")
#: Rows whose words are added up at once.
BLOCK = 1 << 16
#: Bit S of WORDS[failed]: survives the filters in S.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, CONTINUATION))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 2 * points) << 2 | (MARKS.search(text) is not None) << 3


def failures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, failed``: one row per document, ``failed`` holding a bit for each filter it fails."""
    kind = documents.schema[doc_id].dataType.simpleString()
    read = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_values(batch.column("text"))
            failed = pa.array([text_failures(t) for t in texts], pa.int32())
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), failed, digest], names=["doc_id", "part", "failed", "digest"])

    judged = frozen(read.mapInArrow(judge, f"doc_id {kind}, part string, failed int, digest binary"))
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    marked = judged.join(frozen(firsts), "digest", "left")  # stored: the join can be split at a hot text
    return marked.select("doc_id", "part", F.col("failed").bitwiseOR(F.shiftleft(again, 4)).alias("failed"))


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set, by carry-save addition."""
    totals, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third : 2 * third], words[2 * third : 3 * third], words[3 * third :]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate((half ^ c, rest))
        totals += weight * (words[:, None] >> np.arange(32, dtype=np.uint32) & 1).sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return totals


def subset_survivors(failed: DataFrame) -> DataFrame:
    """``part, good, toxic, survivors`` of rows ``part, failed, good, toxic``: survivors of subset S at place S."""
    kinds = "part string, good boolean, toxic boolean"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            codes = table.column("part").combine_chunks().dictionary_encode()
            flags = [table.column(n).combine_chunks().cast(pa.int64()).to_numpy() for n in ("good", "toxic")]
            key = codes.indices.to_numpy().astype(np.int64) * 4 + flags[0] * 2 + flags[1]
            words = WORDS[table.column("failed").to_numpy()]
            order = np.argsort(key, kind="stable")
            found, starts = np.unique(key[order], return_index=True)
            counts = [positional_popcounts(w) for w in np.split(words[order], starts[1:])]
            columns = [codes.dictionary.take(pa.array(found // 4)), pa.array(found // 2 % 2 == 1), pa.array(found % 2 == 1), pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "good", "toxic", "survivors"])

    counts = failed.select("part", "failed", "good", "toxic").mapInArrow(add, kinds + ", survivors array<bigint>")
    sums = F.array(*[F.sum(F.get("survivors", F.lit(s))) for s in range(SUBSETS)])
    return counts.groupBy("part", "good", "toxic").agg(sums.alias("survivors"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """``batches`` put together to about BLOCK rows."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _steps() -> Column:
    """All orders of the filters, step by step: the filter, and the subsets applied before and after it."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, x in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "x": x, "before": before, "after": before | 1 << x})
            before |= 1 << x
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,x:int,before:int,after:int>>")


def audit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """For each part, order of the filters and step: what the step keeps and removes, in documents.

    Columns ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley``.
    """
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc_id")).agg(one("quality"), one("toxic"))
    failed = failures(documents, doc_id, text, part).join(known, "doc_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = subset_survivors(failed.select("part", "failed", flag("quality").alias("good"), flag("toxic").alias("toxic")))
    cells = [F.struct("good", "toxic", "survivors")]
    parts = counts.groupBy("part").agg(F.collect_list(*cells).alias("cells"))  # four cells at most

    def total(where: str) -> Column:
        return F.expr(f"transform(sequence(0, {SUBSETS - 1}), s -> aggregate(cells, 0L, (t, c) -> t + if({where}, get(c.survivors, s), 0L)))")

    parts = parts.select("part", total("true").alias("n"), total("c.good").alias("g"), total("c.toxic").alias("t"))
    weights = [math.factorial(k) * math.factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]
    share = f"transform(sequence(0, {len(FILTERS) - 1}), x -> aggregate(sequence(0, {SUBSETS - 1}), 0L, (sum, s) -> sum + if((s & shiftleft(1, x)) = 0, get(array({', '.join(map(str, weights))}), bit_count(s)) * (get(n, s) - get(n, s | shiftleft(1, x))), 0L)))"
    rows = parts.withColumn("share", F.expr(share)).withColumn("o", F.explode(_steps())).select("part", "n", "g", "t", "share", "o.*")
    at = lambda a, s: f"get({a}, {s})"
    one_fails = "(get(n, 0) - get(n, shiftleft(1, x)))"
    whole = SUBSETS - 1
    return rows.select(
        "part", "filter_order", "step",
        F.expr(at("n", "after")).alias("kept"),
        F.expr(f"{at('n', 'before')} - {at('n', 'after')}").alias("removed"),
        F.expr(f"{one_fails} - ({at('n', 'before')} - {at('n', 'after')})").alias("redundant"),
        F.expr(f"get(n, {whole} ^ shiftleft(1, x)) - get(n, {whole})").alias("unique_fails"),
        F.expr(f"{at('g', 'before')} - {at('g', 'after')}").alias("good_lost"),
        F.expr(f"{at('t', 'before')} - {at('t', 'after')}").alias("toxic_lost"),
        F.expr("get(share, x)").alias("shapley"),
    )

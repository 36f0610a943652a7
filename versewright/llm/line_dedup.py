"""Line dedup by a log-template tree.

A line's leaf in the fixed-depth tree is its number of tokens and its
leading ``DEPTH`` tokens, where a token with a digit stands as ``<*>``.
A leaf holds any number of templates.  Inside a leaf a token's support is
the number of documents that have it at its position (each distinct line
weighed by its documents).  Of a line's tokens the ``SIMILAR`` share with the
highest support are constants, and with them all that are supported as well
as the least of these; the rest are variable fields.  Lines of a leaf with
equal constants are one template: the lines of a template support its
constants together, whatever else the leaf holds, while a field's values
scatter.  A line that shares too little with others is a template of its own.
A template that occurs in at least ``MIN_DOCS`` documents is boilerplate: its
first occurrence, in the smallest (doc_id, line), stays and the others are
dropped.  Lines of few tokens are treated alike unless ``short`` and
``short_docs`` ask for more documents.

Scale: lines travel as 64-bit hashes, one row per document and distinct
line.  An aggregation that combines before its shuffle finds the leaves that
recur in several documents; only their lines go on, and identical lines of a
leaf become one row, so a line with a third of all occurrences is one row.
Leaves with several texts have their tokens counted, one text per distinct
line, by an aggregation on (leaf, position, token).  Joins back to the
occurrences have one row per key on their right side.  Texts are shuffled
compressed, once to fetch the tokens of such lines and once to take lines
out.

Defined results: a null text stays null and an empty text empty; lines
without a token are kept; a text loses dropped lines and the line end of
each; a document whose lines are all dropped becomes the empty text; a null
``doc_id`` comes after all others when the first occurrence is chosen;
repeated rows (equal id and text) are treated alike, and lines that only they share stay; an empty table gives an empty result; other columns are passed on
by :func:`drop_templates`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen, slices, utf8_values, whole_groups

DEPTH = 3
SIMILAR = 0.8
MIN_DOCS = 2
BATCH_BYTES = 2 << 20
_FIELD = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")


def masked_tokens(line: bytes) -> list[bytes]:
    """Tokens between ASCII white space; those with a digit are variable fields."""
    tokens = line.split()
    if any(d in line for d in b"0123456789"):
        tokens = [b"<*>" if _FIELD.fullmatch(t) else t for t in tokens]
    return tokens


def leaf_of(tokens: list[bytes], depth: int = DEPTH) -> int:
    """64-bit name of a line's leaf."""
    return xxhash.xxh64_intdigest(b"%d\x00" % len(tokens) + b"\x00".join(tokens[:depth])) - (1 << 63)


def name_of(tokens: list[bytes]) -> int:
    """64-bit name of a line with its digits masked."""
    return xxhash.xxh64_intdigest(b" ".join(tokens)) - (1 << 63)


def _keys(doc_id: str, text: str) -> list[Column]:
    """A document's name by content, 128 bits: it can be made again in a later job, and only repeated rows share it."""
    return [F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"), F.xxhash64(F.lit(7), F.col(text), F.col(doc_id)).alias("k2")]


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """``(k1, k2, doc_id, line_no, n_tokens, leaf, line)`` of each distinct line with a token of each document, at its first place; hashes only."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            source, number, count, leaf, name = [], [], [], [], []
            for i, text in enumerate(utf8_values(batch.column("text"))):
                seen = set()
                for k, line in enumerate((text or b"").split(b"\n")):
                    tokens = masked_tokens(line)
                    if tokens and (own := name_of(tokens)) not in seen:
                        seen.add(own)
                        source.append(i)
                        number.append(k)
                        count.append(len(tokens))
                        leaf.append(leaf_of(tokens, depth))
                        name.append(own)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("k1", "k2", "doc_id")] + [pa.array(number, pa.int32()), pa.array(count, pa.int32()), pa.array(np.array(leaf, np.int64)), pa.array(np.array(name, np.int64))],
                names=["k1", "k2", "doc_id", "line_no", "n_tokens", "leaf", "line"],
            )

    return docs.select("k1", "k2", "doc_id", "text").mapInArrow(run, f"k1 bigint, k2 bigint, doc_id {kind}, line_no int, n_tokens int, leaf bigint, line bigint")


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` compressed, for a shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        at = names.index("text")
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = [None if t is None else press.compress(t) for t in utf8_values(batch.column(at))]
            columns = [pa.array(texts, pa.binary()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` " + ("binary" if f.name == "text" else f.dataType.simpleString()) for f in docs.schema.fields)
    return docs.mapInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if t is None else press.decompress(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(leaf, line, docs, tokens)`` of one occurrence of each wanted line; tokens as 64-bit hashes."""
    chosen = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("line_no", "leaf", "line", "docs")).alias("lines"))
    found = _packed(docs.select("k1", "k2", "text")).join(chosen, ["k1", "k2"]).select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            out: list[list] = [[], [], [], []]
            for text, wants in zip(_unpacked(batch), batch.column(1).to_pylist()):
                every = (text or b"").split(b"\n")
                for want in wants:
                    row = want["leaf"], want["line"], want["docs"], [xxhash.xxh64_intdigest(t) - (1 << 63) for t in masked_tokens(every[want["line_no"]])]
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["leaf", "line", "docs", "tokens"])

    return found.mapInArrow(run, "leaf bigint, line bigint, docs bigint, tokens array<bigint>").dropDuplicates(["leaf", "line"])


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser of each value."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ values >> np.uint64(shift)) * np.uint64(factor)
    return values ^ values >> np.uint64(31)


def template_names(line: np.ndarray, pos: np.ndarray, token: np.ndarray, votes: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """First row and template name of each line; rows are a line's tokens, all rows of a line together."""
    starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    sizes = np.diff(np.append(starts, len(line)))
    best = np.lexsort((-votes, np.repeat(np.arange(len(starts)), sizes)))
    bar = votes[best[starts + np.ceil(sizes * similar - 1e-9).astype(np.int64) - 1]]
    shown = np.where(votes >= np.repeat(bar, sizes), token, 0).view(np.uint64)
    own = _mixed(_mixed(shown) + _mixed(pos.astype(np.uint64) + np.uint64(1)))  # summed, so the order of rows does not matter
    return starts, _mixed(np.add.reduceat(own, starts)).view(np.int64)


def _templates(tokens: DataFrame, similar: float) -> DataFrame:
    """``(leaf, line, own)``: the template of each line of ``tokens`` as a 64-bit name inside its leaf."""
    spots = tokens.select("leaf", "line", "docs", F.posexplode("tokens").alias("pos", "token"))
    votes = frozen(spots.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("votes")))  # stored: the join can be split at a hot token
    counted = spots.drop("docs").join(votes, ["leaf", "pos", "token"]).select("line", "leaf", "pos", "token", "votes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line, leaf, pos, token, count in whole_groups(batches):
            if len(line):
                starts, own = template_names(line, pos, token, count, similar)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[starts]), pa.array(line[starts]), pa.array(own)], names=["leaf", "line", "own"])

    return counted.repartition("line").sortWithinPartitions("line").mapInArrow(run, "leaf bigint, line bigint, own bigint")


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similar: float = SIMILAR, short: int = 0, short_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Lines of recurring leaves, and the boilerplate lines among them.

    ``docs`` has ``k1, k2, doc_id, text``.  The second result has a row per
    distinct boilerplate line: ``leaf, line, first``, the place that stays.
    Templates of fewer than ``short`` tokens need ``short_docs`` documents.
    """
    lines = frozen(_lines(docs, depth))
    leaves = lines.groupBy("leaf").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min("line").alias("a"), F.max("line").alias("b"))
    # Aggregates are stored before they are joined back: then the join has an exchange on either side and a hot leaf can be split.
    recurring = frozen(leaves.where("lo <> hi").select("leaf", F.expr("a <> b").alias("several")))
    held = frozen(lines.join(recurring, "leaf"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "line_no")
    known = held.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min(place).alias("place"), F.first("n_tokens").alias("n_tokens"), F.first("several").alias("several"))
    known = frozen(known)
    wanted = known.where("several").select("leaf", "line", "docs", "place.k1", "place.k2", "place.line_no")
    named = _templates(frozen(_tokens(docs, wanted)), similar)
    fitted = frozen(known.join(named, ["leaf", "line"], "left").select("leaf", "line", "docs", "place", "n_tokens", F.coalesce("own", "line").alias("own")))
    templates = fitted.groupBy("leaf", "own").agg(F.count("*").alias("texts"), F.max("docs").alias("docs"), F.min("place").alias("first"), F.first("n_tokens").alias("n_tokens"))
    templates = frozen(templates)
    # A line of its own has its documents counted already; those of a template's lines are counted without repeats.
    shared = frozen(fitted.join(templates.where("texts > 1").select("leaf", "own"), ["leaf", "own"]).select("leaf", "own", "line"))
    joint = held.select("leaf", "line", "k1", "k2").join(shared, ["leaf", "line"]).select("leaf", "own", "k1", "k2").distinct().groupBy("leaf", "own").agg(F.count("*").alias("joint"))
    needed = F.when(F.col("n_tokens") < short, F.lit(max(min_docs, short_docs))).otherwise(F.lit(min_docs))
    boiler = templates.join(joint, ["leaf", "own"], "left").where(F.greatest("docs", "joint") >= needed).select("leaf", "own", "first")
    return held, fitted.select("leaf", "line", "own").join(frozen(boiler), ["leaf", "own"]).select("leaf", "line", "first")


def drop_templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None, **options) -> DataFrame:
    """``docs`` with all its columns, recurring template lines taken out of ``text``.

    ``counts`` names two more columns for the lines of each text and those
    dropped; they take the place of columns of these names.
    """
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name clashes from here on
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own, words = at[doc_id], at[text]
    named = named.withColumn(words, F.col(words).cast("string"))
    base = named.select(*_keys(own, words), F.col(own).alias("doc_id"), F.col(words).alias("text"))
    held, boiler = boilerplate(base, **options)
    found = held.join(boiler, ["leaf", "line"])
    stays = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("line_no") == F.col("first.line_no"))
    gone = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("line", stays.alias("stays"))).alias("gone"))
    rest = [c for c in named.columns if c != words]
    joined = _packed(named.select(*rest, F.col(words).alias("text"), *_keys(own, words))).join(gone, ["k1", "k2"], "left").select(*rest, "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            texts, counts, drops = [], [], []
            for raw, instructions in zip(_unpacked(batch), batch.column(len(rest) + 1).to_pylist()):
                every = [] if raw is None else raw.split(b"\n")
                kept = every
                if instructions:
                    once = {x["line"]: x["stays"] for x in instructions}
                    kept = []
                    for line in every:
                        tokens = masked_tokens(line)
                        name = name_of(tokens) if tokens else None
                        if name not in once:
                            kept.append(line)
                        elif once[name]:
                            kept.append(line)
                            once[name] = False
                texts.append(None if raw is None else b"\n".join(kept))
                counts.append(len(every))
                drops.append(len(every) - len(kept))
            new = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32()), pa.array(drops, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + new, names=[*rest, words, "lines", "dropped"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in named.schema.fields if f.name != words)
    done = joined.mapInArrow(run, schema + f"{words} string, lines int, dropped int")
    more = [F.col(x).alias(c) for x, c in zip(("lines", "dropped"), counts or ())]
    return done.select(*[F.col(at[c]).alias(c) for c in docs.columns if c not in (counts or ())], *more)

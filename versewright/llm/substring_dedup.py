"""Repeated passages, found by fixed-block anchors.

A *window* is ``window`` consecutive words of a document; every word covered by a
window whose words also start anywhere else is removed.  Blocks of ``(window +
1) // 2`` words at fixed, non-overlapping places of each document are the
reference index: every window holds a whole block of its own document.
If a window occurs twice, the block in it is met by a rolling window (of
a block's length) of the other place.  So:

1. Every rolling window of every document probes the index: blocks met by two or
   more rolling windows (their own is one) are anchors.
2. An anchor is extended: the windows around it, as many as a block has words, are
   compared by a fingerprint of 96 bits.  Those found twice are repeats, and
   their union is the maximal exact repeats.

Nothing is compared in pairs.  Rolling hashes travel packed, sorted and
as differences, at most two of a kind from each pack, so that a passage
shared by a third of all documents costs no more than another.  They are 48
bits wide and only choose anchors; a chance collision adds a comparison, never
a removal.  Texts are cut into words once and stored compressed in chunks; a
text of more than ``SEGMENT`` bytes is spread over chunks, each piece with the
words around it, so no task holds more than a piece.

Defined results: a null text is empty and has no words; documents with fewer
words than a window lose none; repeated rows are documents of their own, so all
their words go if they have a window; a null doc_id is kept as it is; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import frozen, slices, utf8_values

WINDOW = 35
#: Bytes of a piece of a long text, and of a chunk of texts.
SEGMENT = CHUNK = 1 << 20
#: Rolling windows that are packed at once, and that share a bucket on average.
PACK, BUCKET = 1 << 21, 1 << 20
FEWEST_BUCKETS = 64
#: Odd multipliers of the polynomial hashes.
FIRST, SECOND, THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F)
KEY_BITS = 48
#: Bytes whose words are hashed at once.
HASHED = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Piece(NamedTuple):
    """Words ``first`` to ``first + own`` of a document, with ``lead`` words before them and some behind."""

    words: list[bytes]
    first: int
    lead: int
    own: int


def pieces(text: bytes, around: int, size: int = SEGMENT) -> Iterator[Piece]:
    """A text in pieces of about ``size`` bytes, each with up to ``around`` words before and behind."""
    if len(text) <= size:
        words = text.split()
        yield Piece(words, 0, 0, len(words))
        return
    cuts, at = [0], 0
    while at < len(text):
        space = SPACE.search(text, min(at + size, len(text)))
        at = space.start() if space else len(text)
        cuts.append(at)
    first, before = 0, []
    for k in range(len(cuts) - 1):
        own = text[cuts[k] : cuts[k + 1]].split()
        after: list[bytes] = []
        j = k + 1
        while len(after) < around and j + 1 < len(cuts):
            after += text[cuts[j] : cuts[j + 1]].split()[: around - len(after)]
            j += 1
        yield Piece(before + own + after, first, len(before), len(own))
        first += len(own)
        before = (before + own)[-around:] if around else []


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ values >> np.uint64(32)


def _powers(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


@lru_cache(maxsize=8)
def _table(base: int, n: int) -> np.ndarray:
    """``base ** 0 ... base ** (n - 1)`` in 64 bits."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))), dtype=np.uint64)


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes so far, each times a power of its place."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(int(THIRD), HASHED)[: len(data)], out=sums[1:])
    return sums


def _gaps(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data == 32) | (data == 10))


def word_codes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``text``, which are a space or a line end apart: polynomials of their bytes, mixed.

    All words are hashed together: a word is the difference of two sums, divided by
    the power of its place.
    """
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    spaces = _gaps(data)
    starts, ends = np.concatenate(([0], spaces + 1)), np.append(spaces, len(data))
    codes, k = np.empty(len(starts), np.uint64), 0
    inverse = pow(int(THIRD), -1, 1 << 64)
    while k < len(starts):
        at = starts[k]
        stop = int(np.searchsorted(ends, at + HASHED, side="right"))
        if stop > k:
            sums, own = _sums(data[at : ends[stop - 1]]), starts[k:stop] - at
            codes[k:stop] = (sums[ends[k:stop] - at] - sums[own]) * _table(inverse, HASHED)[own]
        else:  # a word of more than HASHED bytes, in pieces
            stop, total = k + 1, 0
            for place in range(at, ends[k], HASHED):
                total += int(_sums(data[place : min(place + HASHED, ends[k])])[-1]) * pow(int(THIRD), int(place - at), 1 << 64)
            codes[k] = total % (1 << 64)
        k = stop
    return _mixed(codes)


def rolling(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Mixed polynomial hashes of all runs of ``length`` words, put together from runs of powers of two."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, done, run, size = np.zeros(n, np.uint64), 0, words, 1
    while done < length:
        if length & size:
            total += run[done : done + n] * _powers(base, done)
            done += size
        if done < length:
            run = run[: len(run) - size] + run[size:] * _powers(base, size)
            size *= 2
    return _mixed(total)


def rolling_at(words: np.ndarray, starts: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """The same of the runs at ``starts`` only, whichever way is shorter."""
    if len(starts) * 6 > len(words):
        return rolling(words, length, base)[starts]
    total = np.zeros(len(starts), np.uint64)
    for k in range(length):
        total += words[starts + k] * _powers(base, k)
    return _mixed(total)


_PACKER, _UNPACKER = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte by byte; the equal high bytes cost next to nothing once compressed."""
    return _PACKER.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_UNPACKER.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _at_most_two(same: np.ndarray) -> np.ndarray:
    """Places of sorted keys without a third and further one of a kind; ``same``: whether each but the first equals the one before."""
    return np.flatnonzero(~np.concatenate((np.zeros(min(2, len(same) + 1), bool), same[1:] & same[:-1])))


def _twice(same: np.ndarray) -> np.ndarray:
    """Places of one each of those sorted keys that are there twice or more."""
    return np.flatnonzero(same & ~np.concatenate(([False], same[:-1])))


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


class _Prints(NamedTuple):
    """Fingerprints of windows: 64 and 32 bits each."""

    a: np.ndarray
    b: np.ndarray

    @staticmethod
    def joined(parts: list[_Prints]) -> _Prints:
        """All of ``parts``, sorted."""
        a = np.concatenate([np.empty(0, np.uint64), *(p.a for p in parts)])
        b = np.concatenate([np.empty(0, np.uint32), *(p.b for p in parts)])
        return _Prints(a, b).at(np.lexsort((b, a)))

    def at(self, places: np.ndarray) -> _Prints:
        return _Prints(self.a[places], self.b[places])

    def same(self) -> np.ndarray:
        return (self.a[1:] == self.a[:-1]) & (self.b[1:] == self.b[:-1])

    def within(self, known: _Prints) -> np.ndarray:
        """Which of these are in sorted ``known``; first halves that are alike are looked through one by one."""
        found = np.zeros(len(self.a), bool)
        place = np.searchsorted(known.a, self.a)
        open_ = np.arange(len(self.a))
        while len(open_):
            open_ = open_[place[open_] < len(known.a)]
            open_ = open_[known.a[place[open_]] == self.a[open_]]
            found[open_] |= known.b[place[open_]] == self.b[open_]
            place[open_] += 1
        return found

    @staticmethod
    def unpacked(a: bytes, b: bytes) -> _Prints:
        return _Prints(unpack(a), np.frombuffer(b, np.uint32))


class _Chunk:
    """The pieces of one stored chunk, and the windows of each."""

    def __init__(self, row: dict, window: int) -> None:
        self.block, self.window, self.meta = (window + 1) // 2, window, row["meta"]
        self.whole = _UNPACKER.decompress(row["texts"])

    def __iter__(self) -> Iterator[tuple[dict, bytes, np.ndarray]]:
        """Each piece: where it is from, its text, the hashes of its words."""
        data, codes = np.frombuffer(self.whole, np.uint8), word_codes(self.whole)
        cuts = np.flatnonzero(data[_gaps(data)] == 10) + 1
        for meta, text, own in zip(self.meta, self.whole.split(b"\n"), np.split(codes, cuts)):
            yield meta, text, own if text else own[:0]

    def keys(self, meta: dict, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rolling keys of a piece's words, and the places of its whole blocks among them."""
        keys = rolling(codes, self.block, FIRST) >> np.uint64(64 - KEY_BITS)
        return keys, np.arange(-(meta["first"] - meta["lead"]) % self.block, len(keys), self.block)

    def anchored(self, meta: dict, codes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """First words of the windows around the blocks that are anchors."""
        first = -(meta["first"] - meta["lead"]) % self.block
        count = max(0, len(codes) - first) // self.block
        blocks = first + self.block * np.arange(count)
        keys = _mixed((codes[first : first + count * self.block].reshape(count, self.block) * _table(int(FIRST), self.block)).sum(axis=1, dtype=np.uint64))
        hit = blocks[_within(keys >> np.uint64(64 - KEY_BITS), anchors)]
        starts = (hit[:, None] - np.arange(self.window - self.block + 1)[None, ::-1]).ravel()
        starts = starts[(starts >= 0) & (starts + self.window <= len(codes))]
        return starts if self.window % 2 else np.unique(starts)  # two blocks fit in an even window

    def prints(self, codes: np.ndarray, starts: np.ndarray) -> _Prints:
        """Fingerprints of the windows at ``starts``."""
        if not len(starts):
            return _Prints(np.empty(0, np.uint64), np.empty(0, np.uint32))
        return _Prints(rolling_at(codes, starts, self.window, FIRST), (rolling_at(codes, starts, self.window, SECOND) >> np.uint64(32)).astype(np.uint32))


def _own(meta: dict, starts: np.ndarray) -> np.ndarray:
    """Which starts are the piece's own: those around it are counted by other pieces."""
    return (starts >= meta["lead"]) & (starts < meta["lead"] + meta["own"])


META = "array<struct<doc:{kind}, row:bigint, part:int, first:bigint, lead:int, own:int>>"


def store_chunks(documents: DataFrame, doc_id: str, text: str, window: int, segment: int = SEGMENT) -> DataFrame:
    """``chunk, n_words, split, meta, texts``: the words of all documents in stored chunks; long texts have chunks of their own."""
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"chunk bigint, n_words bigint, split boolean, meta {META.format(kind=kind)}, texts binary"
    read = documents.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, chunks, rows = TaskContext.get().partitionId() << 40, 0, 0
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        names = ["chunk", "n_words", "split", "meta", "texts"]

        def flush(split: bool) -> pa.RecordBatch:
            nonlocal chunks
            meta, texts = [m for m, _ in held[split]], [t for _, t in held[split]]
            data = zstandard.ZstdCompressor(3).compress(b"\n".join(texts))
            row = [place | chunks, sum(m["own"] for m in meta), split, meta, data]
            chunks += 1
            held[split], size[split] = [], 0
            kinds = [pa.int64(), pa.int64(), pa.bool_(), meta_type, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for batch in slices(batches, "text", CHUNK):
            for doc, data in zip(batch.column("doc").to_pylist(), utf8_values(batch.column("text"))):
                split = len(data) > segment
                for k, piece in enumerate(pieces(data, window - 1, segment)):
                    meta = {"doc": doc, "row": place | rows, "part": k, "first": piece.first, "lead": piece.lead, "own": piece.own}
                    joined = b" ".join(piece.words)
                    held[split].append((meta, joined))
                    size[split] += len(joined) + 1
                    if size[split] >= CHUNK:
                        yield flush(split)
                rows += 1
        for split in (False, True):
            if held[split]:
                yield flush(split)

    meta_type = _meta_type(documents.schema[doc_id].dataType)
    return frozen(read.mapInArrow(cut, schema))


def _meta_type(doc_type) -> pa.DataType:
    fields = [("doc", to_arrow_type(doc_type)), ("row", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("lead", pa.int32()), ("own", pa.int32())]
    return pa.list_(pa.struct(fields))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _packs(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """``bucket, keys, from, to`` of sorted 64-bit ``keys``; a bucket is a range of keys."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for bucket in range(buckets):
        if cuts[bucket] < cuts[bucket + 1]:
            yield bucket, keys[cuts[bucket] : cuts[bucket + 1]], cuts[bucket], cuts[bucket + 1]


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)], names=[n for n, _ in schema])


PACKED = [("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())]
PACKED_SQL = "bucket int, chunk bigint, keys binary, more binary"
FOUND = [("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())]
FOUND_SQL = "chunk bigint, keys binary, more binary"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The packs of each bucket; rows come sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != held[-1]["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _anchors(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    """``chunk, keys``: the keys of the blocks of each chunk that two or more rolling windows meet."""
    shift = np.uint64(64 - KEY_BITS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def windows() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            keys = keys[_at_most_two(keys[1:] == keys[:-1])]
            return _batch([(b, None, pack(k >> shift), None) for b, k, _, _ in _packs(keys << shift, buckets)], PACKED)

        for row in _rows(batches):
            chunk, own_blocks = _Chunk(row, window), []
            for meta, _, codes in chunk:
                keys, blocks = chunk.keys(meta, codes)
                places = np.arange(len(keys))
                own = keys[_own(meta, places)]
                held.append(own)
                size += len(own)
                own_blocks.append(keys[blocks])
            if own_blocks and len(found := np.unique(np.concatenate(own_blocks))):
                yield _batch([(b, row["chunk"], pack(k >> shift), None) for b, k, _, _ in _packs(found << shift, buckets)], PACKED)
            if size >= PACK:
                yield windows()
                held, size = [], 0
        if size:
            yield windows()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            keys = np.sort(np.concatenate([np.empty(0, np.uint64), *(unpack(r["keys"]) for r in rows if r["chunk"] is None)]))
            twice = keys[_twice(keys[1:] == keys[:-1])]
            out = []
            for r in rows:
                if r["chunk"] is not None and len(hit := (own := unpack(r["keys"]))[_within(own, twice)]):
                    out.append((r["chunk"], pack(hit), None))
            yield _batch(out, FOUND)

    packed = chunks.select("chunk", "meta", "texts").mapInArrow(probe, PACKED_SQL)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, FOUND_SQL).select("chunk", "keys")


def _gathered(found: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk: what its buckets have found, no more than the chunk has windows."""
    return frozen(found.groupBy("chunk").agg(*[F.collect_list(c).alias(c) for c in columns]))


def _repeats(chunks: DataFrame, anchors: DataFrame, window: int, buckets: int) -> DataFrame:
    """``chunk, keys, more``: fingerprints of windows around the anchors of each chunk that are there twice."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            known = np.sort(np.concatenate([unpack(k) for k in row["keys"]]))
            chunk, parts = _Chunk(row, window), []
            for meta, _, codes in chunk:
                starts = chunk.anchored(meta, codes, known)
                parts.append(chunk.prints(codes, starts[_own(meta, starts)]))
            prints = _Prints.joined(parts)
            prints = prints.at(_at_most_two(prints.same()))
            yield _batch([(b, row["chunk"], pack(k), prints.b[i:j].tobytes()) for b, k, i, j in _packs(prints.a, buckets)], PACKED)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            prints = [_Prints.unpacked(r["keys"], r["more"]) for r in rows]
            every = _Prints.joined(prints)
            twice = every.at(_twice(every.same()))
            out = []
            for r, own in zip(rows, prints):
                own = own.at(np.flatnonzero(own.within(twice)))
                if len(own.a):
                    out.append((r["chunk"], pack(own.a), own.b.tobytes()))
            yield _batch(out, FOUND)

    packed = chunks.select("chunk", "meta", "texts").join(anchors, "chunk").mapInArrow(extend, PACKED_SQL)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, FOUND_SQL)


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans, kept``.

    ``spans`` are the maximal runs of removed words, each from a word to the
    one behind its last; ``kept`` holds the other words, joined by one space.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    chunks = store_chunks(documents, doc_id, text, window, segment)
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(FEWEST_BUCKETS, words // BUCKET)
    anchors = _gathered(_anchors(chunks, window, buckets), "keys")
    repeats = _gathered(_repeats(chunks, anchors, window, buckets), "keys", "more")
    told = frozen(repeats.join(anchors.withColumnRenamed("keys", "anchors"), "chunk"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for row in _rows(batches):
            known = np.sort(np.concatenate([none, *(unpack(k) for k in row["anchors"] or [])]))
            repeated = _Prints.joined([_Prints.unpacked(a, b) for a, b in zip(row["keys"] or [], row["more"] or [])])
            chunk, out = _Chunk(row, window), {n: [] for n in ("doc_id", "row", "part", "n_words", "n_removed", "spans", "kept")}
            for meta, text, codes in chunk:
                gone = np.zeros(len(codes) + 1, np.int64)
                if len(repeated.a):
                    starts = chunk.anchored(meta, codes, known)
                    starts = starts[chunk.prints(codes, starts).within(repeated)]
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                gone = (np.cumsum(gone)[:-1] > 0)[meta["lead"] : meta["lead"] + meta["own"]]
                if gone.any() or meta["own"] < len(codes):
                    own = text.split(b" ")[meta["lead"] : meta["lead"] + meta["own"]]
                    text = b" ".join(w for w, g in zip(own, gone.tolist()) if not g)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))) + meta["first"]
                for n, x in zip(out, (meta["doc"], meta["row"], meta["part"], meta["own"], int(gone.sum()), edges.reshape(-1, 2).tolist(), text)):
                    out[n].append(x)
            kinds = [doc_type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names=list(out))

    doc_type = _meta_type(documents.schema[doc_id].dataType).value_type.field("doc").type
    schema = f"doc_id {kind}, row bigint, part int, n_words bigint, n_removed bigint, spans array<array<bigint>>, kept string"
    read = chunks.select("chunk", "split", "meta", "texts").join(told, "chunk", "left")
    whole, cut = (read.where(F.col("split") == s).select("chunk", "meta", "texts", "anchors", "keys", "more").mapInArrow(strip, schema) for s in (False, True))
    order = F.array_sort(F.collect_list(F.struct("part", "spans", "kept")))
    joined = cut.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("n_removed").alias("n_removed"), order.alias("parts"))
    joined = joined.select(
        "doc_id", "n_words", "n_removed", F.flatten(F.transform("parts", lambda p: p["spans"])).alias("spans"), F.concat_ws(" ", F.filter(F.transform("parts", lambda p: p["kept"]), lambda k: k != "")).alias("kept")
    )
    return whole.select("doc_id", "n_words", "n_removed", "spans", "kept").unionByName(joined)

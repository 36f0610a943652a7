"""Byte-level BPE by a priority queue of merge ranks over a linked symbol list.

Each distinct word of a batch is encoded once: its bytes form a doubly
linked list, every adjacent pair that can merge is queued by (rank,
position), and a queued pair whose symbols have changed meanwhile is skipped.
Words are kept in a bounded table while a worker lives; texts are whole.
Decoding concatenates the vocabulary's strings.

The vocabulary is a file of the ``tokenizers`` library whose path is a
parameter; it is read once per worker.  The file must be readable where
tasks run (it belongs to an installed package here).

Defined results: a null text counts as empty and has no ids; strings of
special tokens inside a text become those tokens' ids, as in the library;
repeated rows come out as often as they went in; an empty table gives an
empty result; other columns are passed on, and one that is named like an
output gives way to it.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, utf8_values

#: Words kept in a worker's table before it starts afresh.
KEPT_WORDS = 500_000
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 8 << 20
#: Fixed value: the word pattern of the byte-level pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The printable letter of each byte: Latin-1's visible ones stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return [out[b] for b in range(256)]


class ByteBpe:
    """A vocabulary file with its merges, and a table of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, word: bytes) -> bytes:
        """Ids of one word's bytes, as 32-bit integers."""
        find = self.merges.get
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        if n == 1:
            return array("I", ids).tobytes()
        # A queued pair is one number: its rank, then the position of its left symbol.
        wide = n.bit_length()
        low = (1 << wide) - 1
        queue = [(found >> 20) << wide | i for i in range(n - 1) if (found := find(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = pop(queue)
            i = top & low
            j = after[i]
            a = ids[i]
            if a < 0 or j >= n:
                continue
            found = find(a << 20 | ids[j])
            if found is None or found >> 20 != top >> wide:
                continue  # stale: one of the two has been merged meanwhile
            made = ids[i] = found & 0xFFFFF
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = find(made << 20 | ids[k])
                if found is not None:
                    push(queue, (found >> 20) << wide | i)
            p = before[i]
            if p >= 0:
                found = find(ids[p] << 20 | made)
                if found is not None:
                    push(queue, (found >> 20) << wide | p)
        return array("I", [x for x in ids if x >= 0]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk between spaces, as little-endian 32-bit integers."""
        out, pieces = [], self.pieces
        for word in WORDS.findall(chunk):
            ids = pieces.get(word)
            if ids is None:
                ids = self.merge(word.encode())
                if len(pieces) >= KEPT_WORDS:
                    pieces.clear()
                pieces[word] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A space always begins a word unless other white space meets it, so a
        text without double or closing spaces is cut there first; each piece
        but the first stands for itself with the space before it.
        """
        if not text:
            return b""
        pieces = text.split(" ")
        if "" in pieces:
            return self._chunk(text)
        words = self.words
        head = self._chunk(pieces[0])
        rest = pieces[1:]
        for piece in set(rest).difference(words):
            words[piece] = self._chunk(" " + piece)
        out = head + b"".join(map(words.__getitem__, rest))
        if len(words) > KEPT_WORDS:
            words.clear()
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in self.cut.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary's strings of these ids, one after another; broken UTF-8 is replaced as in the library."""
        raw = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian 32-bit) in place of the text, and the decoded text if ``decoded`` names a column."""
    keep = [f for f in docs.schema.fields if f.name not in (text, ids, decoded)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, text, BATCH_BYTES):
            coded = [bpe.encode((t or b"").decode("utf-8", "replace")) for t in utf8_values(batch.column(text))]
            new = [pa.array(coded, pa.binary())]
            if decoded:
                new.append(pa.array([bpe.decode(c).decode() for c in coded], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + new, names=[*names, ids, *([decoded] if decoded else [])])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + f"`{ids}` binary" + (f", `{decoded}` string" if decoded else "")
    return docs.select(*[f"`{n}`" for n in names], text).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``coded`` with the text of ``ids`` as ``out``; null ids give a null text."""
    keep = [f for f in coded.schema.fields if f.name not in (ids, out)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [None if c is None else bpe.decode(c).decode() for c in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(texts, pa.string())], names=[*names, out])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + f"`{out}` string"
    return coded.select(*[f"`{n}`" for n in names], ids).mapInArrow(run, schema)

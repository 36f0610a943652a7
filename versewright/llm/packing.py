"""Order-preserving packing by dynamic programming over window cuts.

A stream of documents is cut into windows of at most ``window`` tokens
without changing the order.  Cuts are allowed after documents, after
sentences and, where a sentence is long, every ``STRIDE`` tokens.  The best
cuts minimise padding plus a penalty for each cut inside a document: with
``p`` the tokens before a cut, ``f(j) = pen(j) - p(j) + min(f(i) + p(i)) +
window`` over cuts ``i`` with ``p(j) - p(i) <= window``, a sliding minimum
kept in a monotone queue, so a block takes time linear in its cuts.

Each partition is packed on its own in a stream: cuts are settled for
``BLOCK`` tokens at a time and what follows the last full window goes on
with the next block, so memory is bounded by a block and one document.  No
rows are shuffled.  A partition's last tokens are laid in windows of sizes
that are powers of two, which need no padding.

Word ids come from a file of the ``tokenizers`` library (its path is a
parameter).  Words are made distinct in each batch, encoded once per worker and
kept in a table of at most ``KEPT_WORDS``; texts with special tokens or control
separators are encoded whole.

Defined results: a null or empty text is a document of its end id alone;
repeated rows are packed as often as they occur; a null ``doc_id`` is passed
on; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices, utf8_values

WINDOW = 2048
END_ID = 1
#: Cost, in tokens of padding, of a cut after a sentence and inside one.
SENTENCE_CUT, INNER_CUT = 4, 48
#: Largest distance of two allowed cuts.
STRIDE = 64
#: Tokens whose cuts are settled at a time.
BLOCK = 1 << 19
#: Words that a worker keeps; beyond that it forgets those that it has not met for longest.
KEPT_WORDS = 600_000
BATCH_BYTES = 4 << 20
#: A private-use letter that keeps new words apart; texts that hold it are encoded whole.
MARK = "\ue000"
_ODD = re.compile("[\x1c-\x1f\x85\ue000]")


def _segments(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut before spaces."""
    at = 0
    while len(text) - at > size and (cut := text.find(" ", at + size)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


class WordIds:
    """Ids of whole texts, word by word.

    A batch's words are made distinct first; ids of known words lie one
    after another in ``flat``, at ``start`` and of ``size``.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.kept = kept
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocab = self.whole.get_vocab()
        self.ends_sentence = np.zeros(max(vocab.values()) + 2, bool)
        self.ends_sentence[[i for s, i in vocab.items() if s.endswith("</w>") and s.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        self.mark = self._ids(MARK)
        self.ends_word = np.zeros(len(self.ends_sentence), bool)
        self.ends_word[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.tails = {c: self._ids(c) for c in ".,"}
        self.place: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.start, self.size, self.met = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.turn = 0
        self._add([""], np.empty(0, np.uint32), np.zeros(1, np.int64))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, missing: list[str]) -> None:
        """Add new words, those without a closing point or comma first.

        A point or comma behind a letter or digit is a word of its own.  One
        lower-case form ends in a mark instead, but texts with it are not
        lower-cased here.
        """
        closed = [w for w in missing if w[-1] in ".," and w[-2:-1].isalnum() and w[-2] != "\u0130"]
        self._add_words(list({w[:-1] for w in closed}.union(missing).difference(closed, self.place)))
        if closed:
            core = np.fromiter((self.place[w[:-1]] for w in closed), np.int64, len(closed))
            tail = np.concatenate([self.tails[w[-1]] for w in closed])
            size = self.size[core].astype(np.int64)
            self._add(closed, np.insert(self._gather(self.start[core], size), np.cumsum(size), tail), size + 1)

    def _gather(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        moved = (starts - (np.cumsum(sizes) - sizes)).astype(np.int32)  # tables and batches hold far less than 2**31 ids
        at = np.repeat(moved, sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at]

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size.astype(np.int32)))
        self.met = np.concatenate((self.met, np.full(len(words), self.turn, np.int32)))
        self.flat = np.concatenate((self.flat, ids))

    def _add_words(self, missing: list[str]) -> None:
        """Encode words, thousands at a time.

        A word of letters only has one token that ends a word, its last;
        other words are kept apart by a mark.
        """
        plain = [w for w in missing if w.isalpha()]
        odd = [w for w in missing if not w.isalpha()]
        words, ids, sizes = [], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(plain), 2000):
            run = plain[at : at + 2000]
            own = np.array(self.whole.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends_word[own]) + 1
            if len(stops) == len(run):
                words += run
                ids.append(own)
                sizes.append(np.diff(stops, prepend=0))
            else:  # a letter that the library's tables class otherwise
                odd += run
        k = len(self.mark)
        for at in range(0, len(odd), 2000):
            run = odd[at : at + 2000]
            own = np.array(self.whole.encode_batch_fast([f" {MARK} ".join(run)], add_special_tokens=False)[0].ids, np.uint32)
            found = np.ones(max(0, len(own) - k + 1), bool)
            for i, x in enumerate(self.mark):
                found &= own[i : len(own) - k + 1 + i] == x
            marks = np.flatnonzero(found)
            if len(marks) != len(run) - 1:
                raise ValueError("a word holds the mark that keeps words apart")
            words += run
            ids.append(np.delete(own, (marks[:, None] + np.arange(k)).ravel()))
            sizes.append(np.diff(np.concatenate(([-k], marks, [len(own)]))) - k)
        self._add(words, np.concatenate(ids), np.concatenate(sizes))

    def _forget(self) -> None:
        """Keep the half of the table that was met last."""
        stay = np.zeros(len(self.size), bool)
        stay[np.argsort(self.met, kind="stable")[len(self.met) - self.kept // 2 :]] = True
        stay[0] = True  # the empty word
        moved = np.cumsum(stay) - 1
        keep = stay.tolist()
        self.place = {w: int(moved[i]) for w, i in self.place.items() if keep[i]}
        self.flat = self.flat[np.repeat(stay, self.size)]
        self.size, self.met = self.size[stay], self.met[stay]
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size

    def _of_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each of these texts without odd characters."""
        self.turn += 1
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [w for w in names if w not in self.place]
        if missing:
            self._learn(missing)
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        self.met[at] = self.turn
        which = coded.indices.to_numpy()
        sizes = self.size[at][which].astype(np.int64)
        ids = self._gather(self.start[at][which], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[cut.offsets.to_numpy()].tolist()
        if len(self.size) > self.kept:
            self._forget()
        return (ids[i:j] for i, j in zip(ends, ends[1:]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        out: list = []
        parts: list[str] = []
        places: list[int] = []
        held = 0

        def settle() -> None:
            for i, ids in zip(places, self._of_texts(parts)):
                out[i].append(ids)
            parts.clear()
            places.clear()

        for text in texts:
            out.append([])
            if _ODD.search(text) or any(s in text for s in self.special):
                out[-1].append(self._ids(text))
                continue
            # Case is dropped letter by letter, but for two letters whose lower case Python chooses otherwise.
            lower = "\u03a3" not in text and "\u0130" not in text
            own: list[str] = []
            for part in _segments(text, BATCH_BYTES):
                plain = part.isascii()
                part = part if plain else unicodedata.normalize("NFC", part)
                part = part.lower() if lower else part
                if not plain and not unicodedata.is_normalized("NFC", part):
                    break  # small letters that the library, asked word by word, would compose anew
                own.append(part.replace("\n", " "))
            else:
                for part in own:
                    parts.append(part)
                    places.append(len(out) - 1)
                    held += len(part)
                    if held >= BATCH_BYTES:
                        settle()
                        held = 0
                continue
            out[-1].append(self._ids(text))
        if parts:
            settle()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.uint32) for x in out]


@lru_cache(maxsize=4)
def load(path: str) -> WordIds:
    return WordIds(path)


def cut_points(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a stream of ids, as token counts before them, with their costs; ``ends`` are the documents' ends."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int32)
    cost[1:][ends_sentence[ids]] = SENTENCE_CUT
    cost[ends - 1] = -1  # between a document's last word and its end id
    cost[ends] = 0
    cost[0], cost[n] = -1, max(cost[n], 0)
    points = np.flatnonzero(cost >= 0)
    bounds = np.concatenate(([0], points))
    long = np.flatnonzero(np.diff(bounds) > stride)
    if len(long):
        inner = np.concatenate([np.arange(bounds[i] + stride, bounds[i + 1], stride) for i in long])
        cost[inner] = INNER_CUT
        points = np.flatnonzero(cost >= 0)
    return points, cost[points]


def best_cuts(points: list[int], costs: list[int], window: int = WINDOW) -> list[int]:
    """Cuts of a stream from 0 to ``points[-1]`` that cost least; no two neighbours of ``points`` are over ``window`` apart."""
    at, back = [0, *points], [0]
    # The queue holds cuts with rising f(i) + p(i), here kept in ``keys``.
    queue, keys, head = [0], [0], 0
    note = back.append
    for j, (p, cost) in enumerate(zip(points, costs), 1):
        low = p - window
        while at[queue[head]] < low:
            head += 1
        note(queue[head])
        k = keys[head] + window + cost
        while len(keys) > head and keys[-1] >= k:
            keys.pop()
            queue.pop()
        queue.append(j)
        keys.append(k)
    cuts, j = [], len(points)
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def closing_windows(n: int, window: int = WINDOW) -> list[int]:
    """Sizes for the last ``n`` tokens that need no padding: full windows, then powers of two."""
    return [window] * (n // window) + [1 << b for b in range(n.bit_length() - 1, -1, -1) if (n % window) >> b & 1]


class Packer:
    """Packs a stream of documents; gives out pieces ``(doc, ids, start, doc_tokens, window, offset)``."""

    def __init__(self, ends_sentence: np.ndarray, window: int = WINDOW, block: int = BLOCK):
        self.ends_sentence, self.window, self.block = ends_sentence, window, block
        self.docs: list[tuple] = []  # (document, its tokens)
        self.parts: list[np.ndarray] = []  # ids that are not packed yet
        self.packed, self.held, self.number = 0, 0, 0  # packed: tokens of the first document

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            yield from self._settle(False)

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield from self._settle(True)

    def _settle(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate(self.parts)
        ends = np.cumsum([n for _, n in self.docs]) - self.packed
        points, costs = cut_points(ids, ends, self.ends_sentence)
        cuts = best_cuts(points.tolist(), costs.tolist(), self.window)[:-1]  # the last window may still grow
        done = cuts[-1] if cuts else 0
        if last:
            cuts += (np.cumsum(closing_windows(len(ids) - done, self.window)) + done).tolist()
            done = len(ids)
        bounds = np.union1d(cuts, ends[ends <= done]).astype(np.int64)
        bounds = np.unique(np.append(bounds, done)) if done else bounds[:0]
        starts = np.concatenate(([0], bounds[:-1])) if len(bounds) else bounds
        window = np.searchsorted(cuts, starts, side="right")
        opened = np.concatenate(([0], cuts)).astype(np.int64)[window]
        which = np.searchsorted(ends, starts, side="right")
        begun = np.concatenate(([-self.packed], ends))[which]
        for i, j, w, o, d, b in zip(starts.tolist(), bounds.tolist(), window.tolist(), opened.tolist(), which.tolist(), begun.tolist()):
            doc, n = self.docs[d]
            yield doc, ids[i:j], i - b, n, self.number + w, i - o
        self.number += len(cuts)
        gone = int(np.searchsorted(ends, done, side="right"))
        open_at = np.concatenate(([-self.packed], ends))[gone]
        self.packed = int(done - open_at) if gone < len(ends) else 0
        self.docs = self.docs[gone:]
        self.parts = [ids[done:].copy()]
        self.held = len(ids) - done


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in their order: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids`` on demand."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        packer = Packer(words.ends_sentence, window)
        first = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], np.uint32)
        kind = None
        rows: list[tuple] = []

        def note(pieces: Iterator[tuple]) -> None:
            for doc, ids, start, n, number, offset in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, first + number, offset) + ((ids.tolist(),) if with_ids else ()))

        def out() -> pa.RecordBatch:
            kinds = [kind] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in slices(batches, "text", BATCH_BYTES):
            kind = batch.column(0).type
            texts = [(t or b"").decode("utf-8", "replace") for t in utf8_values(batch.column(1))]
            for doc, coded in zip(batch.column(0).to_pylist(), words.encode(texts)):
                note(packer.add(doc, np.concatenate((coded, end))))
            if rows:
                yield out()
                rows.clear()
        note(packer.close())
        if rows:
            yield out()

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)

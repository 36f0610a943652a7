"""Language identification as multilingual mixture inference.

Texts become a stream of letters with single spaces between words; their
character trigrams fall into 2**16 hashed classes.  A language's model is
its smoothed share of each class, learned from labelled documents.  A
document is a mixture: expectation-maximisation estimates each language's
share from the likelihoods of its trigrams, and the set of languages is
chosen by penalised likelihood, starting from all and dropping the smallest
share as long as the loss of log-likelihood stays below the penalty.

Most documents need no iteration: the likelihood is concave in the shares,
so for a single language ``b`` no mixture can gain more than
``N * (max_k mean(p_k / p_b) - 1)``; if that is below the penalty, the
penalised choice is ``b`` alone.

Training data: at most about ``TRAIN_PER_LANG`` labelled documents of each
language, chosen by a hash of ``doc_id`` (the share that is taken follows
from the count of each language; all documents of rarer ones are used).
What is gathered at the driver is the table of 2**16 classes for each
language, whatever the input's size.  Long texts are summed in blocks of
trigrams, so memory does not grow with their length times the languages.

Defined results: a null text or one without letters is ``und`` with score
0; null labels never train; without any labelled document every text is
``und``; repeated rows are treated alike; equal likelihoods go to the first
language in alphabetical order; other columns are passed on by
:func:`identify`, and one that is named like an output gives way to it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_values

CLASSES = 1 << 16
TRAIN_PER_LANG = 3000
#: Log-likelihood that another language must gain for each factor e of the text's length.
PENALTY = 12.0
ROUNDS = 40
BATCH_BYTES = 1 << 19
#: Numbers held at a time while log-likelihoods are summed.
BLOCK = 1 << 20
_BOUND = 1  # stands between documents


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of every code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigram_classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all trigrams of these texts, and where each text's begin (one more than texts)."""
    joined = "\x01".join(t.lower().replace("\x01", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    bound = points == _BOUND
    kept = letter | bound
    kept[1:] |= letter[:-1]  # one space after a word
    points = np.where(letter, points, np.where(bound, _BOUND, 32)).astype(np.uint32)[kept]
    # A bound and the word's space before it are both there; trigrams never reach across a bound.
    n = len(points)
    is_bound = points == _BOUND
    stops = np.flatnonzero(is_bound)
    if n < 3:
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    code = ((a * np.uint32(0x9E3779B1) ^ b) * np.uint32(0x85EBCA6B) ^ c) * np.uint32(0xC2B2AE35)
    whole = ~(is_bound[:-2] | is_bound[1:-1] | is_bound[2:])
    before = np.concatenate(([0], np.cumsum(whole)))
    starts = np.concatenate(([0], before[np.minimum(stops, n - 2)], [before[-1]]))
    return (code >> np.uint32(16))[whole], starts


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages and the share of each class in them, shape (CLASSES, languages)."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()
    names = sorted(r["lang"] for r in counts)
    if not names:
        return [], np.zeros((CLASSES, 0))
    share = {r["lang"]: min(1.0, per_lang / r["n"]) for r in counts}
    size = 1 << 30
    ticket = F.pmod(F.xxhash64(F.lit("train"), F.col(doc_id)), F.lit(size))
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * size))])
    chosen = labelled.where(ticket < limit[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {}
        for batch in slices(batches, "text", BATCH_BYTES):
            codes, starts = trigram_classes([(t or b"").decode("utf-8", "replace") for t in utf8_values(batch.column("text"))])
            for i, name in enumerate(batch.column("lang").to_pylist()):
                own = table.setdefault(name, np.zeros(CLASSES, np.int64))
                own += np.bincount(codes[starts[i] : starts[i + 1]], minlength=CLASSES)
        for name, own in table.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "code", "n"])

    sums = chosen.mapInArrow(count, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((CLASSES, len(names)))
    place = {x: i for i, x in enumerate(names)}
    table[sums["code"].to_numpy(int), [place[x] for x in sums["lang"]]] = sums["n"]
    smooth = 0.2
    return names, (table + smooth) / (table.sum(axis=0) + smooth * CLASSES)


def _loglik(p: np.ndarray, share: np.ndarray, weight: np.ndarray) -> float:
    return float(weight @ np.log(p @ share))


def _em(p: np.ndarray, share: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    n = weight.sum()
    for _ in range(rounds):
        after = share * ((weight / (p @ share)) @ p) / n
        if np.abs(after - share).max() < 1e-4:
            return after
        share = after
    return share


def mixture(p: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Shares of the languages for one document; ``p`` has a row per distinct trigram class and a column per language, ``weight`` counts the trigrams."""
    k = p.shape[1]
    share = _em(p, np.full(k, 1.0 / k), weight)
    active = np.flatnonzero(share > 1e-3)
    share = share[active] / share[active].sum()
    score = _loglik(p[:, active], share, weight)
    while len(active) > 1:
        drop = int(np.argmin(share))
        fewer = np.delete(active, drop)
        less = np.delete(share, drop)
        less = _em(p[:, fewer], less / less.sum(), weight)
        got = _loglik(p[:, fewer], less, weight)
        if score - got >= penalty:
            break
        active, share, score = fewer, less, got
    out = np.zeros(k)
    out[active] = share
    return out


def _sums(codes: np.ndarray, first: np.ndarray, last: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Sum of ``logs`` over each text's trigrams, in blocks of bounded memory; ``first`` and ``last`` are the texts' bounds, none empty."""
    out = np.zeros((len(first), logs.shape[1]))
    step = max(1, BLOCK // logs.shape[1])
    for lo in range(0, len(codes), step):
        i, j = np.searchsorted(last, lo, side="right"), np.searchsorted(first, lo + step)
        if i < j:
            out[i:j] += np.add.reduceat(logs[codes[lo : lo + step]], np.maximum(first[i:j], lo) - lo, axis=0)
    return out


def infer(texts: list[str], shares: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares of each language in each text, a row of zeros for texts without letters."""
    k = shares.shape[1]
    out = np.zeros((len(texts), k))
    codes, starts = trigram_classes(texts)
    full = np.flatnonzero(np.diff(starts) > 0)
    if not len(full) or not k:
        return out
    sums = _sums(codes, starts[:-1][full], starts[1:][full], np.log(shares))
    best = np.argmax(sums, axis=1)
    for b in range(k):
        mine = full[best == b]
        if not len(mine):
            continue
        ratio = shares / shares[:, b : b + 1]
        for d in mine:
            own = codes[starts[d] : starts[d + 1]]
            n = len(own)
            if n > CLASSES:
                own, weight = np.unique(own, return_counts=True)
                mean = weight @ ratio[own] / n
            else:
                mean = ratio[own].mean(axis=0)
            if n * (mean.max() - 1.0) < penalty * np.log(n + 1.0):
                out[d, b] = 1.0
            else:
                if n <= CLASSES:
                    own, weight = np.unique(own, return_counts=True)
                out[d] = mixture(shares[own], weight, penalty * np.log(n + 1.0))
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the language of most of each text and its share; only ``text`` is an input of the prediction."""
    names, shares = model
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(shares)
    keep = [f for f in docs.schema.fields if f.name not in (pred, score) and (f.name != text or keep_text)]
    cols = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in slices(batches, text, BATCH_BYTES):
            texts = [(t or b"").decode("utf-8", "replace") for t in utf8_values(batch.column(text))]
            found = infer(texts, table)
            top = found.argmax(axis=1) if names else np.zeros(len(texts), int)
            most = found.max(axis=1) if names else np.zeros(len(texts))
            # A text of one or two letters has no trigram: the first language stands for it.
            lettered = np.fromiter((m > 0 or any(c.isalpha() for c in t) for m, t in zip(most, texts)), bool, len(texts))
            lang = [names[i] if ok and names else "und" for i, ok in zip(top, lettered)]
            most = np.where(lettered & (most == 0) & bool(names), 1.0 / max(1, len(names)), most)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in cols] + [pa.array(lang), pa.array(np.minimum(most, 1.0))], names=[*cols, pred, score])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + f"`{pred}` string, `{score}` double"
    order = [f"`{n}`" for n in cols] + ([] if keep_text else [text])
    return docs.select(*order).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the fold that never trains: crc32 of its id as text, modulo 3, is 1."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3) == 1


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"), held_out(doc_id).alias("held_out"))
    model = train(base.where("not held_out"))
    return identify(base.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")

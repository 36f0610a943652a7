"""All repairs of a line's timing, one after the other: stray words, untimed words, order, gaps, lengths and flags.

Each step sees what the one before it has changed, so a line is repaired as a whole;
lines are independent rows, dealt as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timing import CLOSE_GAP, EDGE_WORD, LEAST_WORD

# Confidences below which a word is flagged, or can have strayed; how far (ms) a stray
# word is from its neighbour; the longest that it may then be.
LOW, STRAY, STRAY_GAP, STRAY_LENGTH = 0.03, 0.05, 500, 400
WORD = "struct<text: string, begin_ms: double, end_ms: double, confidence: double, flags: array<string>>"


def timed(word: dict) -> bool:
    return word["begin_ms"] is not None and word["end_ms"] is not None


def _flag(word: dict, name: str) -> None:
    if name not in word["flags"]:
        word["flags"].append(name)


def reanchored(words: list[dict]) -> None:
    """A hardly heard word far before the next one is put in front of it; the last of its run, behind the one before."""
    for k, w in enumerate(words):
        if not timed(w) or (w["confidence"] or 0.0) >= STRAY:
            continue
        behind = words[k + 1] if k + 1 < len(words) and timed(words[k + 1]) else None
        before = words[k - 1] if k and timed(words[k - 1]) else None
        length = min(w["end_ms"] - w["begin_ms"], STRAY_LENGTH)
        if behind and behind["begin_ms"] - w["end_ms"] > STRAY_GAP:
            w["begin_ms"], w["end_ms"] = behind["begin_ms"] - length, behind["begin_ms"]
        elif before and not behind and w["begin_ms"] - before["end_ms"] > STRAY_GAP:
            w["begin_ms"], w["end_ms"] = before["end_ms"], before["end_ms"] + length
        else:
            continue
        w["flags"].append("reanchored")


def filled(words: list[dict], begin: float | None, end: float | None) -> None:
    """Untimed words between their neighbours, or at an edge, or in the line's own time."""
    k = 0
    while k < len(words):
        stop = k
        while stop < len(words) and not timed(words[stop]):
            stop += 1
        run = words[k:stop]
        if run:
            edge = EDGE_WORD * len(run)
            left = words[k - 1]["end_ms"] if k else None
            right = words[stop]["begin_ms"] if stop < len(words) else None
            if left is None:
                left = begin if right is None else max(0.0, right - edge)
            if left is None:
                return
            if right is None:
                right = end if k == 0 and end is not None else left + edge
            span, sizes = max(LEAST_WORD * len(run), right - left), [max(1, len((w["text"] or "").strip())) for w in run]
            at = left
            for w, size in zip(run, sizes):
                w["begin_ms"], at = at, at + span * size / sum(sizes)
                w["end_ms"] = at
                _flag(w, "interpolated")
        k = stop + 1


def tidied(words: list[dict]) -> None:
    """Begins after the end before, short gaps closed, a least length, and a flag for hardly heard words."""
    for k, w in enumerate(words):
        if not timed(w):
            continue
        if k and timed(words[k - 1]):
            w["begin_ms"] = max(w["begin_ms"], words[k - 1]["end_ms"])
        if k + 1 < len(words) and timed(words[k + 1]) and 0 < words[k + 1]["begin_ms"] - w["end_ms"] < CLOSE_GAP:
            w["end_ms"] = words[k + 1]["begin_ms"]
        w["end_ms"] = round(max(w["end_ms"], w["begin_ms"] + LEAST_WORD))
        w["begin_ms"] = round(w["begin_ms"])
        if w["confidence"] is not None and w["confidence"] < LOW:
            _flag(w, "low-confidence")


def repaired(words: list[dict], background: list[dict], begin: float | None, end: float | None) -> tuple[list[dict], list[dict]]:
    """Both tracks of a line; only the main one can have stray words."""
    tracks = [[{**w, "flags": list(w["flags"]) if w["flags"] is not None else []} for w in t] for t in (words, background)]
    reanchored(tracks[0])
    for track in tracks:
        filled(track, begin, end)
    for track in tracks:
        tidied(track)
    return tracks[0], tracks[1]


def repaired_lines(lines: DataFrame, begin: str = "begin_ms", end: str = "end_ms") -> DataFrame:
    """``lines`` with ``words`` and ``background`` repaired; ``begin`` and ``end`` stand for the line's time where no word is timed."""
    keep = [f for f in lines.schema.fields if f.name not in ("words", "background")]
    names = [f.name for f in keep]
    read = lines.withColumns({c: F.col(c).cast(f"array<{WORD}>") for c in ("words", "background")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number = lambda x: None if x is None or x != x else float(x)
            both = [repaired(list(w) if w is not None else [], list(b) if b is not None else [], number(lo), number(hi)) for w, b, lo, hi in zip(batch["words"], batch["background"], batch[begin], batch[end])]
            yield batch[names].assign(words=[x for x, _ in both], background=[x for _, x in both]).astype(object)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return read.select(*names, "words", "background").mapInPandas(run, schema + f"words array<{WORD}>, background array<{WORD}>")

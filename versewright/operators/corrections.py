"""Corrections of placed lines by their source's times, in one ordered pass over a song.

An unsure line that contradicts its source is laid over the source's time; another line
that starts late is stretched back to it; words that run past their line's end and into the
next line are squeezed.  Each line sees how far the corrected lines before it reach; a
pass holds one line.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_repair import WORD, timed

# Mean confidence below which a line is a guess; ms that a guess may stray from its
# source, that a line may start late or end late; ms of a squeezed word, of a word laid over a pause,
# of a line at least, and of a word without room.
UNSURE, STRAY_MS, LATE_MS = 0.2, 1000, 400
SQUEEZED_MS, LAID_MS, LEAST_LINE_MS, TIGHT_MS = 200, 450, 1000, 300


def trusted_offset(line: dict) -> float | None:
    """The offset to lay an unsure line by, the song's where the line's own contradicts it as well; None where the placement stands."""
    own = [w for w in line["words"] if timed(w)]
    if not own or line["begin_ms"] is None or sum(w["confidence"] or 0.0 for w in own) / len(own) >= UNSURE:
        return None
    away = lambda offset: abs(own[0]["begin_ms"] - line["begin_ms"] - offset) > STRAY_MS
    if away(line["local_ms"]):
        return line["local_ms"]
    return line["song_ms"] if abs(line["local_ms"] - line["song_ms"]) > STRAY_MS and away(line["song_ms"]) else None


def laid_over(line: dict, offset: float, reach: float) -> list[dict]:
    """The line's words over its source's time, by text length, without confidence and flagged."""
    count = len(line["words"])
    start = max(line["begin_ms"] + offset, reach)
    end = min(x for x in (line["duration_ms"], line["end_ms"] + offset, start + max(LEAST_LINE_MS, LAID_MS * count)) if x is not None)
    end = start + TIGHT_MS * count if end <= start else end
    sizes, at, out = [max(1, len((w["text"] or "").strip())) for w in line["words"]], start, []
    for word, size in zip(line["words"], sizes):
        out.append({**word, "begin_ms": at, "end_ms": at + (end - start) * size / sum(sizes), "confidence": None, "flags": ["line-timing"]})
        at = out[-1]["end_ms"]
    return out


def pulled_back(line: dict, offset: float, reach: float) -> list[dict]:
    """The line's words, the first one begun when the source says, but not inside the line before."""
    words = list(line["words"])
    first = next((k for k, w in enumerate(words) if timed(w)), None)
    if first is None or line["begin_ms"] is None:
        return words
    start = line["begin_ms"] + offset
    start = reach if start < reach - LATE_MS else start
    if words[first]["begin_ms"] - start > LATE_MS:
        words[first] = {**words[first], "begin_ms": start}
    return words


def squeezed(line: dict, following: dict) -> list[dict]:
    """Words that run past their line's end and the next line's begin, in proportion before both; untouched where there is no room."""
    own, other = [w for w in line["words"] if timed(w)], [w for w in following["words"] if timed(w)]
    if not own or not other or line["end_ms"] is None:
        return line["words"]
    start, end, wanted = own[0]["begin_ms"], own[-1]["end_ms"], line["end_ms"] + line["local_ms"]
    limit = min(wanted, other[0]["begin_ms"])
    if end - wanted <= LATE_MS or end <= other[0]["begin_ms"] or limit - start < SQUEEZED_MS * len(own):
        return line["words"]
    at = lambda t: start + (t - start) * (limit - start) / (end - start)
    return [{**w, "begin_ms": at(w["begin_ms"]), "end_ms": at(w["end_ms"])} if timed(w) else w for w in line["words"]]


def corrections(lines: Iterable[dict]) -> Iterator[dict]:
    """One song's lines in order, corrected."""
    held, reach = None, 0.0
    for line in lines:
        offset = trusted_offset(line)
        if offset is not None and line["end_ms"] is not None:
            words = laid_over(line, offset, reach)
        else:
            words = pulled_back(line, min(line["local_ms"], line["song_ms"]), reach)
        line = {**line, "words": words, "from_source": offset is not None and line["end_ms"] is not None}
        reach = max([reach, *(w["end_ms"] for w in words if timed(w))])
        if held is not None:
            yield {**held, "words": squeezed(held, line)}
        held = line
    if held is not None:
        yield held


NUMBERS = ("begin_ms", "end_ms", "local_ms", "song_ms", "duration_ms")


def corrected_lines(lines: DataFrame, song: str = "song", order: str = "line_no") -> DataFrame:
    """``song, order, words, from_source``.

    ``lines``: song, ``order``, begin_ms and end_ms of the source, local_ms and
    song_ms (offsets of line and song), duration_ms, ``words``.  Null offsets are 0.
    """
    offsets = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("local_ms", "song_ms")}
    read = lines.select(song, order, *[offsets.get(c, F.col(c).cast("double")).alias(c) for c in NUMBERS], F.col("words").cast(f"array<{WORD}>").alias("words"))
    ordered = read.repartition(song).sortWithinPartitions(song, order)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                numbers = {c: None if x is None or x != x else float(x) for c, x in zip(NUMBERS, row[2:-1])}
                yield row[0], {**numbers, "words": list(row[-1]) if row[-1] is not None else [], "song": row[0], "order": row[1]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, waiting, out = rows(batches), [], []

        def of_song(first: tuple) -> Iterator[dict]:
            yield first[1]
            for row in source:
                if row[0] != first[0]:
                    waiting.append(row)
                    return
                yield row[1]

        first = next(source, None)
        while first is not None:
            for line in corrections(of_song(first)):
                out.append((line["song"], line["order"], line["words"], line["from_source"]))
                if len(out) == 1000:
                    yield pd.DataFrame(out, columns=[song, order, "words", "from_source"]).astype(object)
                    out = []
            first = waiting.pop() if waiting else None
        yield pd.DataFrame(out, columns=[song, order, "words", "from_source"]).astype(object)

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    return ordered.mapInPandas(run, f"`{song}` {kinds[song]}, `{order}` {kinds[order]}, words array<{WORD}>, from_source boolean")

"""Greedy steps whose outcome depends on what they did before, each in one ordered pass over a song's rows.

Songs are dealt over tasks and sorted by Spark; a pass holds a few values, whatever a
song's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, in milliseconds and words.
JOIN_GAP, LONGEST_PIECE, LINE_PAUSE, LINE_WORDS = 2000, 25_000, 600, 14
SENTENCE_END = re.compile(r"[.!?]\s*$")


def group_pieces(pieces: DataFrame, song: str = "song", gap: int = JOIN_GAP, longest: int = LONGEST_PIECE) -> DataFrame:
    """Spans joined to the one before while the gap is at most ``gap`` and the whole at most ``longest``: song, begin_ms, end_ms, n."""
    ordered = pieces.select(song, F.col("begin_ms").cast("bigint").alias("begin_ms"), F.col("end_ms").cast("bigint").alias("end_ms")).repartition(song).sortWithinPartitions(song, "begin_ms", "end_ms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece: list = []
        for batch in batches:
            out = []
            for own, begin, end in zip(*(batch[c].tolist() for c in batch.columns)):
                if piece and piece[0] == own and begin - piece[2] <= gap and end - piece[1] <= longest:
                    piece[2], piece[3] = max(end, piece[2]), piece[3] + 1
                    continue
                if piece:
                    out.append(tuple(piece))
                piece = [own, begin, end, 1]
            yield pd.DataFrame(out, columns=[song, "begin_ms", "end_ms", "n"]).astype(object)
        if piece:
            yield pd.DataFrame([piece], columns=[song, "begin_ms", "end_ms", "n"]).astype(object)

    return ordered.mapInPandas(run, f"`{song}` {pieces.schema[song].dataType.simpleString()}, begin_ms bigint, end_ms bigint, n bigint")


def heard_lines(words: DataFrame, song: str = "song", pause: int = LINE_PAUSE, most: int = LINE_WORDS) -> DataFrame:
    """Heard words as lines: a break at a pause, after a word that ends a sentence, or after ``most`` words: song, line_no, word_id."""
    ordered = words.select(song, "begin_ms", "word_id", "end_ms", F.coalesce("text", F.lit("")).alias("text")).repartition(song).sortWithinPartitions(song, "begin_ms", "word_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, line, n, ended, stop = None, 0, 0, 0, False
        for batch in batches:
            lines = []
            for own, begin, end, text in zip(*(batch[c].tolist() for c in (song, "begin_ms", "end_ms", "text"))):
                if own != last:
                    last, line, n = own, 0, 0
                elif n >= most or stop or begin - ended >= pause:
                    line, n = line + 1, 0
                n, ended, stop = n + 1, end, bool(SENTENCE_END.search(text))
                lines.append(line)
            yield batch[[song, "word_id"]].assign(line_no=lines)[[song, "line_no", "word_id"]].astype(object)

    kinds = {c: words.schema[c].dataType.simpleString() for c in (song, "word_id")}
    return ordered.mapInPandas(run, f"`{song}` {kinds[song]}, line_no int, word_id {kinds['word_id']}")


def windows_of(words: DataFrame, song: str = "song", longest: int = 7400) -> DataFrame:
    """Consecutive words packed greedily into windows of at most ``longest`` from first begin to last end: song, window, begin_ms, end_ms, n."""
    return group_pieces(words, song, gap=longest, longest=longest)


def split_at_quietest(hops: DataFrame, pieces: DataFrame, song: str = "song", least: int = 5, most: int = 20) -> DataFrame:
    """The quietest hop of each piece between ``least`` and ``most`` hops after its begin (``first_hop``): where a long piece is cut.

    Each piece names the hops it asks for, so the join is on (song, hop).
    """
    asked = pieces.select(song, "first_hop", F.explode(F.sequence(F.col("first_hop") + least, F.col("first_hop") + most)).alias("hop"))
    met = asked.join(hops, [song, "hop"])
    return met.groupBy(song, "first_hop").agg(F.min(F.struct("rms", "hop")).alias("q")).select(song, "first_hop", F.col("q.hop").alias("cut"))

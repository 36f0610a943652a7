"""Timing repair, transcript anchoring and reviewed decisions, song by song.

Words and lines stay in tables; what needs one pass over a song in order
(matching blocks of two word sequences) is a small kernel inside
``applyInPandas`` with one song as a group; its time is near to linear in the
song's length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shapes import LINE, TRACK, timed

#: Fixed values of timing repair, in milliseconds.
DETACHED_GAP, REANCHORED_LENGTH, CLOSE_GAP, LEAST_WORD, PER_WORD = 500, 400, 300, 50, 300
#: Confidence below which a word is weak, or flagged.
DETACHED, LOW = 0.05, 0.03
#: A run of matched words counts from two words on, a single one from four letters on.
LEAST_RUN, LEAST_SINGLE = 2, 4
#: Share of lines that may be removed, notes that are kept.
REMOVED_SHARE, NOTES = 0.25, 10


def reanchored(words: DataFrame) -> DataFrame:
    """Weak words far from their neighbour moved next to it, with ``moved``.

    A weak word more than half a second before the timed word behind it ends
    where that begins; without one behind, it begins where the word before
    ends.  A word before that has been moved itself already touches this one.
    """
    w = Window.partitionBy(*TRACK).orderBy("word_no")
    weak = timed() & (F.coalesce(F.col("confidence"), F.lit(0.0)) < DETACHED)
    after, before_end, before_weak = F.lead("begin_ms").over(w), F.lag("end_ms").over(w), F.lag(weak).over(w)
    behind_timed = F.coalesce(F.lead(timed()).over(w), F.lit(False))
    before_timed = F.coalesce(F.lag(timed()).over(w), F.lit(False))
    length = F.least(F.col("end_ms") - F.col("begin_ms"), F.lit(REANCHORED_LENGTH))
    gap_before = F.when(before_weak & (F.col("begin_ms") - before_end > DETACHED_GAP), 0).otherwise(F.col("begin_ms") - before_end)
    forward = weak & behind_timed & (after - F.col("end_ms") > DETACHED_GAP)
    back = weak & ~behind_timed & before_timed & (gap_before > DETACHED_GAP)
    marked = words.withColumns({"_f": F.coalesce(forward, F.lit(False)), "_b": F.coalesce(back, F.lit(False)), "_len": length, "_after": after, "_before": before_end})
    begin = F.when(F.col("_f"), F.col("_after") - F.col("_len")).when(F.col("_b"), F.col("_before")).otherwise(F.col("begin_ms"))
    end = F.when(F.col("_f"), F.col("_after")).when(F.col("_b"), F.col("_before") + F.col("_len")).otherwise(F.col("end_ms"))
    return marked.withColumns({"begin_ms": begin, "end_ms": end, "moved": F.col("_f") | F.col("_b")}).drop("_f", "_b", "_len", "_after", "_before")


def anchor_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_']", "")


def transcript_times(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Each heard word with a key and its begin: its own where all words of its line are timed, else a share of the line's span by length of key.

    ``lines`` have song, line_no, begin_ms, end_ms; a line that has neither
    kind of time gives no words.
    """
    keyed = words.withColumn("key", anchor_key(F.col("text")))
    whole = keyed.withColumns({"_all": F.min(timed()).over(Window.partitionBy(*LINE)), "_w": F.greatest(F.lit(1), F.length("key"))})
    at = Window.partitionBy(*LINE).orderBy("word_no")
    spread = whole.join(lines.select(*LINE, F.col("begin_ms").alias("_lb"), F.col("end_ms").alias("_le")), list(LINE), "left")
    before = F.coalesce(F.sum("_w").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.col("_lb") + (F.col("_le") - F.col("_lb")) * before / F.sum("_w").over(Window.partitionBy(*LINE))
    begin = F.when(F.col("_all"), F.col("begin_ms").cast("double")).otherwise(share)
    return spread.withColumn("heard_ms", begin).where("heard_ms is not null and key <> ''").select("song", "line_no", "word_no", "key", "heard_ms")


def _runs(codes: np.ndarray, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """A number for each run of ``size`` values, equal for equal runs; ``known`` holds those of powers of two."""
    if size not in known:
        half = 1 << (size - 1).bit_length() - 1
        part = _runs(codes, half, known) if half > 1 else codes
        n = len(codes) - size + 1
        whole = np.unique(part[:n] * len(codes) + part[size - half : size - half + n], return_inverse=True)[1]
        if size & (size - 1):
            return whole
        known[size] = whole
    return known[size]


def matching_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """The blocks (place in a, place in b, length) of ``difflib`` without junk: the longest common run, the leftmost of equal ones, and so on at either side of it.

    What is on both sides of a longest run has no longer one, so blocks are
    taken by falling length: for a length each stretch between blocks is
    passed once from left to right, with equal runs looked up in sorted
    places of ``b``.  Which lengths occur at all is found by halving.
    """
    n, m = len(a), len(b)
    number: dict = {}
    codes = np.array([number.setdefault(x, len(number)) for x in a] + [-1] + [number.setdefault(x, len(number)) for x in b], np.int64)
    codes[n] = len(number)  # no run across the border equals another
    known: dict[int, np.ndarray] = {1: codes}
    # For each place of a its stretch: where it begins and ends, and the stretch of b it belongs to.
    start, stop, low, high = np.zeros(n, np.int64), np.full(n, n), np.zeros(n, np.int64), np.full(n, m)

    def met(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose run of ``size`` occurs in their stretch of b, the runs' numbers, and the sorted runs of b with their places."""
        if size > min(n, m):
            return np.empty(0, np.int64), codes, codes
        runs = _runs(codes, size, known) * (m + 1)
        there = np.sort(runs[n + 1 :] + np.arange(m - size + 1))
        at = np.arange(n - size + 1)
        at = at[(at + size <= stop[: len(at)]) & (low[: len(at)] + size <= high[: len(at)])]
        first = np.searchsorted(there, runs[at] + low[at])
        hit = there[np.minimum(first, len(there) - 1)]
        return at[(first < len(there)) & (hit >= runs[at]) & (hit <= runs[at] + high[at] - size)], runs, there

    blocks: list[tuple[int, int, int]] = []
    size, found = 1, met(1)
    while len(found[0]) and len((more := met(2 * size))[0]):
        size, found = 2 * size, more
    above = 2 * size  # no run is as long as this
    while len(found[0]):
        while above - size > 1:
            middle = (size + above) // 2
            if len((more := met(middle))[0]):
                size, found = middle, more
            else:
                above = middle
        places, runs, there = found
        end = left = below = -1
        for i in places.tolist():
            if i >= end:  # another stretch
                if end > left:
                    start[left:end], low[left:end] = left, below
                end, left, below, top = int(stop[i]), int(start[i]), int(low[i]), int(high[i])
            if i < left or i + size > end:
                continue
            run = int(runs[i])
            k = int(np.searchsorted(there, run + below))
            if k == len(there) or there[k] > run + top - size:
                continue
            j = int(there[k]) - run
            blocks.append((i, j, size))
            start[left:i], stop[left:i], low[left:i], high[left:i] = left, i, below, j
            high[i : i + size] = -1
            left, below = i + size, j + size
        if end > left:
            start[left:end], low[left:end] = left, below
        above, size = size, 1
        if above == 1:
            break
        found = met(above - 1)
        if len(found[0]):
            size = above - 1
        else:
            above, found = above - 1, met(1)
    out: list[tuple[int, int, int]] = []
    for i, j, k in sorted(blocks):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out


def first_hits(ours: list[tuple[int, int, str]], heard: list[tuple[str, float]]) -> dict[int, tuple[int, float]]:
    """For each of our lines with a solid match: place of its first matched word, and when that was heard; ``ours`` has (line, place, key)."""
    hits: dict[int, tuple[int, float]] = {}
    places: dict[tuple[int, str], int] = {}
    for line, place, key in ours:
        places.setdefault((line, key), place)
    for i, j, size in matching_blocks([k for _, _, k in ours], [k for k, _ in heard]):
        if size >= LEAST_RUN or len(ours[i][2]) >= LEAST_SINGLE:
            for (line, _, key), (_, at) in zip(ours[i : i + size], heard[j : j + size]):
                if line not in hits:
                    hits[line] = (places[line, key], at)
    return hits


def anchored_lines(lines: DataFrame, words: DataFrame, heard: DataFrame) -> DataFrame:
    """Lines (song, line_no, duration_ms) with ``begin_ms``, ``end_ms`` and ``matched`` from a transcript of the same song.

    Solid matches of word keys place a line, stepped back over the words
    before the match; a match that would go back in time is dropped; other
    lines lie between their neighbours by number of words.  A song without a
    match leaves its lines untimed.
    """
    kind = lines.schema["song"].dataType.simpleString()
    ours = words.select("song", "line_no", "word_no", anchor_key(F.col("text")).alias("key"), F.lit(None).cast("double").alias("at"), F.lit(0).alias("side"))
    other = heard.select("song", "line_no", "word_no", "key", F.col("heard_ms").alias("at"), F.lit(1).alias("side"))
    length = lines.select("song", "line_no", F.lit(None).cast("int").alias("word_no"), F.lit(None).cast("string").alias("key"), F.col("duration_ms").cast("double").alias("at"), F.lit(2).alias("side"))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        sides = rows["side"].to_numpy()
        order = np.lexsort((rows["word_no"].to_numpy(float), rows["line_no"].to_numpy(float), sides))
        cut = np.searchsorted(sides[order], [0, 1, 2, 3])
        line, word, key, at = (rows[c].to_numpy()[order] for c in ("line_no", "word_no", "key", "at"))
        mine, theirs, whole = (slice(x, y) for x, y in zip(cut, cut[1:]))
        numbers, duration = line[whole].tolist(), float(at[whole][0]) if cut[3] > cut[2] else 0.0
        out = pd.DataFrame({"song": rows["song"].iloc[0], "line_no": numbers, "begin_ms": None, "end_ms": None, "matched": False})
        lines = line[mine].tolist()
        keyed = [(n, int(p), k) for n, p, k in zip(lines, word[mine].tolist(), key[mine]) if k]
        hits = first_hits(keyed, list(zip(key[theirs], at[theirs].tolist()))) if keyed and cut[2] > cut[1] else {}
        if any(n in hits for n in numbers):
            each = Counter(lines)
            counts = [each[n] for n in numbers]
            begins = _interpolated(_in_order([max(0.0, hits[n][1] - hits[n][0] * PER_WORD) if n in hits else None for n in numbers]), counts, duration)
            out["begin_ms"], out["end_ms"], out["matched"] = begins, list(_line_ends(begins, counts, duration)), [n in hits for n in numbers]
        return out

    return ours.unionByName(other).unionByName(length).groupBy("song").applyInPandas(place, f"song {kind}, line_no int, begin_ms double, end_ms double, matched boolean")


def _in_order(begins: list[float | None]) -> list[float | None]:
    last, out = -1.0, []
    for b in begins:
        keep = b is not None and b >= last
        out.append(b if keep else None)
        last = b if keep else last
    return out


def _interpolated(begins: list[float | None], counts: list[int], duration: float) -> list[float]:
    """Every line's begin: between known ones by words, outside them two word lengths for each word."""
    known = [i for i, b in enumerate(begins) if b is not None]
    upto = [0]
    for n in counts:
        upto.append(upto[-1] + n)
    out = []
    for i, b in enumerate(begins):
        after = bisect_right(known, i)
        before = known[after - 1] if after else None
        behind = known[first] if (first := bisect_left(known, i)) < len(known) else None
        if b is not None:
            out.append(b)
        elif before is not None and behind is not None:
            out.append(begins[before] + (begins[behind] - begins[before]) * (upto[i] - upto[before]) / (upto[behind] - upto[before] or 1))
        elif before is not None:
            out.append(min(duration, begins[before] + (upto[i] - upto[before]) * PER_WORD * 2))
        else:
            out.append(max(0.0, begins[behind] - (upto[behind] - upto[i]) * PER_WORD * 2))
    return out


def _line_ends(begins: list[float], counts: list[int], duration: float) -> Iterator[float]:
    for i, (b, n) in enumerate(zip(begins, counts)):
        end = begins[i + 1] if i + 1 < len(begins) else min(duration, b + max(2000, n * 600))
        yield end if end > b else b + max(500, n * PER_WORD)


def checked_choices(choices: DataFrame, variants: DataFrame) -> DataFrame:
    """A reviewer's ``choices`` (song, id, choice) against the ``variants`` offered (song, id, line_no, options): accepted, kept (choice 0) or rejected."""
    met = choices.join(variants, ["song", "id"], "left")
    valid = F.col("options").isNotNull() & (F.col("choice") >= 0) & (F.col("choice") < F.size("options"))
    kind = F.when(~F.coalesce(valid, F.lit(False)), "rejected").when(F.col("choice") == 0, "kept").otherwise("variant")
    return met.withColumns({"kind": kind, "to": F.when(kind == "variant", F.get("options", F.col("choice")))})


def checked_spellings(spellings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Spellings (song, src, dst) that change one word into one word; those whose target no source has are rejected."""
    asked = spellings.where("src <> '' and dst <> '' and src <> dst and not contains(src, ' ') and not contains(dst, ' ')")
    known = vocabulary.select("song", F.lower("word").alias("_k"), F.lit(True).alias("known")).distinct()
    met = asked.withColumn("_k", F.lower("dst")).join(known, ["song", "_k"], "left").drop("_k")
    return met.withColumn("kind", F.when(F.col("known"), "spelling").otherwise("rejected")).drop("known")


def respelled(words: DataFrame, spellings: DataFrame) -> DataFrame:
    """Words with the accepted spellings applied: the word without edge punctuation is compared, case aside; ``edited`` marks changes."""
    bare = F.regexp_replace(F.rtrim("text"), r"^[.,!?;:\"']+|[.,!?;:\"']+$", "")
    asked = spellings.select("song", F.lower("src").alias("_k"), "dst").dropDuplicates(["song", "_k"])
    met = words.withColumns({"_bare": bare, "_k": F.lower(bare)}).join(asked, ["song", "_k"], "left")
    edited = F.coalesce(F.col("dst") != F.col("_bare"), F.lit(False))
    at = F.instr("text", F.col("_bare"))
    text = F.concat(F.substring("text", F.lit(1), at - 1), "dst", F.substring("text", at + F.length("_bare"), F.length("text")))
    return met.withColumns({"edited": edited, "text": F.when(edited, text).otherwise(F.col("text"))}).drop("_bare", "_k", "dst")


def checked_removals(removals: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines to remove that exist, once each; where they are over a quarter of a song's lines all are rejected."""
    asked = removals.select(*LINE).distinct().join(lines.select(*LINE), list(LINE), "left_semi")
    total = lines.groupBy("song").agg(F.count("*").alias("_n"))
    counted = asked.join(asked.groupBy("song").agg(F.count("*").alias("_d")), "song").join(total, "song")
    return counted.withColumn("kind", F.when(F.col("_d") > REMOVED_SHARE * F.col("_n"), "rejected").otherwise("remove")).drop("_n", "_d")


def kept_notes(notes: DataFrame, lines: DataFrame, removed: DataFrame, order: str) -> DataFrame:
    """The first ten notes of each song, of these the ones with text on a line that exists and stays."""
    first = notes.withColumn("_k", F.row_number().over(Window.partitionBy("song").orderBy(order))).where(F.col("_k") <= NOTES).drop("_k")
    return first.where("note <> ''").join(lines.select(*LINE), list(LINE), "left_semi").join(removed.select(*LINE), list(LINE), "left_anti")


def rebuilt(lines: DataFrame, removed: DataFrame, inserted: DataFrame) -> DataFrame:
    """A song's lines after removals and insertions (song, after, text): new lines follow their anchor, those after -1 come first; ``line_no`` is counted anew."""
    stay = lines.join(removed.select(*LINE), list(LINE), "left_anti").select("song", F.col("line_no").alias("_at"), F.lit(0).cast("bigint").alias("_k"), "text", F.lit(False).alias("inserted"))
    nth = F.row_number().over(Window.partitionBy("song", "after").orderBy("text")).cast("bigint")
    new = inserted.select("song", F.col("after").alias("_at"), nth.alias("_k"), "text", F.lit(True).alias("inserted"))
    order = Window.partitionBy("song").orderBy("_at", "_k")
    return stay.unionByName(new).withColumn("line_no", (F.row_number().over(order) - 1).cast("int")).drop("_at", "_k")


def retimed(new: DataFrame, old: DataFrame) -> DataFrame:
    """New words of lines with times from the old ones: copied place by place where the counts are equal, else spread over the old span by length."""
    was = old.groupBy(*LINE).agg(F.count("*").alias("_n"), F.min_by("begin_ms", F.when(timed(), F.col("word_no"))).alias("_b"), F.max_by("end_ms", F.when(timed(), F.col("word_no"))).alias("_e"))
    each = old.select(*LINE, "word_no", F.col("begin_ms").alias("_ob"), F.col("end_ms").alias("_oe"))
    line = Window.partitionBy(*LINE)
    weight = F.greatest(F.lit(1), F.length(F.trim("text")))
    sized = new.withColumns({"_m": F.count("*").over(line), "_w": weight}).join(was, list(LINE), "left").join(each, [*LINE, "word_no"], "left")
    upto = F.sum("_w").over(line.orderBy("word_no"))
    total = F.sum("_w").over(line)
    span = F.col("_e") - F.col("_b")
    same = F.col("_m") == F.col("_n")
    out = sized.withColumns({"_u": upto, "_t": total})
    begin = F.when(same, F.col("_ob").cast("double")).otherwise(F.col("_b") + span * (F.col("_u") - F.col("_w")) / F.col("_t"))
    end = F.when(same, F.col("_oe").cast("double")).otherwise(F.col("_b") + span * F.col("_u") / F.col("_t"))
    return out.withColumns({"begin_ms": begin, "end_ms": end, "spread": ~F.coalesce(same, F.lit(False)) & F.col("_b").isNotNull()}).drop("_m", "_w", "_n", "_b", "_e", "_ob", "_oe", "_u", "_t")


def offset_decision(checks: DataFrame, least_words: int = 10, least_ms: int = 120, most_spread: int = 150) -> DataFrame:
    """Whether a source's timing is shifted: (offset, spread, words) of a song give ``applied`` and a ``reason``."""
    reason = F.when(F.col("offset").isNull() | (F.col("words") < least_words), "few words").when(F.abs("offset") < least_ms, "close").when(F.col("spread") > most_spread, "words disagree").otherwise("shifted")
    return checks.withColumns({"reason": reason, "applied": reason == "shifted"})

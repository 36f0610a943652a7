"""Placing known words on frames of token log-probabilities.

One song is one group: a Viterbi pass over its frames is sequential and its
size is bounded by the song's length.  The kernel is numpy inside
``applyInPandas``; everything around it is DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token lasts until its probability falls below this share of its peak.
FALL = 0.3
BLOCKED = -1e30


def viterbi(logp: np.ndarray, labels: list[int], blank: int = 0, optional: set[int] | None = None, prior: dict[int, tuple[float, float]] | None = None) -> list[tuple[int, int, float]]:
    """Best ``(first frame, last frame, mean probability)`` of each label in order; ``(-1, -1, 0)`` for skipped ones.

    States alternate blank and label.  A path stays, steps to the next
    state, or skips a blank between different labels; labels in ``optional``
    may be skipped as well.  ``prior`` maps a label's index to a wanted frame
    and a penalty for each frame away from it.
    """
    frames, n = logp.shape[0], len(labels)
    if not n or frames < n:
        return [(-1, -1, 0.0)] * n
    optional = optional or set()
    state = np.full(2 * n + 1, blank)
    state[1::2] = labels
    score = logp[:, state].copy()
    for k, (at, cost) in (prior or {}).items():
        score[:, 2 * k + 1] -= cost * np.abs(np.arange(frames) - at)
    size = len(state)
    jumps = [(s, s - 2) for s in range(3, size, 2) if state[s] != state[s - 2]]
    for k in sorted(optional):  # over an optional label: from the state before its blank
        jumps += [(2 * k + 3, 2 * k - 1)] if 0 < k and k + 1 < n else []
        jumps += [(2 * k + 2, 2 * k)]
    into = np.array([j[0] for j in jumps], int)
    out_of = np.array([j[1] for j in jumps], int)
    best = np.full(size, BLOCKED)
    best[0], best[1] = score[0, 0], score[0, 1]
    lead = 0
    while lead in optional and lead + 1 < n:
        lead += 1
        best[2 * lead + 1] = score[0, 2 * lead + 1]
    back = np.zeros((frames, size), np.int32)
    own = np.arange(size)
    for t in range(1, frames):
        move, origin = best.copy(), own.copy()
        step = best[:-1] > move[1:]
        move[1:][step], origin[1:][step] = best[:-1][step], own[:-1][step]
        if len(into):
            better = best[out_of] > move[into]
            for s, f in zip(into[better], out_of[better]):  # few: only transitions that improve
                if best[f] > move[s]:
                    move[s], origin[s] = best[f], f
        best, back[t] = move + score[t], origin
    ends = [size - 1, size - 2]
    k = n - 1
    while k in optional and k > 0:
        ends += [2 * k - 1, 2 * k]
        k -= 1
    at = max(ends, key=lambda s: best[s])
    path = np.empty(frames, int)
    for t in range(frames - 1, -1, -1):
        path[t] = at
        at = back[t, at]
    out = []
    prob = np.exp(logp)
    for k, label in enumerate(labels):
        mine = np.flatnonzero(path == 2 * k + 1)
        if not len(mine):
            out.append((-1, -1, 0.0))
            continue
        first, own_p = int(mine[0]), prob[:, label]
        peak, last = own_p[mine].max(), int(mine[-1])
        while last + 1 < frames and state[path[last + 1]] == blank and own_p[last + 1] >= FALL * peak:
            last += 1
        out.append((first, last, float(own_p[mine].mean())))
    return out


def align_songs(frames: DataFrame, words: DataFrame, frame_ms: int, song: str = "song") -> DataFrame:
    """Words with ``begin_ms``, ``end_ms`` and ``score`` from their song's frames.

    ``frames``: song, frame, logp (array); ``words``: song, word_no, tokens
    (array of token ids).  Songs without frames, or with fewer frames than
    tokens, leave their words untimed.
    """
    left = frames.select(F.col(song).alias("song"), F.col("frame").alias("at"), F.col("logp").alias("values"), F.lit(None).cast("array<int>").alias("tokens"))
    right = words.select(F.col(song).alias("song"), F.col("word_no").alias("at"), F.lit(None).cast(frames.schema["logp"].dataType).alias("values"), F.col("tokens").cast("array<int>").alias("tokens"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        f, w = rows[rows["values"].notna()].sort_values("at"), rows[rows["tokens"].notna()].sort_values("at")
        labels, owner = [], []
        for k, tokens in enumerate(w["tokens"]):
            labels += [int(t) for t in tokens]
            owner += [k] * len(tokens)
        spans = viterbi(np.array(f["values"].tolist(), float).reshape(len(f), -1), labels) if len(f) else [(-1, -1, 0.0)] * len(labels)
        out = []
        for k, at in enumerate(w["at"]):
            mine = [s for s, o in zip(spans, owner) if o == k and s[0] >= 0]
            if mine:
                out.append((rows["song"].iloc[0], at, mine[0][0] * frame_ms, (mine[-1][1] + 1) * frame_ms, sum(s[2] for s in mine) / len(mine)))
            else:
                out.append((rows["song"].iloc[0], at, None, None, None))
        frame = pd.DataFrame(out, columns=["song", "word_no", "begin_ms", "end_ms", "score"])
        return frame.astype({"begin_ms": "Int64", "end_ms": "Int64", "score": "Float64"})

    kind, no = frames.schema[song].dataType.simpleString(), words.schema["word_no"].dataType.simpleString()
    return left.unionByName(right).groupBy("song").applyInPandas(run, f"song {kind}, word_no {no}, begin_ms bigint, end_ms bigint, score double")


# Mean confidence of a repeat that may lend its rhythm, confidence below which a
# word is doubtful, share of doubtful words from which a repeat borrows, ms that lenders may differ
# by, and words of the shortest line.
TRUSTED, UNSURE, DOUBTFUL_SHARE, AGREEMENT_MS, LEAST_WORDS = 0.97, 0.92, 0.3, 200, 3


def borrow_rhythm(words: DataFrame, song: str = "song") -> DataFrame:
    """Doubtful repeats of a line take the rhythm of its trusted repeats, laid from their surest word.

    ``words``: song, line_no, word_no, text, begin_ms, end_ms, confidence.
    Repeats are lines of a song with the same words (case and punctuation aside) in
    the same number of pieces, three at least.  A repeat is trusted
    if all its words are timed and their mean confidence is high; the pattern is
    the median of the trusted ones and holds only if each begin of each of them is
    close to it.  Trusted repeats never change.  ``borrowed`` tells the
    words with new times.
    """
    word = F.struct("word_no", "text", "begin_ms", "end_ms", F.col("confidence").cast("double").alias("confidence"))
    lines = words.groupBy(song, "line_no").agg(F.array_sort(F.collect_list(word)).alias("w")).where(F.size("w") >= LEAST_WORDS)
    text = F.lower(F.array_join(F.transform("w", lambda x: F.coalesce(x["text"], F.lit(""))), " "))
    scores = "filter(transform(w, x -> x.confidence), x -> x is not null)"
    known = "forall(w, x -> x.begin_ms is not null and x.end_ms is not null)"
    lines = lines.withColumns(
        {
            "key": F.concat_ws(" ", F.regexp_extract_all(text, F.lit(r"(?U)([\w']+)"), 1)),
            "n": F.size("w"),
            "sure": F.expr(f"coalesce({known} and size({scores}) > 0 and aggregate({scores}, 0D, (s, x) -> s + x) / size({scores}) >= {TRUSTED}, false)"),
            "doubtful": F.expr(f"size(filter(w, x -> coalesce(x.confidence, 0D) < {UNSURE})) >= {DOUBTFUL_SHARE} * size(w)"),
        }
    )
    repeat = [song, "key", "n"]
    lent = lines.where("sure").select(*repeat, F.posexplode(F.expr("transform(w, x -> struct(x.begin_ms - w[0].begin_ms as b, x.end_ms - w[0].begin_ms as e))")).alias("k", "r"))
    middle = lent.groupBy(*repeat, "k").agg(F.median("r.b").alias("b"), F.median("r.e").alias("e"), F.min("r.b").alias("least"), F.max("r.b").alias("most"))
    pattern = middle.groupBy(*repeat).agg(F.array_sort(F.collect_list(F.struct("k", "b", "e"))).alias("p"), F.max(F.greatest(F.col("b") - F.col("least"), F.col("most") - F.col("b"))).alias("apart"))
    pattern = pattern.where(F.col("apart") <= AGREEMENT_MS)
    timed = "filter(sequence(0, n - 1), k -> w[k].begin_ms is not null and w[k].end_ms is not null)"
    # Of the timed words the surest, the first of equals.
    anchor = f"array_min(transform({timed}, k -> struct(-coalesce(w[k].confidence, 0D) as c, k as k))).k"
    met = lines.where("doubtful and not sure").join(pattern, repeat).withColumn("a", F.expr(anchor)).where("a is not null")
    moved = met.select(song, "line_no", F.explode(F.expr("transform(p, x -> struct(w[x.k].word_no as word_no, cast(floor(w[a].begin_ms - p[a].b + x.b) as bigint) as b, cast(floor(w[a].begin_ms - p[a].b + x.e) as bigint) as e))")).alias("x"))
    out = words.join(moved.select(song, "line_no", "x.*"), [song, "line_no", "word_no"], "left").withColumn("borrowed", F.col("b").isNotNull())
    return out.withColumns({"begin_ms": F.coalesce("b", "begin_ms"), "end_ms": F.coalesce("e", "end_ms")}).select(*words.columns, "borrowed")


def _claimed_sections(codes: np.ndarray, free: np.ndarray) -> list[tuple[list[int], int]]:
    """``(starts, length)`` of the repeated blocks: from the first line on, each free start takes the length with most covered lines (the longer of two) and claims them.

    ``codes`` are equal for equal lines; ``free`` says which may be in a block, and is changed.  The
    places that match the start are kept as the block grows, so only lines
    that match are looked at again.
    """
    n, found, i = len(codes), [], 0
    while i < n:
        best: tuple[int, list[int], int] | None = None
        places = np.arange(i + 1, n)
        for size in range(1, (n - i) // 2 + 1):
            at = i + size - 1
            places = places[places + size <= n]
            places = places[(codes[places + size - 1] == codes[at]) & free[places + size - 1]] if free[at] else places[:0]
            later = int(np.searchsorted(places, i + size))
            if later == len(places):
                break  # a longer block has no repeat either
            if size < 2:
                continue
            starts = [i]
            while later < len(places):
                starts.append(int(places[later]))
                later = int(np.searchsorted(places, starts[-1] + size))
            if best is None or len(starts) * size >= best[0]:
                best = (len(starts) * size, starts, size)
        if best is None:
            i += 1
            continue
        for start in best[1]:
            free[start : start + best[2]] = False
        found.append(best[1:])
        i += best[2]
    return found


def repeating_sections(lines: DataFrame, key: str, song: str = "song", order: str = "line_no") -> DataFrame:
    """Repeated blocks of two lines or more: ``section``, ``line_no``, ``instance``, ``template_line``.

    Greedy over all of one song's lines, as the reference: from the first
    line on, a free line takes the block that starts there and covers most
    lines (the longer of two), which claims its lines; its length is bounded
    by the song's end only.  A null or blank line is in no block.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        numbers, out = rows[order].tolist(), []
        free = np.array([k is not None and k == k and str(k).strip() != "" for k in rows[key]], bool)
        for section, (starts, size) in enumerate(_claimed_sections(pd.factorize(rows[key])[0], free)):
            for instance, start in enumerate(starts):
                for k in range(size):
                    out.append((rows[song].iloc[0], section, numbers[start + k], instance, k))
        return pd.DataFrame(out, columns=[song, "section", order, "instance", "template_line"])

    kind, no = lines.schema[song].dataType.simpleString(), lines.schema[order].dataType.simpleString()
    return lines.select(song, order, key).groupBy(song).applyInPandas(run, f"{song} {kind}, section int, {order} {no}, instance int, template_line int")

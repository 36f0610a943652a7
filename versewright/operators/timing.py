"""Ordered-neighbour operators on timed words and lines: windows over one song."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the timing rules, in milliseconds.
CLOSE_GAP, LEAST_WORD, EDGE_WORD, EDGE_LINE_WORD = 300, 50, 300, 600
LONGEST_CHECKED_OFFSET = 4


def song_window(*order: str) -> Window:
    return Window.partitionBy("song").orderBy(*order)


def local_offsets(lines: DataFrame, reach: int = LONGEST_CHECKED_OFFSET) -> DataFrame:
    """Median of ``offset`` over the lines within ``reach``; with fewer than two known there, the song's median; none for songs with fewer than three known."""
    near = song_window("line_no").rowsBetween(-reach, reach)
    whole = Window.partitionBy("song")
    known = F.count("offset")
    local = F.when(known.over(near) >= 2, F.percentile("offset", F.lit(0.5)).over(near)).otherwise(F.percentile("offset", F.lit(0.5)).over(whole))
    return lines.withColumn("local_offset", F.when(known.over(whole) >= 3, local))


def enforce_order(words: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Begins below an earlier kept begin become null (the largest kept one so far equals the largest so far)."""
    so_far = F.max("begin_ms").over(song_window(*order).rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("kept_begin", F.when(so_far.isNull() | (F.col("begin_ms") >= so_far), F.col("begin_ms")))


def interpolate(lines: DataFrame, weight: str = "n_words") -> DataFrame:
    """``begin_filled``: unknown begins on a straight line by word count between known neighbours; at the edges 600 ms a word."""
    w = song_window("line_no")
    back, on = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    lines = lines.withColumn("_at", F.coalesce(F.sum(weight).over(back), F.lit(0)))
    known = F.when(F.col("begin_ms").isNotNull(), F.struct("begin_ms", "_at"))
    lines = lines.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(on))
    between = F.col("_a.begin_ms") + F.floor((F.col("_b.begin_ms") - F.col("_a.begin_ms")) * (F.col("_at") - F.col("_a._at")) / (F.col("_b._at") - F.col("_a._at")))
    after = F.col("_a.begin_ms") + EDGE_LINE_WORD * (F.col("_at") - F.col("_a._at"))
    ahead = F.greatest(F.lit(0), F.col("_b.begin_ms") - EDGE_LINE_WORD * (F.col("_b._at") - F.col("_at")))
    filled = F.when(F.col("begin_ms").isNotNull(), F.col("begin_ms")).when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), between).when(F.col("_a").isNotNull(), after).when(F.col("_b").isNotNull(), ahead)
    return lines.withColumn("begin_filled", filled.cast("bigint")).drop("_at", "_a", "_b")


def spread(words: DataFrame, line: tuple[str, ...], begin: str, end: str, weight: Column, order: str = "word_no") -> DataFrame:
    """Words laid end to end over their line's span by ``weight``: ``spread_begin``, ``spread_end`` (floored)."""
    every = Window.partitionBy(*line)
    run = every.orderBy(order)
    words = words.withColumn("_w", weight)
    total, upto = F.sum("_w").over(every), F.sum("_w").over(run)
    span = F.col(end) - F.col(begin)
    at = lambda part: (F.col(begin) + F.floor(span * part / total)).cast("bigint")
    return words.withColumn("spread_begin", at(upto - F.col("_w"))).withColumn("spread_end", at(upto)).drop("_w")


def islands(spans: DataFrame, bridge: int, shortest: int = 0, pad: int = 0) -> DataFrame:
    """Runs of spans whose gaps are at most ``bridge``: song, island, begin_ms, end_ms, n; shorter ones than ``shortest`` are dropped, the rest padded."""
    w = song_window("begin_ms", "end_ms", "word_id")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("begin_ms") - reach > bridge), 1).otherwise(0)
    marked = spans.withColumn("_s", starts).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.groupBy("song", "island").agg(F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))
    found = found.where(F.col("end_ms") - F.col("begin_ms") >= shortest)
    return found.withColumn("begin_ms", F.greatest(F.lit(0), F.col("begin_ms") - pad)).withColumn("end_ms", F.col("end_ms") + pad)


def close_runs(frames: DataFrame, longest: int, flag: str = "voiced", order: str = "frame") -> DataFrame:
    """Runs of fewer than ``longest`` unset frames between set ones become set: ``closed``."""
    w = song_window(order)
    turn = F.when(F.col(flag) != F.lag(flag).over(w), 1).otherwise(0)
    runs = frames.withColumn("_t", turn).withColumn("_run", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy("song", "_run"))
    last = F.max("_run").over(Window.partitionBy("song"))
    inner = (F.col("_run") > 0) & (F.col("_run") < last)
    return runs.withColumn("closed", F.col(flag) | (inner & (size < longest))).drop("_t", "_run")


def syllable_groups(words: DataFrame, text: str = "text", order: tuple[str, ...] = ("word_no",), line: tuple[str, ...] = ("song", "line_no")) -> DataFrame:
    """Runs of pieces up to one that ends in a space: ``group_no``, ``in_group``, ``group_size`` and ``position`` (none, first, middle, last)."""
    w = Window.partitionBy(*line).orderBy(*order)
    ends = F.when(F.col(text).endswith(" "), 1).otherwise(0)
    words = words.withColumn("_e", ends)
    words = words.withColumn("group_no", F.coalesce(F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = Window.partitionBy(*line, "group_no")
    words = words.withColumn("in_group", F.row_number().over(g.orderBy(*order))).withColumn("group_size", F.count("*").over(g))
    position = F.when(F.col("group_size") == 1, "none").when(F.col("in_group") == 1, "first").when(F.col("in_group") == F.col("group_size"), "last").otherwise("middle")
    return words.withColumn("position", position).drop("_e")


def whole_words(words: DataFrame, text: str = "text", order: str = "word_no", line: tuple[str, ...] = ("song", "line_no")) -> DataFrame:
    """Words from syllables: joined text, first timed begin, last timed end."""
    grouped = syllable_groups(words, text, (order,), line)
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return grouped.groupBy(*line, "group_no").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"),
        F.min_by("begin_ms", F.when(F.col("begin_ms").isNotNull(), F.col(order))).alias("begin_ms"),
        F.max_by("end_ms", F.when(F.col("end_ms").isNotNull(), F.col(order))).alias("end_ms"),
        F.count("*").alias("pieces"),
    )


def line_ends(lines: DataFrame, weight: str = "n_words") -> DataFrame:
    """Each line ends where the next begins; the last takes 600 ms a word, two seconds at least."""
    on = F.lead("begin_ms").over(song_window("line_no"))
    return lines.withColumn("line_end", F.coalesce(on, F.col("begin_ms") + F.greatest(F.lit(2000), F.col(weight) * EDGE_LINE_WORD)))


def instance_positions(lines: DataFrame, group: str, instance: str) -> DataFrame:
    """Ordinal of each instance in its group, and how many there are."""
    w = Window.partitionBy(group).orderBy(instance)
    lines = lines.withColumn("ordinal", F.dense_rank().over(w))
    return lines.withColumn("instances", F.max("ordinal").over(Window.partitionBy(group)))


def next_free_index(used: DataFrame, group: str, index: str) -> DataFrame:
    """Smallest non-negative integer that a group does not use yet."""
    distinct = used.select(group, index).distinct()
    at = F.row_number().over(Window.partitionBy(group).orderBy(index)) - 1
    ranked = distinct.withColumn("_at", at)
    return ranked.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("_at") != F.col(index), F.col("_at"))), F.count("*")).cast("bigint").alias("next_index"))


def row_bands(rows: DataFrame, keys: tuple[str, ...], order: str, partition: tuple[str, ...]) -> DataFrame:
    """A band number that grows whenever one of ``keys`` differs from the row before."""
    w = Window.partitionBy(*partition).orderBy(order)
    change = F.lit(False)
    for k in keys:
        change = change | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    first = F.row_number().over(w) == 1
    return rows.withColumn("_c", F.when(first | change, 1).otherwise(0)).withColumn("band", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def nudge_headroom(words: DataFrame, selected: Column, order: tuple[str, ...]) -> DataFrame:
    """Per song: how far its selected words can move together to the left and right before one meets an unselected neighbour."""
    w = song_window(*order)
    words = words.withColumn("_sel", selected)
    left = F.last(F.when(~F.col("_sel"), F.col("end_ms")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(F.when(~F.col("_sel"), F.col("begin_ms")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    room = words.withColumn("_l", F.greatest(F.lit(0), F.col("begin_ms") - F.coalesce(left, F.lit(0)))).withColumn("_r", F.greatest(F.lit(0), right - F.col("end_ms")))
    return room.where("_sel").groupBy("song").agg(F.min("_l").alias("left_ms"), F.min("_r").alias("right_ms"), F.count("*").alias("selected"))


def breaks_at_pause(words: DataFrame, pause: int, order: tuple[str, ...]) -> DataFrame:
    """``broken_line``: a new line wherever the gap to the word before is at least ``pause``."""
    w = song_window(*order)
    gap = F.col("begin_ms") - F.lag("end_ms").over(w)
    marked = words.withColumn("_b", F.when(gap >= pause, 1).otherwise(0))
    return marked.withColumn("broken_line", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def fill_untimed(words: DataFrame, line: tuple[str, ...] = ("song", "line_no", "track"), order: str = "word_no", text: str = "text", line_begin: str | None = None, line_end: str | None = None) -> DataFrame:
    """Runs of untimed words of one line laid end to end by text length: ``fill_begin``, ``fill_end``.

    A run has the time between its timed neighbours, at least 50 ms a word; at an
    edge of the line 300 ms a word; in a line without timed words the line's
    own time (300 ms a word if only its begin is known, none without).
    """
    w = Window.partitionBy(*line).orderBy(order)
    timed = F.col("begin_ms").isNotNull() & F.col("end_ms").isNotNull()
    bound = lambda c: F.col(c) if c else F.lit(None).cast("bigint")
    words = words.withColumns({"_t": timed, "_w": F.greatest(F.lit(1), F.length(F.trim(text)))}).withColumn("_run", F.sum(F.when(timed, 1).otherwise(0)).over(w))
    run = Window.partitionBy(*line, "_run", "_t")
    words = words.withColumns(
        {
            "_a": F.last(F.when(timed, F.col("end_ms")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_b": F.first(F.when(timed, F.col("begin_ms")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
            "_edge": F.count("*").over(run) * EDGE_WORD,
            "_s": F.sum("_w").over(run),
            "_u": F.sum("_w").over(run.orderBy(order)),
        }
    )
    start = F.coalesce("_a", F.when(F.col("_b").isNotNull(), F.greatest(F.lit(0), F.col("_b") - F.col("_edge"))), bound(line_begin))
    stop = F.coalesce("_b", F.col("_a") + F.col("_edge"), bound(line_end), bound(line_begin) + F.col("_edge"))
    span = F.greatest(F.col("_edge") * LEAST_WORD / EDGE_WORD, F.col("_stop") - F.col("_start"))
    at = lambda part: (F.col("_start") + F.floor(span * part / F.col("_s"))).cast("bigint")
    words = words.withColumns({"_start": start, "_stop": stop})
    words = words.withColumns({"fill_begin": F.when(F.col("_t"), F.col("begin_ms")).otherwise(at(F.col("_u") - F.col("_w"))), "fill_end": F.when(F.col("_t"), F.col("end_ms")).otherwise(at(F.col("_u")))})
    return words.drop("_t", "_run", "_w", "_a", "_b", "_edge", "_s", "_u", "_start", "_stop")


def tidy_fold(lines: DataFrame, words: str = "words") -> DataFrame:
    """Word arrays with begins pushed past the end before them and short gaps closed, each step seeing the earlier ones.

    ``words`` is an array of structs with ``begin_ms`` and ``end_ms``, all timed.
    """
    # ``own`` is a word's end as it came: gaps are judged by it, before the least length is given.
    before = "element_at(acc, -1)"
    end = f"greatest(if(x.begin_ms - {before}.own between 1 and {CLOSE_GAP - 1}, x.begin_ms, {before}.own), {before}.begin_ms + {LEAST_WORD}L)"
    made = lambda begin: f"array(named_struct('begin_ms', {begin}, 'end_ms', greatest(x.end_ms, {begin} + {LEAST_WORD}L), 'own', x.end_ms))"
    step = f"""transform(aggregate({words}, cast(array() AS array<struct<begin_ms: bigint, end_ms: bigint, own: bigint>>), (acc, x) ->
      if(size(acc) = 0, {made('x.begin_ms')},
        concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin_ms', {before}.begin_ms, 'end_ms', {end}, 'own', {before}.own)), {made(f'greatest(x.begin_ms, {end})')}))),
      w -> named_struct('begin_ms', w.begin_ms, 'end_ms', w.end_ms))"""
    return lines.withColumn("tidied", F.expr(step))


def resolve_overlaps(lines: DataFrame, words: str = "words", duration: str | None = None) -> DataFrame:
    """Word arrays in which every word starts at the end of the one before or later, keeping lengths; ``duration`` clamps the ends."""
    start = "greatest(x.begin_ms, if(size(acc) = 0, x.begin_ms, element_at(acc, -1).end_ms))"
    clamp = (lambda x: f"least({duration}, {x})") if duration else (lambda x: x)
    step = f"""aggregate({words}, cast(array() AS array<struct<begin_ms: bigint, end_ms: bigint>>), (acc, x) ->
      concat(acc, array(named_struct('begin_ms', {clamp(start)}, 'end_ms', {clamp(f"{start} + x.end_ms - x.begin_ms")}))))"""
    return lines.withColumn("resolved", F.expr(step))


def shifted(words: DataFrame, by: Column) -> DataFrame:
    """All times moved by ``by`` ms, not below 0."""
    return words.withColumn("begin_ms", F.greatest(F.lit(0), F.col("begin_ms") + by)).withColumn("end_ms", F.greatest(F.lit(0), F.col("end_ms") + by))

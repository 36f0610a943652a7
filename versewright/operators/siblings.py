"""Edits of a line replayed on its linked copies.

An edit with as many words after as before is a renaming and keeps all times.  Otherwise the
words that the edit keeps (a longest common subsequence of word keys) keep the
copy's times, and each run of new words shares the time of the words it stands for, in the
proportions of the edited line.  A copy whose word count differs from the edited
line's gets its words in proportion as a whole.

Edits meet copies in a join on (song, group, template line); only edits that
change the count run a kernel, on the words of one line.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SIBLING = ["song", "group_id", "template_line"]
WORDS = "array<struct<text: string, begin_ms: double, end_ms: double, explicit: boolean, syllable: string>>"
SAME_MS = 1e-6


def word_key(text: str | None, mark: str = "|") -> str:
    return (text or "").replace(mark, "").strip()


def kept_words(before: Sequence[str], after: Sequence[str]) -> dict[int, int]:
    """Index after -> index before of a longest common subsequence; of equal choices the one with the latest matches in ``after``."""
    rows = [[0] * (len(after) + 1)]
    for x in before:
        last, row = rows[-1], [0]
        for j, y in enumerate(after):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    i, j, kept = len(before), len(after), {}
    while i and j:
        if before[i - 1] == after[j - 1]:
            i, j = i - 1, j - 1
            kept[j] = i
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return kept


def _span(words: Sequence[dict]) -> tuple[float, float]:
    return min(w["begin_ms"] for w in words), max(w["end_ms"] for w in words)


def in_proportion(after: Sequence[dict], copy: Sequence[dict]) -> list[dict] | None:
    """The edited words scaled from their line's time to the copy's; None if either has no length."""
    if not after or not copy:
        return None
    (a, b), (c, d) = _span(after), _span(copy)
    if b <= a or d <= c:
        return None
    at = lambda t: c + (t - a) / (b - a) * (d - c)
    return [{"text": w["text"], "begin_ms": at(w["begin_ms"]), "end_ms": at(w["end_ms"]), "explicit": w["explicit"] or None, "syllable": None} for w in after]


def replayed(after: Sequence[dict], before: Sequence[dict], copy: Sequence[dict]) -> list[dict] | None:
    """The copy's words after the edit."""
    if not after:
        return []
    if len(copy) != len(before):
        return in_proportion(after, copy)
    kept = kept_words([word_key(w["text"]) for w in before], [word_key(w["text"]) for w in after])
    out: list[dict] = []
    for k, word in enumerate(after):
        if k in kept:
            out.append({**copy[kept[k]], "text": word["text"], "explicit": word["explicit"] or None})
        elif k == 0 or k - 1 in kept:
            run = next((m for m in range(k, len(after)) if m in kept), len(after))
            out += _new_run(after[k:run], copy, kept.get(k - 1, -1), kept.get(run, len(copy)))
    return out


def _new_run(run: Sequence[dict], copy: Sequence[dict], left: int, right: int) -> list[dict]:
    """New words between the copy's words ``left`` and ``right``, in the time of the words that they replace or of the gap."""
    if left + 1 < right:
        begin, end = copy[left + 1]["begin_ms"], copy[right - 1]["end_ms"]
    else:
        begin = copy[left]["end_ms"] if left >= 0 else 0.0
        end = max(begin, copy[right]["begin_ms"]) if right < len(copy) else begin
    first, length = run[0]["begin_ms"], run[-1]["end_ms"] - run[0]["begin_ms"]
    before = copy[left]["syllable"] if left >= 0 else None
    behind = copy[right]["syllable"] if right < len(copy) else None
    # A new word inside a group of syllables, or in front of one at the line's begin, belongs to it.
    group = before if before is not None and behind in (None, before) else behind if left < 0 else None
    out = []
    for k, word in enumerate(run):
        share = ((word["begin_ms"] - first) / length, (word["end_ms"] - first) / length) if length > 0 else (k / len(run), (k + 1) / len(run))
        b, e = (begin + s * max(0.0, end - begin) for s in share)
        out.append({"text": word["text"], "begin_ms": b, "end_ms": e, "explicit": word["explicit"] or None, "syllable": group})
    return out


def same_words(a: Sequence[dict] | None, b: Sequence[dict] | None) -> bool:
    if a is None or b is None:
        return a is b
    return len(a) == len(b) and all(x["text"] == y["text"] and abs(x["begin_ms"] - y["begin_ms"]) <= SAME_MS and abs(x["end_ms"] - y["end_ms"]) <= SAME_MS for x, y in zip(a, b))


def propagated_words(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """``song, line_no, source, words, how, retimed``: each copy that an edit changes.

    ``edits``: song, line_no, group_id, template_line, ``before`` and
    ``after`` (arrays of words); ``lines``: song, line_no, group_id,
    template_line, detached, ``words``.  ``how`` is renamed, replayed or scaled;
    ``retimed`` tells whether replaying gives other times than scaling the whole line.
    Copies without words, detached ones and those that nothing changes have no row.
    """
    source = edits.where("group_id is not null and template_line is not null and after is not null").select(*SIBLING, F.col("line_no").alias("source"), F.col("before").cast(WORDS).alias("before"), F.col("after").cast(WORDS).alias("after"))
    copies = lines.where("group_id is not null and template_line is not null and not coalesce(detached, false) and size(words) > 0").select(*SIBLING, "line_no", F.col("words").cast(WORDS).alias("words"))
    met = source.join(copies, SIBLING).where("line_no <> source")
    equal = F.coalesce(F.size("before") == F.size("after"), F.lit(False))
    renamed = met.where(equal & (F.size("words") == F.size("after"))).where(F.expr("exists(zip_with(words, after, (w, a) -> not (w.text <=> a.text)), x -> x)"))
    renamed = renamed.select("song", "line_no", "source", F.expr("zip_with(words, after, (w, a) -> struct(a.text as text, w.begin_ms as begin_ms, w.end_ms as end_ms, w.explicit as explicit, w.syllable as syllable))").alias("words"), F.lit("renamed").alias("how"), F.lit(False).alias("retimed"))
    changed = met.where(~equal & F.col("before").isNotNull()).select("song", "line_no", "source", "before", "after", "words")

    kind = {f.name: f.dataType.simpleString() for f in changed.schema.fields}
    schema = changed.sparkSession.createDataFrame([], f"song {kind['song']}, line_no {kind['line_no']}, source {kind['source']}, words {WORDS}, how string, retimed boolean").schema
    arrow = to_arrow_schema(schema)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # words as Python objects are held for so many lines, not for a batch
                out = []
                for row in batch.slice(at, 128).to_pylist():
                    before, after, copy = row["before"], row["after"], row["words"]
                    made, plain = replayed(after, before, copy), in_proportion(after, copy)
                    if made is not None:
                        out.append({"song": row["song"], "line_no": row["line_no"], "source": row["source"], "words": made, "how": "replayed" if len(copy) == len(before) else "scaled", "retimed": not same_words(made, plain)})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    made = changed.mapInArrow(replay, schema)
    return renamed.select(*made.columns).unionByName(made)


def divergent_edits(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """The edits (song, source) for which replaying would retime words of a copy that scaling would not: the user has to choose."""
    return propagated_words(edits, lines).where("retimed").select("song", "source").distinct()

"""Background vocals taken out of parentheses, line after line.

A line with words inside and outside of parentheses gives up those inside as its
background.  A line that is all parentheses is merged into the line before it.
Each background knows where it comes from: one that an earlier extraction wrote
is replaced, one that someone wrote is kept and added to.

A song's lines are one ordered pass that remembers a single line, whatever the
song's length; songs are dealt over tasks and sorted by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from .siblings import kept_words, word_key

#: Milliseconds of a background word without a known end.
WORD_MS = 300.0
WORD = "struct<text: string, begin_ms: double, end_ms: double, syllable: string>"
FIELDS = {"text": "string", "begin_ms": "double", "end_ms": "double", "words": f"array<{WORD}>", "bg_text": "string", "bg_words": f"array<{WORD}>", "bg_source": "string", "linked": "boolean"}


def parentheses(text: str) -> list[tuple[int, int]] | None:
    """Spans of the parentheses with their brackets; None if they are nested or unbalanced."""
    spans, opened = [], -1
    for i, c in enumerate(text):
        if c == "(":
            if opened >= 0:
                return None
            opened = i
        elif c == ")":
            if opened < 0:
                return None
            spans.append((opened, i + 1))
            opened = -1
    return spans if opened < 0 else None


def classified(text: str) -> tuple[str, str, str]:
    """Kind (none, inline, standalone, skip), text inside the parentheses, and text outside."""
    spans = parentheses(text)
    if spans is None:
        return "skip", "", text
    inside = " ".join(t for a, b in spans if (t := text[a + 1 : b - 1].strip()))
    if not inside:
        return "none", "", text
    outside, at = "", 0
    for a, b in spans:
        outside, at = outside + text[at:a], b
    outside = " ".join(p for p in (outside + text[at:]).split(" ") if p).strip()
    return ("inline" if outside else "standalone"), inside, outside


def pieces(text: str, mark: str = "|") -> list[str]:
    """Words of a text, cut at split marks; the last piece of all words but the last carries its space."""
    out: list[str] = []
    tokens = text.split()
    for k, token in enumerate(tokens):
        parts = [p for p in token.split(mark) if p]
        if parts and k + 1 < len(tokens):
            parts[-1] += " "
        out += parts
    return out


def text_of(words: Sequence[dict], mark: str = "|") -> str:
    return "".join(w["text"] + (mark if k + 1 < len(words) and not w["text"].endswith(" ") else "") for k, w in enumerate(words))


def content_spans(words: Sequence[dict], mark: str = "|") -> list[tuple[int, int]]:
    """Where each word's letters stand in the text of all."""
    at, out = 0, []
    for w in words:
        t = w["text"]
        lead = len(t) - len(t.lstrip())
        out.append((at + lead, at + len(t.rstrip())))
        at += len(t) + (0 if t.endswith(" ") else len(mark))
    return out


def retexted(words: Sequence[dict], text: str, mark: str = "|") -> list[dict]:
    """Words of a new text with the times of the old: by place if as many, else unchanged words keep theirs and runs of new ones share what they replace."""
    new = pieces(text, mark)
    if len(new) == len(words):
        return [{**w, "text": t} for w, t in zip(words, new)]
    kept = kept_words([word_key(w["text"], mark) for w in words], [word_key(t, mark) for t in new])
    out: list[dict] = []
    for k, t in enumerate(new):
        if k in kept:
            out.append({**words[kept[k]], "text": t})
            continue
        if k and k - 1 not in kept:
            continue  # inside a run
        stop = next((m for m in range(k, len(new)) if m in kept), len(new))
        left, right = kept.get(k - 1, -1), kept.get(stop, len(words))
        if left + 1 < right:
            begin, end = words[left + 1]["begin_ms"], words[right - 1]["end_ms"]
        else:
            begin = words[left]["end_ms"] if left >= 0 else words[right]["begin_ms"]
            end = max(begin, words[right]["begin_ms"]) if right < len(words) else begin
        run = new[k:stop]
        for x, t_ in enumerate(run):
            # A piece glued to a neighbour, with no space between, belongs to its syllables.
            to_left = left >= 0 and all(not p.endswith(" ") for p in [new[k - 1], *run[:x]])
            to_right = right < len(words) and all(not p.endswith(" ") for p in run[x:])
            l, r = words[left]["syllable"] if to_left else None, words[right]["syllable"] if to_right else None
            group = l if l is not None and r in (None, l) else r if not to_left else None
            step = (end - begin) / len(run)
            out.append({"text": t_, "begin_ms": begin + step * x, "end_ms": begin + step * (x + 1), "syllable": group})
    return out


def spread(text: str, begin: float, end: float | None, mark: str = "|") -> list[dict]:
    """Words of a text laid over a time by their letters."""
    words = pieces(text, mark)
    letters = [len(w.rstrip(" ")) for w in words]
    end = begin + WORD_MS * len(words) if end is None else end
    out, at = [], begin
    for w, n in zip(words, letters):
        length = n / sum(letters) * (end - begin)
        out.append({"text": w, "begin_ms": at, "end_ms": at + length, "syllable": None})
        at += length
    return out


def bracketed(words: Sequence[dict]) -> list[dict]:
    """The words with a bracket in front of the first and behind the last, whose spaces stay behind it."""
    out = [dict(w) for w in words]
    if out:
        out[0]["text"] = "(" + out[0]["text"]
        core = out[-1]["text"].rstrip(" ")
        out[-1]["text"] = core + ")" + out[-1]["text"][len(core) :]
    return out


def _joined_words(base: Sequence[dict], more: Sequence[dict], one_bracket: bool) -> list[dict]:
    """Both lists; with ``one_bracket`` the brackets where they meet go."""
    out = [dict(w) for w in [*base, *more]]
    if one_bracket and base and more:
        last, first = out[len(base) - 1], out[len(base)]
        core = last["text"].rstrip(" ")
        if core.endswith(")") and first["text"].startswith("("):
            last["text"] = core[:-1] + (last["text"][len(core) :] or " ")
            first["text"] = first["text"][1:]
    return out


def _joined_text(base: str | None, more: str, brackets: bool, one_bracket: bool) -> str:
    base = (base or "").strip()
    if not brackets:
        return f"{base} {more}".strip() if base else more
    if base and one_bracket and base.endswith(")"):
        return f"{base[:-1]} {more})"
    return f"{base} ({more})" if base else f"({more})"


def with_background(line: dict, text: str | None, words: Sequence[dict] | None, source: str) -> dict:
    """The only way a background is written: without text and words, its source goes as well."""
    text = text if text and text.strip() else None
    words = list(words) if words else None
    return {**line, "bg_text": text, "bg_words": words, "bg_source": source if text or words else None}


def inline_extracted(line: dict, brackets: bool = False, mark: str = "|") -> dict:
    """A line without its parentheses; the same object where nothing can be taken out."""
    kind, inside, outside = classified(line["text"] or "")
    if kind != "inline" or line["bg_words"]:
        return line
    base = None if line["bg_source"] == "extraction" else line["bg_text"]
    source = "manual" if base else "extraction"
    text = _joined_text(base, inside, brackets, False)
    if not line["words"]:
        return with_background({**line, "text": outside}, text, None, source)
    if text_of(line["words"], mark) != line["text"]:
        return line
    left = []
    for word, (a, b) in zip(line["words"], content_spans(line["words"], mark)):
        met = [(c, d) for c, d in parentheses(line["text"]) if a < d and b > c]
        if any(a < c or b > d for c, d in met):
            return line  # a word reaches over a bracket
        if not met:
            left.append(word)
    if not left:
        return line
    left[-1] = {**left[-1], "text": left[-1]["text"].rstrip(" ")}
    return with_background({**line, "words": left, "begin_ms": None, "end_ms": None, "text": text_of(left, mark)}, text, None, source)


def merged(line: dict, alone: dict, inside: str, fresh: bool, brackets: bool = False, mark: str = "|") -> dict | None:
    """``line`` with the standalone line behind it as background; ``fresh`` if this pass wrote its background.  None where timed background would meet untimed."""
    own = line["bg_source"] == "extraction"
    stale = own and not fresh
    base_text, base_words = (None, None) if stale else (line["bg_text"], line["bg_words"])
    if alone["words"]:
        carried = retexted(alone["words"], inside, mark)
    elif alone["begin_ms"] is not None and alone["end_ms"] is not None:
        carried = spread(inside, alone["begin_ms"], alone["end_ms"], mark)
    else:
        carried = []
    carried = bracketed(carried) if brackets else carried
    kept = "extraction" if own else "manual"
    if carried and base_words:
        both = _joined_words(base_words, carried, brackets and fresh)
        return with_background(line, text_of(both, mark), both, kept)
    if carried and not base_text:
        return with_background(line, text_of(carried, mark), carried, "extraction")
    if not carried and base_words:
        return None
    return with_background(line, _joined_text(base_text, inside, brackets, fresh), None, kept if base_text else "extraction")


def extraction(lines: Iterable[dict], merge: bool = True, brackets: bool = False, mark: str = "|") -> Iterator[dict]:
    """One song's lines in order, extracted; a line is given out once no later one can be merged into it."""
    last, fresh = None, False
    for line in lines:
        kind, inside, _ = classified(line["text"] or "")
        if merge and kind == "standalone" and last is not None and (last["text"] or "").strip() and classified(last["text"])[0] == "none" and not last["linked"] and not line["linked"]:
            both = merged(last, line, inside, fresh, brackets, mark)
            if both is not None:
                last, fresh = both, True
                continue
        if last is not None:
            yield last
        last = inline_extracted(line, brackets, mark)
        fresh = last is not line
    if last is not None:
        yield last


def extracted(lines: DataFrame, song: str = "song", order: str = "line_no", merge: bool = True, brackets: bool = False, mark: str = "|") -> DataFrame:
    """Songs' lines after extraction: ``song``, ``order`` and FIELDS; merged lines have no row.

    ``lines`` has these columns; ``order`` is unique within a song.
    """
    names = list(FIELDS)
    ordered = lines.select(song, order, *[lines[c].cast(kind).alias(c) for c, kind in FIELDS.items()]).repartition(song).sortWithinPartitions(song, order)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                line = dict(zip(names, row[2:]))
                for c in ("words", "bg_words"):
                    line[c] = list(line[c]) if line[c] is not None and len(line[c]) else None
                for c in ("text", "begin_ms", "end_ms", "bg_text", "bg_source"):
                    line[c] = None if line[c] != line[c] else line[c]
                yield row[0], row[1], {**line, "_no": row[1], "_song": row[0]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        source, waiting = rows(batches), []

        def of_song(first: tuple) -> Iterator[dict]:
            yield first[2]
            for row in source:
                if row[0] != first[0]:
                    waiting.append(row)
                    return
                yield row[2]

        first = next(source, None)
        while first is not None:
            for line in extraction(of_song(first), merge, brackets, mark):
                out.append((line["_song"], line["_no"], *(line[c] for c in names)))
                if len(out) == 1000:
                    yield pd.DataFrame(out, columns=[song, order, *names]).astype(object)
                    out = []
            first = waiting.pop() if waiting else None
        yield pd.DataFrame(out, columns=[song, order, *names]).astype(object)

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    return ordered.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (song, order, *names)))

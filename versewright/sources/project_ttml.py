"""Whole projects as TTML: linked groups, marked words, translations and readings beside the lines.

One row is one line with all that belongs to it.  Attributes and elements of the
editor are known by their local names, whatever prefix a document uses; written
ones get PREFIX.  A line is rendered on its own, in any task; a document is the ordered
lines of its song.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.extraction import text_of
from ..operators.readings import planned, timed_part, visible
from .formats import NAMESPACES, _attribute, _local, _ms, _root, pieces

PREFIX, NAMESPACE = "edit", "urn:versewright:edit"
#: Times of a reading's span and of its word may differ by this much.
SAME_MS = 1
WORD = "struct<text: string, begin_ms: bigint, end_ms: bigint, explicit: boolean, reading: string, joiner: string>"
TRACK = "struct<language: string, text: string, background: string>"
READING = "struct<language: string, text: string, background: string, status: string, bg_status: string>"
LINE = {
    "agent": "string", "begin_ms": "bigint", "end_ms": "bigint", "text": "string", "words": f"array<{WORD}>", "bg_text": "string", "bg_words": f"array<{WORD}>", "bg_source": "string",
    "group_id": "string", "instance": "int", "template_line": "int", "detached": "boolean", "translations": f"array<{TRACK}>", "reading": READING,
}
GROUP = "id string, label string, color string, template_version int"
#: What a group has that says nothing of them.
GROUP_LABEL, GROUP_COLOR = "Group", "#9ca3af"


def stamp(ms: int) -> str:
    minutes, rest = divmod(ms, 60_000)
    hours, minutes = divmod(minutes, 60)
    return (f"{hours}:{minutes:02d}:" if hours else f"{minutes:02d}:") + f"{rest // 1000:02d}.{rest % 1000:03d}"


# -- writing ------------------------------------------------------------------


def _quoted(value: str) -> str:
    return escape(value, {'"': "&quot;"})


def _span(word: dict, text: str) -> str:
    marked = f' {PREFIX}:explicit="true"' if word["explicit"] else ""
    return f'<span begin="{stamp(word["begin_ms"])}" end="{stamp(word["end_ms"])}"{marked}>{escape(text)}</span>'


def _spans(words: list[dict]) -> str:
    return "".join(_span(w, w["text"].rstrip()) + (" " if k + 1 < len(words) and w["text"].endswith(" ") else "") for k, w in enumerate(words))


def with_background(chunks: list[str], background: str, line: dict) -> str:
    """Chunks of a side text with the background in its place: in front of the line, behind it, or in proportion inside."""
    inside = f'<span ttm:role="x-bg">{background}'
    if not chunks:
        return inside + "</span>"
    words, bg = line["words"] or [], line["bg_words"] or []
    at = len(chunks)
    if words and bg and bg[0]["begin_ms"] < words[0]["begin_ms"]:
        at = 0
    elif words and bg and bg[0]["begin_ms"] < words[-1]["end_ms"]:
        before = sum(w["begin_ms"] <= bg[0]["begin_ms"] for w in words)
        at = max(1, min(len(chunks) - 1, int(before / max(1, len(words)) * len(chunks) + 0.5)))
    front, behind = "".join(chunks[:at]).rstrip(), "".join(chunks[at:]).lstrip()
    if not front:
        return f"{inside} </span>{behind}".rstrip()
    return f"{front} {inside} </span>{behind}" if behind else f"{front} {inside}</span>"


def _translation(line: dict, track: dict) -> str:
    background = (track["background"] or "").strip()
    if not background:
        return escape(track["text"] or "")
    words = (track["text"] or "").split()
    return with_background([escape(w) + (" " if k + 1 < len(words) else "") for k, w in enumerate(words)], escape(background), line)


def _reading_chunks(words: list[dict] | None, text: str | None, status: str | None) -> list[str]:
    if not (text or "").strip():
        return []
    if status == "unresolved" or not any(w["reading"] for w in words or []):
        return [escape(visible(text))]
    out = []
    for k, word in enumerate(words):
        own = (word["reading"] or "").strip() or word["text"].rstrip()
        joiner = "" if k + 1 == len(words) else word["joiner"] if word["joiner"] is not None else "  " if word["text"].endswith(" ") else " "
        if re.search("[-‐-―]", joiner):  # a dash is sung with the syllable in front of it
            own, joiner = own + joiner.rstrip(), joiner[len(joiner.rstrip()) :]
        out.append(_span({**word, "explicit": None}, own) + joiner)
    return out


def aligned(line: dict) -> dict:
    """The line with its words taking their parts of the reading, and how that went."""
    track = line["reading"]
    if track is None:
        return line
    out, track = dict(line), dict(track)
    for words, text, source, status in (("words", "text", "text", "status"), ("bg_words", "background", "bg_text", "bg_status")):
        track[status] = "confirmed" if words == "words" or track[text] else None
        if line[words]:
            made, track[status] = planned(line[words], timed_part(line[source], line[words], track[text] or ""))
            out[words] = made
            if words == "bg_words" and not track[text]:
                track[status] = None
    return {**out, "reading": track}


def rendered(line: dict, key: str | None) -> tuple[str, list[tuple[str, str]], tuple[str, str] | None]:
    """A line's ``p``, its translations (language, content), and its reading."""
    words, bg = line["words"] or [], line["bg_words"] or []
    main = _spans(words) if words else escape((line["text"] or "").replace("|", ""))
    begin, end = line["begin_ms"], line["end_ms"]
    if bg:
        main += f'<span ttm:role="x-bg">{_spans(bg)}</span>'
    elif line["bg_text"]:
        main += f'<span ttm:role="x-bg"><span begin="{stamp(begin)}" end="{stamp(end)}">{escape(line["bg_text"])}</span></span>'
    attrs = f' itunes:key="{key}"' if key else ""
    attrs += f' ttm:agent="{_quoted(line["agent"])}"' if line["agent"] else ""
    if line["group_id"]:
        attrs += f' {PREFIX}:groupId="{_quoted(line["group_id"])}" {PREFIX}:instanceIdx="{line["instance"] or 0}" {PREFIX}:templateLineIdx="{line["template_line"] or 0}"'
        attrs += f' {PREFIX}:detached="true"' if line["detached"] else ""
    p = f'<p begin="{stamp(begin)}" end="{stamp(end)}"{attrs}>{main}</p>'
    side = [(t["language"], _translation(line, t)) for t in line["translations"] or [] if (t["text"] or "").strip() or (t["background"] or "").strip()]
    track, reading = line["reading"], None
    if track is not None and ((track["text"] or "").strip() or (track["background"] or "").strip()):
        own = aligned(line)
        chunks = _reading_chunks(own["words"], track["text"], own["reading"]["status"])
        content = "".join(chunks)
        if (track["background"] or "").strip():
            content = with_background(chunks, "".join(_reading_chunks(own["bg_words"], track["background"], own["reading"]["bg_status"])), line)
        reading = (track["language"], content)
    return p, side, reading


def write_project(lines: DataFrame, groups: DataFrame | None = None, song: str = "song") -> DataFrame:
    """``song, content``: one document per song; ``lines`` have line_no and the columns of LINE, ``groups`` those of GROUP.

    A line's time is that of all its words, or its own; lines without any are left out.
    """
    kind = lines.schema[song].dataType.simpleString()
    span = lambda f, c: F.expr(f"array_{f}(transform(concat(coalesce(words, array()), coalesce(bg_words, array())), w -> w.{c}))")
    typed = lines.select(song, "line_no", *[F.col(c).cast(t).alias(c) if c in lines.columns else F.lit(None).cast(t).alias(c) for c, t in LINE.items()])
    typed = typed.withColumns({"begin_ms": F.coalesce(span("min", "begin_ms"), "begin_ms"), "end_ms": F.coalesce(span("max", "end_ms"), "end_ms")}).where("begin_ms is not null and end_ms is not null")
    typed = typed.where("coalesce(trim(text), '') <> '' or coalesce(size(words), 0) > 0 or coalesce(trim(bg_text), '') <> '' or coalesce(size(bg_words), 0) > 0")
    keyed = typed.withColumn("key", F.concat(F.lit("L"), F.row_number().over(Window.partitionBy(song).orderBy("line_no")).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            rows = []
            for r in batch.to_pylist():
                p, side, reading = rendered(r, r["key"])
                text = lambda c: f'<text for="{r["key"]}">{c}</text>'  # noqa: B023, E731
                rows.append({song: r[song], "line_no": r["line_no"], "p": p, "side": [{"language": a, "text": text(c)} for a, c in side], "reading": {"language": reading[0], "text": text(reading[1])} if reading else None})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = lines.sparkSession.createDataFrame([], f"`{song}` {kind}, line_no {lines.schema['line_no'].dataType.simpleString()}, p string, side array<struct<language: string, text: string>>, reading struct<language: string, text: string>").schema
    arrow = to_arrow_schema(schema)
    made = keyed.mapInArrow(run, schema)
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col(c).alias("t")))), lambda x: x["t"]), "")

    # One pass over the rendered lines: what goes to the body, the translations and the readings is told apart by ``kind``.
    part = lambda k, language, text: F.struct(F.lit(k).alias("kind"), language.alias("language"), text.alias("text"))
    read = F.when(F.col("reading").isNotNull(), F.array(part("r", F.col("reading.language"), F.col("reading.text")))).otherwise(F.array().cast("array<struct<kind: string, language: string, text: string>>"))
    parts = F.concat(F.array(part("p", F.lit(None).cast("string"), F.col("p"))), F.transform("side", lambda x: part("t", x["language"], x["text"])), read)
    each = made.select(song, "line_no", F.explode(parts).alias("x")).select(song, "line_no", "x.*").groupBy(song, "kind", "language").agg(in_order("text").alias("t"))

    def container(kind: str, name: str, attrs: str) -> Column:
        tag = F.concat(F.lit(f'<{name} xml:lang="'), F.regexp_replace("language", '"', "&quot;"), F.lit(f'"{attrs}>'), "t", F.lit(f"</{name}>"))
        own = F.col("kind") == kind
        return F.when(F.count_if(own) > 0, F.concat(F.lit(f"<{name}s>"), F.array_join(F.array_sort(F.collect_list(F.when(own, tag))), ""), F.lit(f"</{name}s>")))

    full = each.groupBy(song).agg(F.max(F.when(F.col("kind") == "p", F.col("t"))).alias("_p"), container("t", "translation", ' type="subtitle"').alias("_t"), container("r", "transliteration", "").alias("_r"))
    if groups is not None:
        q = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
        tag = F.concat(F.lit(f'<{PREFIX}:group id="'), q("id"), F.lit('" label="'), q("label"), F.lit('" color="'), q("color"), F.lit('" templateVersion="'), q("template_version"), F.lit('"/>'))
        full = full.join(groups.groupBy(song).agg(F.array_join(F.array_sort(F.collect_list(tag)), "").alias("_g")), song, "left")
    else:
        full = full.withColumn("_g", F.lit(None).cast("string"))
    spaces = "".join(f' xmlns{k}="{v}"' for k, v in NAMESPACES.items()) + f' xmlns:{PREFIX}="{NAMESPACE}"'
    wrapped = lambda a, c, b: F.coalesce(F.concat(F.lit(a), c, F.lit(b)), F.lit(""))
    side = F.when(F.col("_t").isNotNull() | F.col("_r").isNotNull(), F.concat(F.lit(f'<iTunesMetadata xmlns="{NAMESPACES[":itunes"]}">'), F.coalesce("_t", F.lit("")), F.coalesce("_r", F.lit("")), F.lit("</iTunesMetadata>"))).otherwise("")
    content = F.concat(F.lit(f"<tt{spaces}><head><metadata>"), wrapped(f"<{PREFIX}:groups>", F.col("_g"), f"</{PREFIX}:groups>"), side, F.lit("</metadata></head><body><div>"), "_p", F.lit("</div></body></tt>"))
    return full.select(song, content.alias("content"))


# -- reading ------------------------------------------------------------------


def _timed_words(parent) -> list[dict]:
    """Timed spans right inside ``parent``, backgrounds aside; white space behind one ends its word."""
    words: list[dict] = []
    for child in parent:
        text = "".join(child.itertext())
        if _local(child.tag) == "span" and _attribute(child, "role") != "x-bg" and _attribute(child, "begin") is not None and text.strip():
            words.append({"text": text, "begin_ms": _ms(_attribute(child, "begin")), "end_ms": _ms(_attribute(child, "end")), "explicit": _attribute(child, "explicit") == "true" or None, "reading": None, "joiner": None})
        if words and re.search(r"\s", child.tail or "") and not words[-1]["text"].endswith(" "):
            words[-1]["text"] += " "
    return words


def _own_text(element, skip: str) -> str:
    """Text of an element without the children of a role."""
    return ((element.text or "") + "".join(("" if _attribute(c, "role") == skip else "".join(c.itertext())) + (c.tail or "") for c in element)).strip()


def _spans_with(element, role: str) -> list:
    return [e for e in element.iter() if _local(e.tag) == "span" and _attribute(e, "role") == role]


def _number(value: str | None) -> int:
    found = re.match(r"\s*([+-]?\d+)", value or "")
    return int(found[1]) if found else 0


def _mapped(words: list[dict] | None, text: str, element) -> list[dict] | None:
    """Words with the parts of a reading whose timed spans are theirs one by one; None if they are not."""
    spans = [e for e in element if _local(e.tag) == "span" and _attribute(e, "begin") is not None] if element is not None else []
    if not words or len(spans) != len(words):
        return None
    out, at = [], 0
    for word, span in zip(words, spans):
        part = "".join(span.itertext()).strip()
        times = [_ms(_attribute(span, "begin")), _ms(_attribute(span, "end"))]
        start = text.find(part, at) if part else -1
        if start < 0 or None in times or abs(times[0] - word["begin_ms"]) > SAME_MS or abs(times[1] - word["end_ms"]) > SAME_MS or not out and text[:start].strip():
            return None
        if out:
            out[-1]["joiner"] = text[at:start]
        out.append({**word, "reading": part, "joiner": None})
        at = start + len(part)
    return None if text[at:].strip() else out


def parse_groups(content: str) -> list[dict] | None:
    """Groups of one document, without its lines; None for a malformed one."""
    root = _parsed_root(content)
    return None if root is None else list(_groups(root).values())


def _parsed_root(content: str):
    return _root(content.replace('\\"', '"').replace("\\n", "\n"))


def _groups(root) -> dict[str, dict]:
    groups: dict[str, dict] = {}
    for e in root.iter():
        if _local(e.tag) == "group" and e.attrib.get("id") and e.attrib["id"] not in groups:
            groups[e.attrib["id"]] = {"id": e.attrib["id"], "label": e.attrib.get("label", GROUP_LABEL), "color": e.attrib.get("color", GROUP_COLOR), "template_version": _number(e.attrib.get("templateVersion")) or 1}
    return groups


def parse_project(content: str) -> tuple[list[dict], list[dict]] | None:
    """Lines and groups of one document; None for a malformed one."""
    root = _parsed_root(content)
    if root is None:
        return None
    groups = _groups(root)
    lines: list[dict] = []
    places: dict[str, tuple[int, Any]] = {}
    for p in (e for e in root.iter() if _local(e.tag) == "p"):
        line = _line(p, groups)
        if line is not None:
            lines.append(line)
            if _attribute(p, "key"):
                places[_attribute(p, "key")] = (len(lines) - 1, p)
    meta = next((e for e in root.iter() if _local(e.tag) == "iTunesMetadata"), None)
    for name in ("translation", "transliteration"):
        box = next((e for e in meta if _local(e.tag) == f"{name}s"), None) if meta is not None else None
        for one in box if box is not None else ():
            if _local(one.tag) != name:
                continue
            language = _attribute(one, "lang") or ("und" if name == "translation" else "und-Latn")
            for text in (e for e in one if _local(e.tag) == "text" and e.attrib.get("for") in places):
                at, p = places[text.attrib["for"]]
                lines[at] = (_translated if name == "translation" else _read)(lines[at], text, p, language)
    return lines, list(groups.values())


def _line(p, groups: dict[str, dict]) -> dict | None:
    box = next(iter(_spans_with(p, "x-bg")), None)
    bg_words = _timed_words(box) if box is not None else []
    bg_text = text_of(bg_words) if bg_words else (_own_text(box, "x-translation") if box is not None else "") or None
    words = _timed_words(p)
    text = text_of(words) if words else _own_text(p, "x-bg")
    if not text:
        return None
    group = _attribute(p, "groupId")
    known = group in groups
    return {
        "agent": (_attribute(p, "agent") or "v1").replace("#", ""), "begin_ms": None if words else _ms(_attribute(p, "begin")), "end_ms": None if words else _ms(_attribute(p, "end")), "text": text, "words": words or None,
        "bg_text": bg_text, "bg_words": bg_words or None, "bg_source": "manual" if bg_text or bg_words else None, "group_id": group if known else None, "instance": _number(_attribute(p, "instanceIdx")) if known else None,
        "template_line": _number(_attribute(p, "templateLineIdx")) if known else None, "detached": (_attribute(p, "detached") == "true") if known else None, "translations": [], "reading": None,
    }


def _translated(line: dict, text, p, language: str) -> dict:
    inside = next(iter(_spans_with(text, "x-bg")), None)
    background = "".join(inside.itertext()).strip() if inside is not None else ""
    if not background:  # an older place for it
        background = next((t for e in reversed(_spans_with(p, "x-translation")) if (_attribute(e, "lang") or "") == language and (t := "".join(e.itertext()).strip())), "")
    others = [t for t in line["translations"] if t["language"] != language]
    return {**line, "translations": [*others, {"language": language, "text": _own_text(text, "x-bg"), "background": background or None}]}


def _read(line: dict, text, p, language: str) -> dict:
    inside = next(iter(_spans_with(text, "x-bg")), None)
    own, background = visible(_own_text(text, "x-bg")), visible("".join(inside.itertext())) if inside is not None else ""
    words, bg_words = _mapped(line["words"], own, text) or line["words"], (_mapped(line["bg_words"], background, inside) if background else None) or line["bg_words"]
    track = {"language": language, "text": own, "background": background or None, "status": None, "bg_status": None}
    return aligned({**line, "words": words, "bg_words": bg_words, "reading": track})


def read_project(docs: DataFrame, song: str = "song", content: str = "content") -> DataFrame:
    """``song, line_no`` and the columns of LINE: a row per line of each readable document."""
    return _parsed(docs, song, content, "line_no int, " + ", ".join(f"{c} {t}" for c, t in LINE.items()), lambda text: None if (both := parse_project(text)) is None else [{"line_no": k, **line} for k, line in enumerate(both[0])])


def read_groups(docs: DataFrame, song: str = "song", content: str = "content") -> DataFrame:
    """``song`` and the columns of GROUP: the groups that each document declares."""
    return _parsed(docs, song, content, GROUP, parse_groups)


def _parsed(docs: DataFrame, song: str, content: str, columns: str, rows_of) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.sparkSession.createDataFrame([], f"`{song}` {docs.schema[song].dataType.simpleString()}, {columns}").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 16):
            found = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found += [{song: name, **row} for row in rows_of(text or "") or ()]
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return docs.select(song, content).mapInArrow(run, schema)


def sync_of_ttml(content):
    """syllable if a span is timed, line if a paragraph is, else unsynced."""
    timed = lambda tag: content.rlike(rf"<(?:\w+:)?{tag}\b[^>]*\sbegin\s*=")
    return F.when(timed("span"), "syllable").when(timed("p"), "line").otherwise("unsynced")

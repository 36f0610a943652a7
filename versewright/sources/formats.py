"""Readers and writers of timed-text formats: LRC, QRC, SRT, plain text as column work, TTML by a Python table function.

Readers turn a table of documents ``(song, content)`` into rows of lines or
words in integer milliseconds; writers turn such rows back into one document
per song.  Documents are independent, so reading needs no shuffle and
writing one aggregation by song.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timecode as C

#: Patterns of the formats' tags.
LRC_STAMP = r"\[(\d+:\d{1,2}(?:[.:]\d{1,3})?)\]"
LRC_WORD = r"<(\d+:\d{1,2}(?:[.:]\d{1,3})?)>([^<]*)"
QRC_LINE = r"^\[(\d+),(\d+)\](.*)$"
QRC_WORD = r"(.*?)\((\d+),(\d+)\)"
LAST_LINE_MS = 5000


def header(content: Column, tag: str) -> Column:
    """A header's value such as ``[ti:…]``; null without it."""
    return F.nullif(F.trim(F.regexp_extract(content, rf"(?m)^\[{tag}:([^\]]*)\]", 1)), F.lit(""))


def offset_ms(content: Column) -> Column:
    """The ``[offset:]`` header in milliseconds; a positive one shows lines earlier."""
    return F.coalesce(header(content, "offset").try_cast("bigint"), F.lit(0))


def read_lrc(docs: DataFrame, song: str = "song", content: str = "content", duration: str | None = None) -> DataFrame:
    """``song, line_no, begin_ms, end_ms, text``: a text with several stamps is several lines; lines go by time and end where the next stamp begins.

    Empty timed lines are dropped, but end the line before them.  The last
    line ends with the song, or five seconds later without a ``duration``.
    """
    keep = [song] + ([duration] if duration else [])
    lines = docs.select(*keep, offset_ms(F.col(content)).alias("_off"), F.posexplode(F.split(content, r"\r?\n")).alias("_pos", "_raw"))
    stamps = F.regexp_extract_all("_raw", F.lit(LRC_STAMP), 1)
    rows = lines.withColumn("_stamp", F.explode(stamps)).withColumn("text", F.trim(F.regexp_replace("_raw", LRC_STAMP, "")))
    rows = rows.withColumn("begin_ms", F.greatest(F.lit(0), C.decode_lrc(F.col("_stamp")) - F.col("_off"))).where("begin_ms is not null")
    w = Window.partitionBy(song).orderBy("begin_ms", "_pos")
    last = F.greatest(F.col(duration), F.col("begin_ms")) if duration else F.col("begin_ms") + LAST_LINE_MS
    rows = rows.withColumn("end_ms", F.coalesce(F.lead("begin_ms").over(w), last)).where("text <> ''")
    return rows.select(song, (F.row_number().over(w) - 1).alias("line_no"), "begin_ms", "end_ms", "text")


def lrc_words(lines: DataFrame, text: str = "text") -> DataFrame:
    """Words of enhanced lines (``<mm:ss.xx>word``): a word ends at the next tag or with its line; lines without tags have none."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(LRC_WORD), 1).alias("s"), F.regexp_extract_all(text, F.lit(LRC_WORD), 2).alias("w"))
    rows = lines.select("song", "line_no", F.col("end_ms").alias("_line_end"), F.posexplode(pairs).alias("word_no", "_p"))
    w = Window.partitionBy("song", "line_no").orderBy("word_no")
    rows = rows.withColumn("begin_ms", C.decode_lrc(F.col("_p")["s"]))
    rows = rows.withColumn("end_ms", F.greatest("begin_ms", F.coalesce(F.lead("begin_ms").over(w), "_line_end")))
    return rows.withColumn("text", F.col("_p")["w"]).where("trim(text) <> ''").select("song", "line_no", "word_no", "begin_ms", "end_ms", "text")


def qrc_body(content: Column) -> Column:
    """The lyric inside a QRC's XML attribute, or the content itself."""
    inner = F.regexp_extract(content, r'(?s)LyricContent="([^"]*)"', 1)
    body = F.when(inner == "", content).otherwise(inner)
    for code, sign in (("&#10;", "\n"), ("&#13;", ""), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        body = F.replace(body, F.lit(code), F.lit(sign))
    return body


def read_qrc(docs: DataFrame, song: str = "song", content: str = "content") -> DataFrame:
    """``song, line_no, word_no, begin_ms, end_ms, text`` of ``[start,length]word(start,length)`` lines, credit lines left out.

    A timed space joins the word before it; a last word of no length goes on
    to the next line's begin.
    """
    body = docs.select(song, qrc_body(F.col(content)).alias("_b"))
    lines = body.select(song, offset_ms(F.col("_b")).alias("_off"), F.posexplode(F.split("_b", r"\r?\n")).alias("_pos", "_raw")).where(F.col("_raw").rlike(QRC_LINE))
    lines = lines.withColumn("_at", F.regexp_extract("_raw", QRC_LINE, 1).cast("bigint")).withColumn("_body", F.regexp_extract("_raw", QRC_LINE, 3))
    credit = X.is_credit(F.regexp_replace("_body", r"\(\d+,\d+\)", ""))
    lines = lines.where(~credit)
    of_song = Window.partitionBy(song).orderBy("_at", "_pos")
    lines = lines.withColumn("line_no", F.row_number().over(of_song) - 1).withColumn("_next", F.lead("_at").over(of_song))
    part = lambda i: F.regexp_extract_all("_body", F.lit(QRC_WORD), i)
    words = lines.select(song, "line_no", "_off", "_next", F.posexplode(F.arrays_zip(part(1).alias("t"), part(2).alias("b"), part(3).alias("n"))).alias("_i", "_w"))
    words = words.select("*", F.col("_w")["t"].alias("_t"), F.col("_w")["b"].cast("bigint").alias("_b"), (F.col("_w")["b"].cast("bigint") + F.col("_w")["n"].cast("bigint")).alias("_e"))
    w = Window.partitionBy(song, "line_no").orderBy("_i")
    # Spaces with times of their own belong to the word before them.
    words = words.withColumn("_g", F.sum(F.when(F.trim("_t") == "", 0).otherwise(1)).over(w)).where("_g > 0")
    parts = F.sort_array(F.collect_list(F.struct("_i", "_t")))
    merged = words.groupBy(song, "line_no", "_g").agg(F.array_join(F.transform(parts, lambda p: p["_t"]), "").alias("text"), F.min("_b").alias("_b"), F.max(F.when(F.trim("_t") != "", F.col("_e"))).alias("_e"), F.first("_off").alias("_off"), F.first("_next").alias("_next"))
    end = F.when(F.col("_e") <= F.col("_b"), F.coalesce("_next", "_b")).otherwise(F.col("_e"))
    return merged.select(song, "line_no", (F.col("_g") - 1).cast("int").alias("word_no"), F.greatest(F.lit(0), F.col("_b") - F.col("_off")).alias("begin_ms"), F.greatest(F.lit(0), end - F.col("_off")).alias("end_ms"), "text")


def read_plain(docs: DataFrame, song: str = "song", content: str = "content") -> DataFrame:
    """``song, line_no, text``: blank lines and ``[Section]`` labels dropped."""
    lines = docs.select(song, F.posexplode(F.split(content, r"\r?\n")).alias("_pos", "_raw")).withColumn("text", F.trim("_raw"))
    lines = lines.where((F.col("text") != "") & ~X.is_section(F.col("text")))
    return lines.select(song, (F.row_number().over(Window.partitionBy(song).orderBy("_pos")) - 1).alias("line_no"), "text")


def read_srt(docs: DataFrame, song: str = "song", content: str = "content") -> DataFrame:
    """``song, line_no, begin_ms, end_ms, text`` of numbered blocks."""
    form = r"(\d+):(\d{2}):(\d{2}),(\d{3})\s+-->\s+(\d+):(\d{2}):(\d{2}),(\d{3})\r?\n((?s).*)"
    blocks = docs.select(song, F.posexplode(F.split(content, r"\r?\n\s*\r?\n")).alias("_pos", "_raw")).where(F.col("_raw").rlike(form))
    n = lambda i: F.regexp_extract("_raw", form, i).cast("bigint")
    ms = lambda i: n(i) * 3_600_000 + n(i + 1) * 60000 + n(i + 2) * 1000 + n(i + 3)
    return blocks.select(song, F.col("_pos").alias("line_no"), ms(1).alias("begin_ms"), ms(5).alias("end_ms"), F.regexp_replace(F.regexp_extract("_raw", form, 9), r"^\s+|\s+$", "").alias("text"))


#: Roles of spans that stand beside a line's own text, and the format's namespaces.
SIDE_ROLES = ("x-bg", "x-translation", "x-roman")
NAMESPACES = {"": "http://www.w3.org/ns/ttml", ":ttm": "http://www.w3.org/ns/ttml#metadata", ":itunes": "http://music.apple.com/lyric-ttml-internal"}


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _root(content: str):
    """The document's root; prefixes that are used without a declaration get one.  None if it can't be read."""
    import xml.etree.ElementTree as ET

    used = set(re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", content)) - {"xml", "xmlns"}
    declared = set(re.findall(r"xmlns:([\w.-]+)=", content))
    extra = "".join(f' xmlns:{p}="urn:{p}"' for p in sorted(used - declared))
    try:
        return ET.fromstring(re.sub(r"<tt\b", f"<tt{extra}", content, count=1))
    except ET.ParseError:
        return None


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces: what a worker makes of them is held for one piece, not for a batch of thousands of documents."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def parse_ttml_head(content: str) -> dict | None:
    """Title, artists, album, songwriters, language, duration and agents of one document; None for a malformed one."""
    root = _root(content)
    if root is None:
        return None
    out: dict = {"title": None, "artists": [], "album": None, "songwriters": [], "language": _attribute(root, "lang") or None, "duration_ms": None, "agents": []}
    for e in root.iter():
        name, text = _local(e.tag), (e.text or "").strip()
        key, value = e.attrib.get("key"), e.attrib.get("value")
        if name == "title" and text:
            out["title"] = out["title"] or text
        elif name == "songwriter" and text:
            out["songwriters"].append(text)
        elif name == "body":
            out["duration_ms"] = _ms(e.attrib.get("dur"))
        elif name == "agent" and _attribute(e, "id"):
            inner = next((c.text for c in e if _local(c.tag) == "name" and c.text), None)
            out["agents"].append({"id": _attribute(e, "id"), "kind": e.attrib.get("type", "person"), "name": inner})
        elif name == "meta" and value:
            if key == "album":
                out["album"] = value
            elif key in ("artists", "songwriter", "songwriters"):
                out["artists" if key == "artists" else "songwriters"].append(value)
    return out


HEAD = "title string, artists array<string>, album string, songwriters array<string>, language string, duration_ms bigint, agents array<struct<id: string, kind: string, name: string>>"


def read_ttml_head(docs: DataFrame, song: str = "song", content: str = "content") -> DataFrame:
    """One row of head fields per readable document."""
    kind = docs.schema[song].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            rows = [{song: s} | head for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (head := parse_ttml_head(c or "")) is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.sparkSession.createDataFrame([], f"`{song}` {kind}, {HEAD}").schema
    arrow = to_arrow_schema(schema)
    return docs.select(song, content).mapInArrow(run, schema)


def parse_ttml(content: str) -> list[tuple]:
    """``(line_no, track, word_no, begin_ms, end_ms, text, agent)`` of one TTML document; nothing for a malformed one.

    White space between spans decides where words end, which is why this is
    Python: Spark's XML source drops it.
    """
    root = _root(content)
    if root is None:
        return []
    attr = _attribute
    out: list[tuple] = []

    def spans(parent, skip: bool) -> list[tuple]:
        found = []
        for child in parent:
            if _local(child.tag) != "span" or skip and attr(child, "role"):
                continue
            begin, end = _ms(attr(child, "begin")), _ms(attr(child, "end"))
            if begin is None:
                continue
            gap = " " if re.search(r"\s", child.tail or "") else ""
            found.append((begin, end, "".join(child.itertext()).strip() + gap))
        return found

    number = 0
    for p in (e for e in root.iter() if _local(e.tag) == "p"):
        agent = (attr(p, "agent") or "").lstrip("#") or None
        rows = [("main", *s) for s in spans(p, True)]
        for bg in (e for e in p if _local(e.tag) == "span" and attr(e, "role") == "x-bg"):
            timed = spans(bg, False)
            rows += [("bg", *s) for s in timed] if timed else [("bg", None, None, w) for w in "".join(bg.itertext()).split()]
        if not any(r[0] == "main" for r in rows):
            # Backgrounds, translations and readings are not part of the line's own text.
            own = [p.text or ""] + [("" if attr(c, "role") in SIDE_ROLES else "".join(c.itertext())) + (c.tail or "") for c in p]
            text = " ".join("".join(own).split())
            if text:
                rows.insert(0, ("main", _ms(attr(p, "begin")), _ms(attr(p, "end")), text))
        if not rows:
            continue
        counts: dict[str, int] = {}
        for track, begin, end, text in rows:
            counts[track] = counts.get(track, -1) + 1
            out.append((number, track, counts[track], begin, end, text, agent))
        number += 1
    return out


def _ms(value: str | None) -> int | None:
    """Milliseconds of a TTML time; null if invalid."""
    if value is None:
        return None
    v = value.strip()
    if m := re.fullmatch(r"(?:(?:(\d+):)?(\d+):)?(\d+)(?:\.(\d+))?", v):
        h, minute, s, f = m.groups()
        return (int(h or 0) * 60 + int(minute or 0)) * 60000 + int(s) * 1000 + int((f or "")[:3].ljust(3, "0"))
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)(h|ms|m|s)", v):
        return round(float(m[1]) * {"h": 3_600_000, "m": 60000, "s": 1000, "ms": 1}[m[2]])
    return None


def read_ttml(docs: DataFrame, song: str = "song", content: str = "content") -> DataFrame:
    """``song, line_no, track, word_no, begin_ms, end_ms, text, agent`` of TTML documents."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema[song].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"`{song}` {kind}, line_no int, track string, word_no int, begin_ms bigint, end_ms bigint, text string, agent string").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            rows = [(s, *r) for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in parse_ttml(c or "")]
            columns = zip(*rows) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(song, content).mapInArrow(run, schema)


def _document(rows: DataFrame, song: str, order: str, line: Column, separator: str, head: Column | None = None, tail: str = "") -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    body = F.array_join(F.transform(parts, lambda p: p["t"]), separator)
    return rows.groupBy(song).agg(F.concat(head if head is not None else F.lit(""), body, F.lit(tail)).alias("content"))


def write_lrc(lines: DataFrame, song: str = "song") -> DataFrame:
    """``song, content``: one ``[mm:ss.cc]text`` line per bounded line."""
    bounded = lines.where("begin_ms is not null and end_ms is not null")
    return _document(bounded, song, "line_no", F.concat(F.lit("["), C.encode_lrc(F.col("begin_ms")), F.lit("]"), "text"), "\n", tail="\n")


def write_srt(lines: DataFrame, song: str = "song") -> DataFrame:
    """``song, content``: numbered blocks without gaps in the numbers."""
    bounded = lines.where("begin_ms is not null and end_ms is not null").withColumn("_n", F.row_number().over(Window.partitionBy(song).orderBy("line_no")))
    block = F.concat(F.col("_n").cast("string"), F.lit("\n"), C.encode_srt(F.col("begin_ms")), F.lit(" --> "), C.encode_srt(F.col("end_ms")), F.lit("\n"), "text")
    return _document(bounded, song, "_n", block, "\n\n", tail="\n")


def _word_lines(words: DataFrame, song: str, word: Column) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("word_no", word.alias("t"))))
    return words.groupBy(song, "line_no").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"))


def write_qrc(words: DataFrame, song: str = "song") -> DataFrame:
    """``song, content``: ``[start,length]word(start,length)…`` lines."""
    word = F.concat("text", F.lit("("), F.col("begin_ms").cast("string"), F.lit(","), (F.col("end_ms") - F.col("begin_ms")).cast("string"), F.lit(")"))
    lines = _word_lines(words, song, word)
    line = F.concat(F.lit("["), F.col("begin_ms").cast("string"), F.lit(","), (F.col("end_ms") - F.col("begin_ms")).cast("string"), F.lit("]"), "text")
    return _document(lines, song, "line_no", line, "\n", tail="\n")


def _spans(words: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of each group of words; a word's trailing space stands between spans, none behind the last."""
    word = F.concat(F.lit('<span begin="'), C.encode_ttml(F.col("begin_ms")), F.lit('" end="'), C.encode_ttml(F.col("end_ms")), F.lit('">'), X.escape_xml(F.rtrim("text")), F.lit("</span>"), F.when(F.col("text").endswith(" "), " ").otherwise(""))
    parts = F.sort_array(F.collect_list(F.struct("word_no", word.alias("t"))))
    return words.groupBy(*keys).agg(F.rtrim(F.array_join(F.transform(parts, lambda p: p["t"]), "")).alias("text"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"))


def _head(meta: DataFrame, agents: DataFrame, song: str) -> DataFrame:
    """``(song, _head, _attrs, _dur)`` of the document's head."""
    quoted = lambda c: X.escape_xml(c, quotes=True)
    tag = lambda key, c: F.concat(F.lit(f'<meta key="{key}" value="'), quoted(c), F.lit('"/>'))
    own = F.when(F.col("name").isNull(), F.lit("/>")).otherwise(F.concat(F.lit("><ttm:name>"), X.escape_xml(F.col("name")), F.lit("</ttm:name></ttm:agent>")))
    agent = F.concat(F.lit('<ttm:agent xml:id="'), quoted(F.col("id")), F.lit('" type="'), quoted(F.col("kind")), F.lit('"'), own)
    voices = agents.groupBy(song).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", agent.alias("t")))), lambda x: x["t"]), "").alias("_v"))
    title = F.concat(F.lit("<ttm:title>"), X.escape_xml(F.col("title")), F.lit("</ttm:title>"))
    listed = lambda key, c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda a: tag(key, a)), "")
    head = F.concat(F.lit("<head><metadata>"), *[F.coalesce(x, F.lit("")) for x in (title, listed("artists", F.col("artists")), tag("album", F.col("album")), listed("songwriter", F.col("songwriters")), F.col("_v"))], F.lit("</metadata></head>"))
    language = F.concat(F.lit(' xml:lang="'), quoted(F.col("language")), F.lit('"'))
    length = F.concat(F.lit(' dur="'), C.encode_ttml(F.col("duration_ms")), F.lit('"'))
    return meta.join(voices, song, "left").select(song, head.alias("_head"), F.coalesce(language, F.lit("")).alias("_lang"), F.coalesce(length, F.lit("")).alias("_dur"))


def write_ttml(words: DataFrame, song: str = "song", meta: DataFrame | None = None, agents: DataFrame | None = None) -> DataFrame:
    """``song, content``: one ``p`` per line with a running key, one span per word.

    ``words`` may have a ``track`` (bg words go into a background span of
    their line) and an ``agent``.  ``meta`` (title, artists, album,
    songwriters, language, duration_ms) and ``agents`` (id, kind, name) make
    the head, one row of ``meta`` per song.
    """
    words = words if "track" in words.columns else words.withColumn("track", F.lit("main"))
    words = words if "agent" in words.columns else words.withColumn("agent", F.lit(None).cast("string"))
    side = _spans(words, [song, "line_no", "track"])
    pick = lambda t: F.max(F.when(F.col("track") == t, F.col("text")))
    lines = side.groupBy(song, "line_no").agg(pick("main").alias("_m"), pick("bg").alias("_b"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"))
    lines = lines.join(words.groupBy(song, "line_no").agg(F.min("agent").alias("agent")), [song, "line_no"])
    lines = lines.withColumn("_n", F.row_number().over(Window.partitionBy(song).orderBy("line_no")))
    voice = F.coalesce(F.concat(F.lit('" ttm:agent="'), X.escape_xml(F.col("agent"), quotes=True)), F.lit(""))
    background = F.coalesce(F.concat(F.lit('<span ttm:role="x-bg">'), "_b", F.lit("</span>")), F.lit(""))
    p = F.concat(F.lit('<p begin="'), C.encode_ttml(F.col("begin_ms")), F.lit('" end="'), C.encode_ttml(F.col("end_ms")), F.lit('" itunes:key="L'), F.col("_n").cast("string"), voice, F.lit('">'), F.coalesce("_m", F.lit("")), background, F.lit("</p>"))
    spaces = "".join(f' xmlns{k}="{v}"' for k, v in NAMESPACES.items())
    body = _document(lines, song, "_n", p, "", F.lit(""), "</div></body></tt>")
    if meta is None:
        return body.select(song, F.concat(F.lit(f"<tt{spaces}><body><div>"), "content").alias("content"))
    none = agents if agents is not None else meta.select(song, *[F.lit(None).cast("string").alias(c) for c in ("id", "kind", "name")]).limit(0)
    full = body.join(_head(meta, none, song), song, "left")
    start = F.concat(F.lit(f"<tt{spaces}"), F.coalesce("_lang", F.lit("")), F.lit(">"), F.coalesce("_head", F.lit("")), F.lit("<body"), F.coalesce("_dur", F.lit("")), F.lit("><div>"))
    return full.select(song, F.concat(start, "content").alias("content"))


def write_lrc_words(words: DataFrame, song: str = "song", title: Column | None = None) -> DataFrame:
    """``song, content``: enhanced lines ``[mm:ss.cc]<mm:ss.cc>word …<mm:ss.cc>``, the last stamp being the line's end."""
    stamp = lambda c: F.concat(F.lit("<"), C.encode_lrc(F.col(c)), F.lit(">"))
    parts = F.sort_array(F.collect_list(F.struct("word_no", F.concat(stamp("begin_ms"), "text").alias("t"))))
    lines = words.groupBy(song, "line_no").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"))
    line = F.concat(F.lit("["), C.encode_lrc(F.col("begin_ms")), F.lit("]"), "text", stamp("end_ms"))
    head = F.concat(F.lit("[ti:"), F.first(title), F.lit("]\n")) if title is not None else None
    return _document(lines, song, "line_no", line, "\n", head, "\n")


def write_all(words: DataFrame, lines: DataFrame, song: str = "song") -> DataFrame:
    """``song, format, content`` of every song in every format that its timing allows."""
    made = {"lrc": write_lrc(lines, song), "srt": write_srt(lines, song), "qrc": write_qrc(words, song), "ttml": write_ttml(words, song), "elrc": write_lrc_words(words, song)}
    out = None
    for name, df in made.items():
        df = df.select(song, F.lit(name).alias("format"), "content")
        out = df if out is None else out.unionByName(df)
    return out


def read_any(docs: DataFrame, song: str = "song", content: str = "content", kind: str = "format") -> DataFrame:
    """Lines of documents in mixed formats (lrc, srt, plain, qrc, ttml): ``song, format, line_no, begin_ms, end_ms, text``."""
    of = lambda name: docs.where(F.col(kind) == name)
    lines = [read_lrc(of("lrc"), song, content).withColumn("format", F.lit("lrc")), read_srt(of("srt"), song, content).withColumn("format", F.lit("srt"))]
    plain = read_plain(of("plain"), song, content).withColumns({"begin_ms": F.lit(None).cast("bigint"), "end_ms": F.lit(None).cast("bigint"), "format": F.lit("plain")})
    made = [_word_lines(read_qrc(of("qrc"), song, content), song, F.col("text")).withColumn("format", F.lit("qrc")), _word_lines(read_ttml(of("ttml"), song, content).where("track = 'main'"), song, F.col("text")).withColumn("format", F.lit("ttml"))]
    out = lines[0].unionByName(lines[1]).unionByName(plain)
    for m in made:
        out = out.unionByName(m)
    return out.select(song, "format", "line_no", "begin_ms", "end_ms", F.trim("text").alias("text"))

"""Projects as TTML: what is read, what is written, and odd documents."""

from pyspark.sql import functions as F

from versewright.functions import text as X
from versewright.sources import formats, project_ttml
from versewright.sources.project_ttml import parse_project, rendered

HEAD = '<tt xmlns:ttm="a" xmlns:itunes="b"><head><metadata><z:groups><z:group id="g1" label="One" templateVersion="x"/><z:group id="g1"/></z:groups>{}</metadata></head><body><div>{}</div></body></tt>'
META = '<iTunesMetadata><translations><translation xml:lang="de">{}</translation></translations><transliterations><transliteration xml:lang="ja-Latn">{}</transliteration></transliterations></iTunesMetadata>'
P = '<p begin="00:01.000" end="00:05.000" itunes:key="L1" ttm:agent="#v2" z:groupId="g1" z:instanceIdx="2" z:templateLineIdx="1" z:detached="true">{}</p>'
SPANS = '<span begin="00:01.000" end="00:02.000">ko</span><span begin="00:02.000" end="00:03.000" z:explicit="true">e</span> <span begin="00:03.000" end="00:05.000">da</span>'


def parsed(meta, body):
    return parse_project(HEAD.format(meta, body))


def test_lines_groups_and_marks():
    lines, groups = parsed("", P.format(SPANS + '<span ttm:role="x-bg"><span begin="00:04.000" end="00:05.000">oh</span></span>') + '<p z:groupId="other"> plain <b>text</b> <span ttm:role="x-bg">(hey)</span></p><p> </p>')
    assert groups == [{"id": "g1", "label": "One", "color": project_ttml.GROUP_COLOR, "template_version": 1}]
    one, two = lines
    assert (one["text"], one["agent"], one["group_id"], one["instance"], one["template_line"], one["detached"]) == ("ko|e da", "v2", "g1", 2, 1, True)
    assert [(w["text"], w["begin_ms"], w["explicit"]) for w in one["words"]] == [("ko", 1000, None), ("e ", 2000, True), ("da", 3000, None)] and one["begin_ms"] is None
    assert (one["bg_text"], one["bg_words"][0]["end_ms"], one["bg_source"]) == ("oh", 5000, "manual")
    assert (two["text"], two["bg_text"], two["group_id"], two["words"], two["begin_ms"]) == ("plain text", "(hey)", None, None, None)
    assert parse_project("<tt><p>") is None and parse_project("") is None and parse_project("<tt/>") == ([], [])


def test_translations_and_readings():
    meta = META.format('<text for="L1">Stimme <span ttm:role="x-bg">oh </span>da</text><text for="L9">x</text>', '<text for="L1">koe  da</text>')
    one = parsed(meta, P.format(SPANS))[0][0]
    assert one["translations"] == [{"language": "de", "text": "Stimme da", "background": "oh"}]
    assert one["reading"]["text"] == "koe  da" and one["reading"]["status"] == "needs-review" and [w["reading"] for w in one["words"]] == ["ko", "e", "da"]
    exact = META.format("", '<text for="L1"><span begin="00:01.000" end="00:02.000">ko</span>-<span begin="00:02.000" end="00:03.000">é</span>  <span begin="00:03.000" end="00:05.000">da</span></text>')
    one = parsed(exact, P.format(SPANS))[0][0]
    assert [(w["reading"], w["joiner"]) for w in one["words"]] == [("ko", "-"), ("é", "  "), ("da", None)] and one["reading"]["status"] == "confirmed"
    late = exact.replace("00:02.000", "00:02.100")
    assert parsed(late, P.format(SPANS))[0][0]["reading"]["status"] == "inferred"
    older = P.format('we <span ttm:role="x-bg">oh<span ttm:role="x-translation" xml:lang="de">ach</span></span>')
    one = parsed(META.format('<text for="L1">wir</text>', ""), older)[0][0]
    assert one["translations"][0]["background"] == "ach" and one["bg_text"] == "oh"


def test_written_lines():
    word = lambda t, b, e, **k: {"text": t, "begin_ms": b, "end_ms": e, "explicit": None, "reading": None, "joiner": None} | k
    line = {c: None for c in project_ttml.LINE} | {"begin_ms": 0, "end_ms": 9000, "text": "a <b", "words": [word("a ", 0, 1000, explicit=True), word("<b", 1000, 9000)], "translations": [{"language": "de", "text": "ein b", "background": "ach"}]}
    line |= {"bg_words": [word("oh", 8000, 9000)], "bg_text": "oh", "reading": {"language": "x", "text": "ah be", "background": None, "status": None, "bg_status": None}}
    p, side, reading = rendered(line, "L1")
    assert p == '<p begin="00:00.000" end="00:09.000" itunes:key="L1"><span begin="00:00.000" end="00:01.000" edit:explicit="true">a</span> <span begin="00:01.000" end="00:09.000">&lt;b</span><span ttm:role="x-bg"><span begin="00:08.000" end="00:09.000">oh</span></span></p>'
    assert side == [("de", 'ein <span ttm:role="x-bg">ach </span>b')]
    assert reading == ("x", '<span begin="00:00.000" end="00:01.000">ah</span> <span begin="00:01.000" end="00:09.000">be</span>')
    assert rendered({**line, "words": None, "bg_words": None, "text": "a|b", "reading": None}, None)[0].startswith('<p begin="00:00.000" end="00:09.000">ab<span ttm:role="x-bg"><span begin')
    assert project_ttml.stamp(3_723_004) == "1:02:03.004"


def test_sync_of_documents(spark):
    docs = spark.createDataFrame([('<p begin="1"><span begin="1">x</span></p>',), ('<p begin="1"><span>x</span></p>',), ("<p>x</p>",), ("<tt:p begin='1'>",)], "c string")
    assert [r[0] for r in docs.select(project_ttml.sync_of_ttml(F.col("c"))).collect()] == ["syllable", "line", "unsynced", "line"]


def test_credits(spark):
    rows = [("Lyrics by：x", True), ("词: x", True), ("作 曲:x", True), ("Composer : x", True), ("my best 曲: x", False), ("he said: no", False), ("曲", False), (": 曲", False), (None, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(X.is_credit(F.col("t"))).collect()] == [w for _, w in rows]
    doc = spark.createDataFrame([("s", "[0,1000]词(0,500)：(500,100)x(600,400)\n[1000,1000]la(1000,1000)")], "song string, content string")
    assert [r["text"] for r in formats.read_qrc(doc).collect()] == ["la"]

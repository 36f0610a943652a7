"""Line repair, background extraction and stateful streams, by hand and against a naive replay."""

import uuid

import pytest
from pyspark.sql import functions as F

from versewright.operators import extraction, line_repair
from versewright.plans import song_queries
from versewright.streaming import stateful

SF = "/root/testdata/sf0.001"


def word(text, begin=None, end=None, confidence=None, flags=()):
    return {"text": text, "begin_ms": begin, "end_ms": end, "confidence": confidence, "flags": list(flags)}


def times(words):
    return [(w["begin_ms"], w["end_ms"]) for w in words]


def test_repair_fills_inside_the_line():
    fill = lambda words, lo=None, hi=None: times(line_repair.repaired(words, [], lo, hi)[0])
    assert fill([word("a ", 1000, 1200, 0.5), word("bbb "), word("c ", 2200, 2400, 0.5)])[1] == (1200, 2200)
    assert fill([word("x "), word("y ", 5000, 5500, 1), word("z")]) == [(4700, 5000), (5000, 5500), (5500, 5800)]
    assert fill([word("only")], 3000, 4000) == [(3000, 4000)] and fill([word("only")]) == [(None, None)]
    assert fill([word("abcdef"), word("b"), word("c", 3000, 3400)]) == [(2400, 2914), (2914, 3000), (3000, 3400)]
    assert fill([word("a", 0, 1000), word("dd"), word("e", 1000, 1200)]) == [(0, 1000), (1000, 1050), (1050, 1200)]


def test_repair_tidies_and_flags():
    words = [word("a ", 1000, 1200, 0.5), word("b ", 1100, 1500, 0.04), word("c", 1700, 1700, 0.01)]
    got = line_repair.repaired(words, [word("oh", None, None)], 0, 400)
    assert times(got[0]) == [(1000, 1200), (1200, 1700), (1700, 1750)] and [w["flags"] for w in got[0]] == [[], [], ["low-confidence"]]
    assert times(got[1]) == [(0, 400)] and got[1][0]["flags"] == ["interpolated"] and words[1]["begin_ms"] == 1100


def test_repair_moves_stray_words_first():
    got = line_repair.repaired([word("one ", 10_000, 10_300, 0.01), word("two ", 11_500, 11_800, 0.6), word("three", 14_000, 14_200, 0.0)], [], None, None)[0]
    assert times(got) == [(11_200, 11_500), (11_500, 11_800), (11_800, 12_000)]
    assert [w["flags"] for w in got] == [["reanchored", "low-confidence"], [], ["reanchored", "low-confidence"]]


def test_repair_in_spark(spark):
    rows = {(r["song"], r["line_no"]): r.asDict(True) for r in song_queries._tracks(spark, SF).collect()}
    got = song_queries.repaired_lines(spark, SF).collect()
    want = {}
    for (song, line), r in rows.items():
        for track, words in zip(("main", "bg"), line_repair.repaired(r["words"], r["background"], r["begin_ms"], r["end_ms"])):
            want |= {(song, line, track, k): (w["begin_ms"], w["end_ms"], ",".join(w["flags"])) for k, w in enumerate(words)}
    assert {(r["song"], r["line_no"], r["track"], r["word_no"]): (r["begin_ms"], r["end_ms"], r["flags"]) for r in got} == want
    assert {f for _, _, flags in want.values() for f in flags.split(",")} == {"", "interpolated", "reanchored", "low-confidence"}


def sung(text, begin, end, syllable=None):
    return {"text": text, "begin_ms": float(begin), "end_ms": float(end), "syllable": syllable}


def line(text, words=None, linked=False, bg_text=None, bg_words=None, bg_source=None, begin=None, end=None):
    return {"text": text, "words": words, "begin_ms": begin, "end_ms": end, "bg_text": bg_text, "bg_words": bg_words, "bg_source": bg_source, "linked": linked}


@pytest.mark.parametrize(
    ("text", "want"),
    [("we go", ("none", "", "we go")), ("we (oh) go (hey)", ("inline", "oh hey", "we go")), ("(oh) (hey)", ("standalone", "oh hey", "")), ("we (oh", ("skip", "", "we (oh")), ("a (b (c))", ("skip", "", "a (b (c))")), ("a )b(", ("skip", "", "a )b(")), ("a ( )", ("none", "", "a ( )"))],
)
def test_classes(text, want):
    assert extraction.classified(text) == want


def test_inline_extraction_keeps_what_was_written():
    got = extraction.inline_extracted(line("we (oh) go"))
    assert (got["text"], got["bg_text"], got["bg_source"]) == ("we go", "oh", "extraction")
    got = extraction.inline_extracted(line("we (oh) go", bg_text="la", bg_source="manual"))
    assert (got["bg_text"], got["bg_source"]) == ("la oh", "manual")
    got = extraction.inline_extracted(line("we (oh) go", bg_text="la", bg_source="extraction"), brackets=True)
    assert (got["bg_text"], got["bg_source"]) == ("(oh)", "extraction")
    words = [sung("we ", 0, 1), sung("(oh ", 1, 2), sung("no) ", 2, 3), sung("go", 3, 4)]
    got = extraction.inline_extracted(line("we (oh no) go", words))
    assert [w["text"] for w in got["words"]] == ["we ", "go"] and got["text"] == "we go" and got["bg_text"] == "oh no"
    over = line("we(oh) go", [sung("we(oh) ", 0, 1), sung("go", 1, 2)])
    assert extraction.inline_extracted(over) is over
    timed = line("we (oh) go", bg_words=[sung("la", 0, 1)])
    assert extraction.inline_extracted(timed) is timed


def test_standalone_lines_are_merged():
    run = lambda *lines, **k: [(x["text"], x["bg_text"], x["bg_source"], x["bg_words"] and len(x["bg_words"])) for x in extraction.extraction(lines, **k)]
    assert run(line("we go"), line("(oh)"), line("(hey now)"), line("on")) == [("we go", "oh hey now", "extraction", None), ("on", None, None, None)]
    assert run(line("we go"), line("(oh)"), line("(hey)"), brackets=True)[0][1] == "(oh hey)"
    assert run(line("we go", bg_text="la", bg_source="manual"), line("(oh)"))[0] == ("we go", "la oh", "manual", None)
    assert run(line("we go", bg_text="la", bg_source="extraction"), line("(oh)"))[0] == ("we go", "oh", "extraction", None)
    assert len(run(line("we go", linked=True), line("(oh)"))) == len(run(line("(oh)"), line("(hey)"))) == len(run(line("we go"), line("(oh)"), merge=False)) == 2
    timed = line("(oh my)", [sung("(oh ", 10, 20), sung("my)", 20, 40)])
    assert run(line("we go"), timed)[0] == ("we go", "oh my", "extraction", 2)
    assert run(line("we go"), timed, line("(hey)")) == [("we go", "oh my", "extraction", 2), ("(hey)", None, None, None)]
    both = list(extraction.extraction([line("we go"), timed, line("(hey)", begin=50.0, end=70.0)], brackets=True))
    assert [w["text"] for w in both[0]["bg_words"]] == ["(oh ", "my ", "hey)"] and both[0]["bg_words"][2]["begin_ms"] == 50


def test_new_texts_keep_times():
    old = [sung("one ", 0, 10), sung("two ", 10, 30), sung("three", 30, 40)]
    assert [(w["text"], w["begin_ms"]) for w in extraction.retexted(old, "one three")] == [("one ", 0), ("three", 30)]
    assert [(w["text"], w["begin_ms"], w["end_ms"]) for w in extraction.retexted(old, "one a b three")][1:3] == [("a ", 10, 20), ("b ", 20, 30)]
    assert [w["text"] for w in extraction.retexted(old, "a b|c")] == ["a ", "b", "c"]
    assert extraction.spread("ab c", 0.0, 300.0)[1] == sung("c", 200, 300) and extraction.spread("a b", 0.0, None)[1]["end_ms"] == 600


def test_extraction_in_spark(spark):
    """Against the rule on a whole list, looking back into it."""
    rows = [r.asDict(True) for r in song_queries._sung(spark, SF).orderBy("song", "line_no").collect()]
    want: dict = {}
    for r in rows:
        kept, fresh = want.setdefault(r["song"], ([], set()))
        kind, inside, _ = extraction.classified(r["text"])
        prev = kept[-1] if kept else None
        if kind == "standalone" and prev and prev["text"].strip() and extraction.classified(prev["text"])[0] == "none" and not prev["linked"] and not r["linked"]:
            both = extraction.merged(prev, r, inside, len(kept) - 1 in fresh, True)
            if both:
                kept[-1] = both
                fresh.add(len(kept) - 1)
                continue
        kept.append(extraction.inline_extracted(r, True))
        if kept[-1] is not r:
            fresh.add(len(kept) - 1)
    flat = {(s, x["line_no"]): (x["text"], x["bg_text"], x["bg_source"], len(x["bg_words"] or [])) for s, (kept, _) in want.items() for x in kept}
    got = {(r["song"], r["line_no"]): (r["text"], r["bg_text"], r["bg_source"], r["bg_words"]) for r in song_queries.background_extraction(spark, SF).collect()}
    assert got == flat and len(flat) < len(rows)


def stream_of(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    types = spark.read.parquet(f"{tmp_path}/in/0").schema
    return spark.readStream.schema(types).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_throttle_over_batches(spark, tmp_path):
    ms = 1000
    first = [("j", "a", 0, 10**12, 0.1), ("j", "a", 1, 10**12 + 100 * ms, 0.2), ("j", "a", 2, 10**12 + 250 * ms, None), ("j", "b", 3, 10**12 + 10 * ms, -3.0)]
    second = [("j", "a", 4, 10**12 + 300 * ms, 0.5), ("j", "a", 5, 10**12 + 310 * ms, 7.0), ("j", "a", 6, 10**12 + 400 * ms, 1.0), ("j", "a", 7, 10**12 + 500 * ms, 0.9), ("j", "a", 8, 10**12 + 650 * ms, 0.9)]
    stream = stream_of(spark, tmp_path / uuid.uuid4().hex, [first, second], "job string, bar string, seq bigint, us bigint, fraction double")
    got = stateful.run_with_state(spark, stateful.throttled(stream)).collect()
    assert sorted((r["seq"], r["fraction"]) for r in got if r["fraction"] is not None) == [(0, 0.1), (3, 0.0), (5, 1.0), (6, 1.0), (8, 0.9)]
    assert [r["seq"] for r in got if r["fraction"] is None] == [2]


def test_client_state_over_batches(spark, tmp_path):
    t = 10**12
    rows = [("j", 0, t, "status", None, "queued", None, None), ("j", 1, t + 1, "event", None, None, None, None), ("j", 2, t + 2, "progress", "fetch", None, None, 0.4)]
    more = [("j", 3, t + 3, "open", None, None, None, None), ("j", 4, t + 4, "event", None, None, None, None), ("j", 5, t + 5, "progress", "align", None, None, 0.1), ("j", 6, t + 6, "progress", "align", None, None, 0.2), ("j", 7, t + 7, "status", None, "failed", "why", None)]
    stream = stream_of(spark, tmp_path / uuid.uuid4().hex, [rows, more], "job string, seq bigint, us bigint, kind string, stage string, status string, error string, fraction double").withColumn("detail", F.lit(""))
    got = sorted(stateful.run_with_state(spark, stateful.client_state(stream), "update").collect(), key=lambda r: r["last_seq"])
    assert [(r["status"], r["error"], r["stages"], r["fractions"], r["events"]) for r in got] == [("queued", None, ["fetch"], [0.4], 1), ("failed", "why", ["align"], [0.2], 1)]

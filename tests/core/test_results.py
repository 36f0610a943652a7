"""Corrections by the source against a naive pass, and results, questions and selections by hand."""

from pyspark.sql import functions as F

from versewright.operators import corrections, results, selection
from versewright.plans import result_queries

SF = "/root/testdata/sf0.001"


def word(text, begin, end, sure=0.9):
    return {"text": text, "begin_ms": begin, "end_ms": end, "confidence": sure, "flags": []}


def line(begin, end, *words, local=0.0, song=0.0, duration=100_000.0):
    return {"begin_ms": begin, "end_ms": end, "local_ms": local, "song_ms": song, "duration_ms": duration, "words": list(words)}


def test_unsure_lines_are_trusted_to_the_source():
    assert corrections.trusted_offset(line(1000, 3000, word("a", 5000, 5100, 0.1))) == 0.0
    assert corrections.trusted_offset(line(1000, 3000, word("a", 5000, 5100, 0.9))) is None
    assert corrections.trusted_offset(line(1000, 3000, word("a", 5000, 5100, 0.1), local=4000.0, song=0.0)) == 0.0
    assert corrections.trusted_offset(line(1000, 3000, word("a", 5000, 5100, 0.1), local=4000.0, song=3500.0)) is None
    assert corrections.trusted_offset(line(None, None, word("a", 5000, 5100, 0.1))) is None
    made = corrections.laid_over(line(1000, 9000, word("abc", None, None), word("d", None, None)), 500.0, 0.0)
    assert [(w["begin_ms"], w["end_ms"], w["flags"]) for w in made] == [(1500, 2250, ["line-timing"]), (2250, 2500, ["line-timing"])]
    assert corrections.laid_over(line(1000, 2000, word("a", 0, 1)), 0.0, 5000.0)[0]["end_ms"] == 5300


def test_late_starts_and_overruns():
    assert corrections.pulled_back(line(1000, 3000, word("a", 1600, 2000)), 0.0, 0.0)[0]["begin_ms"] == 1000
    assert corrections.pulled_back(line(1000, 3000, word("a", 1300, 2000)), 0.0, 0.0)[0]["begin_ms"] == 1300
    assert corrections.pulled_back(line(1000, 3000, word("a", 3000, 3500)), 0.0, 1500.0)[0]["begin_ms"] == 1500
    made = corrections.squeezed(line(0, 2000, word("a", 0, 1000), word("b", 1000, 4000)), line(2000, 5000, word("c", 3000, 3500)))
    assert [(w["begin_ms"], w["end_ms"]) for w in made] == [(0, 500), (500, 2000)]
    tight = [word("a", 1900, 2500), word("b", 2500, 4000)]
    assert corrections.squeezed(line(0, 2000, *tight), line(2000, 5000, word("c", 3000, 3500))) == tight


def test_corrections_in_spark(spark):
    rows = [r.asDict(True) for r in result_queries._placed(spark, SF).orderBy("song", "line_no").collect()]
    songs: dict = {}
    for r in rows:
        songs.setdefault(r["song"], []).append({**r, **{c: float(r[c]) if r[c] is not None else None for c in corrections.NUMBERS}})
    want, how = {}, set()
    for song, lines in songs.items():
        made, reach = [], 0.0
        for one in lines:
            offset = corrections.trusted_offset(one)
            words = corrections.pulled_back(one, min(one["local_ms"], one["song_ms"]), reach) if offset is None else corrections.laid_over(one, offset, reach)
            reach = max([reach, *(w["end_ms"] for w in words if w["begin_ms"] is not None)])
            made.append({**one, "words": words})
            how.add(offset is not None)
        for k, one in enumerate(made):
            words = corrections.squeezed(one, made[k + 1]) if k + 1 < len(made) else one["words"]
            how.add(words is not one["words"] and "squeezed")
            want |= {(song, one["line_no"], i): (None if w["begin_ms"] is None else round(w["begin_ms"]), ",".join(w["flags"])) for i, w in enumerate(words)}
    got = {(r["song"], r["line_no"], r["word_no"]): (r["begin_ms"], r["flags"]) for r in result_queries.corrected_lines(spark, SF).collect()}
    assert set(got) == set(want) and how >= {True, False}
    assert all(got[k][1] == want[k][1] and (got[k][0] == want[k][0] or abs(got[k][0] - want[k][0]) <= 1) for k in want)


def test_mean_and_questions(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "song string, aae double")
    assert {r["song"]: r["aae"] for r in results.with_mean(scores, ("aae",)).collect()} == {"a": 1.0, "b": 2.0, "c": None, "_mean": 1.5}
    assert results.with_mean(scores.where("aae is null"), ("aae",)).count() == 1
    lines = spark.createDataFrame([("s", 0, "one"), ("s", 1, None)], "song string, line_no int, text string")
    variants = spark.createDataFrame([("s", 1, [("x", ["chosen"]), ("y", ["A", "B"])])], "song string, line_no int, options array<struct<text: string, supporters: array<string>>>")
    missing = spark.createDataFrame([("s", -1, "intro", ["A"])], "song string, after int, text string, supporters array<string>")
    assert results.review_questions(lines, variants, missing).first()["question"] == "Lines\n0: one\n1: \n\nVariants\nV1 at line 1\n  0: x [chosen]\n  1: y [A, B]\n\nMissing lines\nI1 before the first line: intro [A]"


def test_publishing_keeps_other_fields(spark):
    jobs = spark.createDataFrame([(1, "done", '{"audio":"x","sync":"old"}', "word"), (2, "done", None, "line"), (3, "failed", '{"a":"b"}', None)], "job int, status string, report string, sync string")
    checks = spark.createDataFrame([(1, 2, 9), (2, 0, 4)], "job int, flagged_words bigint, total_words bigint")
    files = spark.createDataFrame([(1, "lrc", "1.lrc")], "job int, format string, name string")
    reports, done = results.published(jobs, checks, files, F.lit(5))
    got = {r["job"]: r["report"] for r in reports.collect()}
    assert got[3] == '{"a":"b"}' and '"audio":"x"' in got[1] and '"sync":"word"' in got[1] and "old" not in got[1] and '"published":"5"' in got[2]
    assert {r["job"]: r["total_words"] for r in done.collect()} == {1: 9, 2: 4, 3: None}


def test_toggle_clears_only_marked_targets(spark):
    words = spark.createDataFrame([("s", 0, "main", 0, 0, True), ("s", 0, "main", 1, 0, True), ("s", 0, "main", 2, 1, None)], "song string, line_no int, track string, word_no int, group_no int, explicit boolean")
    picked = lambda *n: spark.createDataFrame([("s", 0, "main", k) for k in n], "song string, line_no int, track string, word_no int")
    run = lambda *n: sorted((r["word_no"], r["value"]) for r in selection.explicit_toggle(words, picked(*n)).collect())
    assert run(0) == [(0, False), (1, False)] and run(1, 2, 7) == [(0, True), (1, True), (2, True)]

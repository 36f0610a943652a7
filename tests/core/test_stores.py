"""What is stored and read again, and small rules, on odd rows."""

import json

from pyspark.sql import functions as F

from versewright.sources import stores


def test_broken_lines_are_left_out(spark, tmp_path):
    good = {"song": "s", "line_no": 0, "begin_ms": 5, "words": [{"text": "a", "begin_ms": 1}]}
    rows = [good, {**good, "line_no": "x"}, {**good, "song": None}, {**good, "line_no": 2, "other": 1}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    got = stores.load_lyrics(spark, str(tmp_path / "in")).orderBy("line_no").collect()
    assert [(r["line_no"], r["words"][0]["text"], r["background"]) for r in got] == [(0, "a", None), (2, "a", None)]
    assert stores.load_lyrics(spark, str(tmp_path / "in"), checked=False).count() == 5


def test_cache_is_used_while_it_is_newer(spark):
    wanted = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), (None, 1)], "item string, modified int")
    cache = spark.createDataFrame([("a", 5, "old"), ("a", 9, "new"), ("b", 4, "late")], "item string, made int, value string")
    fresh, again = stores.fresh_cache(wanted, cache, ("item",))
    assert [tuple(r) for r in fresh.collect()] == [("a", "new")] and {r["item"] for r in again.collect()} == {"b", "c", None}


def test_answers_and_readings(spark):
    rows = spark.createDataFrame([("de", "en"), ("en", "en"), ("DE", "en"), (None, "en"), ("de", None)], "answer string, now string")
    language, changed = stores.answered_language(F.col("answer"), F.col("now"))
    assert [tuple(r) for r in rows.select(language, changed).collect()] == [("de", True), ("en", False), ("en", False), ("en", False), ("de", True)]
    kind = "array<struct<text: string, reading: string, joiner: string>>"
    lines = spark.createDataFrame([([("a ", "x", None), ("bc ", "yz", "-"), ("d", "w", None)], [("b", "y", None), ("c ", "z", None)]), ([("a ", None, None), ("bc", "yz", None)], [("b", "y", None), ("c", "z", None)])], f"words {kind}, parts {kind}")
    text, status = stores.split_reading(F.col("words"), F.lit(1), F.col("parts"))
    assert [tuple(r) for r in lines.select(text, status).collect()] == [("x  y z  w", "confirmed"), (None, None)]


def test_payloads_reach_every_subscriber(spark):
    events = spark.createDataFrame([("j", 1, "s", "failed", "why", "m", None, None), ("j", 2, "s", None, None, "m", 0.123456, None)], "job string, seq int, stage string, status string, error string, label string, fraction double, detail string")
    to = spark.createDataFrame([("j", "a"), ("j", "b"), ("k", "c")], "job string, subscriber string")
    kind = F.when(F.col("seq") == 1, "status").otherwise("progress")
    got = sorted((r["subscriber"], r["seq"], json.loads(r["payload"])) for r in stores.payloads(events, to, kind).collect())
    assert [g[:2] for g in got] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert got[0][2] == {"type": "status", "status": "failed", "error": "why"} and got[1][2] == {"type": "progress", "stage": "s", "label": "m", "fraction": 0.1235, "detail": ""}

"""Work that grows with the input only, and results at the edges that larger tables reach."""

import datetime as dt
import difflib
import random
import time

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from versewright.operators import matches, repair, siblings
from versewright.plans import compare_queries, line_queries, match_queries, shape_queries
from versewright.sources import formats, project_ttml
from versewright.streaming import stateful


def test_closest_within_makes_no_pairs(spark, tmp_path):
    rows = [(k, f"b{k % 2}", float(k // 8)) for k in range(400)] + [(401, "b1", 4.0 - 2.0000000000000002), (402, "b1", 1e6), (403, "b1", 1e6 + 2), (404, "b1", None), (405, None, 1.0)]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = match_queries.length_join(spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(duck.sql(match_queries.SQL["length_join"]).fetchall())


def test_closest_within_at_the_very_edge(spark):
    left = spark.createDataFrame([(1, "a", 4.0)], "id bigint, b string, v double")
    right = spark.createDataFrame([(2, "a", 1.9999999999999998), (3, "a", 6.0)], "id bigint, b string, v double")  # both 2.0 away in doubles
    assert [tuple(r) for r in matches.closest_within(left, right, "b", "v", "id", 2.0).collect()] == [(1, "a", 4.0, 2, 2.0)]


def test_valid_times_of_a_song_without_any(spark, tmp_path):
    rows = [(1, 100.5), (1, 300.0), (1, 3.0), (2, 99.0), (3, None)]
    spark.createDataFrame(rows, "user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in line_queries.valid_times(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 0.5), (2, 0, None), (3, 0, None)]


def _events(spark, tmp_path, kinds):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, 11 * 15 * i + 1, kind, start + dt.timedelta(seconds=i), 1.0) for i, kind in enumerate(kinds)]  # numbers of words that put all on one track
    spark.createDataFrame(rows, "user_id bigint, event_id bigint, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")


def test_fingerprints_are_of_all_words(spark, tmp_path):
    _events(spark, tmp_path, "abcdefgh" "abcdefgh" "abcdefgx" "abcdefgh")
    found = [tuple(r) for r in match_queries.template_matches(spark, str(tmp_path)).collect()]
    assert sorted(found) == [(1, 1, 0), (1, 3, 0)]


def test_blocks_are_of_whole_lines(spark, tmp_path):
    _events(spark, tmp_path, "abcdefgh" "abcdefgx" "abcdefgh" "abcdefgh")
    assert [r["n"] for r in shape_queries.block_fingerprint(spark, str(tmp_path)).collect()] == [1, 1, 1]


def test_state_travels_with_its_rows(spark, tmp_path):
    rows = [("j", None, 1, 10**12, 0.1), ("j", "a", 2, 10**12, 0.2), ("j", None, 3, 10**12 + 1, 0.3), ("k", "a", 4, 10**12, None)]
    spark.createDataFrame(rows, "job string, bar string, seq bigint, us bigint, fraction double").withColumn("ts", F.timestamp_micros("us")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    out = stateful.throttled(stream)
    assert "TransformWithState" not in out._jdf.queryExecution().logical().toString()
    assert sorted((r["seq"], r["fraction"]) for r in stateful.run_with_state(spark, out).collect()) == [(1, 0.1), (2, 0.2), (4, None)]


def test_groups_are_read_without_lines(spark, monkeypatch):
    assert project_ttml.parse_groups('<tt><head><group id="a" label="b"/></head><body><p begin="1">x</p></body></tt>') == [{"id": "a", "label": "b", "color": project_ttml.GROUP_COLOR, "template_version": 1}]
    assert project_ttml.parse_groups("<tt>") is None


def test_lines_of_a_project_are_rendered_once(spark):
    lines = spark.createDataFrame([(1, 0, 0, 9, "la", [("de", "x", None)])], "song bigint, line_no int, begin_ms bigint, end_ms bigint, text string, translations array<struct<language: string, text: string, background: string>>")
    assert project_ttml.write_project(lines)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_documents_are_parsed_in_pieces():
    batch = pa.RecordBatch.from_pydict({"x": list(range(150))})
    assert [p.num_rows for p in formats.pieces(iter([batch, batch.slice(0, 3)]), 64)] == [64, 64, 22, 3]


def test_edits_are_replayed_without_whole_batches(spark):
    word = "array<struct<text: string, begin_ms: double, end_ms: double, explicit: boolean, syllable: string>>"
    words = lambda n: [(f"w{i}", float(i), i + 1.0, None, None) for i in range(n)]
    edits = spark.createDataFrame([(1, 0, "g", 0, words(3), words(2))], f"song bigint, line_no int, group_id string, template_line int, before {word}, after {word}")
    copies = spark.createDataFrame([(1, k, "g", 0, False, words(3)) for k in range(301)], f"song bigint, line_no int, group_id string, template_line int, detached boolean, words {word}")
    out = siblings.propagated_words(edits, copies)
    assert "MapInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["line_no"], r["how"], len(r["words"])) for r in out.collect()) == [(k, "replayed", 2) for k in range(1, 301)]


def test_versions_of_one_language_are_dealt_out(spark, tmp_path):
    spark.createDataFrame([(k, f"text {k}", "en") for k in range(40)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = compare_queries.version_decisions(spark, str(tmp_path))
    assert "_part" in df._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r["n"] for r in df.collect()) == 39


def test_blocks_of_two_word_sequences_as_difflib_in_near_linear_time():
    rng = random.Random(4)
    for _ in range(1500):
        kinds = rng.choice([1, 2, 3, 6, 40])
        a = [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        b = [x for x in a if rng.random() < 0.8] if rng.random() < 0.5 else [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        assert repair.matching_blocks(a, b) == [tuple(x) for x in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks()][:-1]
    # A long song whose transcript lacks every third word: thousands of blocks of two words, which difflib finds with a pass over the rest for each.
    ours = [(n // 80, n % 80, f"w{int(rng.paretovariate(0.6)) % 400}") for n in range(30_000)]
    heard = [(k, float(n)) for n, (_, p, k) in enumerate(ours) if p % 3 != 2]
    began = time.process_time()
    assert len(repair.first_hits(ours, heard)) > 0
    assert time.process_time() - began < 2.5

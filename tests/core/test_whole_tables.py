"""Queries without SQL on whole rows and whole songs."""

import datetime as dt
import random

import numpy as np

from versewright.operators import align
from versewright.plans import compare_queries, edit_queries


def test_long_documents_have_decisions(spark, tmp_path):
    long = "\n".join(f"line {i} says something else" for i in range(300))
    rows = [(1, "a b c d\ne f g h", "en"), (2, "a b c x\ne f g h\nnew words here", "en"), (3, long, "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["kind"]): r["n"] for r in compare_queries.version_decisions(spark, str(tmp_path)).collect()}
    assert got == {(2, "variant"): 1, (2, "insertion"): 1, (3, "insertion"): 300}


def test_every_line_meets_the_next(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, "xyz"[i // 8] if i % 2 else "k", start + dt.timedelta(seconds=i), 1.0) for i in range(24)]
    rows += [(2, 100 + i, "k", start + dt.timedelta(seconds=i), 1.0) for i in range(8)]
    spark.createDataFrame(rows, "user_id bigint, event_id bigint, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["song"], r["line_no"], r["i"], r["j"]) for r in compare_queries.lcs_pairs(spark, str(tmp_path)).collect())
    assert got == [(1, line, k, k) for line in (0, 1) for k in (0, 2, 4, 6)]


def _by_reference(keys):
    """The reference's findRepeatingStandaloneSections, step by step."""
    claimed, found, i, n = set(), [], 0, len(keys)
    whole = lambda at, k: all(keys[p] and p not in claimed for p in range(at, at + k))
    while i < n:
        best = None
        for k in range((n - i) // 2, 1, -1):
            if i in claimed or not whole(i, k):
                continue
            starts, j = [i], i + k
            while j + k <= n:
                if whole(j, k) and keys[i : i + k] == keys[j : j + k]:
                    starts.append(j)
                    j += k
                else:
                    j += 1
            if len(starts) > 1 and (best is None or len(starts) * k > len(best[0]) * best[1]):
                best = (starts, k)
        if best:
            claimed |= {p for s in best[0] for p in range(s, s + best[1])}
            found.append(best)
        i += best[1] if best else 1
    return found


def test_sections_are_the_references():
    rng = random.Random(4)
    for _ in range(400):
        keys = [rng.choice(["a", "b", "c", ""][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))]
        codes = np.array([ord(k) if k else -1 for k in keys], np.int64)
        assert align._claimed_sections(codes, codes >= 0) == _by_reference(keys), keys


def test_long_songs_keep_their_tail_and_long_repeats(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    kinds = [f"v{i}" for i in range(60)] + 2 * [f"c{i}" for i in range(20)]
    rows = [(1, i, k, start + dt.timedelta(seconds=i), 1.0) for i, k in enumerate(kinds)]
    spark.createDataFrame(rows, "user_id bigint, event_id bigint, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in edit_queries.repeating_sections(spark, str(tmp_path)).select("song", "sections", "lines").collect()]
    assert got == [(1, 1, 40)]

"""Hard negatives, substring dedup and the filter audit against brute force, and on odd rows."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versewright.llm import filter_audit, hard_negatives, substring_dedup

from .test_corpus import LONG, odd_documents

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string"


def brute_negatives(rows, anchor, positives=5, negatives=5, low=80, high=100):
    whole = [(i, v, lab, n) for n, (i, v, lab, _) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(256 * x)) for x in v], lab, n) for i, v, lab, n in whole]
    out = []
    for a, v, lab, n in whole:
        if not anchor(a):
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        others = [(score(w), i, m, other) for i, w, other, m in whole if m != n and len(w) == len(v)]
        best = sorted((x for x in others if x[3] == lab), key=lambda x: (-x[0], x[1]))[:positives]
        for p, i, _, _ in best:
            fit = sorted((x for x in others if x[3] != lab and low * p <= 100 * x[0] <= high * p), key=lambda x: (-x[0], x[1]))[:negatives]
            out += [(a, i, k, x[1], p, x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "small", "large"])
def test_hard_negatives_match_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    centres = rng.normal(size=(4, 8))
    rows = []
    for i in range(420):
        label = int(rng.integers(0, 4))
        v = centres[(label + (i % 3 == 0)) % 4] + 0.3 * rng.normal(size=8)
        v = {"clusters": v, "small": np.round(v) / 256, "large": v * 1e6}[kind]
        rows.append((i, v.tolist(), label, "x"))
    rows += [(i, rows[7][1], 1, "x") for i in range(1000, 1060)]  # many of one kind
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, slice_rows=64)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 20 == 0)


def test_score_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(50):
        q = rng.integers(-900, 900, (300, 6))
        q[:3] = 0
        axes = np.linalg.qr(rng.normal(size=(6, 6)))[0][:4]
        norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        angle = hard_negatives.angles(q / np.where(norm > 0, norm, 1)[:, None], axes)
        part = hard_negatives.Slice(np.arange(300), np.arange(300), np.array(["a"] * 300), q, angle)
        a = int(rng.integers(0, 300))
        low, high = hard_negatives.score_bounds(angle[a], norm[a], part.low, part.high, part.least, part.most)
        for k, (s, e) in enumerate(zip(part.start, part.end)):
            scores = part.q[s:e] @ q[a]
            if norm[a] > 0:
                assert low[k] <= scores.min() and scores.max() <= high[k]


def test_hard_negatives_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1, "x"), (0, [1.0, 0.0], 1, "x"), (1, None, 1, "x"), (2, [1.0, None], 1, "x"), (3, [float("nan"), 0.0], 1, "x"), (4, [0.9, 0.0], 2, "x"), (5, [1.0, 0.0, 0.0], 2, "x")]
    rows += [(None, [1.0, 0.0], 1, "x"), (6, [1.0, 0.0], None, "x"), (7, [], 3, "x"), (8, [0.0, 0.0], 2, "x"), (9, [float("inf"), 0.0], 2, "x"), (10, [1e300, 0.0], 2, "x")]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 1, 4, 65536, 58880)] * 2
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def brute_repeats(texts, window):
    words = [(t or "").split() for t in texts]
    seen: dict = {}
    for n, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((n, i))
    gone = [set() for _ in words]
    for places in seen.values():
        for n, i in places if len(places) > 1 else ():
            gone[n].update(range(i, i + window))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(words, gone)]


def planted(seed, n=60):
    rng = random.Random(seed)
    passage = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(9)) for _ in range(rng.randint(5, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.5 else " ".join(f"{rng.choice('xyz')}{rng.randrange(50)}" for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
        texts.append(" \n".join(parts))
    return texts + texts[:3] + ["z " * 90, "", None, "q"]


@pytest.mark.parametrize("window", [2, 5, 12, 35])
def test_repeats_match_brute_force(spark, window):
    texts = planted(window)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), window=window).collect()}
    want = brute_repeats(texts, window)
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) for i in range(len(texts))] == want
    for r in got.values():
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"]


def test_pieces_of_long_texts_change_nothing(spark):
    texts = planted(9, 30) + [" ".join(t or "" for t in planted(10, 40)), "w" * 900 + " x"]
    whole = [w for t in texts for p in substring_dedup.pieces((t or "").encode(), 34, 200) for w in p.words[p.lead : p.lead + p.own]]
    assert whole == [w.encode() for t in texts for w in (t or "").split()]
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), window=13, segment=200).collect()
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in sorted(got, key=lambda r: r["doc_id"])] == brute_repeats(texts, 13)


def test_repeats_on_odd_rows(spark):
    docs = odd_documents(spark).withColumnRenamed("keep", "kept").withColumn("chunk", F.lit(1))
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == 10 and sum(r["n_removed"] for r in got) == 2 * len(LONG.split())
    assert sum(r["doc_id"] is None for r in got) == 1
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    texts: dict = {}
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    fails = []
    for i, t, p in docs:
        t = t or ""
        w = t.split()
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > texts[t]}
        fails.append((p or "", {k for k, v in own.items() if v}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [f for f in fails if f[0] == part]
        total: dict = {}
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                removed = [f for f in own if x in f[1] and not f[1] & before]
                total[x] = total.get(x, 0) + len(removed)
                out[part, "".join(order), k + 1] = [sum(not f[1] & (before | {x}) for f in own), len(removed), sum(x in f[1] for f in own) - len(removed), sum(f[1] == {x} for f in own), sum(f[2] for f in removed), sum(f[3] for f in removed), x]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = total[row[6]]
    return out


def audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(docs, labels).collect()}


def test_audit_matches_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for i in range(300):
        words = [rng.choice(["Hot", "cold", "x#", "yes", f"w{rng.randrange(400)}"][: rng.randint(2, 5)]) for _ in range(rng.choice([0, 50, 199, 200, 260]))]
        docs.append((i, " ".join(words) if rng.random() < 0.9 else None, rng.choice(["s", "t", "", None])))
    docs += [(300 + i, docs[i][1], "u") for i in range(60)] + [(None, docs[1][1], "u"), (5, docs[5][1], "t")]
    labels = [(rng.randrange(320), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(200)] + [(None, 1, 1)]
    got = audited(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got == brute_audit(docs, labels)


def test_audit_on_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = odd_documents(spark).withColumn("failed", F.lit(1)).withColumn("part", F.lit("z"))
    got = audited(docs, labels)
    assert len(got) == 600 * 2 and got["s", "ABCDE", 1][0] == 2
    assert audited(docs.limit(0), labels) == {}


def test_positional_popcounts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 1000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert filter_audit.positional_popcounts(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_query_digests(spark):
    from versewright.llm.queries import queries

    rows = queries()["op12_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(texts)
    want = brute_repeats([texts[i] for i in ids], 35)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert [got[i] for i in ids] == [(n, k, hashlib.sha256(t.encode()).hexdigest()) for n, k, t in want]

"""The pipeline's near-dedup links by SimHash and by similarity."""

import numpy as np

import corpus_pipeline
from versewright.llm import simhash
from versewright.llm.common import frozen


def test_near_stage_links_by_simhash(spark):
    body = "one two three four five " * 200  # five shingles decide every bit; the sets are unlike
    tails = [" ".join(f"{c}{i}" for i in range(12)) for c in "ab"]
    rows = [(1, body + tails[0]), (2, body + tails[1]), (3, "something else that is no copy of the others at all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline._near(spark, docs, "").collect()) == [1, 3]


def test_ball_rows_give_their_fingerprints_back():
    rng = np.random.default_rng(3)
    values = np.concatenate((rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, 1, 1 << 63, (1 << 64) - 1, 1 << 42, 1 << 21], np.uint64)))
    keys, owner = simhash._variants(values)
    rests = simhash._rests(values)
    assert rests.dtype == np.int32 and (rests >= 0).all()
    assert (simhash._restored(keys, rests) == values[owner]).all()


def test_band_rows_are_two_numbers_and_joins_do_not_depend_on_size(spark, monkeypatch):
    """What is stored of a band's rows, and which joins meet them, is the same for a table of any size."""
    plans, widths = [], []

    def stored(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        widths.append(df.columns)
        return frozen(df)

    monkeypatch.setattr(simhash, "frozen", stored)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[1:])), (3, "some other text of a few words")], "doc_id bigint, text string")
    assert sorted(r["component_id"] for r in simhash.near_components(docs).collect()) == [1, 1, 3]
    met = [p for p, c in zip(plans, widths) if c == ["band", "fp", "head"]]
    sets = [p for p, c in zip(plans, widths) if c == ["fp", "size", "bands", "hashes"]]
    assert len(met) == len(sets) == 1
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in met + sets)

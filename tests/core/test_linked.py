"""Similar lines, replayed edits and disguised terms against brute force and by hand."""

import difflib
import random
import re

import pytest

from versewright.operators import siblings, similar, terms
from versewright.plans import linked_queries

SF = "/root/testdata/sf0.001"


def alike(a, b):
    return a == b or difflib.SequenceMatcher(a=a, b=b).ratio() >= 0.6


def test_similar_lines_match_nested_loops(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
    lines = [(s, n, make()) for s in range(3) for n in range(12)]
    others = [(s, v, n, make() if rng.random() < 0.6 else lines[rng.randrange(36)][2][: rng.randint(1, 30)]) for s in range(4) for v in "xy" for n in range(10)]
    lines += [(0, 50, None), (0, 51, "aaa"), (0, 52, "aaab" * 90)]
    others += [(0, "z", 0, ""), (0, "z", 1, "aaaaaaa"), (0, "z", 2, "b" + "aaab" * 90)]
    a, b = spark.createDataFrame(lines, "song int, line_no int, key string"), spark.createDataFrame(others, "song int, version string, line_no int, key string")
    got = {tuple(r) for r in similar.similar_lines(a, b).collect()}
    want = {(s, v, n) for s, n, k in lines for v in "xyz" if any(alike(k or "", o) for t, w, _, o in others if (t, w) == (s, v))}
    assert got == want and len(got) > 10
    shares = {(r["song"], r["version"]): r["hits"] for r in similar.structure_match(a, b).collect()}
    assert shares[0, "x"] == len([1 for s, v, _ in want if (s, v) == (0, "x")]) and (3, "x") not in shares


def test_similar_lines_query(spark):
    a, b = linked_queries._versions(spark, SF)
    versions: dict = {}
    for r in b.collect():
        versions.setdefault((r["song"], r["version"]), []).append(r["key"])
    want = set()
    for r in a.collect():
        want |= {(s, v, r["line_no"]) for (s, v), keys in versions.items() if s == r["song"] and any(alike(r["key"], k) for k in keys)}
    assert {(r["song"], r["version"], r["line_no"]) for r in linked_queries.similar_lines(spark, SF).collect()} == want


def word(text, begin, end, explicit=None, syllable=None):
    return {"text": text, "begin_ms": float(begin), "end_ms": float(end), "explicit": explicit, "syllable": syllable}


def brief(words):
    return [(w["text"], round(w["begin_ms"], 3), round(w["end_ms"], 3)) for w in words]


BEFORE = [word("one ", 0, 100), word("two ", 100, 300), word("three", 300, 400)]
COPY = [word("one ", 1000, 1200), word("two ", 1300, 1700, syllable="g"), word("three", 1800, 2000, True)]


def test_replay_keeps_the_times_of_unchanged_words():
    cut = [BEFORE[0], word("tw", 100, 150), word("o ", 150, 300), BEFORE[2]]
    assert brief(siblings.replayed(cut, BEFORE, COPY)) == [("one ", 1000, 1200), ("tw", 1300, 1400), ("o ", 1400, 1700), ("three", 1800, 2000)]
    assert brief(siblings.replayed([BEFORE[0], BEFORE[2]], BEFORE, COPY)) == [("one ", 1000, 1200), ("three", 1800, 2000)]
    more = [*BEFORE, word("four", 400, 500)]
    assert brief(siblings.replayed(more, BEFORE, COPY))[3] == ("four", 2000, 2000)  # no room behind
    front = [word("a ", 0, 0), word("b ", 0, 0), *BEFORE]
    assert brief(siblings.replayed(front, BEFORE, COPY))[:2] == [("a ", 0, 500), ("b ", 500, 1000)]
    gap = [BEFORE[0], word("x ", 100, 100), *BEFORE[1:]]
    made = siblings.replayed(gap, BEFORE, COPY)
    assert brief(made)[1] == ("x ", 1200, 1300) and made[1]["syllable"] is None and made[2]["syllable"] == "g" and made[3]["explicit"] is None
    assert siblings.replayed([], BEFORE, COPY) == []


def test_other_copies_are_scaled():
    two = [word("one ", 1000, 1500), word("all", 1500, 2000)]
    assert brief(siblings.replayed([BEFORE[0], BEFORE[2]], BEFORE, two)) == [("one ", 1000, 1250), ("three", 1750, 2000)]
    assert siblings.replayed([word("x", 5, 5)], BEFORE, two) is None and siblings.in_proportion([], two) is None


@pytest.mark.parametrize("seed", range(30))
def test_kept_words_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
    kept = siblings.kept_words(a, b)
    pairs = sorted(kept.items())
    assert all(a[i] == b[j] for j, i in pairs) and all(x < y for (_, x), (_, y) in zip(pairs, pairs[1:]))

    def longest(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + longest(i + 1, j + 1) if a[i] == b[j] else max(longest(i + 1, j), longest(i, j + 1))

    assert len(kept) == longest(0, 0)


def test_propagation_in_spark(spark):
    lines = linked_queries._copies(spark, SF)
    edits = linked_queries._edits(lines)
    got = {(r["song"], r["line_no"], r["source"]): r for r in siblings.propagated_words(edits, lines).collect()}
    copies = [r.asDict(True) for r in lines.collect()]
    changed = 0
    for e in (r.asDict(True) for r in edits.collect()):
        for c in copies:
            if (c["song"], c["template_line"]) != (e["song"], e["template_line"]) or c["group_id"] is None or c["line_no"] == e["line_no"] or c["detached"]:
                continue
            row = got.get((c["song"], c["line_no"], e["line_no"]))
            if len(e["before"]) == len(e["after"]):
                same = len(c["words"]) == len(e["after"]) and any(x["text"] != y["text"] for x, y in zip(c["words"], e["after"]))
                assert (row is not None) == same and (not same or ([w["text"] for w in row["words"]] == [w["text"] for w in e["after"]] and [w["begin_ms"] for w in row["words"]] == [w["begin_ms"] for w in c["words"]]))
            else:
                want = siblings.replayed(e["after"], e["before"], c["words"])
                assert brief(w.asDict() for w in row["words"]) == brief(want)
                assert row["retimed"] == (not siblings.same_words(want, siblings.in_proportion(e["after"], c["words"])))
            changed += row is not None
    assert changed == len(got) > 30
    choices = {tuple(r) for r in siblings.divergent_edits(edits, lines).collect()}
    assert choices == {(r["song"], r["source"]) for r in got.values() if r["retimed"]}


def test_folding():
    assert terms.folded("ÉCOLE $1LLY")[0] == "ecole silly"
    plain, at = terms.folded("aaabbbB!")
    assert plain == "abbi" and at == [0, 3, 4, 7]


def naive(words, listed):
    text = " ".join(words)
    plain, at = terms.folded(text)
    out = set()
    for term in listed:
        word = terms.folded(term.strip("|"))[0]
        for m in re.finditer(f"(?={re.escape(word)})", plain) if word else ():
            i, j = m.start(), m.start() + len(word)
            if term[0] == "|" and i and plain[i - 1].isalnum() or term[-1] == "|" and j < len(plain) and plain[j].isalnum() or text[at[i]] == " ":
                continue
            out.add(text[: at[i]].count(" "))
    return sorted(out)


def test_automaton_matches_naive_search():
    rng = random.Random(3)
    for _ in range(300):
        listed = ["".join(rng.choice("abo ") for _ in range(rng.randint(1, 4))).strip() or "a" for _ in range(rng.randint(1, 6))]
        listed = [rng.choice(["", "|"]) + t + rng.choice(["", "|"]) for t in listed]
        words = ["".join(rng.choice("aAb0o@é") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 5))]
        assert terms.words_hit(words, terms.Automaton(listed)) == naive(words, listed)


def test_term_queries(spark):
    rows = linked_queries._disguised(spark, SF).collect()
    listed = [r["term"] for r in linked_queries._terms(spark, SF).collect()]
    want = {(r["song"], r["line_no"], k) for r in rows for k in naive((r["text"] or "").split(), listed)}
    got = linked_queries.disguised_terms(spark, SF).collect()
    assert {(r["song"], r["line_no"], r["word_at"]) for r in got} == want and len(got) == len(want) > 10
    rolled = linked_queries.term_suggestions(spark, SF).collect()
    assert sum(r["copies"] for r in rolled) == len(want)


def test_suggestions_by_template_line(spark):
    rows = [("s", 3, "g", 0, 1, False, "words", 2, "Oh!"), ("s", 9, "g", 0, 0, False, "words", 2, "oh"), ("s", 11, "g", 0, 2, True, "words", 2, "oh"), ("s", 5, "g", 1, 1, False, "words", 0, "hm"), ("s", 7, None, None, None, None, "words", 0, "hm"), ("t", 9, "g", 0, 0, False, "words", 2, "oh")]
    hits = spark.createDataFrame(rows, "song string, line_no int, group_id string, template_line int, instance int, detached boolean, field string, word_at int, word string")
    got = sorted((r["song"], r["fingerprint"], r["line_no"], r["copies"]) for r in terms.suggestions(hits).collect())
    assert got == [("s", "11:words:2:oh", 11, 1), ("s", "5:words:0:hm", 5, 1), ("s", "7:words:0:hm", 7, 1), ("s", "group:g:0:words:2:oh", 9, 2), ("t", "9:words:2:oh", 9, 1)]


def test_marked_words_and_bound(spark, monkeypatch):
    lines = spark.createDataFrame([(0, "so bad bad", [1]), (1, None, None)], "line_no int, text string, known array<int>")
    listed = spark.createDataFrame([("bad",), (None,)], "term string")
    assert [(r["line_no"], r["word_at"]) for r in terms.term_hits(lines, listed, marked="known").collect()] == [(0, 2)]
    monkeypatch.setattr(terms, "MOST_TERMS", 0)
    with pytest.raises(ValueError):
        terms.term_hits(lines, listed)




def test_block_search_is_for_pairs_within_the_common_subsequence():
    """Two texts of the same letters in another order share no long subsequence; their blocks aren't searched."""

    class Counting(difflib.SequenceMatcher):
        searched = 0

        def ratio(self):
            Counting.searched += 1
            return super().ratio()

    text = "abcdefghijklmnop qrstuvwxyz" * 4
    assert not similar.ratio_at_least(Counting(), text, text[::-1], 0.6) and Counting.searched == 0
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30))) for _ in "ab")
        if rng.random() < 0.3:
            b = a[rng.randint(0, 5) :] + b[:5]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similar.common_length(similar.places(a), len(a), b) == table[-1][-1]
        if a or b:
            assert similar.ratio_at_least(difflib.SequenceMatcher(), a, b, 0.6) == (a == b or difflib.SequenceMatcher(a=a, b=b).ratio() >= 0.6)

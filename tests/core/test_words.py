"""Numbers in words, readings over syllables, sung syllables and moved words."""

import random

import pytest

from versewright.functions import numbers
from versewright.operators import readings, sung, tracks
from versewright.plans import track_queries

SF = "/root/testdata/sf0.001"


def naive_english(n):
    """Groups of three digits from the left, each read on its own."""
    if n == 0:
        return "zero"
    small = numbers.EN
    groups = [int(g) for g in f"{n:,}".split(",")]
    out = []
    for k, g in enumerate(groups):
        words = []
        if g >= 100:
            words.append(f"{small[g // 100]} hundred")
        if rest := g % 100:
            text = small[rest] if rest < 20 else numbers.EN_TENS[rest // 10 - 2] + ("-" + small[rest % 10] if rest % 10 else "")
            words.append(("and " if words or (k == len(groups) - 1 and k and g < 100) else "") + text)
        if words:
            out.append(" ".join(words) + ["", " thousand", " million", " billion"][len(groups) - 1 - k])
    text = ", ".join(out)
    return text.replace(", and ", " and ")


def naive_german(n):
    ones = lambda x: "ein" if x == 1 else numbers.DE[x]

    def hundreds(g, final):
        out = ones(g // 100) + "hundert" if g > 99 else ""
        rest = g % 100
        if rest == 1:
            return out + ("eins" if final else "ein")
        if rest < 20:
            return out + (numbers.DE[rest] if rest else "")
        return out + (ones(rest % 10) + "und" if rest % 10 else "") + numbers.DE_TENS[rest // 10 - 2]

    thousands, rest = divmod(n, 1000)
    text = (hundreds(thousands, False) + "tausend" if thousands else "") + hundreds(rest, True)
    return text[3:] if text.startswith(("einhundert", "eintausend")) else text or "null"



@pytest.mark.parametrize(("language", "naive"), [("en", naive_english), ("de", naive_german)])
def test_every_number_below_a_million(language, naive):
    assert all(numbers.spelled(n, language) == naive(n) for n in range(10**6))


@pytest.mark.parametrize("language", ["fr", "es"])
def test_every_number_below_a_million_from_its_thousands(language):
    """Thousands and rest are read alone and joined; readings differ."""
    fr = language == "fr"
    rest = [numbers.spelled(n, language) for n in range(1000)]
    cut = [numbers.SPELLERS[language](n, False) for n in range(1000)]
    seen = set()
    for n in range(10**6):
        t, r = divmod(n, 1000)
        want = " ".join(x for x in ("" if not t else ("mille" if fr else "mil") if t == 1 else f"{cut[t]} {'mille' if fr else 'mil'}", rest[r] if r or not t else "") if x)
        got = numbers.spelled(n, language)
        assert got == want
        seen.add(got)
    assert len(seen) == 10**6


@pytest.mark.parametrize(
    ("n", "language", "words"),
    [
        (187, "de", "hundertsiebenundachtzig"), (21, "de-AT", "einundzwanzig"), (1101, "de", "tausendeinhunderteins"), (2_000_001, "de", "zwei Millionen eins"), (10**9, "de", "eine Milliarde"),
        (1_234_056, "en", "one million, two hundred and thirty-four thousand and fifty-six"), (71, "fr", "soixante et onze"), (80, "fr", "quatre-vingts"), (91, "fr", "quatre-vingt-onze"), (80_000, "fr", "quatre-vingt mille"),
        (200, "fr", "deux cents"), (2_201_000, "fr", "deux millions deux cent un mille"), (100, "es", "cien"), (101, "es", "ciento uno"), (21_001, "es", "veintiún mil uno"), (555, "es", "quinientos cincuenta y cinco"),
        (31_000_000, "es", "treinta y un millones"), (5, "xx", "five"), (10**12, "en", "one zero zero zero zero zero zero zero zero zero zero zero zero"),
    ],
)
def test_known_numbers(n, language, words):
    assert numbers.spelled(n, language) == words


def test_letters_of_an_aligner():
    assert numbers.normalised("Größe", "de") == "grosse" and numbers.normalised("187!", "de") == "hundertsiebenundachtzig"
    assert numbers.normalised("R&B", "en") == "randb" and numbers.normalised("Щука", "ru") == "shchuka" and numbers.normalised("don’t", "en") == "don't"
    assert numbers.normalised("1" * 40, "en") == "one" * 40 and numbers.normalised("漢", "zh") == ""


def test_number_queries(spark):
    rows = track_queries.number_spelling(spark, SF).collect()
    assert rows and all(r["words"] == numbers.spelled(r["o_orderkey"], r["language"]) for r in rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words: dict = {}
    for r in docs:
        words.setdefault(r["lang"], set()).update((r["text"] or "").replace("\x0b", " ").split() if r["text"] is not None else ())
    got = {r["lang"]: r for r in track_queries.alignment_text(spark, SF).collect()}
    for lang, own in words.items():
        if own:
            spelled = [numbers.normalised(w, lang or "en") for w in own]
            assert abs(got[lang]["words"] - len(own)) <= 2 and got[lang]["letters"] == sum(map(len, spelled))


def reading(words, raw):
    done, status = readings.planned([{"text": w, "reading": None, "joiner": None} for w in words], raw)
    return [w["reading"] for w in done], [w["joiner"] for w in done], status


def test_readings_follow_separators_or_letters():
    assert reading(["東", "京 ", "駅"], "tou kyou  eki") == (["tou", "kyou", "eki"], [" ", "  ", None], "inferred")
    assert reading(["a", "b ", "c"], "ab-cd  e") == (["ab", "cd", "e"], ["-", "  ", None], "inferred")
    assert reading(["aa", "bbbb"], "xxyyyy") == (["xx", "yyyy"], ["", None], "needs-review")
    assert reading(["a ", "b"], "one two") == (["one", "two"], [" ", None], "needs-review")
    assert reading(["a", "b", "c"], "é") == ([None] * 3, [None] * 3, "unresolved")
    assert reading(["a"], "  ") == ([None], [None], "confirmed")
    assert reading([], "x") == ([], [], "confirmed")
    assert reading(["a", "b"], "éx")[0] == ["é", "x"]  # a letter and its mark stay together
    done = [{"text": "a ", "reading": "x", "joiner": None}, {"text": "b", "reading": "y", "joiner": None}]
    assert readings.planned(done, "x   y") == (done, "confirmed")
    assert readings.timed_part("a b c", [{"text": "a "}, {"text": "b"}], "x  y  z") == "x  y" and readings.timed_part("a b", [{"text": "a"}], "x y z") == "x y z"


@pytest.mark.parametrize("seed", range(40))
def test_parts_and_joiners_make_the_reading_again(seed):
    rng = random.Random(seed)
    text = readings.visible("".join(rng.choice("abcé-  ‐ ") for _ in range(rng.randint(3, 25))))
    weights = [rng.randint(0, 4) for _ in range(rng.randint(1, 5))]
    found = readings.boundaries(text, weights)
    if found is None:
        return
    cuts, exact = found
    assert len(cuts) == len(weights) - 1 and cuts == sorted(cuts)
    parts = readings.sliced(text, cuts)
    assert len(parts) == len(weights)
    core = "".join(p.text + (p.joiner or "") for p in parts)
    assert core in text and all(p.text == p.text.strip(" -‐") for p in parts)
    if exact and len(weights) > 1:
        assert all(p.text for p in parts[1:])


def test_reading_query(spark):
    rows = track_queries.align_readings(spark, SF).collect()
    by = {s: [r for r in rows if r["status"] == s] for s in {r["status"] for r in rows}}
    assert set(by) == {None, "inferred", "needs-review", "unresolved"} and all(r["song"] % 9 == 0 for r in by[None])
    assert all(r["line_no"] % 4 in (0, 1) or "|" not in r["parts"] for r in by["inferred"])


def test_written_syllables():
    assert [sung.written_syllables(w) for w in ("sleeping ", "wanting", "criminal", "singing", "kicking", "machen", "fire", "go", "two words", "yoyo", "étude")] == [
        ["slee", "ping "], ["wan", "ting"], ["cri", "mi", "nal"], ["sing", "ing"], ["kick", "ing"], ["ma", "chen"], ["fi", "re"], ["go"], ["two words"], ["yoyo"], ["é", "tu", "de"]]


def test_sung_syllables_open_before_their_vowel():
    sounds = ["b", "j", "uː", "t", "ɪ", "f", "ʊ", "l"]
    begins = [1000 + 500 * i for i in range(8)]
    assert sung.timed_syllables("beautiful ", 1000, 5000, sounds, begins) == [("beau", 1000, 2500), ("ti", 2500, 3500), ("ful ", 3500, 5000)]
    assert sung.timed_syllables("beautiful", 1000, 3520, sounds, begins)[0][0] == "beautiful"  # a piece of 20 ms
    assert sung.timed_syllables("beautiful", 1000, 5000, sounds[:4], begins[:4]) == [("beautiful", 1000, 5000)]
    assert sung.timed_syllables("SSIO", 0, 900, ["ɛ", "s", "j", "o"], [0, 100, 300, 500]) == [("SS", 0, 300), ("IO", 300, 900)]
    assert sung.timed_syllables("mama", 0, 400, list("mama"), [0, 100, 200, 300], phonemes=False) == [("ma", 0, 200), ("ma", 200, 400)]
    assert sung.timed_syllables("mama", None, 400, list("mama"), [0, 1, 2, 3]) == [("mama", None, 400)]


def test_sung_query(spark):
    rows: dict = {}
    for r in track_queries.sung_syllables(spark, SF).orderBy("word_id", "part_no").collect():
        rows.setdefault(r["word_id"], []).append(r)
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        own = rows[r["event_id"]]
        assert "".join(p["part"] for p in own).lower() == r["event_type"] and all(a["end_ms"] == b["begin_ms"] for a, b in zip(own, own[1:]))
        assert len(own) == 1 or min(p["end_ms"] - p["begin_ms"] for p in own) >= 40
    assert any(len(v) > 1 for v in rows.values())


def test_moved_words_push_what_follows(spark):
    rows = [("s", 0, "main", k, t, b, e, g) for k, (t, b, e, g) in enumerate([("a ", 0, 100, None), ("b", 100, 200, "x"), ("c ", 200, 300, "x"), ("d ", 300, 400, None), ("e", 400, 500, None)])]
    words = spark.createDataFrame(rows, "song string, line_no int, track string, word_no int, text string, begin_ms bigint, end_ms bigint, syllable string")
    from pyspark.sql import functions as F

    got = tracks.reordered(words, F.col("syllable") == "x", F.lit(250), F.lit(520)).orderBy("word_no").collect()
    assert [(r["text"], r["begin_ms"], r["end_ms"], r["syllable"]) for r in got] == [("a ", 0, 100, None), ("d ", 300, 400, None), ("b", 400, 500, "new x"), ("c ", 500, 600, "new x"), ("e", 420, 520, None)]
    clip = spark.createDataFrame([("s", 1, 0, 1000, 5000, 0, "main", 0, "x", 0, 100, None), ("s", 2, 0, 0, 5000, 7, "main", 0, "y", 0, 100, None)], "song string, paste int, target_line int, delta_ms bigint, duration_ms bigint, line_offset int, track string, word_no int, text string, begin_ms bigint, end_ms bigint, syllable string")
    targets = tracks.paste_targets(clip, words.select("song", "line_no"))
    assert [r["text"] for r in tracks.pasted(words, targets).orderBy("word_no").collect()] == ["a ", "b", "c ", "d ", "e ", "x"]
    assert {r["paste"]: r["overlaps"] for r in tracks.paste_overlaps(targets, words).collect()} == {1: False, 2: True}

"""Each corpus operator against a brute-force version, and its defined results on odd rows."""

import hashlib
import random
import time
import zlib
from xml.etree import ElementTree

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from versewright.llm import bpe, embedding_dedup, exact_dedup, html_extract, language_id, line_dedup, packing, sharding, simhash, url_filter
from versewright.llm.components import connected_components
from versewright.llm.queries import queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, row_id int, keep string"
LONG = "one two, three. " * 4000


def odd_documents(spark):
    rows = [
        (1, "a b c d e f g", "en", "s", 1, "x", 1, "y"),
        (2, None, "en", None, None, None, None, None),
        (3, "", None, "s", 0, "x", 1, "y"),
        (None, "a b c d e f g", "en", "s", 1, "x", 1, "y"),
        (4, LONG, "en", "s", 1, "x", 1, "y"),
        (4, LONG, "en", "s", 1, "x", 1, "y"),
        (5, "A  B\tc d\ne f g", "fr", "s", 1, "x", 1, "y"),
        (6, " \n\t ", "fr", "s", 1, "x", 1, "y"),
        (7, "12345 !!", "fr", "s", 1, "x", 1, "y"),
        (8, "x<|endoftext|>\x1cy é́ ퟿", "fr", "s", 1, "x", 1, "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def settled(n, pairs):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        i, j = sorted((top(i), top(j)))
        up[j] = i
    return [top(i) for i in range(n)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 100), (1, 0)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs + [(None, 3)], "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_simhash_matches_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(6)]
    texts = [None, "", "One", "one TWO", "x y z"] + base
    for t in base:
        for _ in range(8):
            w = t.split()
            w[rng.randrange(len(w))] = "q"
            texts.append(" \n".join(w))
    got = {r["doc_id"]: r for r in simhash.simhash_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}

    def mark(text):
        words = (text or "").lower().split()
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [mark(t) for t in texts]
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == marks
    close = [(i, j) for i in range(len(texts)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
    assert [got[i]["component_id"] for i in range(len(texts))] == settled(len(texts), close)


@pytest.mark.parametrize("dense", [False, True])
def test_ball_links_are_exact(dense):
    rng = random.Random(dense)
    centre, marks = rng.getrandbits(64), set()
    for _ in range(700):
        x = centre if dense else rng.getrandbits(64) if rng.random() < 0.2 else centre
        for _ in range(rng.randint(1, 3 if dense else 6)):
            x ^= 1 << rng.randrange(21 if dense else 64)
        marks.add(x)
    values = np.array(sorted(marks), np.uint64)
    keys, owner = simhash._variants(values)
    order = np.argsort(keys, kind="stable")
    a, b = simhash._links(keys[order], values[owner[order]])
    place = {x: i for i, x in enumerate(values.tolist())}
    found = [(place[x % 2**64], place[y % 2**64]) for x, y in zip(a.tolist(), b.tolist())]
    i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3, 1))
    assert settled(len(values), found) == settled(len(values), zip(i.tolist(), j.tolist()))


def test_near_duplicates_of_wanted_similarity(spark):
    rng = random.Random(8)
    rows = []
    for group in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows.append((group * 10, " ".join(base)))
        for copy in range(1, 4):
            w = list(base)
            for _ in range(4):
                w[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
            rows.append((group * 10 + copy, " ".join(w)))
    rows += [(1000 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(400))) for i in range(60)]
    left = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {1000 + i for i in range(60)} <= left and {g * 10 for g in range(30)} <= left
    assert len(left) <= 90 + 4


def test_flood_keeps_components():
    rng = random.Random(2)
    values = np.array(sorted({rng.getrandbits(9) | rng.getrandbits(2) << 40 for _ in range(150)}), np.uint64)
    a, b = simhash._flood(values, 1)
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) == 1)
    assert settled(len(values), zip(a.tolist(), b.tolist())) == settled(len(values), zip(i.tolist(), j.tolist()))
    assert len(a) < len(values)


def test_keep_one_keeps_columns(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert (False, 1) in ids and (False, 4) in ids and (True, None) not in ids and len(ids) == len(set(ids))
    assert (False, 2) in ids and (False, 3) not in ids and (False, 6) not in ids


def test_exact_duplicates_of_long_texts(spark):
    base = "Ünï word " * 6000
    rows = [(1, base), (2, base + " "), (3, base[:-3] + "X" + base[-2:]), (4, base.replace(" ", "\t")), (5, "x"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(exact_dedup.exact_duplicates(docs).collect(), key=lambda r: r["doc_id"])
    spread = sorted(exact_dedup.exact_duplicates(docs, spread=1000).collect(), key=lambda r: r["doc_id"])
    assert whole == spread and [r["keep_id"] for r in whole] == [2, 2, 3, 2, 5, 6]
    keyed = docs.withColumn("key", F.col("doc_id").cast("string"))
    short = {r["key"]: r["poly"] for r in exact_dedup.text_fingerprints(keyed).collect()}
    long = {r["key"]: r["poly"] for r in exact_dedup.spread_fingerprints(keyed, 1000).collect()}
    assert len(long) == 4 and all(short[k] == v for k, v in long.items())


def test_one_very_long_text(spark):
    long = spark.createDataFrame([(1,), (2,)], "doc_id bigint").select("doc_id", F.expr("concat(repeat('a long text, word by word. ', 1900000), if(doc_id = 1, '', ' '))").alias("text"))
    rows = exact_dedup.exact_duplicates(long).collect()
    assert [r["keep_id"] for r in rows] == [2, 2] and rows[0]["group_size"] == 2


def test_exact_duplicates(spark):
    chunked = "z" * (exact_dedup.COMPARED + 5)
    rows = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (None, "ab  "), (7, chunked), (8, chunked + " "), (9, chunked[:-1] + "y"), (3, "a\tb ")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [by[i][0]["keep_id"] for i in (1, 2, 4, 5, 7, 8, 9)] == [3, 3, 4, 4, 8, 8, 9]
    assert by[None][0]["keep_id"] == 3 and by[1][0]["group_size"] == 5
    assert sorted(r["kept"] for r in by[3]) == [False, True]
    assert by[2][0]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()


def test_exact_duplicates_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b")] * 60 + [(2, "ab")] * 40 + [(3, "c")] * 2, "doc_id bigint, text string")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == 102 and {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(1, 1, 100), (2, 1, 100), (3, 3, 2)}
    assert [(r["doc_id"], r["kept"]) for r in got if r["kept"]] in ([(1, True), (3, True)], [(3, True), (1, True)])


def test_fingerprints_compose():
    data = bytes(random.Random(1).randbytes(3 * exact_dedup.CHUNK + 77))
    whole = exact_dedup.combine(exact_dedup.chunk_hashes(data))
    assert whole == exact_dedup.combine(exact_dedup.chunk_hashes(data, 1000))
    slow = [0, 0]
    for x in data[:5000]:
        slow = [(h * b + x) % p for h, b, p in zip(slow, exact_dedup.BASES, exact_dedup.PRIMES)]
    assert exact_dedup.combine(exact_dedup.chunk_hashes(data[:5000], 999)) == slow[0] << 31 | slow[1]


def test_chunk_rows_combine_in_sql(spark):
    data = bytes(random.Random(2).randbytes(5000))
    rows = []
    for k, (size, hashes) in enumerate(exact_dedup.chunk_hashes(data, 700)):
        rows.append((1, k, size, *hashes, *[pow(b, size, p) for b, p in zip(exact_dedup.BASES, exact_dedup.PRIMES)]))
    got = exact_dedup.combine_chunks(spark.createDataFrame(rows, "doc_id int, chunk_no int, size bigint, h1 bigint, h2 bigint, s1 bigint, s2 bigint")).first()
    assert (got["n_bytes"], got["poly"]) == (5000, exact_dedup.combine(exact_dedup.chunk_hashes(data)))


def test_collisions_form_their_own_class(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "combine", lambda parts: 7)
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "a a"), (4, "b b")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert {k: (r["keep_id"], r["group_size"]) for k, r in got.items()} == {1: (3, 2), 2: (4, 2), 3: (3, 2), 4: (4, 2)}


def brute_rule(host, path, rules):
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else ("allow", None)


def test_url_rules(spark):
    rng = random.Random(2)
    hosts = ["net", "a.net", "example.net", "b.example.net", "example-x.net", "xexample.net", "org", "c.org", ""]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/fr/a", "/fr"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:7] for p in ("/", "/en/", "", "/fr/") if rng.random() < 0.6]
    urls = [None, "nothing", "http://"] + [f"http{rng.choice(['', 's'])}://{h.upper() if rng.random() < 0.3 else h}{p}{rng.choice(['', '?a=/en/', '#://x/'])}" for h in hosts for p in paths for _ in range(3)]
    rules += [("deep.org", "/" + "a/" * k, rng.choice(["allow", "block"])) for k in range(30)] + [("org", "/a\x01", "block"), ("n\x01et", "/", "block"), (None, "/", "block"), ("", "/", "block")]
    urls += [f"http://{h}/" + "a/" * rng.randrange(32) + "b" for h in ("deep.org", "x.deep.org") for _ in range(60)]
    urls += ["http://org/a\x01b", "http://n\x01et/", "http://n/", "http://x.n\x01et/q", "http://net./", "http://.net/"]
    urls += ["http://a.net/en/x"] * 60
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = url_filter.judge(pages, url_filter.rules_table(spark, rules), ranges=7).collect()
    assert len(got) == len(urls)
    for r in got:
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = rest[: next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))]
        path = rest[len(host) :]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
        assert (r["host"], r["path"]) == (host.lower(), path)
        assert (r["verdict"], r["rule"]) == brute_rule(host.lower(), path, rules), url
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rules_table(spark, [])).collect()} == {"allow"}


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Top, of, all, pages here now</header>
<nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav><div class="cookie-notice">We use cookies, so many, that it hurts.</div>
<div id="content"><h1>Head &amp; tail</h1><p>First paragraph, with <b>bold,
 wrapped</b> words &eacute;, long enough.<p>Second   paragraph, also fairly long, with commas.</p><div class="ad">Buy this, now, it is really cheap today</div>
<ul><li>An item that belongs to it</li></ul></div><div class="comments"><p>I think, as a reader, this is a fine article indeed.</p></div>
<form><p>Your name, your mail, your message, please</p></form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "Head & tail\nFirst paragraph, with bold, wrapped words é, long enough.\nSecond paragraph, also fairly long, with commas.\nAn item that belongs to it"
    assert html_extract.main_text(PAGE) == want
    prose = "A long paragraph of prose, with commas, and with words enough to be the article of its page, on and on."
    page = f"<body><article><p>{prose}</p><p class='side-effects'>Drowsiness, thirst and a dry mouth, as with others.</p><div class='search-results'>Forty were found, of which ten were read in full.</div><div class='side-bar'>Elsewhere on this site, today.</div></article></body>"
    assert html_extract.main_text(page) == f"{prose}\nDrowsiness, thirst and a dry mouth, as with others.\nForty were found, of which ten were read in full."
    assert html_extract.main_text(f"<body><article><p>{prose}</p></article><article><p>Second {prose}</p></article><article><a href='/'>More</a></article></body>") == f"{prose}\nSecond {prose}"
    began = time.process_time()
    for deep in ("<div>", "<div><p>x", "<section>text <b>", "<ul><li>"):
        html_extract.main_text(deep * 100_000)
    assert time.process_time() - began < 20
    for odd in ("", "<", "<p", "<!-- x", "<script>x", "</div></p>", "<p><p>"):
        assert html_extract.main_text(odd).strip("<") == ""
    assert html_extract.main_text("plain words") == "plain words"
    assert html_extract.main_text("<p>short</p>") == "short"
    deep = "<div>" * 3000 + "<p>Deep text, that is long enough to count.</p>" + "</div>" * 3000
    assert html_extract.main_text(deep) == "Deep text, that is long enough to count."
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 3), (None, "u", "", 3)], "page_id int, url string, html string, text int")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert (got[1]["text"], got[1]["n_chars"], got[2]["text"], got[None]["n_chars"]) == (want, len(want), "", 0)


def naive_main_text(page):
    """The tree scoring of well-formed pages without classes, by its definition on a parsed tree."""
    root = ElementTree.fromstring(page)
    above = {c: n for n in root.iter() for c in n}
    order = list(root.iter())
    leaves = [n for n in order if n.tag in ("p", "li")]
    words = {n: " ".join("".join(n.itertext()).split()) for n in leaves}
    bare = lambda t: len("".join(t.split()))
    linked = {n: sum(bare("".join(a.itertext())) for a in n.iter("a")) for n in leaves}
    starts = {n: len(list(n.iter("a"))) for n in leaves}
    leaves = [n for n in leaves if words[n]]
    inside = lambda n: [x for x in leaves if x in set(n.iter())]
    total = lambda n, of: sum(of[x] for x in inside(n))
    size = {n: len(words[n]) for n in leaves}
    density = lambda n: min(1.0, total(n, linked) / total(n, size)) if total(n, size) else 0.0
    points = dict.fromkeys(order, 0.0)
    for n in leaves:
        if size[n] >= 25:
            score = (1 + words[n].count(",") + min(size[n] / 100, 3)) * (1 - min(1.0, linked[n] / size[n]))
            up, weights = above.get(n), iter((1, 2, 6, 9, 12))
            while up is not None and (w := next(weights, None)):
                points[up] += score / w
                up = above.get(up)
    final = {n: points[n] * (1 - density(n)) for n in order}
    best = max(order, key=lambda n: (final[n], -order.index(n)))
    if final[best] <= 0:
        return "\n".join(words[n] for n in leaves if linked[n] * 2 <= size[n])
    kept = {best} | {n for n in order if best in above and above.get(n) is above[best] and total(n, size) and (final[n] >= max(10.0, 0.2 * final[best]) or n.tag in ("p", "li") and density(n) < 0.25)}
    menu = lambda n: n.tag in ("ul", "div", "section") and density(n) > 0.8 and total(n, starts) > 1 and total(n, linked) < html_extract.MENU_LINK * total(n, starts)

    def taken(n):
        while n is not None:
            if n in kept:
                return True
            if menu(n):
                return False
            n = above.get(n)
        return False

    return "\n".join(words[n] for n in leaves if taken(n))


def test_tree_scores_match_a_naive_version():
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma", "delta.", "epsilon"]) for _ in range(n))

    def part(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.4:
            return f"<p>{text(rng.randint(0, 25))}{' <a>' + text(rng.randint(1, 4)) + '</a> ' + text(2) if rng.random() < 0.3 else ''}</p>"
        if kind < 0.6:
            return "<ul>" + "".join(f"<li><a>{text(rng.randint(1, 6))}</a>{text(rng.choice([0, 0, 9]))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        tag = rng.choice(["div", "section"])
        return f"<{tag}>" + "".join(part(depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(400):
        page = "<body>" + "".join(part(0) for _ in range(rng.randint(1, 5))) + "</body>"
        assert html_extract.main_text(page) == naive_main_text(page), page


def test_repeated_pages_are_treated_alike(spark):
    rows = [(1, "u", PAGE)] * 3 + [(2, "u", "<font>" * 500 + "<p>kept text</p>" + "<span class='share'>gone</span> still here")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert len(got) == 4 and len({r["text"] for r in got if r["page_id"] == 1}) == 1
    assert [r["text"] for r in got if r["page_id"] == 2] == ["kept text\nstill here"]


def test_language_held_out(spark):
    got = language_id.languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    true = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(true, "doc_id").collect()
    assert len(rows) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
    for r in got.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_language_mixture_and_odd_rows(spark):
    texts = {"en": "the house of the water and the other thing with them ", "xx": "zwq kolar mizu bento wakka dorr "}
    train = spark.createDataFrame([(i, texts[k] * 5, k) for i, k in enumerate(["en", "xx"] * 20)], "doc_id bigint, text string, lang string")
    model = language_id.train(train)
    shares = language_id.infer([texts["en"] * 30, texts["en"] * 30 + texts["xx"] * 20, "", "é"], model[1])
    assert shares[0].tolist() == [1.0, 0.0] and shares[1].min() > 0.2 and abs(shares[1].sum() - 1) < 1e-6 and not shares[2].any()
    odd = language_id.languages(odd_documents(spark)).collect()
    assert len(odd) == 10 and {r["lang_pred"] for r in odd if r["doc_id"] in (2, 3, 6, 7)} == {"und"}
    assert language_id.languages(odd_documents(spark).limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.languages(odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_single_language_shortcut_is_exact():
    rng = np.random.default_rng(1)
    shares = rng.dirichlet(np.ones(50), 3).T
    full = np.vstack([shares, np.full((language_id.CLASSES - 50, 3), 1e-9)])
    for _ in range(20):
        own = rng.choice(50, 200, p=shares[:, 0])
        p = full[own]
        bound = len(own) * ((p / p[:, :1]).mean(axis=0).max() - 1)
        best = language_id._em(p, np.full(3, 1 / 3), np.ones(len(p)), 400)
        assert language_id._loglik(p, best, np.ones(len(p))) - np.log(p[:, 0]).sum() <= bound + 1e-6


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for docs in (documents(spark), odd_documents(spark)):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        rows = packing.pack_documents(docs, path, with_ids=True).collect()
        want = sorted((str(d), tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in texts)
        pieces, sequences = {}, {}
        for r in rows:
            assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
            pieces.setdefault(str(r["doc_id"]), []).append((r["sequence_id"], r["start"], r["ids"]))
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.WINDOW
        sizes = [sum(n for _, n in p) for p in sequences.values()]
        if len(texts) > 100:
            assert len(pieces) == len(texts)
            assert sorted((k, tuple(x for _, _, ids in sorted(v, key=lambda q: q[1]) for x in ids)) for k, v in pieces.items()) == want
            assert sum(packing.WINDOW - s for s in sizes if s & (s - 1)) < 0.02 * sum(sizes)
        assert sum(sizes) == sum(len(ids) for _, ids in want)
    assert packing.pack_documents(documents(spark).limit(0), path).count() == 0


def test_cuts_are_best():
    rng = random.Random(4)
    for _ in range(60):
        points = sorted(rng.sample(range(1, 60), 25)) + [60]
        costs = [rng.choice([0, 1, 5]) for _ in points]
        window, at = 14, [0, *points]
        best = [0] + [None] * len(points)
        for j in range(1, len(at)):
            best[j] = min((best[i] + window - (at[j] - at[i]) + costs[j - 1] for i in range(j) if best[i] is not None and at[j] - at[i] <= window), default=None)
        if None in best:
            continue
        cuts, total = packing.best_cuts(points, costs, window), 0
        for a, b in zip([0, *cuts], cuts):
            total += window - (b - a) + costs[points.index(b)]
        assert total == best[-1]


def test_word_ids_match_the_library():
    words = packing.load(public_tokenizers.path("word_bpe_49k.json"))
    small = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), kept=50)  # forgets all the time
    rng = random.Random(3)
    parts = ["a", "The", "word.", "word,", "İ.", "½.", " ", "  ", "\n", "É", "'s", "12", "!!", ".", ",", "x,", "y.", "_.", "<|endoftext|>", "Σ", "漢", "😀", "\x1c", "́", "\t", "x'll", " ", "\x85", "İ", ""]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = words.whole.encode(text, add_special_tokens=False).ids
        assert words.encode([text])[0].tolist() == ids and small.encode(["zz", text])[1].tolist() == ids, repr(text)
    marks = ["\u0345", "\u0300", "\u0301", "\u0308", "\u030a", "\u030c", "\u0331", "\u0313"]
    letters = [chr(c) for c in [*range(0x391, 0x3AA), *range(0x1F08, 0x1F10), 0x1FBA, 0x1FFA, 0x3AA, *b"AHJTWYahjtwy"] if c != 0x3A2]
    odd = ["\u1ffa\u0345", "\u03a9\u0300\u0345", "\u1fba\u0345", "\u0391\u0300\u0345", "H\u0331"]
    odd += ["".join(rng.choice(letters) + "".join(rng.choice(marks) for _ in range(rng.randint(0, 3))) for _ in range(3)) for _ in range(3000)]
    for text, got in zip(odd, words.encode(odd)):
        assert got.tolist() == words.whole.encode(text, add_special_tokens=False).ids, ascii(text)
    long = "Some words, again and again. " * 400_000  # cut into segments
    assert words.encode([long, "x"])[0].tolist() == words.encode(["Some words, again and again. "])[0].tolist() * 400_000


def test_bpe_matches_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\n ", "é", "'s", "12", "!!", "<|endoftext|>", "Ω", "漢", "😀", "\x1c", "́", "\t", " ", "ing"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, repr(text)
        assert own.decode(own.encode(text)).decode() == library.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(own.encode("x" * 3000), "<u4").tolist() == library.encode("x" * 3000).ids
    rows = bpe.encode(odd_documents(spark).select("doc_id", "text"), path, decoded="back").collect()
    assert len(rows) == 10 and {r["doc_id"]: r["back"] for r in rows}[2] == ""
    back = bpe.decode(bpe.encode(documents(spark).select("doc_id", "text"), path), path).join(documents(spark).select("doc_id", F.col("text").alias("old")), "doc_id")
    assert back.where("not (text <=> coalesce(old, ''))").count() == 0


def test_sharding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = sharding.shard_documents(docs).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() / sums.min() < 1.01
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert got.groupby("vslot")["shard"].nunique().max() == 1
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.limit(50).collect()}
    for r in got[got["doc_id"].isin(list(text))].itertuples():
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
    hot = spark.createDataFrame([(None, "null id", i % 7) for i in range(4000)] + [(5, f"text {i}", 0) for i in range(4000)] + [(9, "same row", 0)] * 4000, "doc_id bigint, text string, n int")
    spread = sharding.shard_documents(hot).toPandas()
    assert len(spread) == 12000 and spread.groupby("shard")["size"].sum().max() < 1.1 * spread["size"].sum() / 16 and spread.groupby("vslot").size().max() < 200
    for _, own in spread.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    for n, size in ((60, 200_000), (12_000, 3)):
        few = spark.createDataFrame([(i, f"text {i}") for i in range(1000)] + [(9, "x" * size)] * n, "doc_id bigint, text string")
        even = sharding.shard_documents(few).toPandas()
        sums = even.groupby("shard")["size"].sum()
        assert sums.max() < 1.1 * sums.sum() / 16
        again = sharding.shard_documents(few.repartition(3)).toPandas()
        assert even.groupby(["shard", "doc_id"]).size().equals(again.groupby(["shard", "doc_id"]).size())
    odd = sharding.shard_documents(odd_documents(spark)).collect()
    assert len(odd) == 10 and {r["doc_id"]: r["size"] for r in odd}[2] == 1
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_map_is_largest_first(spark):
    """Sizes, checksums, slots, the map and the places against a naive version."""
    rows = [(i % 90, "ab" * (i * i % 37)) for i in range(200)] + [(None, None)] * 3
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), slots=32, shards=4).toPandas()
    assert sorted(zip(got["doc_id"].fillna(-1), got["size"], got["text_crc32"])) == sorted((-1 if i is None else i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sums = got.groupby("vslot")["size"].sum().reindex(range(32), fill_value=0)
    loads, home = [0] * 4, {}
    for slot in sorted(range(32), key=lambda v: (-sums[v], v)):
        home[slot] = loads.index(min(loads))
        loads[home[slot]] += max(1, sums[slot])
    assert (got["shard"] == got["vslot"].map(home)).all()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_map_edit_query(spark):
    got = queries()["sharding_map_edit"](spark, SF).toPandas()
    assert len(got) == sharding.SLOTS and got["records"].sum() == documents(spark).count()
    for name, shards in (("shard_1", 16), ("shard_2", 17)):
        load = got.groupby(name)["bytes"].sum()
        assert len(load) == shards and load.max() < 1.5 * load.mean()
    assert (got["shard_1"] != got["shard_2"]).mean() < 0.2


def test_rebalancing_moves_little(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    records = docs.select(sharding.record_size("text").alias("size"), sharding.slot_of("doc_id", 512).alias("vslot"))
    sums = sharding.slot_bytes(records, slots=512)
    one = sharding.edited_map(sums, 8, version=1)
    sharding.write_map(one, str(tmp_path / "map"))
    two = sharding.edited_map(sums, 9, previous=sharding.read_map(spark, str(tmp_path / "map")), version=2)
    sharding.write_map(two, str(tmp_path / "map"))
    old, new = (sharding.read_map(spark, str(tmp_path / "map"), v) for v in (1, 2))
    assert sharding.read_map(spark, str(tmp_path / "map")).first()["version"] == 2
    both = old.join(new.withColumnRenamed("shard", "now"), "vslot").join(sums, "vslot").toPandas()
    assert len(both) == 512
    load = both.groupby("now")["bytes"].sum()
    assert len(load) == 9 and load.max() / load.min() < 1.1
    assert (both["shard"] != both["now"]).mean() < 0.25


def test_extreme_vectors(spark):
    tiny, huge, least = 1e-200, 1e200, 2.0**-1074
    rows = [(1, [tiny, 0.0]), (2, [huge, huge * 1e-3]), (3, [least, 0.0]), (4, [0.0, huge]), (5, [-tiny, 0.0]), (6, [1.0, 0.0]), (7, [tiny, huge]), (8, [tiny, 0.0])]
    docs = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id bigint, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(docs).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 6: (4, 1), 8: (4, 1), 4: (1, 4), 7: (1, 4), 5: (0, 5)}


@pytest.mark.parametrize("interval", [embedding_dedup.INTERVAL, 16])
def test_embeddings_match_brute_force(spark, interval):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(500):
        v = centres[rng.integers(12)] + rng.normal(size=16) * 0.12
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(500 + i, rows[3][1], rows[3][2]) for i in range(5)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] + [1.0] * 15, 1), (604, rows[0][1], None), (605, [float("inf")] * 16, 1), (606, [], 1), (607, rows[5][1][:8], rows[5][2])]
    embedding_dedup_rows = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(embedding_dedup_rows, interval=interval).collect()}
    assert len(got) == len(rows)
    good = [r for r in rows[:505]]
    m = np.array([r[1] for r in good], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    label = np.array([r[2] for r in good])
    hit = (m @ m.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    assert [got[r[0]]["n_links"] for r in good] == hit.sum(axis=1).tolist()
    i, j = np.nonzero(hit)
    ids = [r[0] for r in good]
    assert [got[r[0]]["component_id"] for r in good] == [ids[k] for k in settled(len(good), zip(i.tolist(), j.tolist()))]
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(600, 607))
    assert embedding_dedup.near_vectors(embedding_dedup_rows.limit(0)).count() == 0


def brute_templates(docs, similar=line_dedup.SIMILAR):
    """Places (doc, line) that are dropped, straight from the definition; docs are {id: text} without repeated lines in a text."""
    lines = {}
    for d, text in docs.items():
        for k, line in enumerate(text.split("\n")):
            tokens = tuple("<*>" if any(c.isdigit() for c in t) else t for t in line.split())
            if tokens:
                lines.setdefault(tokens, []).append((d, k))
    support = {}
    for tokens, places in lines.items():
        for i, t in enumerate(tokens):
            key = (len(tokens), tokens[:3], i, t)
            support[key] = support.get(key, 0) + len({d for d, _ in places})
    groups = {}
    for tokens, places in lines.items():
        got = [support[len(tokens), tokens[:3], i, t] for i, t in enumerate(tokens)]
        bar = sorted(got, reverse=True)[int(np.ceil(len(got) * similar - 1e-9)) - 1]
        groups.setdefault((len(tokens), tokens[:3], tuple(t if x >= bar else None for t, x in zip(tokens, got))), []).extend(places)
    return {p for places in groups.values() if len({d for d, _ in places}) > 1 for p in set(places) - {min(places)}}


def test_leaf_holds_several_templates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfghjklm") for _ in range(6))
    kinds = ["please read our {} rules before you post here", "please read our {} notes after one more visit", "please read our daily {} of all new things"]
    docs = {}
    for i in range(120):
        lines = [f"{word()} {word()} own {word()} {word()}", "please read our " + " ".join(word() for _ in range(6))]
        if i < 100:
            lines.insert(rng.randrange(3), kinds[i % 5 // 2].format(word()))
        docs[i] = "\n".join(lines)
    gone = brute_templates(docs)
    assert len(gone) == 97
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_templates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    assert got == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs.items()}


def test_mixtures_match_full_inference():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list(letters), p=None) for _ in range(4000)) for letters in ("abcde abcf ", "cdefg efgh ", "hijkl ijkm ")]
    codes, starts = language_id.trigram_classes(texts)
    table = np.stack([np.bincount(codes[a:b], minlength=language_id.CLASSES) for a, b in zip(starts, starts[1:])], axis=1)
    shares = (table + 0.2) / (table + 0.2).sum(axis=0)
    probes = [t[a : a + n] for t in texts for a, n in ((0, 30), (100, 400), (7, 5), (50, 2000))]
    probes += [texts[0][:500] + texts[1][:900], texts[2][:900] + texts[0][:80], texts[0][:300] + texts[1][:300] + texts[2][:300], texts[1][:30] * 50, "", "12"]
    got = language_id.infer(probes, shares)
    for text, own in zip(probes, got):
        c, s = language_id.trigram_classes([text])
        classes, weight = np.unique(c, return_counts=True)
        want = language_id.mixture(shares[classes], weight, language_id.PENALTY * np.log(len(c) + 1.0)) if len(c) else np.zeros(3)
        assert (own > 0).tolist() == (want > 0).tolist() and np.allclose(own, want, atol=0.02), text[:20]
    assert (got > 0).sum(axis=1).tolist()[:12] == [1] * 12 and (got[12] > 0).sum() == 2 and (got[14] > 0).sum() == 3
    language_id.BLOCK, before = 50, language_id.BLOCK
    try:
        assert np.allclose(language_id.infer(probes, shares), got)
    finally:
        language_id.BLOCK = before


def test_clashing_names(spark):
    docs = odd_documents(spark).toDF("doc_id", "text", "__key", "__lines", "c0", "key", "k1", "component_id").withColumns({"c1": F.lit(1), "own": F.lit(2), "fp": F.lit("f")})
    for out in (simhash.keep_one(docs), line_dedup.drop_templates(docs)):
        assert out.columns == docs.columns and out.count() > 0
    counted = line_dedup.drop_templates(docs, counts=("__lines", "lost"))
    assert counted.columns == [c for c in docs.columns if c != "__lines"] + ["__lines", "lost"] and counted.count() == docs.count()
    coded = bpe.encode(docs.withColumn("ids", F.lit(1)), public_tokenizers.path("byte_bpe_50k.json"), decoded="fp")
    assert coded.columns[-2:] == ["ids", "fp"] and coded.columns.count("ids") == 1 and coded.count() == docs.count()
    found = language_id.identify(docs.withColumns({"score": F.lit("x"), "lang_pred": F.lit("x")}), language_id.train(documents(spark)), keep_text=True)
    assert found.columns.count("score") == found.columns.count("lang_pred") == 1 and found.count() == docs.count()


def test_lines(spark):
    filler = "alpha beta gamma delta number {} epsilon zeta eta theta"
    rows = [(i, f"own line {i} " + " ".join(str(hash((i, k)) % 97) + "w" for k in range(3)) + f"\n{filler.format(i)}\nunique{i} " + " ".join(hashlib.md5(f"{i}-{k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(8))) for i in range(10)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, LONG)]
    docs = spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id bigint, text string, leaf string")
    got = {r["doc_id"]: r for r in line_dedup.drop_templates(docs).collect()}
    assert len(got) == len(rows) and got[20]["text"] is None and got[21]["text"] == "" and got[22]["text"] == "\n\n" and got[23]["text"] == LONG
    assert "epsilon" in got[0]["text"] and all("epsilon" not in got[i]["text"] for i in range(1, 10))
    assert all(f"unique{i}" in got[i]["text"] for i in range(10))
    assert line_dedup.drop_templates(docs.limit(0)).count() == 0
    odd = line_dedup.drop_templates(odd_documents(spark)).collect()
    assert len(odd) == 10 and [r["text"] for r in odd if r["doc_id"] == 4] == [LONG, LONG]


def test_variable_words_join_a_template(spark):
    rows = [(i, f"breaking news today the weather in {w} will be rather fine and warm until evening") for i, w in enumerate("rome oslo kyiv bonn nice".split())]
    rows += [(9, "breaking news today nothing of the kind was said by anyone in that small town at")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_templates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [bool(got[i]) for i in (0, 1, 2, 3, 4, 9)] == [True, False, False, False, False, True]


def test_queries_have_the_contract_columns(spark):
    want = {
        "op2": "doc_id keep_id group_size kept text_sha256",
        "op3": "page_id host path rule verdict",
        "op4": "page_id url text n_chars",
        "op5": "doc_id held_out lang_pred score",
        "op6": "doc_id fingerprint component_id",
        "op7": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op8": "doc_id size text_crc32 law shard slot grown_shard",
        "op9": "vec_id n_links component_id kept",
        "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    for name, query in queries().items():
        columns = want.get(name.split("_")[0])
        if columns:
            assert set(columns.split()) <= set(query(spark, SF).columns), name


@pytest.mark.parametrize("block", [4, simhash.BLOCK])
def test_copies_of_one_base_match_brute_force(spark, block):
    """Copies that are near their base but not near one another, bases that are chained, and strangers."""
    rng = random.Random(13)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts = []
    for base in range(3):
        words = [f"b{base}w{rng.randrange(900)}" for _ in range(240)]
        texts.append(words)
        for _ in range(22):
            copy = list(words)
            for _ in range(rng.randint(1, 7)):
                copy[rng.randrange(240)] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    texts += [[f"s{rng.randrange(900)}" for _ in range(100)] for _ in range(5)]
    rng.shuffle(texts)
    sets = [shingles(w) for w in texts]
    close = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    apart = sum(1 for i in range(len(texts)) for j in range(i) if 0.6 < len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8)
    assert apart > 200 and len(close) > 50
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == settled(len(texts), close)


def test_isolated_pairs_are_judged_by_their_shingles(spark):
    rng = random.Random(11)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near = [], []
    for pair in range(160):
        base = [f"w{rng.randrange(50000)}" for _ in range(300)]
        other = list(base)
        while len(shingles(base) & shingles(other)) / len(shingles(base) | shingles(other)) > (0.84 if pair < 80 else 0.81):
            last, other = other, list(other)
            other[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        if pair < 80:
            other = last  # at or a little above 0.84
        else:
            while len(shingles(base) & shingles(other)) / len(shingles(base) | shingles(other)) >= 0.8:
                other[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        near.append(len(shingles(base) & shingles(other)) / len(shingles(base) | shingles(other)) >= 0.8)
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(other))]
    left = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert near == [True] * 80 + [False] * 80
    assert left == {2 * p for p in range(160)} | {2 * p + 1 for p in range(80, 160)}

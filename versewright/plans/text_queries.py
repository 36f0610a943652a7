"""Registered queries: text functions on ``documents``, ``pages`` and ``conversations``, and clock formats on ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timecode as C
from ..schema import DOC_LINES_SQL, LINED_SQL, WORDS_SQL, document_lines, events_as_words, in_lines, table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null")


def tokenize_words(spark: SparkSession, sf: str) -> DataFrame:
    t = _docs(spark, sf).select("doc_id", X.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join("w", "|")).alias("digest"))


def line_split(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(spark, sf).where("trim(line) <> ''").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.length("line").cast("bigint").alias("n"))


def word_key(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(X.word_key(F.col("text"))).alias("digest"))


def letter_key(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(X.letter_key(F.col("text"))).alias("digest"))


def anchor_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.anchor_key(F.col("text"))).alias("digest"))


def _bracketed(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with their second word in parentheses (every third turn) or wholly in brackets (every seventh)."""
    t = table(spark, sf, "conversations").where("text is not null")
    inline = F.regexp_replace("text", r"^(\S+) (\S+)", "$1 ($2)")
    return t.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, inline).when(F.col("turn") % 7 == 0, F.concat(F.lit("[part "), "turn", F.lit("]"))).otherwise(F.col("text")).alias("line"))


def split_background(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line")
    return _bracketed(spark, sf).select("conv_id", "turn", X.background(line).alias("background"), F.md5(X.without_background(line)).alias("main"))


def section_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _bracketed(spark, sf).where(~X.is_section(F.col("line"))).groupBy("conv_id").agg(F.count("*").alias("lines"))


def paren_class(spark: SparkSession, sf: str) -> DataFrame:
    return _bracketed(spark, sf).groupBy(X.classify_parentheses(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


def join_punctuation(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of punctuation only are appended to the token before them."""
    from pyspark.sql import Window

    spaced = F.regexp_replace("text", r"([.,!?])", " $1")
    t = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(F.filter(F.split(spaced, r"\s+"), lambda w: w != "")).alias("i", "token"))
    w = Window.partitionBy("conv_id", "turn").orderBy("i")
    head = F.when(F.col("token").rlike(r"^[.,!?]+$"), 0).otherwise(1)
    t = t.withColumn("g", F.sum(head).over(w))
    parts = F.sort_array(F.collect_list(F.struct("i", "token")))
    return t.groupBy("conv_id", "turn", "g").agg(F.array_join(F.transform(parts, lambda p: p["token"]), "").alias("word"))


def capitalize_first(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.md5(X.capitalised(F.lower("text"))).alias("digest"))


def sync_detect(spark: SparkSession, sf: str) -> DataFrame:
    stamp = C.encode_lrc(F.col("word_id") * 37)
    w = events_as_words(spark, sf)
    made = F.when(F.col("word_id") % 3 == 0, F.concat(F.lit("["), stamp, F.lit("]"), "kind")).when(F.col("word_id") % 3 == 1, F.concat(F.lit("["), stamp, F.lit("]<"), stamp, F.lit(">"), "kind")).otherwise(F.col("kind"))
    return w.groupBy(X.sync_of(made).alias("sync")).agg(F.count("*").alias("n"))


def url_host(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))


def video_id(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.lpad(F.col("page_id").cast("string"), 11, "v").alias("v"))
    made = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?list=a&v="), "v")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://youtu.be/"), "v", F.lit("?t=3"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://example.org/watch?v="), "v")).otherwise(F.concat(F.lit("https://m.youtube.com/shorts/"), "v"))
    return p.select("page_id", X.video_id(made).alias("video"))


def title_clean(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit(" - "), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit(" (Official Video)")).otherwise(F.lit(" [Lyrics HD]"))).alias("raw"))
    both = X.artist_and_title(X.clean_title(F.col("raw")))
    return p.select("p_partkey", both["artist"].alias("artist"), both["title"].alias("title"))


def slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"))


def time_encode(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.round(F.col("value") * 1000).cast("bigint")
    w = events_as_words(spark, sf)
    return w.select("word_id", C.encode_ttml(ms).alias("ttml"), C.encode_lrc(ms).alias("lrc"), C.encode_srt(ms * 60).alias("srt"), C.display(ms, 2).alias("shown"))


def time_decode(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf).select("word_id", F.round(F.col("value") * 1000).cast("bigint").alias("ms"))
    return w.select("word_id", C.decode_ttml(C.encode_ttml(F.col("ms"))).alias("ttml_ms"), (C.decode_lrc(C.encode_lrc(F.col("ms"))) - F.col("ms")).between(-5, 5).alias("lrc_near"), C.decode_ttml(F.concat(F.col("ms").cast("string"), F.lit("ms"))).alias("offset_ms"))


def lrc_format(spark: SparkSession, sf: str) -> DataFrame:
    w = in_lines(events_as_words(spark, sf))
    first = w.groupBy("song", "line_no").agg(F.min_by(F.round(F.col("value") * 1000).cast("bigint"), "word_no").alias("ms"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "kind"))), lambda p: p["kind"]), " ").alias("words"))
    return first.select("song", "line_no", F.concat(F.lit("["), C.encode_lrc(F.col("ms")), F.lit("]"), "words").alias("lrc"))


def srt_format(spark: SparkSession, sf: str) -> DataFrame:
    w = events_as_words(spark, sf).where("value > 400")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("song").orderBy("begin_ms", "word_id"))
    ms = F.round(F.col("value") * 1000).cast("bigint")
    w = w.withColumn("n", n)
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), C.encode_srt(ms), F.lit(" --> "), C.encode_srt(ms + 1500), F.lit("\n"), "kind")
    return w.select("word_id", block.alias("srt"))


def script_share(spark: SparkSession, sf: str) -> DataFrame:
    accented = X.script_share(F.col("text"), "\\x{00c0}-\\x{00ff}")
    return _docs(spark, sf).select("doc_id", F.floor(accented * 1000).cast("bigint").alias("permille"))


def stopword_vote(spark: SparkSession, sf: str) -> DataFrame:
    votes = X.stop_word_votes(F.col("found"))
    return _docs(spark, sf).select("doc_id", X.stop_words_in(F.col("text")).alias("found")).select("doc_id", *[v.cast("bigint").alias(k) for k, v in votes.items()])


def language_guess(spark: SparkSession, sf: str) -> DataFrame:
    return X.guess_language(_docs(spark, sf)).select("doc_id", "guess")


def escape_xml(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(X.escape_xml(F.col("html"), quotes=True)).alias("digest"))


def credit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns behind six labels, four of which name a role."""
    labels = F.array(*[F.lit(x) for x in ("Lyrics by:", "词：", "Composer :", "the end 曲:", "Notes:", "作 曲:")])
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.element_at(labels, (F.col("turn") % 6 + 1).cast("int")), F.coalesce("text", F.lit(""))).alias("line"))
    return c.where(X.is_credit(F.col("line"))).groupBy("conv_id").agg(F.count("*").alias("credits"))


def term_search(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(X.terms_match(F.col("text"), F.lit("THE and  of"))).select("doc_id")


QUERIES = [
    tokenize_words, line_split, word_key, letter_key, anchor_key, split_background, section_filter, paren_class, join_punctuation, capitalize_first, sync_detect, url_host, video_id,
    title_clean, slug, time_encode, time_decode, lrc_format, srt_format, script_share, stopword_vote, language_guess, escape_xml, credit_lines, term_search,
]

_KEY = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ')"
_BRACKETED = r"""WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN regexp_replace(text, '^(\S+) (\S+)', '\1 (\2)') WHEN turn % 7 = 0 THEN '[part ' || turn || ']' ELSE text END AS line FROM conversations WHERE text IS NOT NULL)"""
_MS = "CAST(round(value * 1000) AS BIGINT)"


def _p(x: str, n: int) -> str:
    return f"lpad(({x})::BIGINT::VARCHAR, greatest({n}, length(({x})::BIGINT::VARCHAR))::INT, '0')"


def _lrc(ms: str) -> str:
    c = f"((({ms}) + 5) // 10)"
    return f"{_p(c + ' // 6000', 2)} || ':' || {_p(c + ' // 100 % 60', 2)} || '.' || {_p(c + ' % 100', 2)}"


def _srt(ms: str) -> str:
    return f"{_p(f'({ms}) // 3600000', 2)} || ':' || {_p(f'({ms}) // 60000 % 60', 2)} || ':' || {_p(f'({ms}) // 1000 % 60', 2)} || ',' || {_p(f'({ms}) % 1000', 3)}"


def _ttml(ms: str) -> str:
    return f"(({ms}) // 60000)::VARCHAR || ':' || {_p(f'({ms}) // 1000 % 60', 2)} || '.' || {_p(f'({ms}) % 1000', 3)}"


def _votes() -> str:
    words = r"regexp_split_to_array(lower(text), '\s+')"
    listed = lambda own: ", ".join("'" + x.replace("'", "''") + "'" for x in own)
    return ", ".join(f"CAST(len(list_filter({words}, lambda w: w IN ({listed(own)}))) AS BIGINT) AS {lang}" for lang, own in X.STOP_WORDS.items())


SQL = {
    "tokenize_words": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, len(w)::BIGINT AS n_words, md5(array_to_string(w, ' |')) AS digest FROM t""",
    "line_split": f"WITH {DOC_LINES_SQL} SELECT doc_id, line_no::BIGINT AS line_no, length(line)::BIGINT AS n FROM doc_lines WHERE trim(line, ' ') <> ''",
    "word_key": f"SELECT doc_id, md5({_KEY}) AS digest FROM documents WHERE text IS NOT NULL",
    "letter_key": r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "anchor_key": r"SELECT conv_id, turn, md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+'), ' ')) AS digest FROM conversations",
    "split_background": _BRACKETED + r""" SELECT conv_id, turn, nullif(trim(array_to_string(regexp_extract_all(line, '\(([^()]*)\)', 1), ' '), ' '), '') AS background,
      md5(trim(regexp_replace(regexp_replace(line, '\([^()]*\)', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS main FROM b""",
    "section_filter": _BRACKETED + r" SELECT conv_id, count(*) AS lines FROM b WHERE NOT regexp_matches(line, '^\s*\[[^\]]*\]\s*$') GROUP BY conv_id",
    "paren_class": _BRACKETED + r""" SELECT CASE WHEN o = 0 AND c = 0 THEN 'none' WHEN o <> c OR regexp_matches(line, '\([^)]*\(') OR regexp_matches(line, '^[^(]*\)') THEN 'skip'
      WHEN regexp_matches(trim(line, ' '), '^\([^()]*\)$') THEN 'standalone' ELSE 'inline' END AS kind, count(*) AS n
      FROM (SELECT line, length(line) - length(replace(line, '(', '')) AS o, length(line) - length(replace(line, ')', '')) AS c FROM b) q GROUP BY 1""",
    "join_punctuation": r"""WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(text, '([.,!?])', ' \1', 'g'), '\s+'), lambda w: w <> '') AS w FROM conversations WHERE text IS NOT NULL
      ), t AS (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM s
      ), g AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(token, '^[.,!?]+$') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS BIGINT) AS g FROM t)
      SELECT conv_id, turn, g, string_agg(token, '' ORDER BY i) AS word FROM g GROUP BY conv_id, turn, g""",
    "capitalize_first": r"""WITH c AS (SELECT conv_id, turn, lower(text) AS t, length(regexp_extract(lower(text), '^([^\p{L}]*)', 1)) AS k FROM conversations WHERE text IS NOT NULL)
      SELECT conv_id, turn, md5(substr(t, 1, k) || upper(substr(t, k + 1, 1)) || substr(t, k + 2)) AS digest FROM c""",
    "sync_detect": "SELECT CASE word_id % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'word' ELSE 'unsynced' END AS sync, count(*) AS n FROM (SELECT event_id AS word_id FROM events) q GROUP BY 1",
    "url_host": r"SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '') AS host FROM pages",
    "video_id": "SELECT page_id, CASE WHEN page_id % 4 = 2 THEN NULL ELSE lpad(page_id::VARCHAR, 11, 'v') END AS video FROM pages",
    "title_clean": r"SELECT p_partkey, trim(p_brand, ' ') AS artist, trim(p_name, ' ') AS title FROM part",
    "slug": r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    "time_encode": f"SELECT event_id AS word_id, {_ttml(_MS)} AS ttml, {_lrc(_MS)} AS lrc, {_srt(_MS + ' * 60')} AS srt, substr({_ttml(_MS)}, 1, length({_ttml(_MS)}) - 1) AS shown FROM events",
    "time_decode": f"SELECT event_id AS word_id, {_MS} AS ttml_ms, true AS lrc_near, {_MS} AS offset_ms FROM events",
    "lrc_format": f"WITH {LINED_SQL} SELECT song, line_no, '[' || {_lrc(f'arg_min({_MS}, word_no)')} || ']' || string_agg(kind, ' ' ORDER BY word_no) AS lrc FROM lined GROUP BY song, line_no",
    "srt_format": f"WITH {WORDS_SQL} SELECT word_id, row_number() OVER (PARTITION BY song ORDER BY begin_ms, word_id) || chr(10) || {_srt(_MS)} || ' --> ' || {_srt(_MS + ' + 1500')} || chr(10) || kind AS srt FROM words WHERE value > 400",
    "script_share": r"""SELECT doc_id, CAST(floor(CASE WHEN n > 0 THEN CAST(k AS DOUBLE) / n ELSE 0 END * 1000) AS BIGINT) AS permille FROM (
      SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n, length(regexp_replace(text, '[^\x{00c0}-\x{00ff}]', '', 'g')) AS k FROM documents WHERE text IS NOT NULL) q""",
    "stopword_vote": f"SELECT doc_id, {_votes()} FROM documents WHERE text IS NOT NULL",
    "language_guess": f"""WITH v AS (SELECT doc_id, {_votes()} FROM documents WHERE text IS NOT NULL), t AS (SELECT *, greatest(en, de, es, fr) AS top FROM v)
      SELECT doc_id, CASE WHEN top = 0 OR (en = top)::INT + (de = top)::INT + (es = top)::INT + (fr = top)::INT > 1 THEN 'en' WHEN en = top THEN 'en' WHEN de = top THEN 'de' WHEN es = top THEN 'es' ELSE 'fr' END AS guess FROM t""",
    "escape_xml": """SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) AS digest FROM pages""",
    "credit_lines": "SELECT conv_id, count(*) AS credits FROM conversations WHERE turn % 6 IN (0, 1, 2, 5) GROUP BY conv_id",
    "term_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'of')",
}

"""The registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, filter_audit, hard_negatives, html_extract, language_id, line_dedup, packing, sharding, simhash, substring_dedup, url_filter
from .common import checkpoint_dir, frozen, gone_at_exit, small_batches

#: The rules of ``op3_url_filter``.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_templates(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return done.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_dropped").cast("bigint").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_table(spark, RULES))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def sharding_map_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot map of all documents for 16 shards, stored and read again, and its next version for 17: each slot's bytes and shards."""
    records = sharding.slotted(_table(spark, sf_dir, "documents"))
    sums = frozen(sharding.slot_bytes(records))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)
    sharding.write_map(sharding.edited_map(sums, 16, version=1), folder)
    sharding.write_map(sharding.edited_map(sums, 17, previous=sharding.read_map(spark, folder, 1), version=2), folder)
    old, new = (sharding.read_map(spark, folder, v).select("vslot", F.col("shard").alias(f"shard_{v}")) for v in (1, 2))
    return sums.select("vslot", "bytes", F.col("n").alias("records")).join(old, "vslot").join(new, "vslot")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_exact_dedup, op3_url_filter, op4_html_extract, op5_language_id, op6_simhash, op7_packing, op8_sharding, op9_embedding_dedup, op10_bpe, op11_hard_negatives, op12_substring_dedup, op13_filter_audit, sharding_map_edit)
    return {f.__name__: f for f in own}


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
"""

URL_SQL = r"""
WITH rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), m AS (
  SELECT u.*, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.h) + length(r.p) DESC, length(r.h) DESC) AS k
  FROM u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

#: The template tree on whole lines instead of hashes.
LINES_SQL = r"""
WITH docs AS (SELECT doc_id, text FROM documents),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM docs),
tok AS (
  SELECT doc_id, line_no, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS w FROM raw
), lines AS (
  SELECT doc_id, line_no, len(w)::VARCHAR || chr(1) || array_to_string(w[1:3], chr(1)) AS leaf, array_to_string(w, ' ') AS line, w FROM tok WHERE len(w) > 0
), known AS (
  SELECT leaf, line, any_value(w) AS w, count(DISTINCT doc_id) AS docs FROM lines GROUP BY leaf, line
), leaves AS (
  SELECT leaf, count(*) AS texts FROM known GROUP BY leaf
), spots AS (
  SELECT k.leaf, k.line, k.docs, unnest(k.w) AS token, generate_subscripts(k.w, 1) AS pos FROM known k JOIN leaves USING (leaf) WHERE texts > 1
), votes AS (
  SELECT leaf, pos, token, sum(docs) AS votes FROM spots GROUP BY leaf, pos, token
), bars AS (
  SELECT s.leaf, s.line, list(votes ORDER BY votes DESC)[ceil(count(*) * 0.8 - 1e-9)::INT] AS bar
  FROM spots s JOIN votes v ON v.leaf = s.leaf AND v.pos = s.pos AND v.token = s.token GROUP BY s.leaf, s.line
), named AS (
  SELECT s.leaf, s.line, string_agg(CASE WHEN votes >= bar THEN s.token ELSE chr(2) END, chr(1) ORDER BY s.pos) AS own
  FROM spots s JOIN votes v ON v.leaf = s.leaf AND v.pos = s.pos AND v.token = s.token JOIN bars b ON b.leaf = s.leaf AND b.line = s.line
  GROUP BY s.leaf, s.line
), placed AS (
  SELECT l.doc_id, l.line_no, l.leaf, coalesce(n.own, l.line) AS template FROM lines l LEFT JOIN named n ON n.leaf = l.leaf AND n.line = l.line
), templates AS (
  SELECT leaf, template, count(DISTINCT doc_id) AS docs, min((doc_id, line_no)) AS place FROM placed GROUP BY leaf, template
), gone AS (
  SELECT p.doc_id, p.line_no FROM placed p JOIN templates t ON t.leaf = p.leaf AND t.template = p.template
  WHERE t.docs >= 2 AND (p.doc_id, p.line_no) <> t.place
), rest AS (
  SELECT r.doc_id, count(*) AS n_lines, count(g.line_no) AS n_dropped, coalesce(string_agg(CASE WHEN g.line_no IS NULL THEN r.line END, chr(10) ORDER BY r.line_no), '') AS text
  FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.line_no = r.line_no GROUP BY r.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(rest.text, '')) AS text_sha256 FROM docs d LEFT JOIN rest ON rest.doc_id = d.doc_id
"""


#: Scores of every anchor with every row; whole numbers under 2^53, so doubles are exact.
NEGATIVES_SQL = r"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, v.rid, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM v a JOIN v ON a.rid <> v.rid AND len(a.q) = len(v.q) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) AS w FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.arid, p.w ORDER BY s.score DESC, s.vec_id, s.rid)::INT AS rank
  FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.w <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: Every window written out.
REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35
), windows AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS words FROM starts
), often AS (
  SELECT words FROM windows GROUP BY words HAVING count(*) > 1
), hits AS (
  SELECT rid, list_distinct(flatten(list(generate_series(i, i + 34)))) AS gone FROM windows JOIN often USING (words) GROUP BY rid
), kept AS (
  SELECT d.rid, doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN hits ON hits.rid = d.rid
), words AS (
  SELECT rid, i, w[i] AS word FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM kept) EXCEPT ALL SELECT rid, i, w[i] FROM (SELECT rid, w, unnest(gone) AS i FROM kept)
), texts AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(texts.text, '')) AS kept_sha256 FROM kept LEFT JOIN texts ON texts.rid = kept.rid
"""

#: Failures counted by part, label and pattern, then every order step by step.
AUDIT_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS failed
  FROM d
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, failed
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT letter AS o, bit AS used, 1 AS k FROM x UNION ALL SELECT o.o || x.letter, o.used + x.bit, k + 1 FROM o JOIN x ON NOT contains(o.o, x.letter)
), steps AS (
  SELECT o AS filter_order, step, x.bit, (SELECT coalesce(sum(y.bit), 0) FROM x y WHERE contains(left(o.o, step - 1), y.letter)) AS before
  FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE k = 5) o JOIN x ON x.letter = substr(o.o, step, 1)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (failed & (before + bit) = 0) AS kept, sum(n) FILTER (failed & before = 0 AND failed & bit > 0) AS removed,
    sum(n) FILTER (failed & before > 0 AND failed & bit > 0) AS redundant, sum(n) FILTER (failed = bit) AS unique_fails,
    sum(g) FILTER (failed & before = 0 AND failed & bit > 0) AS good_lost, sum(t) FILTER (failed & before = 0 AND failed & bit > 0) AS toxic_lost
  FROM c CROSS JOIN steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": LINES_SQL,
        "op2_exact_dedup": EXACT_SQL,
        "op3_url_filter": URL_SQL,
        "op11_hard_negatives": NEGATIVES_SQL,
        "op12_substring_dedup": REPEATS_SQL,
        "op13_filter_audit": AUDIT_SQL,
    }

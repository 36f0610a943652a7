"""Registered queries: comparing and choosing versions, and set operations, on ``documents``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compare, select
from ..schema import DOC_LINES_SQL, WORDS_SQL, document_lines, events_as_words, in_lines, table

#: Parts of one language's documents that meet its chosen version.
PARTS = 64


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null")


def group_versions(spark: SparkSession, sf: str) -> DataFrame:
    g = compare.grouped_versions(_docs(spark, sf), F.md5(X.word_key(F.col("text"))), "source")
    return g.select("key", "copies")


def version_labels(spark: SparkSession, sf: str) -> DataFrame:
    g = compare.grouped_versions(_docs(spark, sf), F.md5(X.word_key(F.col("text"))), "source")
    return g.where("copies > 1").select("key", "label")


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return compare.vocabulary(_docs(spark, sf), by=("lang",)).groupBy("lang").agg(F.count("*").alias("words"))


def spelling_semi(spark: SparkSession, sf: str) -> DataFrame:
    known = compare.vocabulary(table(spark, sf, "benchmark"))
    mine = compare.vocabulary(table(spark, sf, "conversations").where("text is not null"))
    return compare.allowed_spellings(mine, known)


def insertion_support(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf).select(F.col("line_no").cast("bigint").alias("after"), F.md5(X.word_key(F.col("line"))).alias("key"), F.col("source").alias("label"))
    return compare.insertion_support(lines, versions=20)


def line_break_variant(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").where("text is not null").select(F.col("conv_id").alias("song"), F.col("turn").alias("line_no"), X.word_key(F.col("text")).alias("key"))
    w = Window.partitionBy("song").orderBy("line_no")
    half = F.substring("key", F.lit(1), F.floor(F.length("key") / 2).cast("int"))
    option = F.when(F.col("line_no") % 3 == 0, F.concat_ws(" ", "key", F.lead("key").over(w))).when(F.col("line_no") % 3 == 1, half).otherwise(F.lit("other"))
    t = t.withColumn("option", option)
    return compare.line_break_variant(t, F.col("option")).select("song", "line_no", "break_only")


AUDIO = 200.0
PREFERENCE = ("src3", "src1", "src2")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as candidates of the song named by ``doc_id % 50``."""
    words = F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"))
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    kinds = ("word", "line", "unsynced", "syllable")
    length = F.when(F.col("doc_id") % 3 == 0, F.lit(AUDIO) + F.col("doc_id") % 7 - 3).when(F.col("doc_id") % 3 == 1, F.col("n_chars") / 10)
    return _docs(spark, sf).select(
        "doc_id", (F.col("doc_id") % 50).alias("song"), "source", pick(kinds, F.col("doc_id")).alias("sync"), pick(kinds, F.col("doc_id").cast("bigint") * 7 + 1).alias("declared"),
        words.alias("n_words"), length.alias("duration"), (AUDIO + F.col("doc_id") % 9 - 4).cast("double").alias("last_end"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return select.judge(_candidates(spark, sf), F.lit(AUDIO))


def judge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("doc_id", "rejected", "reason", "text_only", "note", "mismatch")


def candidate_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = select.candidate_summary(_judged(spark, sf))
    return c.select("doc_id", "source", "effective_sync", "n_words", "duration", "usable", F.array_join("notes", "; ").alias("notes"))


def _order() -> list:
    return [*select.candidate_order(F.lit(AUDIO), PREFERENCE), F.col("doc_id")]


def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = select.ranked(_judged(spark, sf).where("not rejected"), _order(), ("song",))
    return c.select("song", "doc_id", F.col("rank").cast("bigint").alias("place"))


def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """The first of each song's ranking, by an aggregation."""
    order = F.struct(*[(-k).alias(f"k{i}") for i, k in enumerate(_order())])
    return select.best(_judged(spark, sf).where("not rejected"), order, ("song",), ["doc_id", "source"])


def first_word_synced(spark: SparkSession, sf: str) -> DataFrame:
    """A word-timed candidate whose length fits ends the search: one is enough."""
    fits = (F.col("sync").isin("word", "syllable")) & ~F.col("rejected") & ~F.col("text_only")
    return _judged(spark, sf).where(fits).groupBy("song").agg(F.min("doc_id").alias("doc_id"))


def best_rendition(spark: SparkSession, sf: str) -> DataFrame:
    """The dearest part of each order, the smaller line number first."""
    li = table(spark, sf, "lineitem")
    return select.best(li, F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("l")), ("l_orderkey",), ["l_linenumber", "l_partkey"])


def top_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Three most supported values of each group."""
    n = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "l_suppkey"))
    return n.withColumn("k", k).where("k <= 3").select("l_returnflag", "l_suppkey", "n")


def removal_cap(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").where("text is not null")
    kept = select.removal_cap(t, F.length("text") % 3 == 0, ("conv_id",))
    return kept.groupBy("conv_id").agg(F.count("*").alias("kept"))


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, turns and pages as candidates of one shape."""
    d = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.lit("documents").alias("source"), F.length("text").cast("bigint").alias("n"))
    t = table(spark, sf, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("turns").alias("source"), F.length("text").cast("bigint").alias("n"))
    p = table(spark, sf, "pages").where("html is not null").select(F.col("page_id").cast("string").alias("id"), F.lit("pages").alias("source"), F.length("html").cast("bigint").alias("n"))
    return d.unionByName(t).unionByName(p)


def fallback_union(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    urgent = o.where("o_orderpriority like '1%'").select("o_custkey", "o_orderkey")
    return select.fallback_union(urgent, o.where("o_orderpriority like '2%'").select("o_custkey", "o_orderkey"), "o_custkey")


def except_identical(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of other sources that are not among ``src0``'s."""
    d = _docs(spark, sf).select("source", "doc_id", F.md5(X.word_key(F.col("text"))).alias("key"))
    return d.where("source <> 'src0'").join(d.where("source = 'src0'").select("key").distinct(), "key", "left_anti").select("doc_id")


def membership_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers whose set of parts differs between the two line statuses."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.md5(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ",")).alias("parts"))
    return li.groupBy("l_suppkey").agg(F.count_distinct("parts").alias("sets")).where("sets > 1").select("l_suppkey")


def toggle_selection(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()
    return select.toggled(o.where("o_orderstatus = 'O'").select("o_custkey"), o.where("o_orderstatus = 'F'").select("o_custkey"))


def changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_custkey % 7 <> 0")
    moved = table(spark, sf, "customer").where("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "NEW").otherwise(F.col("c_mktsegment"))).withColumn("c_nationkey", F.col("c_nationkey") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0))
    return select.changed_fields(c, moved, "c_custkey", ["c_mktsegment", "c_nationkey"])


def three_way_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    mine = F.when(F.col("o_orderkey") % 3 == 0, "A").otherwise(F.col("o_orderstatus"))
    theirs = F.when(F.col("o_orderkey") % 4 == 0, "B").otherwise(F.col("o_orderstatus"))
    m = select.three_way_merge(F.col("o_orderstatus"), mine, theirs)
    return o.groupBy(m["value"].alias("value"), m["conflict"].alias("conflict")).agg(F.count("*").alias("n"))


def version_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of one language against the first document of that language, line by line."""
    d = _docs(spark, sf).select("lang", "doc_id", F.split("text", "\n", -1).alias("other"))
    chosen = d.groupBy("lang").agg(F.min_by("other", "doc_id").alias("chosen"))
    # A language may have a large part of all documents: they are dealt out, and the few chosen texts are repeated for each part.
    dealt = d.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    chosen = chosen.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return compare.version_decisions(dealt.join(chosen.withColumn("_part", F.col("_part").cast("bigint")), ["lang", "_part"]).select("doc_id", "chosen", "other")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def lcs_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Common subsequence of the kinds of each line of a song (``line_no``) and the next one."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("word_no", "kind"))), lambda p: p["kind"])
    l = in_lines(events_as_words(spark, sf)).groupBy("song", "line_no").agg(ordered.alias("a"))
    following = F.lead("a").over(Window.partitionBy("song").orderBy("line_no"))
    return compare.lcs_pairs(l.withColumn("b", following).where("b is not null"))


QUERIES = [
    group_versions, version_labels, vocabulary, spelling_semi, insertion_support, line_break_variant, judge_candidates, candidate_summary, rank_candidates, best_candidate, first_word_synced, best_rendition, top_variants,
    removal_cap, union_sources, fallback_union, except_identical, membership_diff, toggle_selection, changed_fields, three_way_merge, version_decisions, lcs_pairs,
]

_K = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ')"
_CAND = rf"""cand AS (SELECT doc_id, doc_id % 50 AS song, source, ['word', 'line', 'unsynced', 'syllable'][doc_id % 4 + 1] AS sync, ['word', 'line', 'unsynced', 'syllable'][(doc_id * 7 + 1) % 4 + 1] AS declared,
    len(list_filter(string_split({_K}, ' '), lambda w: w <> '')) AS n_words, CASE doc_id % 3 WHEN 0 THEN 200.0 + doc_id % 7 - 3 WHEN 1 THEN n_chars / 10 END AS duration, 200.0 + doc_id % 9 - 4 AS last_end FROM documents WHERE text IS NOT NULL
  ), j AS (SELECT *, n_words < 12 AS rejected, coalesce(abs(duration - 200) > 3, false) AS off, sync <> 'unsynced' AND last_end > 203 AS late FROM cand
  ), judged AS (SELECT *, NOT rejected AND (off OR late) AS text_only, CASE WHEN rejected THEN 'words:' || n_words END AS reason,
      CASE WHEN rejected THEN NULL WHEN off THEN 'duration:' || round(duration)::BIGINT || ':200' WHEN late THEN 'late_end:' || last_end::BIGINT || ':200' END AS note,
      NOT rejected AND declared IN ('word', 'syllable') AND sync NOT IN ('word', 'syllable') AS mismatch FROM j
  ), keyed AS (SELECT *, CASE WHEN text_only THEN 0 ELSE list_position(['line', 'word', 'syllable'], sync) END AS r, list_position(['line', 'word', 'syllable'], sync) AS own,
      CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 ELSE 4 END AS pref, abs(coalesce(duration, 200) - 200) AS diff FROM judged WHERE NOT rejected
  ), placed AS (SELECT song, doc_id, source, row_number() OVER (PARTITION BY song ORDER BY coalesce(r, 0) DESC, coalesce(own, 0) DESC, pref, diff, doc_id) AS place FROM keyed)"""

SQL = {
    "group_versions": f"SELECT md5({_K}) AS key, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "version_labels": f"""WITH per AS (SELECT md5({_K}) AS key, source, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)
      SELECT key, string_agg(CASE WHEN n > 1 THEN source || ' ×' || n ELSE source END, ' + ' ORDER BY source) AS label FROM per GROUP BY key HAVING sum(n) > 1""",
    "vocabulary": f"SELECT lang, count(DISTINCT w) AS words FROM (SELECT lang, unnest(string_split({_K}, ' ')) AS w FROM documents WHERE text IS NOT NULL) q WHERE w <> '' GROUP BY lang",
    "spelling_semi": f"""SELECT w AS word FROM (SELECT DISTINCT unnest(string_split({_K}, ' ')) AS w FROM conversations WHERE text IS NOT NULL) q
      WHERE w <> '' AND w IN (SELECT unnest(string_split({_K}, ' ')) FROM benchmark)""",
    "insertion_support": rf"WITH {DOC_LINES_SQL} SELECT line_no::BIGINT AS after, md5({_K.replace('text', 'line')}) AS key, count(DISTINCT source) AS support FROM doc_lines GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2",
    "line_break_variant": rf"""WITH t AS (SELECT conv_id AS song, turn AS line_no, {_K} AS key FROM conversations WHERE text IS NOT NULL
      ), n AS (SELECT *, lead(key) OVER w AS nx, lag(key) OVER w AS pv FROM t WINDOW w AS (PARTITION BY song ORDER BY line_no)
      ), o AS (SELECT *, CASE line_no % 3 WHEN 0 THEN concat_ws(' ', key, nx) WHEN 1 THEN substr(key, 1, length(key) // 2) ELSE 'other' END AS opt FROM n)
      SELECT song, line_no, opt = concat_ws(' ', key, nx) OR opt = concat_ws(' ', pv, key) OR (length(opt) < length(key) * 0.8 AND (starts_with(key, opt) OR ends_with(key, opt))) AS break_only FROM o""",
    "judge_candidates": f"WITH {_CAND} SELECT doc_id, rejected, reason, text_only, note, mismatch FROM judged",
    "rank_candidates": f"WITH {_CAND} SELECT song, doc_id, place FROM placed",
    "best_candidate": f"WITH {_CAND} SELECT song, doc_id, source FROM placed WHERE place = 1",
    "candidate_summary": f"""WITH {_CAND} SELECT doc_id, source, CASE WHEN text_only THEN 'unsynced' ELSE sync END AS effective_sync, n_words, duration, NOT rejected AND n_words > 0 AS usable,
      concat_ws('; ', note, CASE WHEN mismatch THEN 'mismatch:' || declared || ':' || sync END) AS notes FROM judged""",
    "first_word_synced": f"WITH {_CAND} SELECT song, min(doc_id) AS doc_id FROM judged WHERE sync IN ('word', 'syllable') AND NOT rejected AND NOT text_only GROUP BY song",
    "best_rendition": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) q WHERE k = 1",
    "top_variants": """SELECT l_returnflag, l_suppkey, n FROM (SELECT l_returnflag, l_suppkey, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) AS k FROM lineitem GROUP BY 1, 2) q WHERE k <= 3""",
    "removal_cap": """WITH t AS (SELECT conv_id, length(text) % 3 = 0 AS d, count(*) FILTER (length(text) % 3 = 0) OVER (PARTITION BY conv_id) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE text IS NOT NULL)
      SELECT conv_id, count(*) AS kept FROM t WHERE NOT d OR k > n * 0.25 GROUP BY conv_id""",
    "union_sources": """SELECT doc_id::VARCHAR AS id, 'documents' AS source, length(text) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT conv_id || '-' || turn, 'turns', length(text) FROM conversations WHERE text IS NOT NULL
      UNION ALL SELECT page_id::VARCHAR, 'pages', length(html) FROM pages WHERE html IS NOT NULL""",
    "fallback_union": """SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderpriority LIKE '2%'
      AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority LIKE '1%')""",
    "except_identical": f"WITH d AS (SELECT doc_id, source, md5({_K}) AS key FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM d WHERE source <> 'src0' AND key NOT IN (SELECT key FROM d WHERE source = 'src0')",
    "membership_diff": """WITH s AS (SELECT l_suppkey, l_linestatus, md5(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR)) AS parts FROM lineitem GROUP BY 1, 2)
      SELECT l_suppkey FROM s GROUP BY l_suppkey HAVING count(DISTINCT parts) > 1""",
    "toggle_selection": """WITH o AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F')) SELECT o_custkey FROM o GROUP BY o_custkey HAVING count(*) = 1""",
    "changed_fields": """WITH a AS (SELECT * FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS c_nationkey FROM customer WHERE c_custkey % 11 <> 0),
      j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_custkey AS x, b.c_custkey AS y, a.c_mktsegment IS DISTINCT FROM b.c_mktsegment AS m, a.c_nationkey IS DISTINCT FROM b.c_nationkey AS n FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)
      SELECT c_custkey, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS change, concat_ws(',', CASE WHEN m THEN 'c_mktsegment' END, CASE WHEN n THEN 'c_nationkey' END) AS fields FROM j WHERE x IS NULL OR y IS NULL OR m OR n""",
    "three_way_merge": """WITH o AS (SELECT o_orderstatus AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE o_orderstatus END AS m, CASE WHEN o_orderkey % 4 = 0 THEN 'B' ELSE o_orderstatus END AS t FROM orders)
      SELECT CASE WHEN m = t OR t = b THEN m WHEN m = b THEN t ELSE m END AS value, NOT (m = t OR t = b OR m = b) AS conflict, count(*) AS n FROM o GROUP BY 1, 2""",
}

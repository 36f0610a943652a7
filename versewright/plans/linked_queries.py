"""Registered queries: similar lines of versions, edits replayed on linked copies, disguised terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import siblings, similar, terms
from ..schema import events_as_words, in_lines, table


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as songs: the first turn is the text, the other turns are versions, their sentences lines."""
    t = table(spark, sf, "conversations").where("text is not null and conv_id is not null and turn is not null")
    lines = t.select(F.col("conv_id").alias("song"), F.col("turn").alias("version"), F.posexplode(F.split("text", r"[.!?\n]+")).alias("line_no", "line"))
    lines = lines.select("song", "version", "line_no", X.word_key(F.col("line")).alias("key")).where("key <> ''")
    first = lines.groupBy("song").agg(F.min("version").alias("_first"))
    met = lines.join(first, "song")
    return met.where("version = _first").select("song", "line_no", "key"), met.where("version <> _first").select("song", "version", "line_no", "key")


def similar_lines(spark: SparkSession, sf: str) -> DataFrame:
    return similar.similar_lines(*_versions(spark, sf))


def structure_match(spark: SparkSession, sf: str) -> DataFrame:
    return similar.structure_match(*_versions(spark, sf)).where(F.col("share") >= similar.SAME_STRUCTURE)


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of four to eight words in groups: lines 0 and 1 of every four belong to ``g1``."""
    w = in_lines(events_as_words(spark, sf))
    first = F.col("line_no") * 9000
    begin = (first + F.col("word_no") * 900 + F.col("value") % 300).cast("double")
    word = F.struct(F.concat("kind", F.lit(" ")).alias("text"), begin.alias("begin_ms"), (begin + 500).alias("end_ms"), (F.col("word_id") % 13 == 0).alias("explicit"), F.when(F.col("word_id") % 5 == 0, F.concat(F.lit("s"), F.col("line_no").cast("string"))).alias("syllable"))
    short = (F.col("song") + F.col("line_no")) % 3 == 0
    l = w.where(~short | (F.col("word_no") < 5)).groupBy("song", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", word.alias("w")))), lambda x: x["w"]).alias("words"))
    hit = F.col("line_no") % 4 < 2
    return l.withColumns({"group_id": F.when(hit, "g1"), "template_line": F.when(hit, F.col("line_no") % 4), "detached": (F.col("song") % 10 == 0) & (F.col("line_no") == 5)})


def _edits(lines: DataFrame) -> DataFrame:
    """Edits of the first copy: renamings, a word dropped, and a word cut in two with one more behind."""
    name = lambda i, t: f"struct({t} as text, words[{i}].begin_ms as begin_ms, words[{i}].end_ms as end_ms, words[{i}].explicit as explicit, words[{i}].syllable as syllable)"
    cut = "concat(slice(words, 1, 2), array(struct('left-' as text, words[2].begin_ms as begin_ms, words[2].begin_ms + 200D as end_ms, true as explicit, words[2].syllable as syllable), struct('right ' as text, words[2].begin_ms + 200D as begin_ms, words[2].end_ms as end_ms, false as explicit, words[2].syllable as syllable)), slice(words, 4, 100))"
    renamed = f"concat(array({name(0, chr(39) + 'Renamed ' + chr(39))}), slice(words, 2, 100))"
    after = F.when(F.col("song") % 3 == 0, F.expr(renamed)).when(F.col("song") % 3 == 1, F.expr("concat(slice(words, 1, 1), slice(words, 3, 100))")).otherwise(F.expr(cut))
    return lines.where("line_no < 2 and size(words) > 3").select("song", "line_no", "group_id", "template_line", F.col("words").alias("before"), after.alias("after"))


def propagate_words(spark: SparkSession, sf: str) -> DataFrame:
    lines = _copies(spark, sf)
    out = siblings.propagated_words(_edits(lines), lines)
    rounded = F.transform("words", lambda w: F.concat_ws("|", w["text"], F.round(w["begin_ms"]).cast("bigint").cast("string"), F.round(w["end_ms"]).cast("bigint").cast("string"), F.coalesce(w["syllable"], F.lit("-"))))
    return out.select("song", "line_no", "source", "how", "retimed", F.array_join(rounded, ",").alias("words"))


def divergent_edits(spark: SparkSession, sf: str) -> DataFrame:
    lines = _copies(spark, sf)
    return siblings.divergent_edits(_edits(lines), lines)


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    """Words of six letters in ``benchmark``, some bound to a word's begin."""
    word = table(spark, sf, "benchmark").select(F.explode(F.split(X.word_key(F.col("text")), " ")).alias("t")).where("length(t) = 6").distinct()
    return word.select(F.when(F.ascii("t") % 2 == 0, F.concat(F.lit("|"), "t")).otherwise(F.col("t")).alias("term"))


def _disguised(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines, their letters disguised in two of three; every third line is a copy of a template line."""
    t = table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    loud = F.translate(F.upper("text"), "AEOS", "@3Ø$")
    doubled = F.regexp_replace("text", "([aiu])", "$1$1")
    kind = F.col("turn") % 3
    linked = F.col("turn") % 2 == 0
    return t.select(
        F.floor(F.col("conv_id") / 8).alias("song"), (F.col("conv_id") % 8 * 100 + F.col("turn")).alias("line_no"), F.when(kind == 0, F.col("text")).when(kind == 1, loud).otherwise(doubled).alias("text"),
        F.when(linked, "g1").alias("group_id"), F.when(linked, F.col("turn")).alias("template_line"), (F.col("conv_id") % 8).alias("instance"), (F.col("conv_id") % 11 == 0).alias("detached"), F.lit("words").alias("field"),
    )


def disguised_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_hits(_disguised(spark, sf), _terms(spark, sf)).select("song", "line_no", "word_at", "word")


def term_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    out = terms.suggestions(terms.term_hits(_disguised(spark, sf), _terms(spark, sf)))
    return out.select("song", "fingerprint", "line_no", "word_at", "word", "copies", F.array_join("lines", ",").alias("lines"))


QUERIES = [similar_lines, structure_match, propagate_words, divergent_edits, disguised_terms, term_suggestions]
SQL: dict[str, str] = {}

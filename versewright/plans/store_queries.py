"""Registered queries: what songs leave in storage, and small rules around jobs and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LINES, SONG_SQL, song_words, table
from ..sources import stores
from ..streaming import progress


def stored_lyrics(spark: SparkSession, sf: str) -> DataFrame:
    """Songs' lines through JSON; lines of every ninth song are broken on the way, as text in place of a number."""
    w = song_words(spark, sf)
    word = F.struct("text", "begin_ms", "end_ms", "confidence", F.array(F.lit("x")).alias("flags"))
    track = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("track") == n, F.struct("word_no", word.alias("w"))))), lambda x: x["w"])
    l = w.groupBy("song", "line_no").agg(track("main").alias("words"), track("bg").alias("background"), F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"))
    l = l.select(F.col("song").cast("string").alias("song"), F.when(F.col("song") % 9 == 0, "first").otherwise(F.col("line_no").cast("string")).alias("line_no"), F.lit("v1").alias("agent"), "begin_ms", "end_ms", "words", "background", (F.col("song") % 4).alias("bucket"))
    path = progress.passing_folder(spark, "lyrics")
    numbers = l.where("line_no <> 'first'").withColumn("line_no", F.col("line_no").cast("int"))
    stores.save_lyrics(numbers, f"{path}/right")
    stores.save_lyrics(l.where("line_no = 'first'"), f"{path}/wrong")
    back = stores.load_lyrics(spark, f"{path}/right").unionByName(stores.load_lyrics(spark, f"{path}/wrong"))
    assert set(LINES.names) <= set(back.columns)
    return back.select("song", "line_no", "begin_ms", "end_ms", F.size("words").alias("words"), F.size("background").alias("background"))


def cached_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sources, line items as cached values made on their receipt days."""
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 7).alias("modified"))
    cache = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").cast("bigint").alias("made"), F.col("l_partkey").alias("value"))
    fresh, again = stores.fresh_cache(wanted, cache, ("item",))
    return fresh.select("item", "value").unionByName(again.select("item", F.lit(None).cast(fresh.schema["value"].dataType).alias("value")))


def benchmark_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders as songs with a truth."""
    meta = table(spark, sf, "customer").select(F.col("c_custkey").alias("song"), "c_name")
    truth = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("song")).agg(F.count("*").alias("lines"))
    return stores.benchmark_songs(meta, truth)


def saved_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidates of jobs, those of job 0 saved a second time."""
    p = table(spark, sf, "part").select((F.col("p_partkey") % 4).cast("int").alias("job"), F.col("p_partkey").alias("number"), F.col("p_name").alias("content"))
    path = progress.passing_folder(spark, "candidates")
    stores.save_candidates(p, path)
    stores.save_candidates(p.where("job = 0 and number % 8 = 0").withColumn("content", F.lit("new")), path)
    return spark.read.schema(p.schema).parquet(path).select("job", "number", "content")


def source_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as queries to sources that need a title and artist, also a length and a video, or an album or a length."""
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).alias("track"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_brand")).otherwise("").alias("artist"), (F.col("p_size") % 3).alias("duration"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("album"), F.when(F.col("p_partkey") % 3 == 0, "v").alias("video"))
    base = (("track",), ("artist",))
    return p.select("p_partkey", stores.can_search(base).alias("plain"), stores.can_search((*base, ("duration",), ("video",))).alias("exact"), stores.can_search((*base, ("album", "duration"))).alias("either"))


def event_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Events sent to the subscribers of their user: two for even users, one for others."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "purchase", "status").when(F.col("event_type") == "click", "progress").otherwise("event")
    rows = e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("step").alias("label"), (F.col("event_id") % 16 / 16).alias("fraction"), F.lit(None).cast("string").alias("detail"), kind.alias("kind"))
    jobs = e.select(F.col("user_id").alias("job")).distinct()
    listening = jobs.select("job", F.explode(F.when(F.col("job") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("subscriber"))
    sent = stores.payloads(rows, listening, F.col("kind"))
    field = lambda k: F.get_json_object("payload", f"$.{k}")
    return sent.select("subscriber", "job", "seq", field("type").alias("type"), field("status").alias("status"), field("event.stage").alias("stage"), (field("fraction").cast("double") * 10_000).cast("bigint").alias("share"))


def answered_language(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' languages after answers that are right, wrong, too long or none."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.element_at(F.array(F.lit("en"), F.lit("EN"), F.lit("eng"), F.lit(None).cast("string")), (F.col("doc_id") % 4 + 1).cast("int")).alias("answer"))
    now, changed = stores.answered_language(F.col("answer"), F.col("lang"))
    return d.select("doc_id", now.alias("language"), changed.alias("changed"))


def track_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as found tracks, in the four fields that are shown of one."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_name").alias("title"), F.array("p_brand").alias("artists"), F.col("p_partkey").cast("string").alias("video_id"), F.lit(None).cast("string").alias("cover_url")).select("title", F.array_join("artists", ", ").alias("artists"), "video_id", F.coalesce("cover_url", F.lit("-")).alias("cover_url"))


def split_reading(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose second word was cut in two, both halves with a reading; every seventh word has none."""
    w = song_words(spark, sf).where("track = 'main'")
    word = F.struct("text", F.when(F.col("word_id") % 7 > 0, F.concat(F.lit("r"), F.trim("text"))).alias("reading"), F.when(F.col("word_id") % 5 == 0, "-").alias("joiner"))
    l = w.groupBy("song", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", word.alias("w")))), lambda x: x["w"]).alias("words")).where("size(words) > 1")
    parts = F.array(F.struct(F.lit("a").alias("text"), F.lit("ra").alias("reading"), F.lit(None).cast("string").alias("joiner")), F.struct(F.lit("b ").alias("text"), F.lit("rb").alias("reading"), F.lit(None).cast("string").alias("joiner")))
    text, status = stores.split_reading(F.col("words"), F.lit(1), parts)
    return l.select("song", "line_no", text.alias("reading"), status.alias("status"))


QUERIES = [stored_lyrics, cached_items, benchmark_scan, saved_candidates, source_eligibility, event_fanout, answered_language, track_summary, split_reading]

SQL = {
    "stored_lyrics": f"WITH {SONG_SQL} SELECT song::VARCHAR AS song, line_no, min(begin_ms) AS begin_ms, max(end_ms) AS end_ms, count(*) FILTER (track = 'main') AS words, count(*) FILTER (track = 'bg') AS background FROM sw WHERE song % 9 > 0 GROUP BY 1, 2",
    "cached_items": """WITH c AS (SELECT l_orderkey AS item, max(l_linenumber) AS made, arg_max(l_partkey, (l_linenumber, l_partkey)) AS value FROM lineitem GROUP BY 1)
      SELECT o_orderkey AS item, CASE WHEN made >= o_orderkey % 7 THEN value END AS value FROM orders LEFT JOIN c ON c.item = o_orderkey""",
    "benchmark_scan": "SELECT c_custkey AS song, c_name, count(*) AS lines FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "saved_candidates": "SELECT CAST(p_partkey % 4 AS INT) AS job, p_partkey AS number, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_name END AS content FROM part WHERE p_partkey % 4 > 0 OR p_partkey % 8 = 0",
    "source_eligibility": """WITH p AS (SELECT p_partkey, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS plain, p_size % 3 > 0 AS d, p_partkey % 2 = 0 AS a, p_partkey % 3 = 0 AS v FROM part) SELECT p_partkey, plain, plain AND d AND v AS exact, plain AND (a OR d) AS either FROM p""",
    "event_fanout": """SELECT unnest(CASE WHEN user_id % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS subscriber, user_id AS job, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'status' WHEN 'click' THEN 'progress' ELSE 'event' END AS type, CASE WHEN event_type = 'purchase' THEN 'done' END AS status,
      CASE WHEN event_type NOT IN ('purchase', 'click') THEN event_type END AS stage, CASE WHEN event_type = 'click' THEN CAST(event_id % 16 * 625 AS BIGINT) END AS share FROM events""",
    "answered_language": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS language, doc_id % 4 = 0 AND lang IS DISTINCT FROM 'en' AS changed FROM documents",
    "track_summary": "SELECT p_name AS title, p_brand AS artists, p_partkey::VARCHAR AS video_id, '-' AS cover_url FROM part",
    "split_reading": f"""WITH {SONG_SQL}, m AS (SELECT *, max(word_no) OVER (PARTITION BY song, line_no) AS last FROM sw WHERE track = 'main'), l AS (SELECT song, line_no, bool_and(word_id % 7 > 0 OR word_no = 1) AS whole,
      string_agg(CASE WHEN word_no = 1 THEN 'ra rb' || CASE WHEN last > 1 THEN '  ' ELSE '' END ELSE 'r' || trim(text, ' ') || CASE WHEN word_no = last THEN '' WHEN word_id % 5 = 0 THEN '-' WHEN text LIKE '% ' THEN '  ' ELSE ' ' END END, '' ORDER BY word_no) AS reading FROM m WHERE last > 0 GROUP BY 1, 2)
      SELECT song, line_no, CASE WHEN whole THEN reading END AS reading, CASE WHEN whole THEN 'confirmed' END AS status FROM l""",
}

"""Registered queries: streams with state of their own, on ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import progress, stateful

HOURS = 3_600_000_000


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return progress.event_stream(spark, f"{sf}/events.parquet")


def progress_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """Users as jobs, kinds of events as bars; a value of 200 or more is a full bar."""
    e = _stream(spark, sf).select(F.col("user_id").alias("job"), F.col("event_type").alias("bar"), F.col("event_id").alias("seq"), "ts", (F.col("value") / 200).alias("fraction"))
    return stateful.run_with_state(spark, stateful.throttled(e, 24 * HOURS)).select("job", "bar", "seq", F.round("fraction", 9).alias("fraction"))


def client_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Users as jobs: errors open the connection anew, purchases are statuses, clicks progress."""
    kind = F.col("event_type")
    e = _stream(spark, sf).select(
        F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts",
        F.when(kind == "error", "open").when(kind == "purchase", "status").when(kind == "click", "progress").otherwise("event").alias("kind"),
        F.concat(F.lit("stage "), (F.col("event_id") % 4).cast("string")).alias("stage"), F.concat(F.lit("status "), (F.col("event_id") % 3).cast("string")).alias("status"),
        F.when(F.col("event_id") % 3 == 0, "failed").alias("error"), (F.col("value") / 500).alias("fraction"), F.lit("").alias("detail"),
    )
    out = stateful.run_with_state(spark, stateful.client_state(e), mode="update")
    shown = F.transform(F.arrays_zip("stages", "fractions"), lambda b: F.concat_ws("=", b["stages"], F.round(b["fractions"] * 1000).cast("bigint").cast("string")))
    return out.select("job", "status", "error", F.array_join(shown, ",").alias("progress"), "events", "last_seq")


QUERIES = [progress_throttle, client_fold]

SQL = {
    "progress_throttle": """WITH RECURSIVE e AS (
        SELECT user_id AS job, event_type AS bar, event_id AS seq, epoch_us(ts) AS us, least(1.0, value / 200) AS f, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events
      ), r AS (SELECT job, bar, seq, f, k, us AS last, true AS passed FROM e WHERE k = 1
        UNION ALL SELECT e.job, e.bar, e.seq, e.f, e.k, CASE WHEN e.us - r.last >= 86400000000 OR e.f = 1 THEN e.us ELSE r.last END, e.us - r.last >= 86400000000 OR e.f = 1 FROM r JOIN e ON e.job = r.job AND e.bar = r.bar AND e.k = r.k + 1)
      SELECT job, bar, seq, round(f, 9) AS fraction FROM r WHERE passed""",
    "client_fold": """WITH e AS (SELECT user_id AS job, event_id AS seq, event_type AS kind, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
      ), o AS (SELECT job, max(k) FILTER (kind = 'error') AS opened FROM e GROUP BY job
      ), s AS (SELECT e.*, k > coalesce(opened, 0) AS fresh FROM e JOIN o ON o.job = e.job
      ), b AS (SELECT job, 'stage ' || seq % 4 AS stage, arg_max(value / 500, k) AS f FROM s WHERE kind = 'click' AND fresh GROUP BY 1, 2
      ), p AS (SELECT job, string_agg(stage || '=' || CAST(round(f * 1000) AS BIGINT), ',' ORDER BY stage) AS progress FROM b GROUP BY job
      ), j AS (SELECT job, 'status ' || arg_max(seq, k) FILTER (kind = 'purchase') % 3 AS status, CASE WHEN arg_max(seq, k) FILTER (kind = 'purchase') % 3 = 0 THEN 'failed' END AS error,
        count(*) FILTER (fresh AND kind NOT IN ('error', 'purchase', 'click')) AS events, arg_max(seq, k) FILTER (fresh AND kind NOT IN ('error', 'purchase', 'click')) AS last_seq FROM s GROUP BY job)
      SELECT j.job, status, error, coalesce(progress, '') AS progress, events, last_seq FROM j LEFT JOIN p ON p.job = j.job""",
}

"""Registered queries: jobs, their events and reports, on ``events`` as job events and ``labels`` as reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import table
from ..streaming import jobs, progress



def _state(column: str = "event_type"):
    return F.when(F.col(column) == "purchase", "done").when(F.col(column) == "login", "failed").otherwise("running")


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Users as jobs; the last event says how a job stands."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("events"), F.min("ts").alias("created")).withColumn("status", _state("last"))


def job_store(spark: SparkSession, sf: str) -> DataFrame:
    """Stored jobs, of which only the folder of finished ones is read."""
    path = progress.passing_folder(spark, "jobs")
    progress.gone_at_exit(spark, f"{path}-again")
    own = _jobs(spark, sf).select("job", "events", "status")
    jobs.save_jobs(own, path)
    jobs.save_jobs(jobs.read_jobs(spark, path, own.schema, "failed").withColumn("events", F.lit(0).cast("bigint")), f"{path}-again")
    return jobs.read_jobs(spark, path, own.schema, "done").unionByName(jobs.read_jobs(spark, f"{path}-again", own.schema)).select("job", "events", "status")


def finished_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.finished(_jobs(spark, sf)).select("job", "events")


def job_details(spark: SparkSession, sf: str) -> DataFrame:
    reports = table(spark, sf, "labels").select(F.col("doc_id").alias("job"), "quality", "toxic")
    return jobs.details(_jobs(spark, sf), reports).select("job", "status", "quality", "toxic")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of a stream appended to the log as it comes."""
    stream = progress.event_stream(spark, f"{sf}/events.parquet")
    log = progress.run_once(stream.select("user_id", "event_id", _state().alias("state")), mode="append")
    return log.groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "done").alias("done"))


def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    frame = jobs.frames(e, F.when(_state() == "running", "progress").otherwise("status"), F.struct(F.col("user_id").alias("job"), F.col("event_id").alias("event"), _state().alias("state")))
    return e.select("event_id", F.md5(frame).alias("digest"))


def subscription(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.until_final(table(spark, sf, "events"), _state(), "user_id", "ts", "event_id").select("event_id", _state().alias("state"))


def stage_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each job as its stages."""
    e = table(spark, sf, "events").withColumn("stage", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    s = e.select(F.col("user_id").alias("job"), "stage", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("began"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("ended"), (F.col("event_id") % 17 == 0).alias("failed"))
    return jobs.stage_reports(s, "job", "stage").select("job", F.col("stage").cast("bigint").alias("stage"), "state")


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    now = e.groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("modified"))
    known = e.where("event_id % 40 <> 0 and user_id % 9 <> 0").groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("modified"))
    return jobs.changed_files(known, now, _jobs(spark, sf).where("status = 'running' and job % 2 = 0")).select("job")


def pipeline_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Which lyrics are checked by a transcript, and which model places them."""
    d = table(spark, sf, "documents")
    source = F.when(F.col("doc_id") % 4 == 0, "user").when(F.col("doc_id") % 4 == 1, "file").when(F.col("doc_id") % 4 == 2, F.col("source"))
    witness = jobs.wants_witness(F.col("doc_id") % 3 != 0, F.col("n_chars") > 500, source, F.col("doc_id") % 5 == 0)
    model = jobs.aligner_model(F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "-x").otherwise("")), ("en", "de"), "singing", "speech")
    return d.select("doc_id", witness.alias("witness"), model.alias("model"))


QUERIES = [job_store, finished_jobs, job_details, event_log, event_frames, subscription, stage_reports, changed_files, pipeline_rules]

_ST = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'login' THEN 'failed' ELSE 'running' END"
_JOBS = f"""WITH j AS (SELECT user_id AS job, arg_max({_ST}, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY 1)"""

SQL = {
    "job_store": f"{_JOBS} SELECT job, CASE WHEN status = 'failed' THEN 0 ELSE events END AS events, status FROM j WHERE status <> 'running'",
    "finished_jobs": f"{_JOBS} SELECT job, events FROM j WHERE status = 'done'",
    "job_details": f"{_JOBS} SELECT job, status, quality, toxic FROM j LEFT JOIN labels ON doc_id = job",
    "event_log": f"SELECT user_id AS job, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS done FROM events GROUP BY 1",
    "event_frames": f"""SELECT event_id, md5('event: ' || CASE WHEN event_type IN ('purchase', 'login') THEN 'status' ELSE 'progress' END || chr(10) || 'data: {{"job":' || user_id || ',"event":' || event_id || ',"state":"' || {_ST} || '"}}' || chr(10) || chr(10)) AS digest FROM events""",
    "subscription": f"""WITH b AS (SELECT *, count(*) FILTER (event_type IN ('purchase', 'login')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM events) SELECT event_id, {_ST} AS state FROM b WHERE k = 0""",
    "stage_reports": """WITH s AS (SELECT user_id AS job, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stage FROM events), f AS (SELECT *, coalesce(bool_or(event_id % 17 = 0) OVER (PARTITION BY job ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS broken FROM s)
      SELECT job, stage, CASE WHEN broken THEN 'skipped' WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_id % 3 = 0 THEN 'running' ELSE 'done' END AS state FROM f""",
    "changed_files": f"""{_JOBS}, n AS (SELECT user_id AS job, max(ts) AS m, max(ts) FILTER (event_id % 40 <> 0 AND user_id % 9 <> 0) AS was FROM events GROUP BY 1) SELECT n.job FROM n JOIN j ON j.job = n.job WHERE (was IS NULL OR m > was) AND NOT (status = 'running' AND n.job % 2 = 0)""",
    "pipeline_rules": """SELECT doc_id, doc_id % 3 <> 0 AND n_chars > 500 AND doc_id % 4 > 1 AND doc_id % 5 <> 0 AS witness, CASE WHEN lang IN ('en', 'de') THEN 'singing' ELSE 'speech' END AS model FROM documents""",
}

"""Jobs as tables: a store partitioned by status, an event log, frames for subscribers, stage reports, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: States of a job that end it.
FINAL = ("done", "failed")


def save_jobs(jobs: DataFrame, path: str) -> None:
    """Replace the stored jobs of the statuses that ``jobs`` has; each status is a folder."""
    jobs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status").parquet(path)


def read_jobs(spark: SparkSession, path: str, schema: StructType, *statuses: str) -> DataFrame:
    """The stored jobs, of some statuses only if they are named: only their folders are read.  An empty store gives no rows."""
    jobs = spark.read.schema(schema).parquet(path)
    return jobs.where(F.col("status").isin(*statuses)) if statuses else jobs


def finished(jobs: DataFrame) -> DataFrame:
    """Jobs whose result may be read, edited or aligned again."""
    return jobs.where("status = 'done'")


def details(jobs: DataFrame, reports: DataFrame, job: str = "job") -> DataFrame:
    """Every job with its report, if it has one."""
    return jobs.join(reports, job, "left")


def frames(events: DataFrame, kind: Column, payload: Column) -> Column:
    """Each event as a server-sent frame: its kind, its payload as JSON, and an empty line."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def until_final(events: DataFrame, state: Column, job: str, *order: str) -> DataFrame:
    """What a subscriber of each job gets: its events in order, up to the first that ends the job."""
    before = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_ended", F.coalesce(F.max(state.isin(*FINAL)).over(before), F.lit(False))).where("not _ended").drop("_ended")


def stage_reports(stages: DataFrame, by: str, order: str) -> DataFrame:
    """Stages (began, ended, failed) of jobs as ``running``, ``done``, ``skipped`` or ``failed``; nothing runs after a failure."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    broken = F.coalesce(F.max("failed").over(before), F.lit(False))
    state = F.when(broken, "skipped").when(F.col("failed"), "failed").when(F.col("began").isNull(), "skipped").when(F.col("ended").isNull(), "running").otherwise("done")
    return stages.withColumn("state", state)


def changed_files(known: DataFrame, now: DataFrame, running: DataFrame, job: str = "job") -> DataFrame:
    """Jobs to read again: their file is new or its time has moved on, and they do not run here."""
    met = now.join(known.select(job, F.col("modified").alias("_was")), job, "left")
    return met.where(F.col("_was").isNull() | (F.col("modified") > F.col("_was"))).join(running.select(job), job, "left_anti").drop("_was")


def wants_witness(enabled: Column, has_audio: Column, source: Column, transcribed: Column) -> Column:
    """Whether a transcript is made to check lyrics: only for lyrics that neither a user nor a file gave, and once."""
    return enabled & has_audio & ~F.coalesce(source.isin("user", "file"), F.lit(False)) & ~transcribed


def aligner_model(language: Column, supported: tuple[str, ...], first: str, fallback: str) -> Column:
    """The singing model where it knows the language, else the fallback."""
    return F.when(F.split_part(language, F.lit("-"), F.lit(1)).isin(*supported), first).otherwise(fallback)

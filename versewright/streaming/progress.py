"""Job progress as streams: the stage view, time windows, sessions, deduplication and throttling."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATE = "60 days"


def event_stream(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Events arriving as Parquet files; times are made zoned for watermarks."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if path.endswith(".parquet"):
        # A file source watches a folder: the file itself is picked by a filter.
        folder, name = path.rsplit("/", 1)
        reader, path = reader.option("pathGlobFilter", name), folder
    events = reader.parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def stage_view(events: DataFrame) -> DataFrame:
    """Per job and stage: last status, first time, how many events; for update or complete mode."""
    return events.groupBy("job", "stage").agg(F.max_by("status", F.struct("at", "event_id")).alias("last_status"), F.min("at").alias("started"), F.count("*").alias("events"))


def tumbling(events: DataFrame, width: str, *keys: str) -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


def sliding(events: DataFrame, width: str, step: str, *keys: str) -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, *keys: str) -> DataFrame:
    """History and live events together without repeats."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(list(keys))


def throttled(events: DataFrame, width: str = "250 milliseconds") -> DataFrame:
    """At most one progress value per job and window, the latest."""
    latest = F.max_by(F.struct("value", "event_id"), F.struct("ts", "event_id"))
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "user_id").agg(latest.alias("last"))


def run_once(stream: DataFrame, sink: Callable[[DataFrame], None] | None = None, mode: str = "complete") -> DataFrame:
    """All that has arrived, through the streaming engine into a table in the shared folder, read back.

    Every batch's result is written under its number, so a batch that runs
    twice after a failure overwrites itself.  In complete mode the last
    batch is the result, in append and update mode all are.  The folder goes
    when the driver ends.
    """
    spark = stream.sparkSession
    base = passing_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink or write).start()
    query.awaitTermination()
    done = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    if mode == "complete":
        newest = done.agg(F.max("batch")).first()[0]
        done = done.where(F.col("batch") == newest)
    return done.drop("batch")


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver delete ``path`` when it ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new folder among those that all executors share; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    gone_at_exit(spark, path)
    return path


def shared_folder(spark: SparkSession) -> str:
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="versewright-stream-")

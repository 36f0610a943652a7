"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, ``[\x20\x09-\x0D]``.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    It is the one in ``spark.checkpoint.dir`` (or set on the context).  Only
    a local session without one gets a temporary folder; on a cluster a
    missing setting is an error, since a machine-local folder would be lost
    with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="versewright-checkpoints-")
    context.setCheckpointDir(configured)
    return configured


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver delete ``path`` when it ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def frozen(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back, its lineage cut.

    The table is compressed, unlike a checkpoint of rows, and goes when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/versewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 512 rows and 2 MiB and Parquet batches of 512 rows for this session, unless it has its own setting.

    A worker holds a batch of texts and its copy at once.  This is a choice
    of the queries and the pipeline; the operators leave settings alone.
    """
    for key, usual, wanted in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"),
        ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512"),
    ):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, wanted)


def row_key(doc_id: str, text: str) -> Column:
    """A document's name by content: its id and a hash of its text.

    It does not depend on the order in which a table is read, so it can be
    made again in a later job.  Only repeated rows share it.
    """
    shown = F.coalesce(F.concat(F.lit("+"), F.col(doc_id).cast("string")), F.lit("-"))
    return F.concat_ws(":", shown, F.hex(F.xxhash64(F.col(text).cast("string"), F.col(text).isNull())))


def utf8_values(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, one object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """``batch`` without ``drop`` and with ``new`` columns at its end."""
    names = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces whose ``column`` holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of ``batches``, which are sorted by the first, in parts that never end inside a group; each row is copied once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held and columns[0][-1] == held[-1][0][-1]:
            held.append(columns)  # the group goes on
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        held.append([c[:cut] for c in columns])
        yield [np.concatenate(c) for c in zip(*held)]
        held = [[c[cut:] for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]

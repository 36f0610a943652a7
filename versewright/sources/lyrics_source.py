"""A Spark data source for folders of timed-text files: ``spark.read.format("lyrics").load(path)``.

Files are listed once and read by tasks, ``FILES`` to a partition.  This source
is for local and mounted folders; :func:`read_folder` gives the same table, by
the same rules, through Spark's own binary reader for any store.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "song string, format string, content string"
SUFFIXES = {".lrc": "lrc", ".qrc": "qrc", ".xml": "qrc", ".ttml": "ttml", ".srt": "srt", ".txt": "plain"}


def sniff(name: str, content: str) -> str:
    """Format by suffix, or by content where the suffix says too little."""
    kind = SUFFIXES.get(os.path.splitext(name)[1].lower(), "plain")
    if kind == "plain":
        head = content.lstrip()[:400]
        if head.startswith("<") and "<tt" in head:
            return "ttml"
        if "QrcInfos" in head:
            return "qrc"
        if head.startswith("[") and any(c.isdigit() for c in head[1:3]) and ":" in head[:8]:
            return "lrc"
    return kind


#: Files of one partition.
FILES = 64


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "**", "*"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        files = [p for p in found if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_"))]
        return [_Files(files[i : i + FILES]) for i in range(0, len(files), FILES)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, encoding="utf-8", errors="replace", newline="") as f:
                content = f.read()
            name = os.path.basename(path)
            yield os.path.splitext(name)[0], sniff(name, content), content


class LyricsSource(DataSource):
    """Whole files as ``song, format, content``."""

    @classmethod
    def name(cls) -> str:
        return "lyrics"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LyricsSource)


def read_folder(spark: SparkSession, path: str):
    """The same table through Spark's binary reader, for any store that Spark can open."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    content = F.decode("content", "UTF-8")
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), suffix), F.lit("plain"))
    head = F.substring(F.regexp_replace(content, r"^\s+", ""), 1, 400)
    sniffed = F.when(F.startswith(head, F.lit("<")) & F.contains(head, F.lit("<tt")), "ttml").when(F.contains(head, F.lit("QrcInfos")), "qrc").when(head.rlike(r"^\[(?=.?\d|\d)[^:]{0,6}:"), "lrc").otherwise("plain")
    kind = F.when(named == "plain", sniffed).otherwise(named)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("song"), kind.alias("format"), content.alias("content"))

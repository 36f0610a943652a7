"""URL rules by a sort-merge range join.

A key is a host's labels in reverse, each closed by ``\\x01``, then ``\\x00``
and the path: ``http://a.example.net/en/x`` has the key
``net\\x01example\\x01a\\x01\\x00/en/x``.  Everything that a rule fits on its own host
begins with the rule's key, so a rule is an interval of keys, and two rules'
intervals are nested or apart.  For subdomains each URL is looked up once for
its host and once for every parent of it (three or four keys).  Keys and
rules are sorted together, and a sweep over each sorted range keeps a stack
of the rules that are open there, each nested in the one below; its top is
the longest rule for a key.  Of a URL's keys the longest rule (characters of
host and path together, then of the host) wins.

The ranges are cut at keys of a sample of bounded size, by (key, page), so
one host or one path with a third of all rows spreads over many ranges.  A
rule is sent to each range that its interval meets: once, but for the few
nested ones that are open where a range begins.  No task gathers the rules
of a host; rules can be as many as rows.

Defined results: a null url, or one without ``://``, has an empty host and
path and gets the default verdict; null rules and rules without a host are
ignored, of equal rules with different verdicts ``block`` wins; repeated rows
are counted first and judged once; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen

#: Sampled keys per range.
SAMPLED = 20
DEFAULT = "allow"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    """A host's labels in reverse; the three letters that keys are built with are written otherwise."""
    for letter, name in (("\x02", "\x02c"), ("\x01", "\x02b"), ("\x00", "\x02a")):
        host = F.replace(host, F.lit(letter), F.lit(name))
    return F.reverse(F.split(host, r"\."))


def host_key(labels: Column) -> Column:
    """Labels, each closed by \\x01, and the end of the host."""
    return F.concat(F.array_join(labels, "\x01"), F.lit("\x01\x00"))


def after(prefix: str) -> str:
    """The least string above all that begin with ``prefix``, which holds a letter that is not the last of all."""
    prefix = prefix.rstrip("\U0010ffff")
    point = ord(prefix[-1]) + 1
    return prefix[:-1] + chr(0xE000 if point == 0xD800 else point)


def rules_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(host, path, verdict)`` rows as a table of rules."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _bounds(urls: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Where ranges begin, from the keys of a bounded sample chosen by a hash of the page."""
    wanted = ranges * SAMPLED
    sample = urls.select("key", "tie").orderBy(F.xxhash64("tie", "key"), "tie").limit(wanted).collect()
    ordered = sorted((r["key"], r["tie"]) for r in sample)
    step = len(ordered) / ranges
    return sorted({ordered[int(i * step)] for i in range(1, ranges) if ordered and int(i * step) < len(ordered)})


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", ranges: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``."""
    spark = pages.sparkSession
    if ranges is None:
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    link = F.col(url).cast("string")
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"))
    urls = urls.groupBy("page_id", "host", "path").agg(F.count("*").alias("n"))
    labels = urls.withColumn("labels", _labels(F.col("host")))
    keys = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.concat(host_key(F.slice("labels", 1, k)), F.col("path")))
    probes = frozen(labels.select("page_id", "host", "path", F.when(F.col("host") == "", F.lit(0)).otherwise(F.size("labels")).alias("hosts"), "n", F.posexplode(keys).alias("level", "key")))
    # Only the row of the whole host stands for the page in the end.
    probes = probes.withColumn("n", F.when(F.col("level") + 1 == F.greatest("hosts", F.lit(1)), F.col("n")).otherwise(F.lit(0)))
    probes = probes.select("page_id", "host", "path", "n", "key", F.xxhash64("page_id", "host", "path").alias("tie"))
    bounds = _bounds(probes, ranges)
    places = spark.sparkContext.broadcast(bounds)  # at most one for each range

    clean = rules.where("host <> '' and path is not null and verdict is not null")
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
    clean = clean.select(F.concat(host_key(_labels(F.col("host"))), "path").alias("key"), "host", "path", "verdict")

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, low = places.value, -(1 << 63)
        for batch in batches:
            spans = [range(bisect_right(cuts, (k, low)), bisect_left(cuts, (after(k), low)) + 1) for k in batch.column(0).to_pylist()]
            again = batch.take(pa.array([i for i, s in enumerate(spans) for _ in s], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r for s in spans for r in s], pa.int32()), *again.columns], names=["part", *batch.schema.names])

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = places.value
        for batch in batches:
            part = [bisect_right(cuts, x) for x in zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    kind = urls.schema["page_id"].dataType.simpleString()
    rule_rows = clean.mapInArrow(deal_rules, "part int, key string, host string, path string, verdict string")
    rule_rows = rule_rows.select("part", F.lit(None).cast(kind).alias("page_id"), "host", "path", F.lit(-1).cast("bigint").alias("n"), "key", F.lit(0).cast("bigint").alias("tie"), "verdict", F.lit(0).alias("kind"))
    url_rows = probes.mapInArrow(deal_urls, f"part int, page_id {kind}, host string, path string, n bigint, key string, tie bigint")
    url_rows = url_rows.withColumns({"verdict": F.lit(None).cast("string"), "kind": F.lit(1)})
    together = url_rows.unionByName(rule_rows).repartitionByRange(ranges, "part").sortWithinPartitions("part", "key", "kind", "tie")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # of (key, rank, characters of the host, rule, verdict)
        for batch in batches:
            keep, found = [], []
            columns = (batch.column(c).to_pylist() for c in ("part", "key", "n", "host", "path", "verdict"))
            for i, (at, key, n, host, path, verdict) in enumerate(zip(*columns)):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if n < 0:
                    stack.append((key, len(host) + len(path), len(host), host + path, verdict))
                elif stack or n:
                    keep.append(i)
                    found.append(stack[-1][1:] if stack else (-1, -1, None, None))
            rows = batch.take(pa.array(keep, pa.int64()))
            new = [pa.array(list(c), k) for c, k in zip(list(zip(*found)) or [()] * 4, (pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("page_id", "host", "path", "n")] + new, names=["page_id", "host", "path", "n", "rank", "size", "rule", "verdict"])

    swept = together.mapInArrow(sweep, f"page_id {kind}, host string, path string, n bigint, rank int, size int, rule string, verdict string")
    best = swept.groupBy("page_id", "host", "path").agg(F.sum("n").alias("n"), F.max(F.struct("rank", "size", "rule", "verdict")).alias("best"))
    every = best.select("page_id", "host", "path", "best", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return every.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))

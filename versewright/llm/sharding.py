"""Sharding over fixed virtual slots, in SQL functions only.

A record's slot is a hash of its key and never changes.  Bytes are summed
per slot, and a versioned map says which shard holds each slot; rebalancing
writes a new version of the map and moves as few slots as it can.  The map
and the slot sums have ``slots`` rows whatever the input's size, so they may
be broadcast and gathered; records are only hashed, counted per slot and
joined with the map.

Sums combine before their shuffle, and numbering inside a shard is done per
slot, thousands of independent tasks, after which slots are laid end to end.
A document's key is its id and a checksum of its text, so neither null nor
repeated ids share a slot.  Rows that are the same in both are told apart by their
number among their like, which is part of the key too: a record that makes
up a third of the table is dealt over all slots like other records, and
however the table is split, as many of its rows are in a slot.

Defined results: a null text has no bytes; a null key hashes like the empty
string; repeated rows are numbered one after another; an empty table gives
an empty result and a map of evenly dealt slots; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frozen

SLOTS = 4096
SHARDS = 16


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, fixed by its key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text and one more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def slot_bytes(records: DataFrame, slot: str = "vslot", size: str = "size", slots: int = SLOTS) -> DataFrame:
    """``(vslot, bytes, n)`` of all slots, empty ones included."""
    sums = records.groupBy(F.col(slot).alias("vslot")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(sums), "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def edited_map(sums: DataFrame, shards: int = SHARDS, previous: DataFrame | None = None, version: int = 1) -> DataFrame:
    """The next version of the map: ``(version, vslot, shard)``.

    Slots of ``previous`` stay in their shard, smallest first, as long as its
    bytes stay within an even share, so few and large ones move; these, largest
    first, go to the shard that has least.  Without ``previous`` every slot is dealt so.  ``sums`` has one
    row per slot, a fixed number, and is folded in one row.
    """
    if previous is None:
        placed = sums.withColumn("home", F.lit(None).cast("int"))
    else:
        placed = sums.join(F.broadcast(previous.select("vslot", F.col("shard").alias("home"))), "vslot", "left")
    placed = placed.withColumn("home", F.when(F.col("home") < shards, F.col("home")))
    total = placed.withColumn("total", F.sum("bytes").over(Window.partitionBy(F.lit(0))))
    running = F.sum("bytes").over(Window.partitionBy("home").orderBy("bytes", "vslot"))
    kept = total.withColumn("stays", F.col("home").isNotNull() & (running <= F.col("total") / shards))
    rows = kept.groupBy().agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), F.col("vslot").alias("vslot"))))).alias("loose"),
        F.collect_list(F.when(F.col("stays"), F.struct(F.col("home").alias("shard"), F.col("vslot").alias("vslot"), F.col("bytes").alias("bytes")))).alias("fixed"),
    )
    rows = rows.selectExpr(
        "loose", "fixed",
        f"transform(sequence(0, {shards - 1}), s -> aggregate(fixed, 0L, (acc, x) -> acc + if(x.shard = s, x.bytes, 0L))) AS loads",
    )
    # The state of the fold: bytes and slots of each shard so far.  A slot of
    # no bytes counts as one byte, so that empty slots are dealt evenly too.
    start = "named_struct('loads', loads, 'homes', cast(array() AS array<int>))"
    step = """(acc, x) -> named_struct(
        'loads', transform(acc.loads, (l, i) -> if(i = array_position(acc.loads, array_min(acc.loads)) - 1, l - x.less + if(x.less = 0, 1L, 0L), l)),
        'homes', concat(acc.homes, array(cast(array_position(acc.loads, array_min(acc.loads)) - 1 AS int))))"""
    dealt = rows.selectExpr("loose", "fixed", f"aggregate(loose, {start}, {step}).homes AS homes")
    made = dealt.selectExpr(
        "explode(concat(transform(loose, (x, i) -> named_struct('vslot', x.vslot, 'shard', homes[i])), transform(fixed, x -> named_struct('vslot', x.vslot, 'shard', x.shard)))) AS m"
    )
    return made.select(F.lit(version).alias("version"), "m.vslot", "m.shard")


def sharded(records: DataFrame, slot_map: DataFrame, slot: str = "vslot", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``records`` with ``shard`` and their place in it as ``slot`` (gapless from 0)."""
    sums = records.groupBy(F.col(slot).alias("vslot")).agg(F.count("*").alias("n"))
    laid = sums.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    start = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = laid.select("vslot", "shard", start.alias("start"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(*order)) - 1
    numbered = records.withColumnRenamed(slot, "vslot").withColumn("place", place)
    return numbered.join(F.broadcast(laid), "vslot").withColumn("slot", (F.col("start") + F.col("place")).cast("bigint")).drop("start", "place")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add one version to the stored map, a folder partitioned by version."""
    slot_map.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the newest by default."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("version", "vslot", "shard")


def slotted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """All documents with ``size``, ``text_crc32`` and their ``vslot``, stored."""
    records = docs.select(
        F.col(doc_id).alias("doc_id"),
        record_size(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    records = numbered_among_like(records.withColumn("key", key))
    return frozen(records.withColumn("vslot", slot_of(F.concat_ws("/", "key", "number"), slots)).drop("key", "number"))


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All documents with ``size``, ``text_crc32``, ``vslot``, ``shard`` and ``slot``: bytes are near equal over shards."""
    records = slotted(docs, doc_id, text, slots)
    slot_map = edited_map(slot_bytes(records, slots=slots), shards)
    return sharded(records, slot_map, order=("doc_id", "size", "text_crc32", "row")).drop("row")


def numbered_among_like(records: DataFrame, key: str = "key", row: str = "row") -> DataFrame:
    """``records`` with ``number``, from 0, among the rows of their key; ``row`` is unique and of :func:`monotonically_increasing_id`.

    Only keys that repeat are numbered: in each part of the table on its own, the
    parts' counts laid end to end, so a key with a third of all rows is numbered by
    as many tasks as have read it.
    """
    stored = frozen(records.withColumn("part", F.shiftright(row, 33)))
    counts = frozen(stored.groupBy(key, "part").agg(F.count("*").alias("n")))
    several = frozen(counts.groupBy(key).agg(F.sum("n").alias("all")).where("all > 1").select(key))
    met = stored.join(several.withColumn("repeats", F.lit(True)), key, "left")
    alone = met.where("repeats is null").select(*records.columns, F.lit(0).cast("bigint").alias("number"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = counts.join(several, key, "left_semi").select(key, "part", start.alias("start"))
    place = F.row_number().over(Window.partitionBy(key, "part").orderBy(row)) - 1
    numbered = stored.join(several, key, "left_semi").withColumn("place", place).join(laid, [key, "part"])
    return alone.unionByName(numbered.select(*records.columns, (F.col("start") + F.col("place")).cast("bigint").alias("number")))

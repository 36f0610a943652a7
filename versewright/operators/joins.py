"""Matches between two ordered collections: positional, interval, nearest and text joins.

Every join has an equality key (the song, a bucket of time, or a text key),
so none plans as a Cartesian product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positional(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows at the same position on both sides; other columns get the prefixes ``a_`` and ``b_``."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    return left.join(right, list(keys))


def interval_stab(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, by: str = "song", bucket: int = 600_000) -> DataFrame:
    """Points with the spans ``[begin, end)`` that contain them.

    Spans are listed under each bucket of time they touch, points under
    theirs, so the join is on (song, bucket) with a residual comparison.
    ``bucket`` should be near the usual span's length.
    """
    p = points.withColumn("_k", F.floor(F.col(at) / bucket))
    s = spans.where(F.col(end) > F.col(begin)).withColumn("_k", F.explode(F.sequence(F.floor(F.col(begin) / bucket), F.floor((F.col(end) - 1) / bucket))))
    return p.join(s, [by, "_k"]).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_k")


def nearest(left: DataFrame, right: DataFrame, at: str, to: str, by: str = "song", tie: str = "right") -> DataFrame:
    """Each left row with the nearest right position of its key, by one sort and two running values: ``near``; at equal distance ``tie`` decides.

    No pairs are made: both sides are laid on one line and the last position
    before and the first after are carried along.
    """
    marks = right.select(by, F.col(to).alias("_p"), F.lit(None).alias("_row")).where("_p is not null")
    rows = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns])).select(by, F.col(at).alias("_p"), "_row")
    line = rows.unionByName(marks.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    w = Window.partitionBy(by).orderBy("_p", F.col("_row").isNotNull())
    mark = F.when(F.col("_row").isNull(), F.col("_p"))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    line = line.withColumn("_b", before).withColumn("_a", after).where("_row is not null")
    db, da = F.col("_p") - F.col("_b"), F.col("_a") - F.col("_p")
    right_first = (da <= db) if tie == "right" else (da < db)
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | ~right_first, F.col("_b")).otherwise(F.col("_a"))
    return line.select("_row.*", near.alias("near"))


def asof(left: DataFrame, right: DataFrame, at: str, to: str, value: str, by: str = "song") -> DataFrame:
    """Each left row with ``value`` of the last right row at or before it: ``as_of``."""
    marks = right.select(by, F.col(to).alias("_p"), F.struct(F.col(value).alias("v")).alias("_v"))
    rows = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns])).select(by, F.col(at).alias("_p"), "_row")
    line = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_p", F.col("_row").isNotNull(), F.col("_v.v")).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_row is not null").select("_row.*", F.col("_last.v").alias("as_of"))


def overlaps(a: DataFrame, b: DataFrame, by: str = "song", bucket: int = 600_000) -> DataFrame:
    """Rows of ``a`` whose half-open span meets one of ``b``'s (``begin_ms``, ``end_ms``)."""
    cut = lambda d: d.where("end_ms > begin_ms").withColumn("_k", F.explode(F.sequence(F.floor(F.col("begin_ms") / bucket), F.floor((F.col("end_ms") - 1) / bucket))))
    right = cut(b).select(F.col(by).alias("_by"), F.col("_k").alias("_kk"), F.col("begin_ms").alias("_b"), F.col("end_ms").alias("_e"))
    left = cut(a)
    on = (left[by] == right["_by"]) & (left["_k"] == right["_kk"]) & (left["begin_ms"] < right["_e"]) & (left["end_ms"] > right["_b"])
    return left.join(right, on, "left_semi").drop("_k").distinct()


def snap(edges: DataFrame, anchors: DataFrame, at: str, to: str, within: int, by: str = "song") -> DataFrame:
    """Edges with their nearest anchor within ``within``; the later of two equally near ones."""
    return nearest(edges, anchors, at, to, by).where(F.abs(F.col("near") - F.col(at)) <= within)


def identical_words(words: DataFrame, key: Column, unique: str = "word_id", by: tuple[str, ...] = ("song",)) -> DataFrame:
    """How many other words of the same song have the same text key; counts only, no pairs."""
    keyed = words.withColumn("_key", key)
    counts = keyed.groupBy(*by, "_key").agg((F.count("*") - 1).alias("others"))
    return keyed.join(counts, [*by, "_key"]).drop("_key")


def propagate(edits: DataFrame, members: DataFrame, keys: tuple[str, ...], unique: str, fields: tuple[str, ...]) -> DataFrame:
    """Members with the fields of the latest edit of their key; an edited member keeps its own edit."""
    last = edits.groupBy(*keys).agg(F.max_by(F.struct(*fields), unique).alias("_e"))
    joined = members.join(last, list(keys), "left")
    return joined.select(*[F.coalesce(F.col(f"_e.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in members.columns])


def claim_by_text(wanted: DataFrame, existing: DataFrame, text: str, order: str, by: tuple[str, ...]) -> DataFrame:
    """Each wanted row takes the first unused existing row of the same text: the k-th with the k-th; ``claimed`` is null for the rest."""
    nth = F.row_number().over(Window.partitionBy(*by, text).orderBy(order))
    a = wanted.withColumn("_n", nth)
    b = existing.withColumn("_n", nth).select(*by, text, "_n", F.col(order).alias("claimed"))
    return a.join(b, [*by, text, "_n"], "left").drop("_n")

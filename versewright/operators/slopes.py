"""The exact median of the slopes of all pairs of a song's points, without storing the pairs.

Points are dealt by a hash into blocks of bounded size, and pairs of blocks
are compared in memory.  A song of one block gives its median at once.  For a
longer one every pair of blocks only gives out counts: of slopes by the
leading bits of their order-preserving 64-bit number, then by the next bits
among the slopes that share the median's leading ones, then by the rest.  So
a song of any length is many bounded tasks; its work is quadratic in its
points, as the definition asks, its memory and shuffled rows are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1024
#: Bits that are not looked at yet after each pass.
SHIFTS = (44, 22, 0)


def _slopes(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    run = u[None, :] - x[:, None]
    far = run > least
    return (v[None, :] - y[:, None])[far] / run[far] + 0.0


def _numbers(slopes: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the slopes."""
    bits = slopes.view(np.int64)
    return bits ^ (bits >> 63 & np.int64(2**63 - 1))


def median_slopes(points: DataFrame, x: str, y: str, by: str, least: float, block: int = BLOCK) -> DataFrame:
    """``(by, slope)``: the median slope over all pairs more than ``least`` apart in ``x``; songs without such a pair give none.

    Points with a null coordinate have no slopes.
    """
    kind = points.schema[by].dataType.simpleString()
    points = points.select(F.col(by).alias("song"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    longest = points.groupBy("song").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            songs, medians = [], []
            for song, x, y in zip(batch["song"], batch["x"], batch["y"]):
                own = _slopes(np.asarray(x, float), np.asarray(y, float), np.asarray(x, float), np.asarray(y, float), least)
                if len(own):
                    songs.append(song)
                    medians.append(np.median(own))
            yield pd.DataFrame({"song": songs, "slope": medians}).astype({"song": object})

    def whole(rows: DataFrame) -> DataFrame:
        """Medians of songs of one block: a row per song."""
        each = rows.groupBy("song").agg(F.collect_list(F.struct("x", "y")).alias("p"))
        return each.select("song", F.transform("p", lambda p: p["x"]).alias("x"), F.transform("p", lambda p: p["y"]).alias("y")).mapInPandas(direct, f"song {kind}, slope double")

    if (longest or 0) <= block:
        return whole(points).select(F.col("song").alias(by), "slope")
    blocks = F.ceil(F.col("n") / block).cast("int")
    sized = points.join(points.groupBy("song").agg(F.count("*").alias("n")), "song").withColumn("blocks", blocks)
    small = whole(sized.where("blocks = 1"))
    long = sized.where("blocks > 1")
    # Each point meets every block of its song; a pair of blocks is one group.
    own = F.pmod(F.xxhash64("x", "y"), F.col("blocks")).cast("int")
    met = long.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("song", "x", "y", (F.col("own") <= F.col("other")).alias("first"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    medians = _by_counting(met, least, kind)
    return small.union(medians).select(F.col("song").alias(by), "slope")


def _counter(shift: int, known: int | None, least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Counts of a block pair's slopes by their bits above ``shift``, of those that share the wanted bits above ``known``."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        same = rows["p"].iloc[0] == rows["q"].iloc[0]
        a, b = (rows, rows) if same else (rows[rows["first"]], rows[~rows["first"]])
        ax, ay, bx, by = (c.to_numpy() for c in (a["x"], a["y"], b["x"], b["y"]))
        found = [_slopes(ax, ay, bx, by, least)] + ([] if same else [_slopes(bx, by, ax, ay, least)])
        numbers, out = _numbers(np.concatenate(found)), []
        for which in (0, 1):
            mine = numbers if known is None else numbers[numbers >> known == rows[f"bin{which}"].iloc[0]]
            bins, n = np.unique(mine >> shift, return_counts=True)
            out.append(pd.DataFrame({"song": rows["song"].iloc[0], "which": which, "bin": bins, "n": n}))
        return pd.concat(out)

    return count


def _by_counting(met: DataFrame, least: float, kind: str) -> DataFrame:
    targets = None
    for number, shift in enumerate(SHIFTS):
        rows = met if targets is None else met.join(targets, "song")
        counts = rows.groupBy("song", "p", "q").applyInPandas(_counter(shift, SHIFTS[number - 1] if number else None, least), f"song {kind}, which int, bin bigint, n bigint").groupBy("song", "which", "bin").agg(F.sum("n").alias("n"))
        ordered = Window.partitionBy("song", "which").orderBy("bin")
        counts = counts.withColumn("upto", F.sum("n").over(ordered))
        if targets is None:
            total = F.sum("n").over(Window.partitionBy("song", "which"))
            counts = counts.withColumn("rank", F.floor((total - F.when(F.col("which") == 0, 1).otherwise(0)) / 2))
        else:
            counts = counts.join(targets, "song").withColumn("rank", F.when(F.col("which") == 0, F.col("rank0")).otherwise(F.col("rank1")))
        hit = counts.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).withColumn("rank", F.col("rank") - F.col("upto") + F.col("n"))
        pick = lambda c, w: F.max(F.when(F.col("which") == w, F.col(c)))
        targets = hit.groupBy("song").agg(*[pick(c, w).alias(f"{c}{w}") for c in ("bin", "rank") for w in (0, 1)])
    return targets.select("song", ((_value(F.col("bin0")) + _value(F.col("bin1"))) / 2).alias("slope"))


@F.pandas_udf(T.DoubleType())
def _value(number: pd.Series) -> pd.Series:
    own = number.to_numpy(np.int64)
    return pd.Series((own ^ (own >> 63 & np.int64(2**63 - 1))).view(np.float64))


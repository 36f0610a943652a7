"""Robust statistics of timing, benchmark metrics, and the placement judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slopes import median_slopes

LEAST_WORDS, LEAST_POINTS, LEAST_DRIFT = 10, 6, 250
#: A decision below this probability is flagged.
JUDGE_THRESHOLD = 0.92


def offset_and_spread(pairs: DataFrame, a: str, b: str, by: str = "song") -> DataFrame:
    """Median difference of paired words, and the median absolute deviation from it; songs with fewer than ten pairs give none."""
    d = pairs.select(by, (F.col(b) - F.col(a)).alias("_d"))
    middle = d.groupBy(by).agg(F.median("_d").alias("offset"), F.count("*").alias("words")).where(F.col("words") >= LEAST_WORDS)
    return d.join(middle, by).groupBy(by).agg(F.first("offset").alias("offset"), F.median(F.abs(F.col("_d") - F.col("offset"))).alias("spread"), F.first("words").alias("words"))


def theil_sen(points: DataFrame, x: str, y: str, by: str = "song", least: float = 1000.0) -> DataFrame:
    """Median slope of all pairs and median residual; a constant for fewer than six points or a drift of at most 250 ms over the song."""
    slopes = median_slopes(points, x, y, by, least).withColumnRenamed("slope", "_s")
    span = points.groupBy(by).agg(F.count("*").alias("_n"), (F.max(x) - F.min(x)).alias("_span"))
    slope = F.when((F.col("_n") < LEAST_POINTS) | F.col("_s").isNull() | (F.abs(F.col("_s") * F.col("_span")) <= LEAST_DRIFT), F.lit(0.0)).otherwise(F.col("_s"))
    known = points.join(span, by).join(slopes, by, "left").withColumn("slope", slope)
    return known.groupBy(by).agg(F.first("slope").alias("slope"), F.median(F.col(y) - F.col("slope") * F.col(x)).alias("intercept"))


def repeat_pattern(words: DataFrame, key: tuple[str, ...], position: str, most: int = 200, trusted: str | None = None) -> DataFrame:
    """Median relative begin of each word position over a line's trusted repeats; keys where one deviates by more than ``most`` give none.

    ``trusted`` names a flag of the rows whose repeat may lend its rhythm; without it all may.
    """
    keys = list(key)
    words = words.where(F.col(trusted)) if trusted else words
    middle = words.groupBy(*keys, position).agg(F.median("rel_begin").alias("pattern"), F.count("*").alias("repeats"))
    worst = words.join(middle, [*keys, position]).groupBy(*keys).agg(F.max(F.abs(F.col("rel_begin") - F.col("pattern"))).alias("_worst"))
    return middle.join(worst.where(F.col("_worst") <= most).select(*keys), keys, "left_semi")


def benchmark_metrics(errors: DataFrame, by: str = "song", line: str = "line_no") -> DataFrame:
    """Mean absolute error, shares within 100 and 300 ms, and the worst line's median drift, each song after its median is taken out."""
    middle = errors.groupBy(by).agg(F.median("error").alias("_m"))
    left = errors.join(middle, by).withColumn("_e", F.col("error") - F.col("_m"))
    drift = left.groupBy(by, line).agg(F.abs(F.median("_e")).alias("_d")).groupBy(by).agg(F.max("_d").alias("worst_drift"))
    own = left.groupBy(by).agg(F.avg(F.abs("_e")).alias("aae"), F.avg((F.abs("_e") <= 100).cast("int")).alias("within_100"), F.avg((F.abs("_e") <= 300).cast("int")).alias("within_300"), F.count("*").alias("words"))
    return own.join(drift, by)


def macro_mean(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the songs' values: a short song weighs as much as a long one."""
    return metrics.agg(*[F.avg(c).alias(c) for c in columns])


def threshold_sweep(scored: DataFrame, score: str, right: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: share flagged, and recall and precision for wrong placements.  Counts for all thresholds come from one pass."""
    bins = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(score) >= t))
    per = scored.groupBy(bins.alias("_k")).agg(F.count("*").alias("n"), F.count_if(F.col(right) == 0).alias("wrong"))
    grid = per.sparkSession.createDataFrame([(i, t) for i, t in enumerate(thresholds)], "i int, threshold double")
    met = F.broadcast(per).crossJoin(F.broadcast(grid))  # both have a row per threshold
    sums = met.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), F.sum(F.when(F.col("_k") <= F.col("i"), F.col("n")).otherwise(0)).alias("flagged"), F.sum(F.when(F.col("_k") <= F.col("i"), F.col("wrong")).otherwise(0)).alias("caught"))
    return sums.select("threshold", "flagged", "caught", (F.col("flagged") / F.col("n")).alias("share"), F.when(F.col("wrong") > 0, F.col("caught") / F.col("wrong")).alias("recall"), F.when(F.col("flagged") > 0, F.col("caught") / F.col("flagged")).alias("precision"))


def judge_features(score: Column, disagreement: Column, outside: Column, voiced: Column, ratio: Column) -> list[Column]:
    """Log score (floor 1e-4), disagreement and distance outside the window (capped at 3 s), voiced start, absolute log ratio of lengths (floor 1e-2)."""
    return [F.ln(F.greatest(score, F.lit(1e-4))), F.least(disagreement, F.lit(3.0)), F.least(outside, F.lit(3.0)), voiced.cast("double"), F.abs(F.ln(F.greatest(ratio, F.lit(1e-2))))]


def logistic(features: list[Column], weights: list[float], bias: float) -> Column:
    z = F.lit(bias)
    for f, w in zip(features, weights):
        z = z + f * w
    return 1 / (1 + F.exp(-z))


def fit_logistic(rows: DataFrame, features: list[str], label: str, rounds: int = 12, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias by iteratively reweighted least squares; each round gathers only the (k+1) x (k+1) sums."""
    import numpy as np

    cols = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    w = np.zeros(len(cols))
    for _ in range(rounds):
        z = F.lit(0.0)
        for c, x in zip(cols, w):
            z = z + c * float(x)
        p = 1 / (1 + F.exp(-z))
        v = p * (1 - p)
        pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
        got = rows.agg(*[F.sum(v * cols[i] * cols[j]) for i, j in pairs], *[F.sum((F.col(label) - p) * c) for c in cols]).first()
        if got[0] is None:
            return [0.0] * len(features), 0.0
        h = np.zeros((len(cols), len(cols)))
        for (i, j), x in zip(pairs, got):
            h[i, j] = h[j, i] = x
        step = np.linalg.solve(h + ridge * np.eye(len(cols)), np.array(got[len(pairs) :]) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def stage_view(events: DataFrame, job: str = "job", stage: str = "stage", status: str = "status", at: str = "at", unique: str = "event_id") -> DataFrame:
    """Per job and stage: last status, first time, first time it was no longer running, and how long that took."""
    out = events.groupBy(job, stage).agg(F.max_by(status, F.struct(at, unique)).alias("last_status"), F.min(at).alias("started"), F.min(F.when(F.col(status) != "running", F.col(at))).alias("ended"), F.count("*").alias("events"))
    return out.withColumn("took", F.col("ended") - F.col("started"))


def log_mean_exp(a: Column, b: Column) -> Column:
    """``ln((e^a + e^b) / 2)`` without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))) - F.ln(F.lit(2.0))

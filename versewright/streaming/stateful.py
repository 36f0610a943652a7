"""Streams with state of their own: throttled progress and the state that a client folds from a job's messages.

Both keep a few values per job in the state store, which is checkpointed with
the stream; a job that has been silent for ``KEEP`` (in event time, by a timeout) is
forgotten.  The state of a job travels with its rows, so a task asks for nothing
job by job.  Rows of a key come in order from batch to batch, as a running job
sends them; inside a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import progress

#: Fixed value: microseconds between two values of a progress bar.
INTERVAL_US = 250_000
KEEP_MS = 7 * 24 * 3600 * 1000
LATE = "60 days"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(batches: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> list[tuple]:
    """Rows of one job by time and number; ``columns`` begin with these two."""
    rows = [row for batch in batches for row in zip(*[batch[c].tolist() for c in columns])]
    return sorted(rows, key=lambda r: (r[0], r[1]))


def _keep_until(state: GroupState, us: int) -> None:
    state.setTimeoutTimestamp(max(us // 1000 + KEEP_MS, state.getCurrentWatermarkMs() + 1))


def throttled(updates: DataFrame, interval_us: int = INTERVAL_US) -> DataFrame:
    """The values of each progress bar that are published: the first, those ``interval_us`` or more after the last one published, and every value of one.

    ``updates`` is a stream of job, bar, seq, ``ts`` and ``fraction``
    (null for unknown progress; others are brought into 0 to 1).  A job's bars are kept
    together; one published so long ago that its next value passes anyway is dropped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in updates.schema.fields}
    timed = updates.withWatermark("ts", LATE).select("job", "bar", "seq", "ts", F.unix_micros("ts").alias("at_us"), F.col("fraction").cast("double").alias("fraction"))
    names = ["job", "bar", "at_us", "seq", "fraction"]

    def publish(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = dict(zip(*state.get)) if state.exists else {}, []
        rows = _in_order(batches, ("at_us", "seq", "bar", "fraction"))
        for at, seq, bar, fraction in rows:
            known = fraction is not None and fraction == fraction
            fraction = min(1.0, max(0.0, fraction)) if known else None
            if bar not in last or at - last[bar] >= interval_us or fraction == 1.0:
                last[bar] = at
                out.append((key[0], bar, at, seq, fraction))
        newest = rows[-1][0]
        last = {bar: at for bar, at in last.items() if newest - at <= max(KEEP_MS * 1000, interval_us)}
        state.update((list(last), list(last.values())))
        _keep_until(state, newest)
        if out:
            yield pd.DataFrame({n: pd.Series(c, dtype=object) if n != "fraction" else pd.Series(c, dtype=float) for n, c in zip(names, zip(*out))})

    schema = f"job {kinds['job']}, bar {kinds['bar']}, at_us bigint, seq {kinds['seq']}, fraction double"
    return timed.groupBy("job").applyInPandasWithState(publish, schema, f"bars array<{kinds['bar']}>, at array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def client_state(messages: DataFrame) -> DataFrame:
    """What a client knows of each job, after every batch that has messages of it.

    ``messages`` is a stream of job, seq, ``ts``, ``kind`` (open, status,
    progress, event), stage, status, error, fraction and detail.  A status
    replaces the one before, progress replaces that of its stage, events
    add up; an opened connection forgets progress and events, since the history
    comes again.
    """
    kind = messages.schema["job"].dataType.simpleString()
    timed = messages.withWatermark("ts", LATE).select("job", F.col("seq").cast("bigint").alias("seq"), "ts", F.unix_micros("ts").alias("at_us"), "kind", *[F.col(c).cast("string").alias(c) for c in ("stage", "status", "error", "detail")], F.col("fraction").cast("double").alias("fraction"))
    none = lambda v: None if v is None or v != v else v

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, error, stages, fractions, details, n, last = state.get if state.exists else (None, None, [], [], [], 0, None)
        bars = dict(zip(stages, zip(fractions, details)))
        rows = _in_order(batches, ("at_us", "seq", "kind", "stage", "status", "error", "fraction", "detail"))
        for _, seq, kind, stage, own, reason, fraction, detail in rows:
            if kind == "open":  # the history is sent again
                bars, n, last = {}, 0, None
            elif kind == "status":
                status, error = none(own), none(reason)
            elif kind == "progress":
                bars[none(stage)] = none(fraction), none(detail)
            else:
                n, last = n + 1, seq
        shown = sorted(bars, key=lambda b: (b is not None, b))
        fractions = [bars[b][0] for b in shown]
        state.update((status, error, shown, fractions, [bars[b][1] for b in shown], n, last))
        _keep_until(state, rows[-1][0])
        yield pd.DataFrame({"job": [key[0]], "status": pd.Series([status], dtype=object), "error": pd.Series([error], dtype=object), "stages": [shown], "fractions": [fractions], "events": [n], "last_seq": pd.Series([last], dtype=object)})

    schema = f"job {kind}, status string, error string, stages array<string>, fractions array<double>, events bigint, last_seq bigint"
    held = "status string, error string, stages array<string>, fractions array<double>, details array<string>, n bigint, last bigint"
    return timed.groupBy("job").applyInPandasWithState(fold, schema, held, "update", GroupStateTimeout.EventTimeTimeout)


def run_with_state(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """:func:`progress.run_once` with a state store that keeps several states of a key; the session's own choice comes back after it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return progress.run_once(stream, mode=mode)
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)

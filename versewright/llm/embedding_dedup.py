"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c lie within ``eps = sqrt(2 - 2c)`` of each
other.  Vectors are sorted, within each label, by their grid cells (width
eps) on the leading principal dimensions, and inside a cell along a space-filling
curve; consecutive runs of at most ``INTERVAL`` vectors form intervals with a
bounding box.  Intervals meet if they hold the same or neighbouring cells on
all grid dimensions and their boxes are not provably more than eps apart.  Each
such pair is halved again and again, skipping distant halves, down to blocks
that one matrix product compares in double precision.

Components are divided by the largest magnitude before they are squared, so
neither tiny nor huge vectors under- or overflow.  Equal vectors of a label
are joined once and counted; they are known by a 128-bit hash.  A pair of intervals
gives out, for each vector, how many vectors it links with there, and a
spanning set of links; pairs of vectors are never emitted.  A hot label has
more intervals, not larger groups.

The principal dimensions come from the sums and products of all vectors, 64
by 64 numbers whatever their count.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows with a null label link with nothing and are kept;
vectors of different length never link; a null ``vec_id`` is never a
component id unless alone; repeated rows link with each other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen
from .components import connected_components

COSINE = 0.93
INTERVAL = 4096
#: Leading principal dimensions of the grid and of the boxes.
GRID_DIMS, BOX_DIMS = 3, 16
#: Dimensions and bits of each of the curve inside a cell.
CURVE_DIMS, CURVE_BITS = 8, 7
#: Largest block side that is compared at once.
BLOCK = 256


def principal_axes(units: DataFrame, dims: int) -> np.ndarray:
    """Axes of largest variance, shape (dims, vectors' length); sums are combined on the executors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for v in _groups(batch.column(0)):
                own = np.column_stack((np.ones(len(v)), v))
                size = v.shape[1]
                total[size] = total.get(size, 0) + own.T @ own
        for size, m in total.items():
            k = np.arange(m.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, size)), pa.array(k), pa.array(m.ravel())], names=["size", "k", "x"])

    parts = units.select("v").mapInArrow(sums, "size bigint, k bigint, x double").groupBy("size", "k").agg(F.sum("x").alias("x"))
    table = parts.toPandas()
    if not len(table):
        return np.zeros((0, 0))
    size = int(table.loc[table["k"] == 0].sort_values("x")["size"].iloc[-1])  # the commonest length
    own = table[table["size"] == size].sort_values("k")["x"].to_numpy().reshape(size + 1, size + 1)
    mean = own[0, 1:] / own[0, 0]
    cov = own[1:, 1:] / own[0, 0] - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1][:, : min(dims, size)].T


def _groups(column: pa.Array) -> list[np.ndarray]:
    """Matrices of a list column's vectors, by length, in the order of rows for a single length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == sizes[0]).all():
        return [flat.reshape(len(sizes), sizes[0])]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    return [np.stack([flat[starts[i] : starts[i + 1]] for i in np.flatnonzero(sizes == n)]) for n in np.unique(sizes)]


def _settle(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def join_blocks(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, eps: float, cosine: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(row of a, row of b, links)`` blocks, halving intervals and skipping those whose boxes are apart."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        if i >= j or k >= m:
            continue
        p, q = pa_[i:j], pb[k:m]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        if (gap**2).sum() > eps * eps * (1 + 1e-9):
            continue
        if j - i <= BLOCK and m - k <= BLOCK:
            yield i, k, a[i:j] @ b[k:m].T >= cosine
        elif j - i >= m - k:
            half = (i + j) // 2
            stack += [(i, half, k, m), (half, j, k, m)]
        else:
            half = (k + m) // 2
            stack += [(i, j, k, half), (i, j, half, m)]


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel(), kind))


def _neighbours(cells: str, dims: int) -> Column:
    """The distinct cells of a list of cells and of those next to them on each of ``dims`` dimensions."""
    every = F.col(cells)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))

    def around(d: int) -> Callable[[Column], Column]:
        return lambda cell: F.transform(steps, lambda step: F.transform(cell, lambda x, i: F.when(i == d, x + step).otherwise(x)))

    for d in range(dims):
        every = F.flatten(F.transform(every, around(d)))
    return F.array_distinct(every)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their last column, vectors, scaled to length one; by the largest magnitude first, so that no square over- or underflows."""
    for batch in batches:
        sizes = batch.column(batch.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            e = _groups(part.column(part.num_columns - 1))[0]
            e = e / np.abs(e).max(axis=1)[:, None]
            v = e / np.sqrt((e * e).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(v, pa.float64())], names=[*part.schema.names[:-1], "v"])


def _spots(v: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Places of the rows of ``v`` on the principal axes; vectors of an uncommon length are all at the origin."""
    return v @ axes.T if axes.size and v.shape[1] == axes.shape[1] else np.zeros((len(v), len(axes)))


def _curve(spots: np.ndarray, eps: float) -> np.ndarray:
    """Place of each row on a curve that visits the parts of its cell in turn: the bits of its fine cells, interleaved."""
    fine = ((spots[:, :CURVE_DIMS] / eps % 1.0) * (1 << CURVE_BITS)).astype(np.int64).clip(0, (1 << CURVE_BITS) - 1)
    code = np.zeros(len(spots), np.int64)
    for bit in range(CURVE_BITS - 1, -1, -1):
        for d in range(fine.shape[1]):
            code = code << 1 | fine[:, d] >> bit & 1
    return code


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, interval: int = INTERVAL) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    eps = float(np.sqrt(2 - 2 * cosine))
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"), F.col(label).alias("label"))
    whole = F.col("label").isNotNull() & F.coalesce(F.size("e") > 0, F.lit(False)) & F.expr(
        "coalesce(forall(e, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity')) and exists(e, x -> x <> 0), false)"
    )
    # Equal vectors of a label are one from here on.  0.0 and -0.0 are equal numbers.
    base = base.withColumn("e", F.when(whole, F.expr("transform(e, x -> double(x) + 0D)")))
    base = base.withColumns({"h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit("second"), "e")})
    order = F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"))
    same = ["label", "h1", "h2"]
    distinct = base.where("e is not null").groupBy(*same).agg(F.count("*").alias("copies"), F.min(order).alias("first"), F.first("e").alias("e"))
    kind = base.schema["label"].dataType.simpleString()
    keep = [*same, "copies", "first"]
    units = distinct.select(*keep, "e").mapInArrow(_units, distinct.select(*keep, F.col("e").alias("v")).schema)
    # Numbered as they are stored, so a number means the same vector in every later job.
    distinct = frozen(units.withColumn("vid", F.monotonically_increasing_id()))
    axes = principal_axes(distinct.select("v"), BOX_DIMS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "vid", "copies", "v"]
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                spots = _spots(_groups(part.column("v"))[0], axes)
                cells = np.floor(spots[:, :GRID_DIMS] / eps).astype(np.int32)
                new = [_lists(cells, pa.int32()), _lists(spots, pa.float64()), pa.array(_curve(spots, eps)), pa.array(np.full(part.num_rows, size, np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + new, names=[*names, "cell", "spot", "curve", "size"])

    columns = f"label {kind}, vid bigint, copies bigint, v array<double>, cell array<int>, spot array<double>, curve bigint, size int"
    placed = distinct.select("label", "vid", "copies", "v").mapInArrow(place, columns)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of at most ``interval`` rows of one label and length, in grid order."""
        part, run, held, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            names, places = [], []
            for key in zip(batch.column("label").to_pylist(), batch.column("size").to_pylist()):
                if key != last or held == interval:
                    run, held, last = run + 1, 0, key
                names.append(part << 32 | run)
                places.append(held)
                held += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64()), pa.array(places, pa.int32())], names=[*batch.schema.names, "run", "pos"])

    grid_order = ["label", "size", "cell", "curve", "vid"]
    runs = frozen(placed.repartitionByRange(*grid_order).sortWithinPartitions(*grid_order).mapInArrow(number, columns + ", run bigint, pos int"))
    dims = len(axes)
    low = F.array(*[F.min(F.col("spot")[d]) for d in range(dims)])
    high = F.array(*[F.max(F.col("spot")[d]) for d in range(dims)])
    boxes = frozen(runs.groupBy("label", "size", "run").agg(low.cast("array<double>").alias("low"), high.cast("array<double>").alias("high"), F.collect_set("cell").alias("cells")))
    one = boxes.select("label", "size", F.col("run").alias("r1"), F.col("low").alias("l1"), F.col("high").alias("u1"), F.explode("cells").alias("cell"))
    two = boxes.select("label", "size", F.col("run").alias("r2"), F.col("low").alias("l2"), F.col("high").alias("u2"), F.explode(_neighbours("cells", min(GRID_DIMS, dims))).alias("cell"))
    gap = F.expr("aggregate(sequence(0, size(l1)), 0D, (s, i) -> s + coalesce(pow(greatest(0D, get(l1, i) - get(u2, i), get(l2, i) - get(u1, i)), 2), 0D))")
    pairs = one.join(two, ["label", "size", "cell"]).where("r1 <= r2").where(gap <= eps * eps * (1 + 1e-9)).select("r1", "r2").distinct()
    sides = frozen(pairs.select("r1", "r2", F.explode(F.array_distinct(F.array("r1", "r2"))).alias("run")))
    met = sides.join(runs.select("run", "pos", "vid", "copies", "v"), "run")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links between two intervals (or within one), at most two intervals of rows."""
        r1, r2 = key
        rows = rows.sort_values("pos")  # in grid order again, so that halves are compact
        first, second = rows[rows["run"] == r1], rows[rows["run"] == r2]
        a, b = (np.stack(x["v"].to_list()).astype(float) for x in (first, second))
        w1, w2 = first["copies"].to_numpy(), second["copies"].to_numpy()
        n1, n2 = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        spots_a, spots_b = _spots(a, axes), _spots(b, axes)
        left, right = [], []
        for i, k, hit in join_blocks(a, b, spots_a, spots_b, eps, cosine):
            if r1 == r2:
                own = np.arange(i, i + hit.shape[0])[:, None] == np.arange(k, k + hit.shape[1])[None, :]
                hit = hit & ~own
            n1[i : i + hit.shape[0]] += hit @ w2[k : k + hit.shape[1]]
            if r1 != r2:
                n2[k : k + hit.shape[1]] += hit.T @ w1[i : i + hit.shape[0]]
            x, y = np.nonzero(hit)
            left.append(x + i)
            right.append(y + k)
        x = np.concatenate(left) if left else np.empty(0, int)
        y = np.concatenate(right) if right else np.empty(0, int)
        ids = first["vid"].to_numpy() if r1 == r2 else np.concatenate((first["vid"].to_numpy(), second["vid"].to_numpy()))
        count = n1 if r1 == r2 else np.concatenate((n1, n2))
        root = _settle(len(ids), x, y if r1 == r2 else y + len(a))
        out = pd.DataFrame({"vid": ids, "n": count, "root": ids[root]})
        return out[out["n"] > 0]

    found = frozen(met.groupBy("r1", "r2").applyInPandas(compare, "vid bigint, n bigint, root bigint"))
    counts = found.groupBy("vid").agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("vid <> root").select(F.col("vid").alias("a"), F.col("root").alias("b")))
    known = distinct.select(*same, "vid", "copies", "first").join(counts, "vid", "left").join(parts.withColumnRenamed("node", "vid"), "vid", "left")
    known = frozen(known.select(*same, "copies", "first", "others", F.coalesce("component", "vid").alias("part")))
    heads = frozen(known.groupBy("part").agg(F.min("first").alias("head")))  # stored: the join can be split at a hot component
    known = known.join(heads, "part").select(*same, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("head.id").alias("head"))
    linked = base.where("e is not null").select("vec_id", *same).join(known, same).select("vec_id", F.col("links").alias("n_links"), F.col("head").alias("component_id"))
    alone = base.where("e is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

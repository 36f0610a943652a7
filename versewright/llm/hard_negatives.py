"""Hard negatives of anchor vectors by angular triangle filtering.

Components are made integers, ``floor(scale * x)``, and a row's score for an
anchor is the integer inner product.  Each vector stores its norm and its
angles to a few reference directions.  By the triangle inequality of angles,
the angle between an anchor and a vector lies between the largest difference
and the smallest (folded) sum of their angles to a reference; its cosine, times
both norms, rounded outwards, bounds the score.  Vectors lie sorted by label
and angle in blocks that keep the ranges of angles and norms, so that one bound
serves a block, and only blocks whose range of scores overlaps a wanted window
get integer scoring.  Blocks are visited from the highest bound down, and a
window that has its rows already raises its floor to the last of them.

All vectors are dealt by a hash into slices of at most about ``SLICE`` rows,
whatever their labels, so a label with a third of all rows is spread like any
other.  The anchors, a stated query set, go to every slice, in batches; a slice
gives out the first few rows of each window, and the first few of all
slices are the result.  The first pass finds positives, the second negatives.

Defined results: rows with a null label, id or vector, with a null or
non-finite component, or whose integers have a squared length of 2^62 or more (a
score could leave 64 bits) take no part; vectors of different length never
meet; a zero or empty vector scores 0; repeated rows are rows of their own; ties go to the smaller
id, then to one of the repeated rows; an anchor with no positive, or without
negatives in a window, gives no row for it; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen
from .embedding_dedup import _groups, _units, principal_axes

SCALE = 256
#: Reference directions: leading principal axes of the unit vectors.
REFERENCES = 8
#: Most rows of a slice on average, fewest if there are tasks to spare, rows of a block, and blocks that are scored together.
SLICE, LEAST_SLICE, BLOCK, GROUP = 1 << 16, 1 << 10, 128, 8
#: What rounding can move an angle or, as a share of both norms, a score.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def angles(units: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of the rows of ``units`` to each reference direction."""
    return np.arccos(np.clip(units @ references.T, -1.0, 1.0))


def score_bounds(angle: np.ndarray, norm: float, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores between a vector (its angles, its norm) and blocks (their ranges of angles and norms)."""
    apart = np.maximum(0.0, np.maximum(angle - high, low - angle)).max(axis=1, initial=0.0)
    top = np.minimum(np.pi, np.minimum(angle + high, 2 * np.pi - angle - low)).min(axis=1, initial=np.pi)
    best, worst = np.cos(np.maximum(0.0, apart - ANGLE_SLACK)), np.cos(np.minimum(np.pi, top + ANGLE_SLACK))
    slack = 1 + SCORE_SLACK * norm * most
    upper = norm * np.where(best > 0, best * most, best * least) + slack
    lower = norm * np.where(worst > 0, worst * least, worst * most) - slack
    return lower, upper


class Slice:
    """The vectors of one slice and one length, in blocks of one label."""

    def __init__(self, rid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, q: np.ndarray, angle: np.ndarray) -> None:
        nearest = angle.argmin(axis=1) if angle.shape[1] else np.zeros(len(rid), int)
        order = np.lexsort((angle.min(axis=1, initial=np.pi), nearest, label))
        self.rid, self.vec_id, self.label, self.q, angle = rid[order], vec_id[order], label[order], q[order], angle[order]
        squares = (self.q.astype(float) ** 2).sum(axis=1)
        norm = np.sqrt(squares)
        starts = np.flatnonzero(np.concatenate(([True], self.label[1:] != self.label[:-1]))) if len(rid) else np.empty(0, int)
        ends = np.append(starts[1:], len(rid))
        cuts = np.concatenate([np.arange(s, e, BLOCK) for s, e in zip(starts, ends)]) if len(rid) else starts
        self.start, self.end = cuts, np.append(cuts[1:], len(rid))
        self.block_label = self.label[cuts]
        low, high = np.minimum.reduceat(angle, cuts), np.maximum.reduceat(angle, cuts)
        self.low, self.high = low, high
        self.least, self.most = np.minimum.reduceat(norm, cuts) * (1 - 1e-12), np.maximum.reduceat(norm, cuts) * (1 + 1e-12)
        zero = self.least == 0  # a zero vector has no angle
        self.low[zero], self.high[zero] = 0.0, np.pi
        #: Below this product of norms every partial sum is an exact double.
        self.double = self.q.astype(float) if self.most.max(initial=0.0) ** 2 < 2.0**52 else None

    def search(self, rid: int, label: str, q: np.ndarray, angle: np.ndarray, same: bool, windows: list[tuple[int, int]], first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``window, rows, scores`` of the first ``first`` rows of each window ``(low, high)``, by score down and id up, among rows of the same label or of others."""
        norm = float(np.sqrt((q.astype(float) ** 2).sum()))
        lower, upper = score_bounds(angle, norm, self.low, self.high, self.least, self.most)
        use = np.flatnonzero((self.block_label == label) == same)
        use = use[np.argsort(-upper[use], kind="stable")]
        exact = self.double is not None and norm * self.most.max(initial=0.0) < 2.0**52
        floors = [low for low, _ in windows]
        best = [(np.empty(0, int), np.empty(0, np.int64)) for _ in windows]
        for at in range(0, len(use), GROUP):
            blocks = use[at : at + GROUP]
            if upper[blocks[0]] < min(floors):
                break
            wanted = np.zeros(len(blocks), bool)
            for floor, (_, high) in zip(floors, windows):
                wanted |= (upper[blocks] >= floor) & (lower[blocks] <= high)
            rows = np.concatenate([np.arange(self.start[b], self.end[b]) for b in blocks[wanted]]) if wanted.any() else np.empty(0, int)
            rows = rows[self.rid[rows] != rid]
            if not len(rows):
                continue
            scores = (self.double[rows] @ q.astype(float)).astype(np.int64) if exact else self.q[rows] @ q
            for w, (_, high) in enumerate(windows):
                inside = (scores >= floors[w]) & (scores <= high)
                if not inside.any():
                    continue
                r, s = np.concatenate((best[w][0], rows[inside])), np.concatenate((best[w][1], scores[inside]))
                order = np.lexsort((self.rid[r], self.vec_id[r], -s))[:first]
                best[w] = r[order], s[order]
                if len(order) == first:
                    floors[w] = int(best[w][1][-1])  # rows as good may have a smaller id
        for w, (r, s) in enumerate(best):
            if len(r):
                yield w, r, s


def _scan(rows: DataFrame, same: bool, first: int, id_kind: str) -> DataFrame:
    """``anchor, w, score, rid, vec_id``: for each slice, the first rows of each window of the anchors in it.

    Rows come by slice, vectors before anchors; only vectors are held.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, slices = None, [], {}
        for batch in batches:
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(batch.column("slice").to_numpy())) + 1, [batch.num_rows]))
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if not part.num_rows:
                    continue
                if part.column("slice")[0].as_py() != last:
                    last, held, slices = part.column("slice")[0].as_py(), [], {}
                vectors = part.filter(pa.compute.is_null(part.column("windows")))
                if vectors.num_rows:
                    held.append(vectors)
                queries = part.filter(pa.compute.is_valid(part.column("windows")))
                if not queries.num_rows:
                    continue
                if held:
                    slices, held = _slices(held), []
                out: list[tuple] = []
                for r in queries.to_pylist():
                    q = np.array(r["q"], np.int64)
                    if len(q) in slices:
                        found = slices[len(q)].search(r["rid"], r["label"], q, np.array(r["angle"]), same, [tuple(w) for w in r["windows"]], first)
                        for w, hit, scores in found:
                            out += zip([r["rid"]] * len(hit), [w] * len(hit), scores.tolist(), slices[len(q)].rid[hit].tolist(), slices[len(q)].vec_id[hit].tolist())
                columns = list(zip(*out)) if out else [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), batch.schema.field("vec_id").type]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "w", "score", "rid", "vec_id"])

    dealt = rows.repartition("slice").sortWithinPartitions("slice", F.col("windows").isNotNull(), "rid")
    return dealt.mapInArrow(scan, f"anchor bigint, w int, score bigint, rid bigint, vec_id {id_kind}")


def _slices(held: list[pa.RecordBatch]) -> dict[int, Slice]:
    """The vectors of a slice by length."""
    table = pa.Table.from_batches(held).combine_chunks()
    sizes = pa.compute.list_value_length(table.column("q")).to_numpy()
    out = {}
    for size in np.unique(sizes):
        part = table.filter(pa.array(sizes == size))
        flat = [c.combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in (part.column("q"), part.column("angle"))]
        label = np.array(part.column("label").to_pylist(), dtype=object).astype(str)
        vec_id = part.column("vec_id").to_numpy(zero_copy_only=False)
        out[int(size)] = Slice(part.column("rid").to_numpy(), vec_id, label, flat[0].reshape(part.num_rows, size), flat[1].reshape(part.num_rows, -1))
    return out


def _first(found: DataFrame, first: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def quantised(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """``rid, vec_id, label, q, anchor`` of the rows that take part, stored, each with a number of its own."""
    whole = "coalesce(forall(e, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity')), false)"
    read = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"), F.col(label).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    read = read.where("vec_id is not null and label is not null").where(whole)
    # A component of 2^31 or more has no place in a squared length under 2^62.
    read = read.where(f"forall(e, x -> abs(double(x)) < {2**31 // scale})")
    sized = read.withColumn("q", F.expr(f"transform(e, x -> cast(floor({scale}D * double(x)) as bigint))"))
    sized = sized.where(f"aggregate(q, 0D, (s, x) -> s + double(x) * double(x)) < {2.0**62!r}D * 0.999999D")
    return frozen(sized.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "q", "anchor"))


def mine(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE, slice_rows: int = SLICE) -> DataFrame:
    """Hard negatives of the rows where ``anchor`` holds: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Positives are an anchor's ``positives`` best rows of its label; for each, the
    ``negatives`` best rows of other labels with ``low * positive_score <=
    100 * negative_score <= high * positive_score`` are returned.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    spark = vectors.sparkSession
    stored = quantised(vectors, anchor, vec_id, embedding, label, scale)
    nonzero = stored.where("exists(q, x -> x <> 0)").select(F.transform("q", lambda x: x.cast("double")).alias("v"))
    references = principal_axes(nonzero.mapInArrow(_units, nonzero.schema), REFERENCES)
    rows = stored.count()
    count = max(1, -(-rows // slice_rows), min(2 * spark.sparkContext.defaultParallelism, -(-rows // LEAST_SLICE)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("q").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                q = _groups(part.column("q"))[0]
                norm = np.sqrt((q**2).sum(axis=1))
                fits = references.size and references.shape[1] == size
                angle = angles(q / np.where(norm > 0, norm, 1.0)[:, None], references) if fits else np.zeros((part.num_rows, 0))
                width = angle.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * width, pa.int32()), pa.array(angle.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "angle"])

    schema = f"rid bigint, vec_id {kind}, label string, q array<bigint>, anchor boolean, angle array<double>"
    placed = frozen(stored.mapInArrow(place, schema))
    one = placed.select(F.pmod(F.xxhash64("rid"), F.lit(count)).cast("int").alias("slice"), "rid", "vec_id", "label", "q", "angle", F.lit(None).cast("array<array<bigint>>").alias("windows"))
    asked = placed.where("anchor").select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("slice"), "rid", "vec_id", "label", "q", "angle")
    everything = F.array(F.array(F.lit(LOWEST), F.lit(HIGHEST)))
    best = frozen(_first(_scan(one.union(asked.withColumn("windows", everything)), True, positives, kind), positives))
    # The least and the most score of a window; hundreds apart from the rest, so that nothing overflows.
    pairs = best.select("anchor", F.col("rank").alias("w"), "score", F.col("vec_id").alias("positive_id"))
    rest = "pmod(score, 100)"
    least, most = (F.expr(f"cast({share} * ((score - {rest}) div 100) + ({share} * {rest} + {up}) div 100 as bigint)") for share, up in ((low, 99), (high, 0)))
    window = F.struct("w", F.array(least, most).alias("range"))
    windows = pairs.groupBy(F.col("anchor").alias("rid")).agg(F.transform(F.array_sort(F.collect_list(window)), lambda x: x["range"]).alias("windows"))  # a few each
    found = _first(_scan(one.unionByName(asked.join(frozen(windows), "rid").select(*one.columns)), False, negatives, kind), negatives)
    named = found.select("anchor", (F.col("w") + 1).alias("w"), F.col("rank").cast("int").alias("rank"), F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"))
    anchors = placed.where("anchor").select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    done = named.join(pairs, ["anchor", "w"]).join(anchors, "anchor")
    return done.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")

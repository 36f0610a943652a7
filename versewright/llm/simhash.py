"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: ASCII-lower-cased words, overlapping shingles of ``shingle``
words (repeats count), XXH64 (seed 42) of each; a bit is 1 if more than half
of the hashes have it.

Links: two fingerprints within ``2r`` bits of one another have a common
variant within ``r`` bits of both, so each distinct fingerprint emits its
ball of half the radius, rows are shuffled on the variants, and colliding
pairs are verified.  The radius 3 is odd; a full ball of two flips has 2,081
variants.  Instead one of three bit blocks (21, 21 and 22 bits) is erased at
a time and one flip is made in the rest, 131 variants in all: three
differing bits that are not all in one block leave a block that holds just
one of them, and erasing it leaves two, one flip from either side; three in
one block collide when that block is erased, without any flip.

Inside one variant's rows fingerprints are compared in memory and only a
spanning set of verified links goes on.  Such a group never grows with the
copies of a text (fingerprints are distinct before they are emitted).
Beyond ``DIRECT`` rows the comparison runs on the erased bits alone by
neighbour look-up, which is linear in the group and keeps the same
components.

Near duplicates of a wanted similarity (:func:`keep_one`): texts are linked by
their fingerprints as above.  Three of 64 bits mean a similarity of about
0.98, and at 0.8 about ten of 64 bits differ, too many for a ball, so links of
that similarity are added.  A text is its set of shingles there.  Candidates have all
``ROWS`` minima in common in one of ``BANDS`` bands (MinHash); a pair at
``SIMILAR`` is missed with probability (1 - 0.8**6)**32 = 6e-5, whatever other
texts there are.  Every link is verified: the sets themselves must have a
Jaccard similarity of ``SIMILAR`` or more.  First each text is compared with
the least text of each of its bands; then all texts of one band that are in
different components are compared in blocks of bounded size, so a link that
the first step did not see is never lost.  Blocks give out spanning links, not
pairs; only the comparisons in memory grow with the square of a band's texts
that are not linked yet.

Defined results: a null or empty text has fingerprint zero (the empty set)
and links like any other; a null ``doc_id`` never becomes a component id unless its
component holds nothing else; repeated rows come out as often as they went
in; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen, row_key, utf8_values, whole_groups
from .components import connected_components
from .line_dedup import _packed, _unpacked

RADIUS = 3
SEED = 42
#: First bit and number of bits of the blocks that are erased in turn.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Rows of one variant up to which every pair in memory is compared.
DIRECT = 48
#: Jaccard similarity of near duplicates; MinHash bands of a text, and minima of a band.
SIMILAR, BANDS, ROWS = 0.8, 32, 6
#: Texts of one band that are compared with one another, or with as many others, in one group.
BLOCK = 512
#: Odd factors and summands of the MinHash orders.
_TURNS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The hash of each shingle of one text given in UTF-8, repeats too."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, n = xxhash.xxh64_digest, max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in zip(starts, stops)]), ">u8").astype(np.uint64)


def _fingerprint(values: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(values)).tobytes(), "big")


def text_fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text given in UTF-8."""
    return _fingerprint(_hashes(text, shingle))


def _band_keys(values: np.ndarray) -> list[int]:
    """One signed key per band, of the minima of a set of shingles that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(least, (values[at : at + 1024, None] * _TURNS[0] + _TURNS[1]).min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(bands[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def text_sketch(text: bytes | None, shingle: int = 5) -> tuple[int, int, int, list[int]]:
    """Signed SimHash of one text, a hash of its set of shingles, the size of the set, and its band keys; zeros and no keys if it is empty."""
    every = _hashes(text, shingle)
    values = np.unique(every)
    if not len(values):
        return 0, 0, 0, []
    sim = _fingerprint(every)
    return sim - (1 << 64) if sim >> 63 else sim, xxhash.xxh64_intdigest(values.tobytes(), SEED) - (1 << 63), len(values), _band_keys(values)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with the signed 64-bit SimHash of ``text`` as ``out`` in place of the text."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([text_fingerprint(t, shingle) for t in utf8_values(batch.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(values)], names=[*names, out])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + f"`{out}` bigint"
    return docs.select(*[f"`{n}`" for n in names], text).mapInArrow(run, schema)


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with ``sim`` (the SimHash), ``fp`` (a hash of the set of shingles), ``size`` and ``bands`` of :func:`text_sketch` in place of ``text``."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim, fp, size, bands = zip(*[text_sketch(t, shingle) for t in utf8_values(batch.column("text"))]) if batch.num_rows else ((), (), (), ())
            new = [pa.array(sim, pa.int64()), pa.array(fp, pa.int64()), pa.array(size, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + new, names=[*names, "sim", "fp", "size", "bands"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + "sim bigint, fp bigint, size int, bands array<bigint>"
    return docs.select(*[f"`{n}`" for n in names], "text").mapInArrow(run, schema)


def _variants(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all variants, and for each the index of its fingerprint."""
    keys = []
    for number, (first, width) in enumerate(BLOCKS):
        below = values & np.uint64((1 << first) - 1)
        above = values >> np.uint64(first + width) if first + width < 64 else np.zeros_like(values)
        rest = 64 - width
        outside = (above << np.uint64(first)) | below
        flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(rest, dtype=np.uint64)))
        keys.append((outside[:, None] ^ flips[None, :]) | np.uint64(number << 60))
    every = np.concatenate(keys, axis=1)
    return every.ravel().view(np.int64), np.repeat(np.arange(len(values)), every.shape[1])


def _rests(values: np.ndarray) -> np.ndarray:
    """What a variant lacks of its fingerprint, for all rows of :func:`_variants`: the erased bits, and above them the number of the flip (0: none)."""
    flips = np.concatenate([np.arange(65 - width, dtype=np.int64) << 22 for _, width in BLOCKS])
    inner = [((values >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64) for first, width in BLOCKS]
    per = [np.repeat(x[:, None], 65 - width, axis=1) for x, (_, width) in zip(inner, BLOCKS)]
    return (np.concatenate(per, axis=1) | flips).ravel().astype(np.int32)


def _restored(keys: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """The fingerprints of variants and their rests."""
    keys, rests = keys.view(np.uint64), rests.astype(np.uint64)
    number, flip = keys >> np.uint64(60) & np.uint64(3), rests >> np.uint64(22)
    bit = np.where(flip > 0, np.uint64(1) << (np.maximum(flip, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    outside = (keys & np.uint64((1 << 60) - 1)) ^ bit
    first = np.array([b[0] for b in BLOCKS], np.uint64)[number]
    below = outside & ((np.uint64(1) << first) - np.uint64(1))
    above = outside >> first
    after = np.array([min(63, b[0] + b[1]) for b in BLOCKS], np.uint64)[number]  # nothing lies above the last block
    return above << after | (rests & np.uint64((1 << 22) - 1)) << first | below


def _settle(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For every node 0..n-1 the smallest node it reaches over links (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _large_group(values: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one variant's fingerprints that keep its components, by look-up of neighbours in the erased block.

    Rows with the same erased bits, or with one bit between them, differ in
    at most three bits.  Of other pairs only those without a flip (equal
    outside the block) are needed here; the rest meet under another block.
    """
    number = (key >> 60) & 3
    first, width = BLOCKS[number]
    inner = ((values >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
    order = np.argsort(inner, kind="stable")
    cells, start = np.unique(inner[order], return_index=True)
    head = order[start]
    owner = np.searchsorted(cells, inner)
    a, b = [np.arange(len(values))], [head[owner]]

    def look(found: np.ndarray, of: np.ndarray, known: np.ndarray, at: np.ndarray) -> None:
        k = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[k] == found
        a.append(of[hit])
        b.append(at[k[hit]])

    ones = [1 << x for x in range(width)]
    for flip in ones:
        look(cells ^ flip, head, cells, head)
    below = values & np.uint64((1 << first) - 1)
    above = values >> np.uint64(first + width) if first + width < 64 else np.zeros_like(values)
    plain = np.flatnonzero(((above << np.uint64(first)) | below) == np.uint64(key & ((1 << 60) - 1)))
    if len(plain) > 1:
        plain = plain[np.argsort(inner[plain])]
        known = inner[plain]
        for x in range(width):
            for y in range(x + 1, width):
                look(known ^ (ones[x] | ones[y]), plain, known, plain)
                for z in range(y + 1, width):
                    look(known ^ (ones[x] | ones[y] | ones[z]), plain, known, plain)
    return np.concatenate(a), np.concatenate(b)


def _flood(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among fingerprints within ``radius``: each found one looks for those not found yet, so a dense group takes one look."""
    a, b = [], []
    left = np.arange(len(values))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            hit = np.bitwise_count(values[left] ^ values[at]) <= radius
            found = left[hit]
            left = left[~hit]
            a.append(found)
            b.append(np.full(len(found), at))
            front += found.tolist()
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def _links(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of verified pairs among rows that are sorted by key."""
    n = len(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, n))
    several = np.repeat(sizes > 1, sizes)
    small = np.repeat((sizes > 1) & (sizes <= DIRECT), sizes)
    if not several.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = [], []
    rows = np.flatnonzero(small)
    for gap in range(1, int(sizes[sizes <= DIRECT].max(initial=1))):
        rows = rows[rows + gap < n]
        rows = rows[keys[rows] == keys[np.minimum(rows + gap, n - 1)]]
        if not len(rows):
            break
        close = np.bitwise_count(values[rows] ^ values[rows + gap]) <= radius
        left.append(rows[close])
        right.append(rows[close] + gap)
    for at, size in zip(starts[sizes > DIRECT], sizes[sizes > DIRECT]):
        own = values[at : at + size]
        i, j = _large_group(own, int(keys[at : at + 1].view(np.uint64)[0]))
        left.append(i + at)
        right.append(j + at)
    i, j = np.concatenate(left), np.concatenate(right)
    differ = i != j
    label = _settle(n, i[differ], j[differ])
    moved = np.flatnonzero(label != np.arange(n))
    pairs = np.unique(np.stack((values[moved].view(np.int64), values[label[moved]].view(np.int64)), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _met(rows: DataFrame, radius: int) -> DataFrame:
    """Spanning links ``(a, b)`` of the fingerprints, given as (variant, rest), that share a variant and are within ``radius``."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rests in whole_groups(batches):
            a, b = _links(keys, _restored(keys, rests), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition("variant").sortWithinPartitions("variant").mapInArrow(meet, "a bigint, b bigint").distinct()


def fingerprint_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints at most three bits apart, exact and free of pairs of large groups."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 4096):
                keys, _ = _variants(values[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(_rests(values[at : at + 4096]))], names=["variant", "rest"])

    # Dealt over all tasks: the table is small, what it emits is not.
    dealt = distinct.select(F.col(fp).alias("fp")).repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return _met(dealt.mapInArrow(emit, "variant bigint, rest int"), RADIUS)


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning links ``(a, b)`` between the parts of two blocks of one band (or within one), by the sets themselves.

    Only pairs of different parts, of sizes that allow ``SIMILAR`` and whose
    first common band this is are compared; a verified link makes two parts
    one, so what follows from it isn't compared again.
    """
    band = rows["band"].iloc[0]
    same = rows["p"].iloc[0] == rows["q"].iloc[0]
    first = rows["first"].to_numpy() | same
    fp, part, size = (rows[c].to_numpy() for c in ("fp", "part", "size"))
    part = part.copy()
    bands = np.stack(rows["bands"].to_list())
    own = (bands == band).argmax(axis=1)
    sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
    a, b = [], []
    for i in np.flatnonzero(first):
        wanted = part != part[i]
        wanted &= np.arange(len(fp)) > i if same else ~first
        wanted &= np.minimum(size, size[i]) >= SIMILAR * np.maximum(size, size[i]) - 1e-9
        wanted &= ~(bands[:, : own[i]] == bands[i, : own[i]]).any(axis=1)
        for j in np.flatnonzero(wanted):
            if part[j] == part[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= SIMILAR * (size[i] + size[j] - common) - 1e-9:
                part[part == part[j]] = part[i]
                a.append(fp[i])
                b.append(fp[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _links_apart(known: DataFrame, open_bands: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Verified links ``(a, b)`` between texts of one band in ``known`` (band, fp, part) that are in different parts.

    ``open_bands`` (band, n) are the bands with such texts.  A band's texts are
    dealt into blocks of about ``block``; each pair of blocks is one bounded
    group, which gives out spanning links only, never its pairs.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = known.select("band", "fp", "part").join(open_bands.select("band", blocks.alias("blocks")), "band")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = frozen(rows.select("band", "fp", "part", (F.col("own") <= F.col("other")).alias("first"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")))
    return rows.join(sets, "fp").groupBy("band", "p", "q").applyInPandas(_joined, "a bigint, b bigint").distinct()


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(fp, size, bands, hashes)`` of the texts with a ``key`` in ``wanted`` (key, fp); ``hashes`` is the sorted set of shingles, 8 bytes each."""
    found = _packed(docs.select("key", "text")).join(wanted.hint("merge"), "key").select("text", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(_hashes(t, shingle)) for t in _unpacked(part)]
                size, bands = pa.array(map(len, sets), pa.int32()), pa.array(map(_band_keys, sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(1), size, bands, pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "size", "bands", "hashes"])

    return found.mapInArrow(run, "fp bigint, size int, bands array<bigint>, hashes binary").dropDuplicates(["fp"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have a Jaccard similarity of ``SIMILAR`` or more; sets of sizes that exclude it aren't moved."""
    size = sets.select("fp", "size")
    sized = pairs.join(size.toDF("a", "m"), "a").join(size.toDF("b", "n"), "b")
    fits = frozen(sized.where(F.least("m", "n") >= F.greatest("m", "n") * F.lit(SIMILAR) - F.lit(1e-9)).select("a", "b"))
    of = sets.select("fp", "hashes")
    both = fits.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= SIMILAR * (len(x) + len(y) - common) - 1e-9)
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def similar_links(docs: DataFrame, marked: DataFrame, shingle: int, block: int = BLOCK) -> DataFrame:
    """Verified links ``(a, b)`` of the sets ``fp`` in ``marked`` (key, fp, size, bands); every pair of one band is linked by one of them or a chain of them, or not similar.

    Band rows hold two numbers each, since there are ``BANDS`` of them for a
    text; names of texts are met again where a band has several.  Their joins are merge joins at every
    size of table.
    """
    distinct = frozen(marked.where("size > 0").groupBy("fp").agg(F.min("key").alias("key"), F.first("bands").alias("bands")))
    rows = distinct.select("fp", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("fp").alias("head"), F.max("fp").alias("last"))
    heads = frozen(heads.where("head <> last").select("band", "head"))  # stored: the join can be split at a hot band
    met = frozen(rows.join(heads.hint("merge"), "band").select("band", "fp", "head"))
    wanted = distinct.select("fp", "key").join(met.select("fp").distinct(), "fp")
    sets = frozen(_shingle_sets(docs, frozen(wanted), shingle))
    stars = met.where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()
    links = frozen(_verified(stars, sets))
    parts = connected_components(links)
    known = frozen(met.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("band", "fp", F.coalesce("component", "fp").alias("part")))
    apart = known.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2")
    return links.union(_links_apart(known, frozen(apart.select("band", "n")), sets, block))


def _components(marked: DataFrame, links: DataFrame) -> DataFrame:
    """``marked`` (doc_id, key, row_id, fp) with the head of its component and whether it is that head."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    groups = marked.groupBy("fp").agg(F.min(order).alias("first"))
    parts = connected_components(links)
    whole = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    whole = whole.select("fp", "first", F.coalesce("component", "fp").alias("part"))
    heads = whole.groupBy("part").agg(F.min("first").alias("head"))
    known = whole.join(heads, "part").select("fp", "head")
    joined = marked.join(known, "fp")
    return joined.select("doc_id", "key", "fp", F.col("head.doc_id").alias("component_id"), (F.col("row_id") == F.col("head.row_id")).alias("keep"))


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).cast("string").alias("text"))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``key``, ``fp`` (signed long), ``component_id``, ``keep``; links are fingerprints within three bits.

    ``component_id`` is the smallest ``doc_id`` whose fingerprint can be
    reached over links.  ``keep`` holds for one row of each component, that
    with the smallest ``doc_id`` (nulls come last).
    """
    marked = frozen(fingerprints(_base(docs, doc_id, text), "text", shingle).withColumn("row_id", F.monotonically_increasing_id()))
    return _components(marked, fingerprint_links(marked.select("fp").distinct()))


def _ball_links(marked: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between sets ``fp`` whose texts' SimHash ``sim`` is within three bits: each set to the least one of its fingerprint, and these by the ball."""
    pairs = marked.select("sim", "fp").distinct()
    least = frozen(pairs.groupBy("sim").agg(F.min("fp").alias("least")))
    same = pairs.join(least, "sim").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    close = fingerprint_links(least.select("sim"), "sim").join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    return same.union(close.where("x <> y").select("x", "y"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, block: int = BLOCK) -> DataFrame:
    """As :func:`simhash_components`, whose links within three bits are joined by those between texts whose sets of shingles have a Jaccard similarity of ``SIMILAR`` or more; ``fp`` names the set."""
    base = _base(docs, doc_id, text)
    marked = frozen(sketches(base, shingle).withColumn("row_id", F.monotonically_increasing_id()))
    links = _ball_links(marked).union(similar_links(base, marked.drop("sim"), shingle, block))
    return _components(marked.drop("sim", "size", "bands"), links)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with all its columns, one document of each group of near duplicates; repeated rows are one document."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name clashes from here on
    own, words = (named.columns[docs.columns.index(c)] for c in (doc_id, text))
    kept = near_components(named, own, words, shingle).where("keep").select("key")
    left = named.withColumn("key", row_key(own, words)).join(kept, "key", "left_semi").dropDuplicates(["key"])
    return left.select(*[F.col(c).alias(n) for c, n in zip(named.columns, docs.columns)])

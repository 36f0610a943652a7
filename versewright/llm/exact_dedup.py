"""Exact duplicates by composable polynomial fingerprints.

The text without ASCII white space is hashed as a polynomial over its UTF-8
bytes modulo two primes below 2**31.  Chunks are hashed independently of one
another and combined with ``H(a + b) = H(a) * B**len(b) + H(b)``.  A text of
more than ``SPREAD`` bytes is cut into rows of ``SPREAD`` bytes, which are
dealt over all tasks, hashed in parallel and combined by
:func:`combine_chunks`; a shorter one is hashed where it is, chunk by chunk.
The arithmetic, and so the fingerprint, is the same.

Documents with equal fingerprint and length are candidates.  Their texts are
stored once, in chunks, and each is compared chunk by chunk with the smallest
row of its candidate group: an equi-join on (fingerprint, chunk number) whose
right side has one row per chunk, so a group with a third of all rows is
split like any skewed join.  A candidate that differs (a fingerprint
collision) forms a class of its own by SHA-256.  Texts meet the list of candidates
in a merge join, whatever the list's size, so the work grows evenly with the input.

Defined results: null text counts as empty; of equal texts the row with the
most code points, then the smallest ``doc_id`` (null last), then any one
of the repeated rows stays; repeated rows come out as often as they went in; an
empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, frozen, row_key, utf8_values

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 8_191_009)
#: Bytes of a chunk that is hashed on its own.
CHUNK = 1 << 16
#: Bytes of a chunk that is compared on its own.
COMPARED = 1 << 18
#: Bytes of text beyond which a document's chunks are hashed in parallel.
SPREAD = 1 << 20


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base**(n-1) ... base**0`` modulo ``prime``."""
    out = np.ones(1, np.uint64)
    while len(out) < n:  # doubling: the next powers are the known ones shifted
        shift = np.uint64(pow(base, len(out), prime))
        out = np.concatenate((out * shift % np.uint64(prime), out))
    return out[-n:] if n else out[:0]


_TABLES = [_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES)]


def chunk_hashes(data: bytes, chunk: int = CHUNK) -> list[tuple[int, list[int]]]:
    """``(length, hashes)`` of each chunk; no chunk depends on another."""
    values, out = np.frombuffer(data, np.uint8), []
    whole = len(values) // chunk
    rows = []
    for table, prime in zip(_TABLES, PRIMES):
        table = table[-chunk:]
        got = [int(x) for x in (values[: whole * chunk].reshape(whole, chunk) @ table) % np.uint64(prime)] if whole else []
        rest = values[whole * chunk :]
        if len(rest):
            got.append(int((rest @ table[-len(rest) :]) % np.uint64(prime)))
        rows.append(got)
    sizes = [chunk] * whole + [len(values) - whole * chunk] * (len(values) > whole * chunk)
    for i, size in enumerate(sizes):
        out.append((size, [r[i] for r in rows]))
    return out


def combine(parts: list[tuple[int, list[int]]]) -> int:
    """One 62-bit fingerprint of the chunks in order, by length-shifted arithmetic."""
    total = [0] * len(PRIMES)
    for size, hashes in parts:
        for k, (base, prime) in enumerate(zip(BASES, PRIMES)):
            total[k] = (total[k] * pow(base, size, prime) + hashes[k]) % prime
    return total[0] << 31 | total[1]


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, ASCII_SPACE)


def _bare_blocks(text: bytes | None) -> Iterator[bytes]:
    """The normalised text in blocks of at most ``SPREAD`` bytes of the text."""
    text = text or b""
    for at in range(0, len(text), SPREAD):
        yield normalised(text[at : at + SPREAD])


def text_fingerprints(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """``docs`` without ``text`` and with ``n_points``, ``n_bytes``, ``poly`` (null beyond ``spread`` bytes) and ``text_sha256``."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, sizes, polys, shas = [], [], [], []
            for raw in utf8_values(batch.column("text")):
                sha, size = hashlib.sha256(), 0
                short = len(raw or b"") <= spread
                parts: list[tuple[int, list[int]]] = []
                for block in _bare_blocks(raw):
                    sha.update(block)
                    size += len(block)
                    if short:
                        parts += chunk_hashes(block)
                points.append(len(raw or b"") - sum(np.count_nonzero((np.frombuffer(raw, np.uint8, min(SPREAD, len(raw) - at), at) & 0xC0) == 0x80) for at in range(0, len(raw or b""), SPREAD)))
                sizes.append(size)
                polys.append(combine(parts) if short else None)
                shas.append(sha.hexdigest())
            new = [pa.array(points, pa.int64()), pa.array(sizes, pa.int64()), pa.array(polys, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + new, names=[*names, "n_points", "n_bytes", "poly", "text_sha256"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.select(*[f"`{n}`" for n in names], "text").mapInArrow(run, schema + "n_points bigint, n_bytes bigint, poly bigint, text_sha256 string")


def spread_fingerprints(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """``(key, poly)`` of the texts of more than ``spread`` bytes; their chunks are dealt over all tasks."""
    bytes_ = F.col("text").cast("binary")
    long = docs.where(F.octet_length("text") > spread).select("key", bytes_.alias("text"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / spread).cast("int")), lambda i: F.substring("text", i * spread + 1, F.lit(spread)))
    rows = long.dropDuplicates(["key"]).select("key", F.posexplode(cut).alias("chunk_no", "piece"))
    dealt = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for piece in batch.column(2).to_pylist():
                bare = normalised(piece)
                both = combine(chunk_hashes(bare))
                for column, x in zip(out, (len(bare), both >> 31, both & (1 << 31) - 1, *(pow(b, len(bare), p) for b, p in zip(BASES, PRIMES)))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [pa.array(c, pa.int64()) for c in out], names=["key", "chunk_no", "size", "h1", "h2", "s1", "s2"])

    hashed = dealt.mapInArrow(run, "key string, chunk_no int, size bigint, h1 bigint, h2 bigint, s1 bigint, s2 bigint")
    return combine_chunks(hashed, "key").select("key", "poly")


def combine_chunks(chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, poly)`` of documents stored as rows ``(doc_id, chunk_no, size, h1, h2, s1, s2)``.

    ``s1`` and ``s2`` are ``B**size`` modulo the primes.  Only hashes are
    gathered, 56 bytes a chunk, and folded in chunk order.
    """
    fold = [f"aggregate(parts, 0L, (acc, x) -> (acc * x.s{k} + x.h{k}) % {p}L) AS t{k}" for k, p in enumerate(PRIMES, 1)]
    parts = chunks.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "size", "h1", "h2", "s1", "s2"))).alias("parts"), F.sum("size").alias("n_bytes"))
    return parts.selectExpr(doc_id, "n_bytes", *fold).selectExpr(doc_id, "n_bytes", "shiftleft(t1, 31) | t2 AS poly")


def _pieces(df: DataFrame) -> DataFrame:
    """A row for each chunk of the normalised text (one at least)."""
    df = df.withColumn("bare", F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "").cast("binary")).drop("text")
    last = F.greatest(F.lit(0), F.floor((F.octet_length("bare") - 1) / COMPARED)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("bare", i * COMPARED + 1, F.lit(COMPARED)))
    return df.select(*[c for c in df.columns if c != "bare"], F.posexplode(cut).alias("chunk_no", "piece"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spread: int = SPREAD) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    base = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).cast("string").alias("text"))
    long = frozen(spread_fingerprints(base, spread).withColumnRenamed("poly", "spread_poly"))
    marked = text_fingerprints(base, spread).join(long, "key", "left").withColumn("poly", F.coalesce("poly", "spread_poly")).drop("spread_poly")
    marked = frozen(marked.withColumn("row_id", F.monotonically_increasing_id()))
    groups = marked.groupBy("poly", "n_bytes").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    groups = frozen(groups.where("first_key <> last_key").drop("last_key"))
    # Candidates with their texts; the first of each group is what the others are compared with.
    # Repeated rows share a key and are one candidate, or their copies would meet in the joins below.
    members = frozen(marked.select("key", "poly", "n_bytes").distinct().join(groups, ["poly", "n_bytes"]).select("key", "poly", "n_bytes", "first_key"))
    pieces = frozen(_pieces(base.select("key", "text").join(members.hint("merge"), "key").dropDuplicates(["key"])))
    model = pieces.where("key = first_key").select("poly", "n_bytes", "chunk_no", F.col("piece").alias("model"))
    compared = pieces.where("key <> first_key").join(model, ["poly", "n_bytes", "chunk_no"], "left")
    differs = frozen(compared.where(~F.col("piece").eqNullSafe(F.col("model"))).select("key").distinct().withColumn("differs", F.lit(True)))
    marked = marked.join(differs, "key", "left")
    marked = marked.withColumn("other", F.when(F.col("differs"), F.col("text_sha256")).otherwise(F.lit("")))
    key = ["poly", "n_bytes", "other"]
    order = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    # Stored, so that the join below has an exchange on either side and a hot class can be split.
    classes = frozen(marked.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(order).alias("stays")))
    return marked.join(classes, key).select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("stays.row_id")).alias("kept"), "text_sha256"
    )

"""What the operators of this subpackage share: written tables, Arrow batches as numpy, word hashes.

Words are runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``.  They are found in whole batches of
texts at once: a batch is one byte buffer with offsets, and a word's hash is a difference of two prefix
sums of a polynomial in 64 bits, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions import tables
from sceneloom.functions.tables import drop_written, shared_dir  # noqa: F401  passed on to the operators

#: Broadcast a side only if it has at most so many rows and bytes; beyond that, a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


#: Bytes of a batch of rows on its way to or from Python; one longer row is a batch by itself.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound batches by bytes, not by rows alone: texts differ in length. A bound that the session names stays."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again, its batches bounded."""
    bound_batches(df.sparkSession)
    return tables.written(df)


def small_enough(df: DataFrame) -> bool:
    """Whether df's measured rows and bytes lie within the broadcast bound."""
    length = {"string": F.octet_length, "binary": F.octet_length, "array<binary>": lambda c: F.aggregate(c, F.lit(0), lambda n, b: n + F.octet_length(b) + 24)}
    length |= {t: lambda c: 8 * F.size(c) + 16 for t in ("array<bigint>", "array<int>")}
    width = sum(F.coalesce(length[t](F.col(c)), F.lit(0)) if t in length else F.lit(16) for c, t in df.dtypes)
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not use (names are compared without case, as Spark does)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def byte_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with about `most` text bytes: (rows, bytes, offsets). Null counts as empty; one long text is one slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            hi = min(hi, len(col))
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi
    pa.default_memory_pool().release_unused()  # a worker waits for its next task without what this one needed


# Hashing ------------------------------------------------------------------------------------------

_R = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BYTE_SECOND = _BYTE[np.random.default_rng(8).permutation(256)] ^ np.uint64(0x5555555555555554)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, r in enumerate((_R, _INV)):
            step = np.full(size, r, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of a well-known public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they lie. second: another, independent one."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_SECOND if second else _BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: each word's start, end, text number and hash, in order. letters: words are runs of letters and digits."""
    solid = ~(NO_LETTER if letters else SPACE)[data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    if len(solid):
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[off[:-1][off[:-1] < len(data)]] = False
        after[off[1:][off[1:] > 0] - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1, span_hashes(data, start, end, lower)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i and hashes of the n-word windows i .. i + n - 1 that lie in one text."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = mix(out + hashes[at + k]) * _R
    return at, out


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text as (offsets, hashes sorted within a text). A text with 1 to n - 1 words has its whole sequence as the one shingle; without words, none."""
    _, _, doc, h = words(data, off, lower)
    at, grams = windows(h, doc, n)
    owner = doc[at]
    count = np.bincount(doc, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    first = np.searchsorted(doc, short)
    tail = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        has = count[short] > k
        tail[has] = mix(tail[has] + h[first[has] + k]) * _R
    owner, grams = np.concatenate([owner, short]), np.concatenate([grams, mix(tail ^ _R)])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    owner, grams = owner[keep], grams[keep]
    return np.searchsorted(owner, np.arange(len(off))), grams


def list_array(off: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


# Connected components ---------------------------------------------------------------------------


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that is reachable, for every id in edges (columns a, b: long).

    Large-star and small-star passes by grouped minima and joins until nothing changes; each pass is a
    written table, so a lost executor costs one pass. Nothing is collected.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, last = written(edges), None
    while True:
        stats = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stats[0] == 0 or tuple(stats) == last:
            break
        last = tuple(stats)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = written(small.where("a <> b").distinct())
        drop_written(large)
        drop_written(current)
        current = new
    del spark
    found = current.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())

"""Vectors as codes: each part of a vector becomes the number of its nearest codebook entry.

Components are fixed-point integers, so every sum is exact and the codebooks do not depend on how rows are dealt
to tasks.  The nearest entry is found by an equal-average search: entries lie sorted by the sum of their components;
from a part's own sum the search goes outward, the nearer side first, and ends once the squared gap of sums divided by
the dimension is more than the best distance so far (it bounds the distance from below).  An equal bound goes on, as an
entry behind it may tie with a lower number.

Spark deals the rows; a task adds up its parts by entry, and one grouped sum of (part, entry, position) joins the
tasks.  The driver sees the codebooks alone, whose size is a parameter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bound_batches, free_name, small_enough, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: A label with more than this share of all rows is hot: its sum is broadcast, so there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4

_HEX = np.array([list(b"%02x" % k) for k in range(256)], np.uint8)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x (n, d) the nearest row of book (k, d), the lowest number on ties, and the squared distance. Integers."""
    size, dim = book.shape
    total = book.sum(1)
    order = np.argsort(total, kind="stable")
    # a guard at either end stands for "no entry left": no gap reaches it
    far = np.int64(1) << 62
    sums = np.concatenate([[-far], total[order], [far]])
    own = x.sum(1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best, arg = np.full(len(x), far // max(dim, 1)), np.full(len(x), size)
    live = np.arange(len(x))
    while len(live):
        low, high, s = left[live], right[live], own[live]
        lower = np.where(low > 0, s - sums[low], far)
        upper = np.where(high <= size, sums[high] - s, far)
        gap = np.minimum(lower, upper)
        on = gap < far
        on[on] = gap[on] ** 2 <= best[live[on]] * dim
        live, take_low, low, high = live[on], (lower <= upper)[on], low[on], high[on]
        entry = order[np.where(take_low, low, high) - 1]
        left[live[take_low]] -= 1
        right[live[~take_low]] += 1
        away = x[live] - book[entry]
        distance = np.einsum("ij,ij->i", away, away)
        better = (distance < best[live]) | ((distance == best[live]) & (entry < arg[live]))
        best[live[better]], arg[live[better]] = distance[better], entry[better]
    return arg, best


def _limit(dim: int, parts: int) -> int:
    """How large an integer component may be so that gaps, distances and their sum over parts stay within 63 bits."""
    return int(2**30 / max(dim / max(parts, 1), dim**0.5, 1))


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors without rows whose vector is null or holds null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(v.isNotNull() & finite)


def _fits(v: Column, dim: int, parts: int, scale: int) -> Column:
    most = _limit(dim, parts) - 1
    return (F.size(v) == dim) & F.forall(v, lambda x: F.abs(F.floor(x.cast("double") * scale)) <= most)


def _integers(column: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), parts, dim // parts)


def first_codebooks(rows: DataFrame, vec_id: str, vector: str, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids (null last; equal ids in order of the vectors): (parts, entries, dimension of a part).

    The dimension is that of the smallest id whose length parts divides; vectors of other lengths, or with components
    too large for exact sums, are passed over.
    """
    smallest = [F.col(vec_id).asc_nulls_last(), F.col(vector)]
    whole = rows.where((F.size(vector) > 0) & (F.size(vector) % parts == 0))
    first = whole.select(vec_id, vector).orderBy(*smallest).limit(1).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0][1])
    chosen = whole.where(_fits(F.col(vector), dim, parts, scale)).select(vec_id, vector).orderBy(*smallest).limit(entries).collect()
    values = np.array([r[1] for r in chosen], np.float64).reshape(len(chosen), dim)
    return np.floor(values * scale).astype(np.int64).reshape(len(chosen), parts, dim // parts).transpose(1, 0, 2).copy()


def refined(rows: DataFrame, vector: str, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: every part to its nearest entry, then each entry the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _integers(batch.column(0), parts * width, parts, scale)
            for p in range(parts):
                entry, _ = nearest(x[:, p], books[p])
                count[p] += np.bincount(entry, minlength=entries)
                for c in range(width):  # exact: a batch's sums lie far below 2**53
                    total[p, :, c] += np.bincount(entry, x[:, p, c], entries).astype(np.int64)
        used = np.flatnonzero(np.repeat(count.reshape(-1) > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.repeat(count.reshape(-1), width)[used]), pa.array(total.reshape(-1)[used])], names=["cell", "n", "total"])

    sums = rows.select(vector).mapInArrow(run, "cell bigint, n bigint, total bigint").groupBy("cell")
    out = books.copy().reshape(-1)
    for cell, n, total in sums.agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)"))).collect():  # one row for each number of the codebooks
        out[cell] = int(total) // n
    return out.reshape(books.shape)


def compressed(rows: DataFrame, vector: str, books: np.ndarray, scale: int) -> DataFrame:
    """rows with `code` and `error` in place of the vector; both null where the vector is null."""
    parts, _, width = books.shape
    names = [c for c in rows.columns if c != vector]
    schema = StructType([rows.schema[c] for c in names] + [StructField("code", StringType()), StructField("error", LongType())])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            x = _integers(column.take(pa.array(there)), parts * width, parts, scale) if len(there) else np.zeros((0, parts, width), np.int64)
            code, error = np.zeros((len(there), parts), np.int64), np.zeros(len(there), np.int64)
            for p in range(parts):
                code[:, p], distance = nearest(x[:, p], books[p])
                error += distance
            text = _HEX[code].tobytes().decode()
            codes, errors = [None] * batch.num_rows, np.ma.masked_all(batch.num_rows, np.int64)
            for k, row in enumerate(there.tolist()):
                codes[row] = text[2 * parts * k : 2 * parts * (k + 1)]
            errors[there] = error
            others = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*others, pa.array(codes, pa.string()), pa.array(errors.filled(0), pa.int64(), mask=np.ma.getmaskarray(errors))], schema=pa.schema([*(pa.field(c, o.type) for c, o in zip(names, others)), ("code", pa.string()), ("error", pa.int64())]))

    return rows.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(rows of vec_id, label, code, error; codebooks): product codes of every usable vector.

    Rows whose vector is null or holds null or non-finite components are left out. A vector whose length is not the common
    one (that of the smallest id whose length parts divides), or with a component beyond about 2**19 (for 64
    components; sums would not fit 64 bits), stays with a null code and error. With fewer vectors than entries the codebooks are
    shorter; an empty table gives no rows. Equal ids are rows of their own; a null id comes last; ties go to the
    lower entry. Other columns are not looked at. entries is at most 256 (two hex digits).
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    bound_batches(vectors.sparkSession)
    rows = kept(vectors.select(vec_id, label, vector), vector)
    books = first_codebooks(rows, vec_id, vector, parts, entries, scale)
    dim = parts * books.shape[2]
    fits = _fits(F.col(vector), dim, parts, scale) if books.shape[1] else F.lit(False)
    for _ in range(rounds if books.size else 0):
        books = refined(rows.where(fits), vector, books, scale)
    coded = compressed(rows.withColumn(vector, F.when(fits, F.col(vector))), vector, books, scale)
    return coded, books


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error: the errors of all rows of that label, nulls together (null beyond 64 bits).

    Sums are combined before they are shuffled. A hot label's rows meet its sum by a broadcast of fewer than 10,000 rows; the others by
    a join whose keys each hold at most 1 in 10,000 rows, or by a broadcast if all sums are measured to be small.
    """
    key, name = free_name(coded, "_label"), free_name(coded, "_sum")
    sums = written(coded.groupBy(F.col(label).alias(key)).agg(F.try_sum("error").alias(name), F.count(F.lit(1)).alias("_rows")))
    join = F.col(label).eqNullSafe(F.col(key))
    if small_enough(sums):
        return coded.join(F.broadcast(sums.drop("_rows")), join).withColumnRenamed(name, "label_error").drop(key)
    bound = (sums.agg(F.sum("_rows")).first()[0] or 0) * HOT_SHARE
    hot, rest = (sums.where(c).drop("_rows") for c in (F.col("_rows") > bound, F.col("_rows") <= bound))
    known = coded.join(F.broadcast(hot), join, "left")
    found = known.where(F.col(name).isNotNull())
    others = coded.join(F.broadcast(hot), join, "left_anti").join(rest, join)
    return found.unionByName(others).withColumnRenamed(name, "label_error").drop(key)


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = with_label_errors(written(coded))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _books_sql(before: str, name: str) -> str:
    return f"""
{name}n AS (
    SELECT p.vec_id, p.part, arg_min(b.entry, (list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry,
        min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
    FROM parts p JOIN {before} b USING (part) GROUP BY p.vec_id, p.part),
{name}s AS (
    SELECT part, entry, c, CAST(floor(CAST(sum(x[c]) AS DOUBLE) / count(*)) AS BIGINT) AS v
    FROM {name}n JOIN parts USING (vec_id, part), (SELECT unnest(range(1, {64 // PARTS + 1})) AS c) GROUP BY part, entry, c),
{name} AS (
    SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM {before} b
    LEFT JOIN (SELECT part, entry, list(v ORDER BY c) AS x FROM {name}s GROUP BY part, entry) u USING (part, entry))"""


OP11_SQL = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
    SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM kept, (SELECT unnest(range(0, {PARTS})) AS part)),
b0 AS (
    SELECT part, rank - 1 AS entry, x FROM parts JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM kept QUALIFY rank <= {ENTRIES}) USING (vec_id)),
{_books_sql("b0", "b1")},
{_books_sql("b1", "b2")},
{_books_sql("b2", "b3")},
coded AS (
    SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM b3n GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""

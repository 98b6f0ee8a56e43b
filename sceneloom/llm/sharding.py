"""Uniform shuffle into shards of exact size (DataFrame operations only).

Rows are dealt to `blocks` blocks by a hash of the whole row.  A communication matrix says how many rows
of each block go to each cell (a shard is `cells_per_shard` cells); it is drawn row by row from the
multivariate hypergeometric law, so its counts are those of a uniform permutation and its column sums
are the cells' exact sizes.  Each block permutes its rows locally (a rank by one random key), the matrix
turns ranks into cells, and each cell permutes again (a rank by another key), which gives the slot.
Both counts grow with the bytes of the rows until the matrix is as large as the driver should draw; beyond that, ranks are taken by
ranges of a block or a cell, so that no task holds more than PART_BYTES or so at any size.
Rows travel whole, texts included; the query derives its digests from the shards.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.ranking import numbered_within

from .common import documents, free_name

#: Bytes of a block or a cell, about, or of the ranges of larger ones.
PART_BYTES = 64 << 20
LEAST_BLOCKS, MOST_BLOCKS = 512, 2048  # powers of two
LEAST_CELLS_PER_SHARD, MOST_CELLS = 16, 2048


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good items among `draws` without replacement: weights by the law's recurrence from its mode outwards, until they vanish."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    values, weights = [mode], [1.0]
    for step in (1, -1):
        k, w = mode, 1.0
        while low <= k + step <= high:
            a, b = (k, k + 1) if step > 0 else (k - 1, k)
            ratio = (good - a) * (draws - a) / (b * (bad - draws + b))
            w *= ratio if step > 0 else 1 / ratio
            if w < 1e-18:
                break
            k += step
            values.append(k)
            weights.append(w)
    return rng.choices(values, weights)[0]


#: Items beyond which numpy does not draw.
_NUMPY_ITEMS = 10**9


def split_counts(rng: np.random.Generator, exact: random.Random, counts: np.ndarray, draws: int) -> np.ndarray:
    """How many of `draws` items, taken without replacement, are of each kind."""
    if counts.sum() < _NUMPY_ITEMS:
        return rng.multivariate_hypergeometric(counts, draws, method="marginals")
    rest, out = int(counts.sum()), []
    for room in counts.tolist():
        rest -= room
        out.append(k := hypergeometric(exact, room, rest, draws))
        draws -= k
    return np.array(out, np.int64)


def communication_matrix(block_sizes: list[int], cell_sizes: list[int], seed: int) -> list[list[int]]:
    """Counts from each block to each cell, with row sums block_sizes and column sums cell_sizes.

    The cells' rows are split between halves of the blocks, and so on down to single blocks, so few draws are about many items.
    """
    rng, exact = np.random.default_rng(seed), random.Random(seed)
    ends = np.concatenate([[0], np.cumsum(np.array(block_sizes, np.int64))])
    matrix, todo = [[]] * len(block_sizes), [(0, len(block_sizes), np.array(cell_sizes, np.int64))]
    while todo:
        low, high, counts = todo.pop()
        if high - low == 1:
            matrix[low] = counts.tolist()
        elif high > low:
            middle = (low + high) // 2
            left = split_counts(rng, exact, counts, int(ends[middle] - ends[low]))
            todo += [(low, middle, left), (middle, high, counts - left)]
    return matrix


def uniform_shards(df: DataFrame, n_shards: int = 8, blocks: int | None = None, cells_per_shard: int | None = None, seed: int = 17) -> DataFrame:
    """df with `shard` (0 .. n_shards - 1, sizes at most one apart) and `slot` (a uniform order, gapless from 0 in each shard).

    Reruns agree: the keys are hashes of the row. Repeated rows are dealt one by one (which of them gets
    which slot makes no difference); nulls and empty values hash like any other; an empty table gives an
    empty table; a very long text goes whole with its row. Where df has a column named shard or slot, the new one
    has an underscore at its end. The driver sees one count per block and draws the matrix (at most MOST_BLOCKS times MOST_CELLS numbers).
    """
    shard, slot_name = free_name(df, "shard"), free_name(df, "slot")
    block, rank, cell, bounds = (free_name(df, x) for x in ("_block", "_rank", "_cell", "_bounds"))
    first, key = free_name(df, "_first"), [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    texts = [c for c, t in df.dtypes if t in ("string", "binary")]
    parts = blocks or MOST_BLOCKS
    keyed = df.withColumn(block, F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(parts)).cast("int"))
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * len(df.columns))).cast("long")
    counted = keyed.groupBy(block).agg(F.count(F.lit(1)), F.sum(width)).collect()  # at most `parts` rows
    n, size = sum(r[1] for r in counted), sum(r[2] for r in counted)
    if blocks is None:
        blocks = LEAST_BLOCKS
        while blocks < MOST_BLOCKS and size > blocks * PART_BYTES:
            blocks *= 2
        keyed = keyed.withColumn(block, F.col(block) % blocks)
    if cells_per_shard is None:
        cells_per_shard = max(LEAST_CELLS_PER_SHARD, min(-(-size // (n_shards * PART_BYTES)), MOST_CELLS // n_shards))
    sizes: dict[int, int] = {}
    for b, k, _ in counted:
        sizes[b % blocks] = sizes.get(b % blocks, 0) + k
    shard_sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    cells = [(s, m // cells_per_shard + (c < m % cells_per_shard)) for s, m in enumerate(shard_sizes) for c in range(cells_per_shard)]
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], [m for _, m in cells], seed)
    rows, starts, run, at = [], [], 0, 0
    for b, counts in enumerate(matrix):
        run, ends = 0, []
        for k in counts:
            run += k
            ends.append(run)
        rows.append((b, ends))
    for c, (s, m) in enumerate(cells):
        at = 0 if c % cells_per_shard == 0 else at
        starts.append((c, s, at))
        at += m
    spark = df.sparkSession
    sent = F.broadcast(spark.createDataFrame(rows, f"{block} int, {bounds} array<bigint>"))  # blocks x cells numbers
    places = F.broadcast(spark.createDataFrame(starts, f"{cell} int, {shard} int, {first} bigint"))
    # Ties of both hashes are equal rows, but for what a hash passes over: nulls, told apart by flags, and those inside nested values.
    nulls, rest = [F.col(c).isNull() for c in key], [c for c in key if c not in texts]
    order = lambda k: [F.xxhash64(F.lit(seed + k), *key), F.xxhash64(F.lit(seed + k + 2), *nulls, *key), *rest]

    def ranked(rows: DataFrame, group: str, by: list[Column], parts_: int) -> DataFrame:
        """rows with their rank, by these keys, in their block or cell; by ranges where these are too large for a task."""
        if size <= 2 * parts_ * PART_BYTES:
            return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*by)).cast("long") - 1)
        named = {free_name(rows, f"_by{k}"): c for k, c in enumerate(by)}
        return numbered_within(rows.withColumns(named), group, list(named), rank, -(-size // PART_BYTES)).drop(*named)

    placed = ranked(keyed, block, order(1), blocks).join(sent, block)
    placed = placed.withColumn(cell, F.size(F.filter(bounds, lambda x: x <= F.col(rank)))).drop(bounds, rank, block)
    placed = ranked(placed.join(places, cell), cell, order(2), len(cells))
    return placed.withColumn(slot_name, (F.col(rank) + F.col(first)).cast("long")).drop(cell, first, rank)


def digests(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32 (null for a null text) and the other columns named."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return docs.select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), *others)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    out = digests(uniform_shards(documents(spark, sf_dir)), "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Image difference metrics over pairs of channel arrays, and over pictures cut into tiles.

A picture may be as large as it likes when it comes as rows of pixels: rows are cut into pieces, pieces meet in tiles of bounded size
(with a margin for windows that cross into the next tile), each tile gives sums, and a picture's figures are sums of its tiles'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

OFF_ABOVE = 10
#: Pixels along a tile's side, without the margin.
TILE = 128
#: The side of a window of structural similarity, the constants of its published formula and the range of a channel.
WINDOW, K1, K2, RANGE = 11, 0.01, 0.03, 255.0
#: The weights of red, green and blue in grey.
GREY = (0.29894, 0.58704, 0.11402)


def pixel_metrics(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with n_pixels, off_pixels, off_pct, mean_delta and off_delta; a and b are arrays of r, g, b values in turn.

    A pixel's delta is its largest channel difference, and it is off above 10.
    """
    delta = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    pixels = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 3).cast("int") - 1), lambda i: F.array_max(F.slice(F.col("_d"), i * 3 + 1, 3)))
    out = pairs.withColumn("_d", delta).withColumn("_p", pixels).withColumn("_off", F.filter("_p", lambda v: v > OFF_ABOVE))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    n, off = F.size("_p"), F.size("_off")
    return out.select(
        *pairs.columns, n.alias("n_pixels"), off.alias("off_pixels"), (100.0 * off / n).alias("off_pct"), F.floor(total("_p") / n * 100 + 0.5).alias("mean_delta_100"),
        F.when(off > 0, F.floor(total("_off") / off * 10 + 0.5)).otherwise(0).alias("off_delta_10"),
    )


def tier(score: str):
    return F.when(F.col(score) >= 0.99, "PASS").when(F.col(score) >= 0.9, "WARN").otherwise("FAIL")


def overlay(render: str, reference: str):
    """Channels of the picture that shows where two differ: half of the reference and half of the inverted rendering."""
    return F.zip_with(reference, render, lambda r, d: F.floor(r / 2 + (255 - d) / 2 + 0.5).cast("int"))


def report_rows(pairs: DataFrame, key: str, a: str, b: str, score: str) -> DataFrame:
    """(key, off_pct, mean_delta_100, off_delta_10, score, tier, overlay) of pairs of pictures (channel arrays a: rendered, b: reference) with a score of likeness."""
    rows = pixel_metrics(pairs, a, b)
    return rows.select(key, "off_pct", "mean_delta_100", "off_delta_10", score, tier(score).alias("tier"), overlay(a, b).alias("overlay"))


# Pictures as tiles ---------------------------------------------------------------------------------


def tiles(rows: DataFrame, channels: int = 3, tile: int = TILE, margin: int = WINDOW - 1) -> DataFrame:
    """(key, ty, tx, y0, x0, rows) of pictures given as pixel rows: key, y, a and b (arrays of `channels` values a pixel).

    rows is an array of (y, a, b), in order, of the tile's own pixel rows and `margin` more below, each as wide as the tile and `margin` more to the right
    where the picture goes on. A group holds at most tile + margin pieces of bounded length.
    """
    width = F.floor(F.size("a") / channels).cast("int")
    last = F.greatest(F.floor((width - 1) / tile).cast("int"), F.lit(0))
    cut = lambda c: F.slice(F.col(c), F.col("tx") * (tile * channels) + 1, (tile + margin) * channels)
    wide = rows.where((width > 0) & F.col("b").isNotNull()).select("key", "y", "a", "b", F.explode(F.sequence(F.lit(0), last)).alias("tx"))
    own = F.floor(F.col("y") / tile).cast("int")
    # a row among a tile's first `margin` ones also lies in the margin of the tiles above
    above = F.greatest(F.floor((F.col("y") - margin) / tile).cast("int"), F.lit(0))
    pieces = wide.select("key", "tx", F.explode(F.sequence(above, own)).alias("ty"), F.struct("y", cut("a").alias("a"), cut("b").alias("b")).alias("row"))
    met = pieces.groupBy("key", "ty", "tx").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return met.select("key", "ty", "tx", (F.col("ty") * tile).alias("y0"), (F.col("tx") * tile).alias("x0"), "rows")


def window_sums(x: np.ndarray, window: int) -> np.ndarray:
    """Sums of x over all windows of a square's side that lie in it, from a table of sums."""
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    np.cumsum(np.cumsum(x, 0), 1, out=total[1:, 1:])
    return total[window:, window:] - total[:-window, window:] - total[window:, :-window] + total[:-window, :-window]


def similarity(a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Structural similarity of each window of two grey pictures."""
    n = window * window
    ma, mb = window_sums(a, window) / n, window_sums(b, window) / n
    va, vb, both = window_sums(a * a, window) / n - ma * ma, window_sums(b * b, window) / n - mb * mb, window_sums(a * b, window) / n - ma * mb
    c1, c2 = (K1 * RANGE) ** 2, (K2 * RANGE) ** 2
    return (2 * ma * mb + c1) * (2 * both + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


_SUMS = {"windows": LongType(), "similarity": DoubleType(), "pixels": LongType(), "off": LongType(), "delta": DoubleType(), "off_delta": DoubleType()}


def tile_sums(tiled: DataFrame, channels: int = 3, tile: int = TILE, window: int = WINDOW) -> DataFrame:
    """(key, sums) of tiles: windows that begin in the tile and the sum of their similarity; its own pixels, those that are off, and sums of deltas."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _SUMS}
            rows, pixels = batch.column(1), batch.column(1).flatten()
            first = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy())])
            a, b = (pixels.field(c) for c in "ab")
            begins = np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy())])
            a, b = (x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in (a, b))
            for low, high in zip(first[:-1], first[1:]):
                x, y = (c[begins[low] : begins[high]].reshape(high - low, -1, channels) for c in (a, b))
                delta = np.abs(x - y).max(2)[:tile, :tile]
                grey = [c[:, :, 0] if channels == 1 else c @ np.array(GREY) for c in (x, y)]
                near = similarity(*grey, window)[:tile, :tile] if min(grey[0].shape) >= window else np.zeros(0)
                off = delta > OFF_ABOVE
                for name, v in zip(_SUMS, (near.size, near.sum(), delta.size, off.sum(), delta.sum(), delta[off].sum())):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if isinstance(_SUMS[c], LongType) else pa.float64()) for c, v in out.items())], names=["key", *out])

    schema = StructType([tiled.schema["key"], *(StructField(c, t) for c, t in _SUMS.items())])
    return tiled.select("key", "rows").mapInArrow(run, schema)


def picture_likeness(rows: DataFrame, channels: int = 3, tile: int = TILE, window: int = WINDOW) -> DataFrame:
    """(key, ssim, tier, n_pixels, off_pixels, off_pct, mean_delta, off_delta) of pairs of pictures, given as pixel rows (key, y from 0, a, b).

    ssim is the mean structural similarity of all windows of the grey pictures (published formula, equal weights in a
    window); null, with the tier FAIL, for a picture smaller than a window. Deltas are a pixel's largest channel difference.
    Arrays of one picture are equally long, in whole pixels; rows without a or b are left out.
    """
    sums = tile_sums(tiles(rows, channels, tile, window - 1), channels, tile, window)
    per = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in _SUMS))
    out = per.withColumn("ssim", F.col("similarity") / F.nullif(F.col("windows"), F.lit(0)))
    mean = lambda total, n, digits: F.floor(F.col(total) / F.nullif(F.col(n), F.lit(0)) * 10**digits + 0.5) / 10**digits
    return out.select(
        "key", "ssim", tier("ssim").alias("tier"), F.col("pixels").alias("n_pixels"), F.col("off").alias("off_pixels"), (100.0 * F.col("off") / F.col("pixels")).alias("off_pct"),
        mean("delta", "pixels", 2).alias("mean_delta"), F.coalesce(mean("off_delta", "off", 1), F.lit(0.0)).alias("off_delta"),
    )

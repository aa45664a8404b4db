"""Overlapping tiles: padding, tile starts, Gaussian blending, and the scorers that tiles go to."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.raster import gaussian_weight, sigmoid
from ..schema import OVERLAP, TILE


def required_pad(size: int, tile: int, stride: int) -> int:
    """Pixels to add at the far edge so that tiles cover all."""
    if size <= tile:
        return tile - size
    return tile + math.ceil((size - tile) / stride) * stride - size


def tile_starts(total: int, tile: int, stride: int) -> list[int]:
    return list(range(0, total - tile + 1, stride))


def check_overlap(tile: int, overlap: int) -> int:
    if overlap >= tile:
        raise ValueError("the overlap must be smaller than the tile")
    return tile - overlap


def pad_reflect(pixels: DataFrame, keys: list[str], height: int, width: int, tile: int, stride: int) -> DataFrame:
    """Pixels with copies below and to the right, reflected without repeating the edge.

    Each source pixel is exploded to the padded places that show it; no join is needed.
    """
    def places(c: str, n: int, pad: int) -> Column:
        """A coordinate, and where it shows again behind the edge: at multiples of 2 (n - 1), plus or minus it."""
        turn, every = 2 * (n - 1), n + pad
        if n == 1:
            return F.explode(F.sequence(F.lit(0), F.lit(pad)))
        turns = F.sequence(F.lit(1), F.lit(every // turn + 1))
        again = F.concat(F.transform(turns, lambda k: k * turn - F.col(c)), F.transform(turns, lambda k: k * turn + F.col(c)))
        return F.explode(F.concat(F.array(F.col(c)), F.array_distinct(F.filter(again, lambda i: (i >= n) & (i < every)))))

    rows = pixels.withColumn("_y", places("y", height, required_pad(height, tile, stride)))
    rows = rows.withColumn("_x", places("x", width, required_pad(width, tile, stride)))
    return rows.drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})


def covering(c: Column, total: int, tile: int, stride: int) -> Column:
    """The starts of the tiles along an axis that cover a coordinate, by arithmetic."""
    last = (total - tile) // stride * stride
    low = F.greatest(F.ceil((c - tile + 1) / stride) * stride, F.lit(0)).cast("int")
    high = F.least(F.floor(c / stride) * stride, F.lit(last)).cast("int")
    return F.when(low <= high, F.sequence(low, high, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def to_tiles(pixels: DataFrame, total_y: int, total_x: int, tile: int, stride: int) -> DataFrame:
    """Each pixel once for each tile (``row_start``, ``col_start``) that covers it."""
    rows = pixels.withColumn("row_start", F.explode(covering(F.col("y"), total_y, tile, stride)))
    return rows.withColumn("col_start", F.explode(covering(F.col("x"), total_x, tile, stride)))


def blend(tiled: DataFrame, keys: list[str], tile: int, height: int, width: int, logit: str = "logit") -> DataFrame:
    """Probability per pixel: sigmoids of the covering tiles' logits, weighted by each tile's Gaussian, summed in double
    precision, then cropped to the raster and cast to single."""
    w = gaussian_weight(F.col("y") - F.col("row_start"), F.col("x") - F.col("col_start"), tile)
    rows = tiled.filter((F.col("y") < height) & (F.col("x") < width)).select(*keys, "y", "x", w.alias("w"), sigmoid(F.col(logit).cast("double")).alias("p"))
    total = F.sum("w")
    return rows.groupBy(*keys, "y", "x").agg((F.sum(F.col("w") * F.col("p")) / F.when(total != 0, total).otherwise(F.lit(1.0))).cast("float").alias("prob"))


def index_scorer(weights: list[float] | None = None, bias: float = 0.0):
    """A scorer of tiles (n, channels, size, size): a linear score of the channels' change. By default, more built-up and
    less green means change."""

    def score(t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        w = np.zeros(t1.shape[1])
        if weights is not None:
            w[:] = weights
        else:
            w[-3:] = (-1.0, 1.0, 0.0)  # NDVI, NDBI, NDWI
        return np.tensordot(t2 - t1, w, axes=(1, 0)) + bias

    return score


def predict_change(pairs: DataFrame, channels: list[str], stats: dict[str, tuple[float, float]], height: int, width: int, scorer=None, keys: list[str] | None = None, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """Change probability by pixel. ``pairs`` has, for each pixel, every channel of both months as ``<name>_1``, ``<name>_2``.

    Channels are scaled (missing is 0 before it), padded and tiled in the JVM; one row holds one tile, so that the
    scorer's memory is bounded by an Arrow batch of tiles; blending is an aggregation by pixel with partial sums.
    """
    from .grid import scored_tiles
    from ..functions.raster import z_score

    keys = keys or []
    stride = check_overlap(tile, overlap)
    scaled = pairs.select(*keys, "y", "x", *(F.array(*(z_score(F.col(f"{c}_{t}"), *map(F.lit, stats[c])).cast("float") for c in channels)).alias(f"v{t}") for t in (1, 2)))
    total_y, total_x = height + required_pad(height, tile, stride), width + required_pad(width, tile, stride)
    tiled = to_tiles(pad_reflect(scaled, keys, height, width, tile, stride), total_y, total_x, tile, stride)
    where = [*keys, "row_start", "col_start"]
    rows = tiled.groupBy(*where).agg(F.array_sort(F.collect_list(F.struct("y", "x", "v1", "v2"))).alias("p"))
    # channel-major, as scorers expect
    plane = lambda v: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(channels) - 1)), lambda c: F.transform("p", lambda p: F.get(p[v], c))))
    rows = rows.select(*where, plane("v1").alias("t1"), plane("v2").alias("t2"), F.lit(len(channels)).alias("channels"), F.lit(tile).alias("size"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*where).schema)
    logits = scored_tiles(rows, scorer or index_scorer(), where, f"{kinds}, logits array<double>")
    at = logits.select(*where, F.posexplode("logits").alias("_at", "logit"))
    at = at.withColumn("y", (F.col("row_start") + F.floor(F.col("_at") / tile)).cast("int")).withColumn("x", (F.col("col_start") + F.col("_at") % tile).cast("int"))
    return blend(at, keys, tile, height, width)

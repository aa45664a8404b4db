"""Training patches: labels, windows, missing-value filter, splits, scaling, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.raster import change_label
from ..schema import LABEL_THRESHOLD, MAX_MISSING, PATCH, SPLITS, STRIDE
from .tiling import covering


def change_labels(before: DataFrame, after: DataFrame, keys: list[str], value: str = "density", limit: float = LABEL_THRESHOLD) -> DataFrame:
    """0/1 per pixel of the first raster; a pixel that the other lacks is 0."""
    b = after.select(*keys, "y", "x", F.col(value).alias("_after"))
    return before.join(b, [*keys, "y", "x"], "left").select(*keys, "y", "x", change_label(F.col(value), F.col("_after"), limit).alias("label"))


def change_rate(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per cent of pixels with change."""
    return labels.groupBy(*keys).agg((100.0 * F.sum("label") / F.greatest(F.count("*"), F.lit(1))).alias("change_rate"))


def windows(pixels: DataFrame, height: int, width: int, size: int = PATCH, stride: int = STRIDE) -> DataFrame:
    """Pixels once for each window that covers them; windows never reach over the edge and what is left there is dropped."""
    rows = pixels.withColumn("row_start", F.explode(covering(F.col("y"), height, size, stride)))
    return rows.withColumn("col_start", F.explode(covering(F.col("x"), width, size, stride)))


def extract_patches(pixels: DataFrame, keys: list[str], channels: list[str], height: int, width: int, size: int = PATCH, stride: int = STRIDE, max_missing: float = MAX_MISSING, per_band: bool = True) -> DataFrame:
    """Patches as arrays: ``t1``, ``t2`` (channel-major) and ``label``.

    ``per_band`` counts each channel's missing values of the first month against the pixels of one channel; without it,
    they count against the values of all channels.
    """
    where = [*keys, "row_start", "col_start"]
    rows = windows(pixels, height, width, size, stride).groupBy(*where)
    missing = sum((F.sum(F.col(f"{c}_1").isNull().cast("int")) for c in channels), F.lit(0))
    values = size * size * (1 if per_band else len(channels))
    p = F.array_sort(F.collect_list(F.struct("y", "x", *(f"{c}_{t}" for t in (1, 2) for c in channels), "label")))
    out = rows.agg(missing.alias("n_missing"), p.alias("p")).filter(F.col("n_missing") <= max_missing * values)
    values_of = lambda name: F.transform("p", lambda r: r[name])
    plane = lambda t: F.flatten(F.array(*(values_of(f"{c}_{t}") for c in channels)))
    return out.select(*where, "n_missing", plane(1).alias("t1"), plane(2).alias("t2"), values_of("label").alias("label"))


def split_of(city: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, cities in SPLITS.items():
        out = F.when(city.isin(*cities), name).otherwise(out)
    return out


def in_split(patches: DataFrame, split: str | None, city: str = "city") -> DataFrame:
    """Patches of a split's cities; all for None."""
    if split is None:
        return patches
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return patches.filter(F.col(city).isin(*SPLITS[split]))


def turned(y: Column, x: Column, size: int, hflip: Column, vflip: Column, k: Column) -> tuple[Column, Column]:
    """Where a pixel goes when a patch is flipped and then turned left k times by 90 degrees."""
    x = F.when(hflip, size - 1 - x).otherwise(x)
    y = F.when(vflip, size - 1 - y).otherwise(y)
    k = F.pmod(k, F.lit(4))
    ty = F.when(k == 0, y).when(k == 1, size - 1 - x).when(k == 2, size - 1 - y).otherwise(x)
    tx = F.when(k == 0, x).when(k == 1, y).when(k == 2, size - 1 - x).otherwise(size - 1 - y)
    return ty, tx


def augment(pixels: DataFrame, patch: list[str], size: int, seed: int = 0) -> DataFrame:
    """Random flips and turns, the same for all values of a patch: drawn from a hash of the patch's key and the seed, so
    that a lost task repeats them."""
    draw = F.xxhash64(F.lit(seed), *patch)
    bit = lambda n: F.shiftright(draw, n).bitwiseAND(F.lit(1).cast("long")) == 1
    y, x = turned(F.col("y"), F.col("x"), size, bit(3), bit(7), F.shiftright(draw, 11).bitwiseAND(F.lit(3).cast("long")))
    return pixels.withColumns({"_y": y, "_x": x}).drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})

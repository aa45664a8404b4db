"""Cloud-free monthly composites: mask, median by pixel and month, spectral indices, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.raster import as_float, is_clear, masked, ndbi, ndvi, ndwi
from ..schema import MIN_SCENES
from ..sources.scratch import small


def mask_observations(obs: DataFrame, bands: list[str], scl: str = "scl") -> DataFrame:
    """Bands as single precision, missing where the pixel is not clear; ``clear`` says which are."""
    clear = is_clear(F.col(scl))
    return obs.withColumns({"clear": clear, **{b: masked(as_float(F.col(b)), clear) for b in bands}})


def median_composite(obs: DataFrame, bands: list[str], keys: list[str], min_scenes: int = MIN_SCENES, scene: str = "scene") -> DataFrame:
    """Per group: exact median of each band's clear values, clear observations (of the last band by name), and the scenes
    of its month (all keys but ``y`` and ``x``), whether or not they cover the pixel, and whether those suffice.

    A pixel-month has as many rows as scenes (some 15), so the median's buffer is small; groups are pixels, so that no
    key is hot however large the area. Months are counted by themselves from two columns and joined by a counted
    broadcast.
    """
    months = [k for k in keys if k not in ("y", "x")]
    last = sorted(bands)[-1]
    out = mask_observations(obs, bands).groupBy(*keys).agg(*(F.median(b).cast("float").alias(b) for b in bands), F.count(last).cast("int").alias("clear_obs_count"))
    if not months:  # one month: one row
        n = obs.agg(F.count_distinct(scene)).first()[0]
        return out.withColumns({"n_scenes": F.lit(n).cast("long"), "reliable": F.lit(n >= min_scenes)})
    headers = month_headers(obs, months, min_scenes, scene).withColumnsRenamed({k: f"_{k}" for k in months})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in months))
    return out.join(small(headers, headers.count()), same).drop(*(f"_{k}" for k in months))


def mean_composite(pixels: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """Per group: the mean of the values that are there."""
    return pixels.groupBy(*keys).agg(*(F.avg(b).cast("float").alias(b) for b in bands))


def add_indices(pixels: DataFrame, green: str = "B03", red: str = "B04", nir: str = "B08", swir: str = "B11") -> DataFrame:
    """NDVI, NDBI and NDWI behind the bands, in this order."""
    g, r, n, s = (F.col(c) for c in (green, red, nir, swir))
    return pixels.withColumn("NDVI", ndvi(n, r)).withColumn("NDBI", ndbi(s, n)).withColumn("NDWI", ndwi(g, n))


def cloud_free_fraction(obs: DataFrame, keys: list[str], scl: str = "scl") -> DataFrame:
    """Share of clear pixels, 0.0 for none."""
    return obs.groupBy(*keys).agg(F.coalesce(F.avg(is_clear(F.col(scl)).cast("int")), F.lit(0.0)).alias("cloud_free_fraction"))


def month_headers(obs: DataFrame, keys: list[str], min_scenes: int = MIN_SCENES, scene: str = "scene") -> DataFrame:
    """Scenes of each month and whether they suffice."""
    return obs.groupBy(*keys).agg(F.count_distinct(scene).alias("n_scenes")).withColumn("reliable", F.col("n_scenes") >= min_scenes)

"""Scalar column expressions of the raster operators. Missing values are NULL everywhere, never NaN."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EPSILON, LABEL_THRESHOLD, MASKED_CLASSES


def as_float(x: Column) -> Column:
    return x.cast("float")


def not_nan(x: Column) -> Column:
    """NaN as NULL: what every source does with its values."""
    return F.when(~F.isnan(x), x)


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0.0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) in single precision; 0 where the sum is 0, NULL where a band is missing."""
    a, b = as_float(a), as_float(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a + b != 0, (a - b) / (a + b)).otherwise(F.lit(0.0)).cast("float")


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndbi(swir: Column, nir: Column) -> Column:
    return normalized_difference(swir, nir)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def is_clear(scl: Column) -> Column:
    """Classes 0 (no data) and 1 (saturated) count as clear."""
    return ~scl.isin(*MASKED_CLASSES)


def masked(band: Column, clear: Column) -> Column:
    return F.when(clear, band)


def at_least(x: Column, threshold: float) -> Column:
    """A comparison in single precision; false where x is missing."""
    return F.coalesce(as_float(x) >= F.lit(threshold).cast("float"), F.lit(False))


def change_label(before: Column, after: Column, threshold: float = LABEL_THRESHOLD) -> Column:
    """1 where density rose by at least the threshold; 0 for less, for a fall and for missing values."""
    return at_least(as_float(after) - as_float(before), threshold).cast("tinyint")


def z_score(x: Column, mean: float | Column, std: float | Column) -> Column:
    """Missing is taken for 0 before scaling."""
    return (F.coalesce(x, F.lit(0.0)) - mean) / (std + F.lit(EPSILON))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def gaussian_weight(row: Column, col: Column, size: int) -> Column:
    """A tile's blending weight at a place in it: sigma is a quarter of the size, the peak at its middle is 1."""
    centre, sigma = (size - 1) / 2, size / 4
    dy, dx = row - F.lit(centre), col - F.lit(centre)
    return F.exp(-(dx * dx + dy * dy) / F.lit(2 * sigma * sigma))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_index(month: Column) -> Column:
    parts = F.split(month, "-")
    return parts[0].cast("int") * 12 + parts[1].cast("int")


def month_as_year(month: Column) -> Column:
    parts = F.split(month, "-")
    return parts[0].cast("double") + (parts[1].cast("double") - 1) / 12


def period(t1: Column, t2: Column, separator: str = "/") -> Column:
    """The name of a pair of months; files use ``_to_``."""
    return F.concat_ws(separator, t1, t2)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall != 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def tile_id(scene_id: Column) -> Column:
    """The grid tile in a scene's name, empty where there is none."""
    return F.regexp_extract(scene_id, r"_(T[0-9]{2}[A-Z]{3})_", 1)


def asset(assets: Column, band: str, resolution: int) -> Column:
    """An asset's place by its name with resolution, else by its plain name."""
    return F.coalesce(F.element_at(assets, f"{band}_{resolution}m"), F.element_at(assets, band))


def nodes_path(href: Column, product: Column, root: str = "") -> Column:
    """The node address below a product for an object-store address; any other address stays as it is.

    The part from the product's folder on is walked folder by folder.
    """
    parts = F.split(href, "/")
    at = F.array_max(F.transform(parts, lambda x, i: F.when(x.endswith(".SAFE"), i + 1)))
    nodes = F.concat_ws("/", F.transform(F.slice(parts, at, F.size(parts) - at + 1), lambda x: F.concat(F.lit("Nodes("), x, F.lit(")"))))
    return F.when(href.startswith("s3://") & at.isNotNull(), F.concat(F.lit(f"{root}/Products("), product, F.lit(")/"), nodes, F.lit("/$value"))).otherwise(href)


def ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed ring SW, SE, NE, NW, SW."""
    return F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south))


def geojson_polygon(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(west, south, east, north)).alias("coordinates")))


def overlap_area(a: Iterable[Column], b: Iterable[Column]) -> Column:
    """The common area of two boxes (west, south, east, north); 0 if they are apart."""
    (aw, as_, ae, an), (bw, bs, be, bn) = a, b
    return F.greatest(F.least(ae, be) - F.greatest(aw, bw), F.lit(0.0)) * F.greatest(F.least(an, bn) - F.greatest(as_, bs), F.lit(0.0))

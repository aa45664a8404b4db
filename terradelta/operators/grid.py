"""Raster grids as tables: chunks and pixels, stencils, connected components, resampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projection import project
from ..functions.raster import at_least
from ..sources.scratch import saved
from .graph import components

#: Rows and columns of the chunks that stencils and components work on.
CHUNK = 256


def pixels_of(chunks: DataFrame, data: str, width: Column, y0: Column | int = 0, x0: Column | int = 0, name: str = "value") -> DataFrame:
    """Array layout to pixel layout: one row for each value of a row-major array."""
    others = [c for c in chunks.columns if c != data]
    rows = chunks.select(*others, width.alias("_w"), (F.lit(0) + y0).alias("_y0"), (F.lit(0) + x0).alias("_x0"), F.posexplode(data).alias("_at", name))
    return rows.select(*others, (F.col("_y0") + F.floor(F.col("_at") / F.col("_w"))).cast("int").alias("y"), (F.col("_x0") + F.col("_at") % F.col("_w")).cast("int").alias("x"), name)


def chunks_of(pixels: DataFrame, keys: list[str], value: str, height: int = CHUNK, width: int = CHUNK) -> DataFrame:
    """Pixel layout to array layout: chunks of at most height x width values, row by row."""
    at = [F.floor(F.col("y") / height).cast("int").alias("chunk_row"), F.floor(F.col("x") / width).cast("int").alias("chunk_col")]
    rows = pixels.select(*keys, *at, F.struct("y", "x", value).alias("p")).groupBy(*keys, "chunk_row", "chunk_col")
    return rows.agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        *keys, "chunk_row", "chunk_col",
        (F.array_max(F.transform("p", lambda p: p["x"])) - F.array_min(F.transform("p", lambda p: p["x"])) + 1).alias("w"),
        F.transform("p", lambda p: p[value]).alias("data"),
    )


def chunked(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """Deals pixels to chunks, with copies of those within ``halo`` of a neighbouring chunk (``own`` says which are not)."""
    # all chunks from the one ``halo`` before to the one ``halo`` behind; none lies before the first one
    near = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0)).cast("int"), F.floor((F.col(c) + halo) / size).cast("int"))
    rows = pixels.withColumn("chunk_row", F.explode(near("y"))).withColumn("chunk_col", F.explode(near("x")))
    return rows.withColumn("own", (F.floor(F.col("y") / size) == F.col("chunk_row")) & (F.floor(F.col("x") / size) == F.col("chunk_col")))


def _dense(t: pd.DataFrame, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's values and where it has pixels, in a frame of one empty pixel, and the pixels' places in it."""
    y, x = t["y"].to_numpy() - t["y"].min() + 1, t["x"].to_numpy() - t["x"].min() + 1
    there = np.zeros((y.max() + 2, x.max() + 2), bool)
    there[y, x] = True
    out = np.zeros(there.shape, bool)
    out[y, x] = t[value].to_numpy().astype(bool)
    return out, there, y, x


def _cross(a: np.ndarray, grow: bool) -> np.ndarray:
    p = np.pad(a, 1)
    five = (p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:])
    return np.logical_or.reduce(five) if grow else np.logical_and.reduce(five)


#: Passes of the morphological operators, over a pixel and its four neighbours.
OPEN, CLOSE = ("erode", "dilate"), ("dilate", "erode")


def morphology(pixels: DataFrame, keys: list[str], passes: tuple[str, ...] = OPEN + CLOSE, value: str = "on", size: int = CHUNK) -> DataFrame:
    """Binary erosions and dilations one after another; what is outside a raster is 0 in every pass.

    Pixels are shuffled once, to chunks with a halo of as many pixels as there are passes; memory is bounded by a chunk.
    """
    base = pixels.select(*keys, "y", "x", F.col(value).cast("boolean").alias("on"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a, there, y, x = _dense(t, "on")
        for p in passes:
            a = _cross(a, p == "dilate") & there
        t = t.assign(on=a[y, x])
        return t[t["own"]].drop(columns=["own", "chunk_row", "chunk_col"])

    return chunked(base, size, len(passes)).groupBy(*keys, "chunk_row", "chunk_col").applyInPandas(run, base.schema)


def label_runs(a: np.ndarray) -> np.ndarray:
    """4-connected components of a boolean array: runs of rows are united with those they touch above. -1 is outside."""
    out = np.full(a.shape, -1, np.int64)
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(a):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here, k = [], 0
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            label = len(parent)
            parent.append(label)
            while k < len(above) and above[k][1] <= begin:
                k += 1
            j = k
            while j < len(above) and above[j][0] < end:
                r, s = find(above[j][2]), find(label)
                parent[max(r, s)] = min(r, s)
                j += 1
            here.append((begin, end, label))
            out[y, begin:end] = label
        above = here
    roots = np.array([find(i) for i in range(len(parent))] or [0], np.int64)
    return np.where(out >= 0, roots[np.maximum(out, 0)], -1)


def connected_components(pixels: DataFrame, keys: list[str], width: int, value: str = "on", size: int = CHUNK, height: int | None = None) -> DataFrame:
    """Set pixels with ``component``, the smallest ``y * width + x`` of their 4-connected component.

    Chunks are labelled each for itself; labels that touch over a chunk's edge are united by the distributed components
    of a table that has only edge pixels. A raster that fits a chunk (``height`` given) needs no uniting.
    """
    on = pixels.filter(F.col(value).cast("boolean"))
    base = on.select(*keys, "y", "x", F.floor(F.col("y") / size).cast("int").alias("chunk_row"), F.floor(F.col("x") / size).cast("int").alias("chunk_col"), F.lit(True).alias("on"))
    schema = pixels.select(*keys, "y", "x", F.lit(0).cast("long").alias("label")).schema

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a, _, y, x = _dense(t, "on")
        label = pd.Series(label_runs(a)[y, x], index=t.index)
        place = t["y"].astype(np.int64) * width + t["x"]
        return t.assign(label=place.groupby(label).transform("min"))[[*keys, "y", "x", "label"]]

    labelled = base.groupBy(*keys, "chunk_row", "chunk_col").applyInPandas(run, schema)
    if height is not None and height <= size and width <= size:
        return labelled.withColumnRenamed("label", "component")
    labelled = saved(labelled, "labels")  # read by both joins of edges and by the last one
    node = F.struct(*keys, "label")
    edge = labelled.filter((F.pmod("y", F.lit(size)).isin(0, size - 1)) | (F.pmod("x", F.lit(size)).isin(0, size - 1))).select(*keys, "y", "x", node.alias("n"))
    links = []
    for dy, dx in ((1, 0), (0, 1)):
        other = edge.select(*keys, (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("n").alias("m"))
        links.append(edge.join(other, [*keys, "y", "x"]).filter("n != m").select("n", "m"))
    found = components(links[0].unionByName(links[1]).distinct())
    roots = found.select(*(F.col("node")[k].alias(k) for k in keys), F.col("node")["label"].alias("label"), F.col("component")["label"].alias("root"))
    return labelled.join(roots, [*keys, "label"], "left").select(*keys, "y", "x", F.coalesce("root", "label").alias("component"))


def nearest_axis(target: DataFrame, source: DataFrame) -> DataFrame:
    """For each target coordinate (``t``) the nearest source coordinate (``s``), the larger of two that are equally near.

    One sorted pass over both axes' coordinates (thousands at most, whatever the rasters' size): the last source
    coordinate before a target and the first behind it are all that can be nearest.
    """
    both = target.distinct().select("t", F.col("t").alias("c"), F.lit(None).cast(source.schema["s"].dataType).alias("s"))
    both = both.unionByName(source.distinct().select(F.lit(None).cast(target.schema["t"].dataType).alias("t"), F.col("s").alias("c"), "s"))
    order = Window.orderBy("c")
    before = F.last("s", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    behind = F.first("s", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("lo", before).withColumn("hi", behind).filter("t IS NOT NULL")
    return near.select("t", F.when(F.col("hi").isNull(), F.col("lo")).when(F.col("lo").isNull() | (F.col("hi") - F.col("t") <= F.col("t") - F.col("lo")), F.col("hi")).otherwise(F.col("lo")).alias("s"))


def upsample_nearest(coarse: DataFrame, factor: int, keys: list[str]) -> DataFrame:
    """Each coarse pixel as factor x factor fine ones: what nearest-pixel matching of aligned grids comes to, with no join."""
    offsets = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    rows = coarse.withColumn("_dy", offsets).withColumn("_dx", offsets)
    return rows.withColumn("y", F.col("y") * factor + F.col("_dy")).withColumn("x", F.col("x") * factor + F.col("_dx")).drop("_dy", "_dx")


def target_grid(spark, epsg: int, west: float, south: float, east: float, north: float, res: float) -> DataFrame:
    """Pixels (``y``, ``x``, centre ``px``, ``py``) of a north-up grid over a box."""
    height, width = max(1, round((north - south) / res)), max(1, round((east - west) / res))
    rows = spark.range(height).select(F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return rows.withColumn("px", F.lit(west) + (F.col("x") + 0.5) * res).withColumn("py", F.lit(north) - (F.col("y") + 0.5) * res)


def _cubic(d: Column) -> Column:
    d = F.abs(d)
    return F.when(d < 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2).otherwise(F.lit(0.0))


def _lanczos(d: Column) -> Column:
    pi = F.lit(float(np.pi))
    sinc = lambda v: F.sin(pi * v) / (pi * v)
    return F.when(F.abs(d) < 1e-9, F.lit(1.0)).when(F.abs(d) < 3, sinc(F.when(F.abs(d) < 1e-9, F.lit(1.0)).otherwise(d)) * sinc(F.when(F.abs(d) < 1e-9, F.lit(1.0)).otherwise(d / 3))).otherwise(F.lit(0.0))


#: Name: (pixels on either side, weight of a distance in pixels).
KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "bilinear": (1, lambda d: F.greatest(F.lit(1.0) - F.abs(d), F.lit(0.0))),
    "cubic": (2, _cubic),
    "lanczos": (3, _lanczos),
}


def resample(source: DataFrame, targets: DataFrame, u: Column, v: Column, keys: list[str], value: str = "value", method: str = "bilinear") -> DataFrame:
    """``targets`` with ``value`` from a source grid at the fractional column ``u`` and row ``v`` (pixel centres are whole).

    Missing neighbours are left out and the other weights scaled up. Neighbours are matched by an equi-join on whole
    coordinates, which shuffles each side once.
    """
    ids = [*keys, *[c for c in targets.columns if c not in keys]]
    src = source.select(*keys, F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.col(value).alias("_v"))
    at = targets.withColumn("_u", u).withColumn("_t", v)
    if method == "nearest":
        near = at.withColumn("_sx", F.floor(F.col("_u") + 0.5).cast("int")).withColumn("_sy", F.floor(F.col("_t") + 0.5).cast("int"))
        return near.join(src, [*keys, "_sy", "_sx"], "left").select(*ids, F.col("_v").alias(value))
    if method not in KERNELS:
        raise ValueError(f"unknown resampling {method!r}; there are nearest, {', '.join(KERNELS)}")
    reach, weight = KERNELS[method]
    span = F.sequence(F.lit(1 - reach), F.lit(reach))
    near = at.withColumn("_sx", F.explode(F.transform(span, lambda d: (F.floor("_u") + d).cast("int")))).withColumn("_sy", F.explode(F.transform(span, lambda d: (F.floor("_t") + d).cast("int"))))
    near = near.withColumn("_w", weight(F.col("_u") - F.col("_sx")) * weight(F.col("_t") - F.col("_sy")))
    both = near.join(src, [*keys, "_sy", "_sx"], "left").withColumn("_w", F.when(F.col("_v").isNotNull(), F.col("_w")))
    total = F.sum("_w")
    return both.groupBy(*ids).agg(F.when(F.abs(total) > 1e-12, F.sum(F.col("_w") * F.col("_v")) / total).cast("float").alias(value))


def reproject(source: DataFrame, header: dict, targets: DataFrame, lon: Column, lat: Column, keys: list[str], value: str = "value", method: str = "nearest") -> DataFrame:
    """``targets`` (with their longitude and latitude) with values from a source grid in its own projection."""
    x, y = project(lon, lat, header["epsg"])
    u, v = (x - header["x0"]) / header["res_x"] - 0.5, (y - header["y0"]) / header["res_y"] - 0.5
    return resample(source, targets, u, v, keys, value, method)


def clip(pixels: DataFrame, header: dict, west: float, south: float, east: float, north: float) -> DataFrame:
    """Pixels whose centres are in a box of the grid's own projection."""
    px, py = F.lit(header["x0"]) + (F.col("x") + 0.5) * header["res_x"], F.lit(header["y0"]) + (F.col("y") + 0.5) * header["res_y"]
    return pixels.filter(px.between(west, east) & py.between(south, north))


def nodata_to_null(pixels: DataFrame, value: str, nodata: list[float]) -> DataFrame:
    """Values that stand for missing, and NaN, as NULL; the rest in single precision."""
    v = F.col(value).cast("float")
    return pixels.withColumn(value, F.when(F.isnan(v) | v.isin(*(float(x) for x in nodata)), F.lit(None)).otherwise(v))


def threshold(pixels: DataFrame, prob: str, limit: float) -> DataFrame:
    return pixels.withColumn("on", at_least(F.col(prob), limit))


def scored_tiles(tiles: DataFrame, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], keys: list[str], schema: str) -> DataFrame:
    """Rows of (keys, t1, t2, shape) to rows with ``logits``: a whole Arrow batch of tiles goes to the scorer at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            shape = (len(rows), rows[0]["channels"], rows[0]["size"], rows[0]["size"]) if rows else (0,) * 4
            t1, t2 = (np.array([r[n] for r in rows], np.float64).reshape(shape) for n in ("t1", "t2"))
            logits = scorer(t1, t2).reshape(len(rows), -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), pa.array(list(logits.astype(np.float64)), pa.list_(pa.float64()))], [*keys, "logits"])

    return tiles.mapInArrow(run, schema)

"""From probabilities to change polygons: threshold, open and close, components, confidence, area, rings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MIN_AREA_M2, PROB_THRESHOLD
from .grid import CHUNK, connected_components, morphology, threshold


def change_members(prob: DataFrame, keys: list[str], width: int, limit: float = PROB_THRESHOLD, size: int = CHUNK, height: int | None = None) -> DataFrame:
    """Pixels of cleaned change areas: ``component``, ``prob`` (closing may add pixels below the limit, or without value)."""
    clean = morphology(threshold(prob, "prob", limit), keys, size=size)
    members = connected_components(clean, keys, width, size=size, height=height)
    return members.join(prob.select(*keys, "y", "x", "prob"), [*keys, "y", "x"])


def change_polygons(members: DataFrame, keys: list[str], pixel_area: float, min_area: float = MIN_AREA_M2, detection_period: str | None = None) -> DataFrame:
    """Per component: mean probability of its pixels and its area; those below the least area are dropped."""
    out = members.groupBy(*keys, "component").agg(F.avg("prob").alias("confidence"), F.count("*").alias("n_pixels"))
    out = out.withColumn("area_m2", F.col("n_pixels") * F.lit(float(pixel_area))).filter(F.col("area_m2") >= min_area)
    return out if "detection_period" in keys else out.withColumn("detection_period", F.lit(detection_period).cast("string"))


def boundary(members: DataFrame, keys: list[str]) -> DataFrame:
    """The sides of a component's pixels that it does not share with itself: ``x``, ``y`` (the corner it begins or ends
    at, the other lies to the right or, if ``down``, below) and ``way`` (1: from that corner, -1: to it).

    Each pixel has four sides walked around it; a side of two pixels is walked both ways, so its ways add up to 0. The
    sums are made by corner, so that a large component is spread over all tasks and only its outline goes on.
    """
    side = lambda dx, dy, down, way: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(down).alias("down"), F.lit(way).alias("way"))
    sides = F.explode(F.array(side(0, 0, False, 1), side(1, 0, True, 1), side(0, 1, False, -1), side(0, 0, True, -1))).alias("s")
    every = members.select(*keys, "component", sides).select(*keys, "component", "s.*")
    return every.groupBy(*keys, "component", "x", "y", "down").agg(F.sum("way").cast("int").alias("way")).filter("way <> 0")


def cell_sides(cells: list[tuple[int, int]]) -> list[tuple[int, int, bool, int]]:
    """``boundary`` of a few cells (y, x), as (x, y, down, way)."""
    ways: dict[tuple[int, int, bool], int] = {}
    for y, x in cells:
        for key, way in (((x, y, False), 1), ((x + 1, y, True), 1), ((x, y + 1, False), -1), ((x, y, True), -1)):
            ways[key] = ways.get(key, 0) + way
    return [(*k, w) for k, w in ways.items() if w]


def rings(sides: list[tuple[int, int, bool, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings (x, y corners) of a boundary: outer ones one way round, holes the other. At a corner where two rings
    touch the walk turns such that cells that only touch stay apart."""
    out_of: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y, down, way in sides:
        ends = (x, y), (x, y + 1) if down else (x + 1, y)
        a, b = ends if way > 0 else ends[::-1]
        out_of.setdefault(a, []).append(b)
    for ways in out_of.values():
        ways.sort()
    found = []
    while out_of:
        start = min(out_of)
        ring, at, came = [start], start, None
        while True:
            ways = out_of[at]
            if len(ways) > 1 and came is not None:
                # keep to the cell on the right hand: turn right where there is a choice
                d = (at[0] - came[0], at[1] - came[1])
                right = (at[0] - d[1], at[1] + d[0])
                step = right if right in ways else ways[0]
            else:
                step = ways[0]
            ways.remove(step)
            if not ways:
                del out_of[at]
            came, at = at, step
            if at == start:
                break
            ring.append(at)
        # corners only
        n = len(ring)
        corners = [p for i, p in enumerate(ring) if (ring[i - 1][0] - p[0]) * (ring[(i + 1) % n][1] - p[1]) != (ring[i - 1][1] - p[1]) * (ring[(i + 1) % n][0] - p[0])]
        found.append([*corners, corners[0]])
    return sorted(found, key=lambda r: (-abs(_area(r)), r))


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def polygon_rings(members: DataFrame, keys: list[str], header: dict) -> DataFrame:
    """Per component ``rings``: lists of (easting, northing), the outer ring first. A task holds one component's outline."""
    schema = members.select(*keys, "component", F.array(F.array(F.array(F.lit(0.0)))).alias("rings")).schema
    x0, y0, dx, dy = (header[k] for k in ("x0", "y0", "res_x", "res_y"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        found = rings(list(zip(t["x"].tolist(), t["y"].tolist(), t["down"].tolist(), t["way"].tolist(), strict=True)))
        out = t[[*keys, "component"]].head(1).copy()
        out["rings"] = [[[[x0 + x * dx, y0 + y * dy] for x, y in r] for r in found]]
        return out

    return boundary(members, keys).groupBy(*keys, "component").applyInPandas(run, schema)

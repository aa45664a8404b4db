"""Scene catalogue: search, top-k per month, pairing of months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.raster import asset, month_key, period, tile_id
from ..schema import BANDS_20M, MAX_CLOUD, SCENES_PER_MONTH

STAC_ITEM = "id string, properties string, geometry string, assets map<string,struct<href:string>>"


def scenes_from_items(items: DataFrame) -> DataFrame:
    """Catalogue items (columns of STAC_ITEM) as scene rows, with the defaults of missing properties."""
    get = lambda path: F.get_json_object("properties", path)
    return items.select(
        F.col("id").alias("scene_id"),
        F.to_timestamp(get("$.datetime")).alias("datetime"),
        F.coalesce(get("$['eo:cloud_cover']").cast("double"), F.lit(0.0)).alias("cloud_cover"),
        F.coalesce(get("$['s2:product_uri']"), F.col("id")).alias("product_id"),
        tile_id(F.col("id")).alias("tile_id"),
        F.coalesce("geometry", F.lit("{}")).alias("geometry"),
        F.transform_values("assets", lambda _, v: v["href"]).alias("assets"),
        *geometry_box(F.col("geometry")),
    )


def geometry_box(geometry: Column) -> list[Column]:
    """``west``, ``south``, ``east``, ``north`` of a GeoJSON geometry of any kind: the least and greatest of all its
    positions; null without any."""
    position = r"\[\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    x, y = (F.transform(F.regexp_extract_all(geometry, F.lit(position), F.lit(k)), lambda v: v.cast("double")) for k in (1, 2))
    return [F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north")]


def search(scenes: DataFrame, start: str | Column, end: str | Column, max_cloud: float = MAX_CLOUD, bbox: tuple[float, ...] | None = None) -> DataFrame:
    """Scenes from ``start`` to ``end`` (both included) with at most ``max_cloud`` percent of cloud, and, if a box (west,
    south, east, north) is given, those whose own box meets it; scenes without a place are in no box.

    Plain comparisons on columns, so that Parquet scans get them as pushed filters.
    """
    out = scenes.filter((F.col("datetime") >= F.lit(start).cast("timestamp")) & (F.col("datetime") <= F.lit(end).cast("timestamp")) & (F.col("cloud_cover") <= max_cloud))
    if bbox:
        west, south, east, north = bbox
        out = out.filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    return out


def by_month(scenes: DataFrame, ts: str = "datetime", scene: str = "scene_id") -> DataFrame:
    """Months with their scenes' ids in order of time."""
    rows = scenes.groupBy(month_key(F.col(ts)).alias("year_month"))
    return rows.agg(F.count("*").alias("n_scenes"), F.transform(F.array_sort(F.collect_list(F.struct(ts, scene))), lambda x: x[scene]).alias("scenes"))


def clearest(scenes: DataFrame, keys: list[str], k: int = SCENES_PER_MONTH, arrival: str = "scene_id") -> DataFrame:
    """The k scenes of least cloud in each group; ties by arrival. The rank filter plans to a limit within groups before
    the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("cloud_cover", arrival))
    return scenes.withColumn("rank", rank).filter(F.col("rank") <= k)


def primary_tile(scenes: DataFrame, tiles: dict[str, str], city: str = "city") -> DataFrame:
    """Scenes on their city's primary tile."""
    pairs = F.create_map(*(F.lit(x) for kv in tiles.items() for x in kv))
    return scenes.filter(F.col("tile_id") == F.element_at(pairs, F.col(city)))


def consecutive_months(months: DataFrame, keys: list[str] | None = None, separator: str = "/") -> DataFrame:
    """Each month with the next that is there. Months are few (12 a year), whatever the number of scenes."""
    keys = keys or []
    following = F.lead("year_month").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("year_month"))
    pairs = months.select(*keys, "year_month").distinct().withColumn("t2", following).filter("t2 IS NOT NULL")
    return pairs.select(*keys, F.col("year_month").alias("t1"), "t2", period(F.col("year_month"), F.col("t2"), separator).alias("detection_period"))


def cross_epoch_pairs(months: DataFrame, before: str, after: str, separator: str = "_to_") -> DataFrame:
    """One pair of months of two years: the first calendar month that both have, else the first of each."""
    # one row: at most 12 months on either side
    of = lambda y: F.array_sort(F.collect_set(F.when(F.col("year_month").startswith(f"{y}-"), F.col("year_month"))))
    row = months.agg(of(before).alias("a"), of(after).alias("b")).filter("size(a) > 0 AND size(b) > 0")
    same = lambda x, y: F.substring(x, 6, 2) == F.substring(y, 6, 2)
    both = F.filter("a", lambda x: F.exists("b", lambda y: same(x, y)))
    t1 = F.coalesce(F.get(both, F.lit(0)), F.get("a", F.lit(0)))
    row = row.withColumn("t1", t1)
    t2 = F.coalesce(F.get(F.filter("b", lambda y: same(F.col("t1"), y)), F.lit(0)), F.get("b", F.lit(0)))
    return row.select("t1", t2.alias("t2")).select("t1", "t2", period(F.col("t1"), F.col("t2"), separator).alias("detection_period"))


def wanted_assets(scenes: DataFrame, bands: list[str]) -> DataFrame:
    """One row for each scene and wanted band that the scene has."""
    rows = F.array(*(F.struct(F.lit(b).alias("band"), asset(F.col("assets"), b, 20 if b in BANDS_20M else 10).alias("href")) for b in bands))
    return scenes.select("scene_id", F.inline(rows)).filter("href IS NOT NULL")


def search_window(first: str, last: str, whole_month: bool = False) -> tuple[str, str]:
    """The dates that a run from month to month searches; its last month ends on day 28 unless ``whole_month``."""
    if not whole_month:
        return f"{first}-01", f"{last}-28"
    year, month = map(int, last.split("-"))
    days = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return f"{first}-01", f"{last}-{days[month - 1]}"


def acquire_window(year: int, month: int) -> tuple[str, str]:
    """A month and the first day of the next one, which the search includes."""
    return f"{year}-{month:02d}-01", f"{year + month // 12}-{month % 12 + 1:02d}-01"

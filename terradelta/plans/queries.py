"""The registered queries of the raster operators, each over its whole table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import raster as R
from ..operators import catalog, composite, grid, patches, spatial, tiling, validate, vectorize
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- catalogue ---


@query(f"WITH {V.SCENE_SQL} SELECT * FROM scene WHERE datetime >= '2024-01-05' AND datetime <= '2024-01-20' AND cloud_cover <= 50")
def scene_search(spark, sf):
    return catalog.search(V.scenes(spark, sf), "2024-01-05", "2024-01-20", 50.0)


_ITEM_SQL = """item AS (SELECT *, x - 180.0 AS west, y - 80.0 AS south, x - 180.0 + w AS east, y - 80.0 + 2.5 AS north
 FROM (SELECT *, (event_id * 7 % 350)::DOUBLE AS x, (event_id * 11 % 150)::DOUBLE AS y, (1 + event_id % 5)::DOUBLE AS w, event_id % 9 = 0 AS nowhere FROM events))"""


def _items(spark, sf) -> DataFrame:
    """Events as catalogue items: their JSON renamed, and a polygon as their place, which every ninth lacks."""
    e = V.table(spark, sf, "events")
    number = lambda x: F.expr(x).cast("double")
    w, s = number("event_id * 7 % 350") - 180, number("event_id * 11 % 150") - 80
    properties = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datetime"), F.get_json_object("props", "$.k").cast("double").alias("eo:cloud_cover"), F.get_json_object("props", "$.uri").alias("s2:product_uri")))
    assets = F.create_map(F.lit("B02"), F.struct(F.concat(F.lit("s3://x/"), F.col("event_id").cast("string")).alias("href")))
    return e.select(F.col("event_id").cast("string").alias("id"), properties.alias("properties"), F.when(F.expr("event_id % 9 <> 0"), R.geojson_polygon(w, s, w + number("1 + event_id % 5"), s + 2.5)).alias("geometry"), assets.alias("assets"))


@query("""SELECT event_id::VARCHAR AS scene_id, ts AS datetime, coalesce(json_extract_string(props, '$.k')::DOUBLE, 0.0) AS cloud_cover, coalesce(json_extract_string(props, '$.uri'), event_id::VARCHAR) AS product_id, 's3://x/' || event_id AS href FROM events""")
def scene_properties_json(spark, sf):
    return catalog.scenes_from_items(_items(spark, sf)).select("scene_id", "datetime", "cloud_cover", "product_id", F.element_at("assets", "B02").alias("href"))


@query(f"""WITH {_ITEM_SQL} SELECT event_id::VARCHAR AS scene_id, west, south, east, north FROM item
WHERE NOT nowhere AND ts >= '2024-01-05' AND ts <= '2024-01-20' AND coalesce(json_extract_string(props, '$.k')::DOUBLE, 0.0) <= 80 AND west <= 60 AND east >= -75 AND south <= 45 AND north >= -10""")
def scene_search_box(spark, sf):
    found = catalog.search(catalog.scenes_from_items(_items(spark, sf)), "2024-01-05", "2024-01-20", 80.0, (-75.0, -10.0, 60.0, 45.0))
    return found.select("scene_id", "west", "south", "east", "north")


_NAME = "'S2A_' || event_type || CASE WHEN event_id % 3 = 0 THEN '_T32VKM_' ELSE '_x_' END || event_id"


@query(f"SELECT event_id, regexp_extract(name, '_(T[0-9]{{2}}[A-Z]{{3}})_', 1) AS tile_id FROM (SELECT event_id, {_NAME} AS name FROM events)")
def tile_id_extract(spark, sf):
    return V.table(spark, sf, "events").select("event_id", R.tile_id(F.expr(_NAME)).alias("tile_id"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n_scenes, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def scenes_by_month(spark, sf):
    rows = V.table(spark, sf, "orders").groupBy(R.month_key(F.col("o_orderdate")).alias("year_month"))
    return rows.agg(F.count("*").alias("n_scenes"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query(f"""WITH {V.SCENE_SQL} SELECT strftime(datetime, '%Y-%m') AS year_month, string_agg(scene_id::VARCHAR, ',' ORDER BY datetime, scene_id) AS scenes FROM scene GROUP BY 1""")
def month_scene_lists(spark, sf):
    out = catalog.by_month(V.scenes(spark, sf))
    return out.select("year_month", F.concat_ws(",", F.col("scenes").cast("array<string>")).alias("scenes"))


@query(f"""WITH {V.SCENE_SQL} SELECT tile_id, day, scene_id, cloud_cover, rank FROM (SELECT tile_id, strftime(datetime, '%Y-%m-%d') AS day, scene_id, cloud_cover,
 row_number() OVER (PARTITION BY tile_id, strftime(datetime, '%Y-%m-%d') ORDER BY cloud_cover, scene_id)::INT AS rank FROM scene) WHERE rank <= 5""")
def top_k_clear_scenes(spark, sf):
    rows = V.scenes(spark, sf).withColumn("day", F.date_format("datetime", "yyyy-MM-dd"))
    return catalog.clearest(rows, ["tile_id", "day"], 5).select("tile_id", "day", "scene_id", "cloud_cover", "rank")


@query(f"""WITH {V.SCENE_SQL} SELECT n_name AS city, count(*) AS n FROM scene JOIN nation ON n_nationkey = scene_id % 25 AND tile_id = CASE WHEN n_nationkey % 2 = 0 THEN 'click' ELSE 'view' END GROUP BY 1""")
def primary_tile_scenes(spark, sf):
    nations = V.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    names = {r["city"]: "view" if r["n_nationkey"] % 2 else "click" for r in nations.collect()}
    rows = V.scenes(spark, sf).withColumn("n_nationkey", (F.col("scene_id") % 25).cast("int")).join(F.broadcast(nations), "n_nationkey")
    return catalog.primary_tile(rows, names).groupBy("city").agg(F.count("*").alias("n"))


@query("""SELECT t1, t2, t1 || '/' || t2 AS detection_period FROM (SELECT m AS t1, lead(m) OVER (ORDER BY m) AS t2 FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders)) WHERE t2 IS NOT NULL""")
def consecutive_month_pairs(spark, sf):
    return catalog.consecutive_months(V.table(spark, sf, "orders").select(R.month_key(F.col("o_orderdate")).alias("year_month")))


@query("""WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders)
SELECT a.m AS t1, b.m AS t2, a.m || '_to_' || b.m AS detection_period FROM m a, m b WHERE a.m LIKE '1996-%' AND b.m LIKE '1999-%' ORDER BY (a.m[6:7] = b.m[6:7]) DESC, t1, t2 LIMIT 1""")
def cross_epoch_pairs(spark, sf):
    months = V.table(spark, sf, "orders").select(R.month_key(F.col("o_orderdate")).alias("year_month"))
    return catalog.cross_epoch_pairs(months, "1996", "1999")


@query("""SELECT scene_id, band, href FROM (SELECT event_id AS scene_id, unnest(['B02', 'B11', 'SCL']) AS band, event_id, event_type FROM events) s
 CROSS JOIN LATERAL (SELECT CASE WHEN band = 'B02' THEN CASE WHEN event_id % 2 = 0 THEN 'a/' || event_id ELSE 'b/' || event_id END WHEN band = 'B11' THEN CASE WHEN event_id % 5 = 0 THEN 'c/' || event_id END END AS href) WHERE href IS NOT NULL""")
def asset_fallback_lookup(spark, sf):
    i = F.col("event_id")
    place = lambda p: F.concat(F.lit(p), i.cast("string"))
    assets = F.map_filter(F.create_map(F.lit("B02_10m"), F.when(i % 2 == 0, place("a/")), F.lit("B02"), place("b/"), F.lit("B11_20m"), F.when(i % 5 == 0, place("c/"))), lambda _, v: v.isNotNull())
    return catalog.wanted_assets(V.table(spark, sf, "events").select(i.alias("scene_id"), assets.alias("assets")), ["B02", "B11", "SCL"])


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'https://h/x' ELSE 'root/Products(p' || event_id || ')/Nodes(A' || event_id || '.SAFE)/Nodes(G)/Nodes(f.jp2)/$value' END AS url FROM events""")
def href_to_nodes(spark, sf):
    i = F.col("event_id").cast("string")
    href = F.when(F.col("event_id") % 4 == 0, "https://h/x").otherwise(F.concat(F.lit("s3://bucket/2024/A"), i, F.lit(".SAFE/G/f.jp2")))
    return V.table(spark, sf, "events").select("event_id", R.nodes_path(href, F.concat(F.lit("p"), i), "root").alias("url"))


@query("""SELECT n_name AS name, '{"type":"Polygon","coordinates":[[[' || w || ',' || s || '],[' || e || ',' || s || '],[' || e || ',' || n || '],[' || w || ',' || n || '],[' || w || ',' || s || ']]]}' AS geojson
FROM (SELECT n_name, (n_nationkey + 0.5)::DOUBLE::VARCHAR AS w, (n_regionkey + 0.25)::DOUBLE::VARCHAR AS s, (n_nationkey + 1.5)::DOUBLE::VARCHAR AS e, (n_regionkey + 1.25)::DOUBLE::VARCHAR AS n FROM nation)""")
def aoi_geojson(spark, sf):
    d = lambda e: F.expr(e).cast("double")
    return V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), R.geojson_polygon(d("n_nationkey + 0.5"), d("n_regionkey + 0.25"), d("n_nationkey + 1.5"), d("n_regionkey + 1.25")).alias("geojson"))


# --- composites and indices ---

_CLEAR = "scl NOT IN (3, 7, 8, 9, 10)"
_MEDIANS = ", ".join(f"median(CASE WHEN {_CLEAR} THEN {b}::DOUBLE END)::FLOAT AS {b}" for b in V.BANDS)
_COMPOSITE_SQL = f"""{V.OBS_SQL}, comp AS (SELECT year_month, y, x, {_MEDIANS}, count(CASE WHEN {_CLEAR} THEN 1 END)::INT AS clear_obs_count, any_value(n_scenes) AS n_scenes, any_value(n_scenes >= 3) AS reliable
 FROM obs JOIN (SELECT year_month, count(DISTINCT scene) AS n_scenes FROM obs GROUP BY 1) USING (year_month) GROUP BY 1, 2, 3)"""
_ND = lambda a, b, n: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) ELSE 0 END::FLOAT AS {n}"
_NDS = {"NDVI": _ND("B08", "B04", "NDVI"), "NDBI": _ND("B11", "B08", "NDBI"), "NDWI": _ND("B03", "B08", "NDWI")}


def _composite(spark, sf) -> DataFrame:
    return composite.median_composite(V.observations(spark, sf), V.BANDS, ["year_month", "y", "x"])


@query(f"WITH {V.OBS_SQL} SELECT y, x, scene, scl, {_CLEAR} AS clear FROM obs")
def cloud_mask(spark, sf):
    return V.observations(spark, sf).select("y", "x", "scene", "scl", R.is_clear(F.col("scl")).alias("clear"))


@query(f"WITH {V.OBS_SQL} SELECT y, x, scene, year_month, {_CLEAR} AS clear, CASE WHEN {_CLEAR} THEN B08 END AS B08 FROM obs")
def masked_band(spark, sf):
    return composite.mask_observations(V.observations(spark, sf), ["B08"]).select("y", "x", "scene", "year_month", "clear", "B08")


@query(f"WITH {V.OBS_SQL} SELECT year_month, round(avg(CASE WHEN {_CLEAR} THEN 1.0 ELSE 0.0 END), 6) AS cloud_free_fraction FROM obs GROUP BY 1")
def cloud_free_fraction(spark, sf):
    return composite.cloud_free_fraction(V.observations(spark, sf), ["year_month"]).withColumn("cloud_free_fraction", F.round("cloud_free_fraction", 6))


@query(f"WITH {_COMPOSITE_SQL} SELECT year_month, y, x, B03, B04, B08, B11, clear_obs_count, n_scenes, reliable, {', '.join(_NDS.values())} FROM comp")
def monthly_median_composite(spark, sf):
    """The flagship: cloud-free monthly composites with three indices."""
    return composite.add_indices(_composite(spark, sf))


@query(f"WITH {V.OBS_SQL} SELECT year_month, y, x, count(CASE WHEN {_CLEAR} THEN B11 END) AS clear_obs_count FROM obs GROUP BY 1, 2, 3")
def clear_obs_count(spark, sf):
    rows = composite.mask_observations(V.observations(spark, sf), ["B11"])
    return rows.groupBy("year_month", "y", "x").agg(F.count("B11").alias("clear_obs_count"))


@query(f"WITH {V.OBS_SQL} SELECT year_month, count(DISTINCT scene) AS n_scenes, count(DISTINCT scene) >= 3 AS reliable FROM obs GROUP BY 1")
def reliable_months(spark, sf):
    return composite.month_headers(V.observations(spark, sf), ["year_month"])


@query(f"WITH {_COMPOSITE_SQL} SELECT y, x, avg(B08::DOUBLE)::FLOAT AS B08, avg(B11::DOUBLE)::FLOAT AS B11 FROM comp GROUP BY 1, 2")
def mean_composite(spark, sf):
    return composite.mean_composite(_composite(spark, sf), ["B08", "B11"], ["y", "x"])


def _one_index(name: str) -> None:
    def f(spark, sf):
        return composite.add_indices(_composite(spark, sf)).select("year_month", "y", "x", name)

    f.__name__ = name.lower()
    query(f"WITH {_COMPOSITE_SQL} SELECT year_month, y, x, {_NDS[name]} FROM comp")(f)


for _name in _NDS:
    _one_index(_name)


@query(f"WITH {V.OBS_SQL} SELECT y, x, scene, {', '.join(_NDS.values())} FROM obs")
def index_stack(spark, sf):
    return composite.add_indices(V.observations(spark, sf)).select("y", "x", "scene", "NDVI", "NDBI", "NDWI")


# --- grids ---


@query(f"""WITH {V.TILE_SQL}, coarse AS (SELECT raster, y, x, v > 0 AS clear FROM tile WHERE y < 4 AND x < 4), axis AS (SELECT unnest(range(8)) AS t),
near AS (SELECT t, s FROM (SELECT t, s, row_number() OVER (PARTITION BY t ORDER BY abs(t * 10 - s * 20), s DESC) AS r FROM axis, (SELECT unnest(range(4)) AS s)) WHERE r = 1)
SELECT raster, a.t::INT AS y, b.t::INT AS x, clear FROM coarse JOIN near a ON a.s = y JOIN near b ON b.s = x""")
def mask_upsample_nearest(spark, sf):
    coarse = V.tiles(spark, sf).filter("y < 4 AND x < 4").select("raster", "y", "x", (F.col("v") > 0).alias("clear"))
    fine, wide = spark.range(8).select((F.col("id") * 10).alias("t")), spark.range(4).select((F.col("id") * 20).alias("s"))
    near = grid.nearest_axis(fine, wide).select((F.col("t") / 10).cast("int").alias("t"), (F.col("s") / 20).cast("int").alias("s"))
    rows = coarse.join(F.broadcast(near.select(F.col("t").alias("fy"), F.col("s").alias("y"))), "y").join(F.broadcast(near.select(F.col("t").alias("fx"), F.col("s").alias("x"))), "x")
    return rows.select("raster", F.col("fy").alias("y"), F.col("fx").alias("x"), "clear")


@query(f"""WITH {V.TILE_SQL}, g AS (SELECT a::INT AS y, b::INT AS x FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b))
SELECT raster, g.y, g.x, v AS value FROM g JOIN tile t ON t.y = floor(g.y * 1.25 + 0.6 + 0.5) AND t.x = floor(g.x * 1.25 + 0.3 + 0.5)""")
def grid_align_nearest(spark, sf):
    src, targets = _src_targets(spark, sf)
    out = grid.resample(src, targets, F.col("x") * 1.25 + 0.3, F.col("y") * 1.25 + 0.6, ["raster"], "v", "nearest")
    return out.filter("v IS NOT NULL").select("raster", "y", "x", F.col("v").alias("value"))


def _src_targets(spark, sf):
    src = V.tiles(spark, sf).select("raster", "y", "x", "v")
    cells = F.explode(F.sequence(F.lit(0), F.lit(5)))
    return src, V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("raster"), cells.alias("y")).withColumn("x", cells)


def _kernel_sql(weight: str, reach: int) -> str:
    w = lambda d: weight.replace("{d}", f"({d})")
    return f"""WITH {V.TILE_SQL}, g AS (SELECT a::INT AS y, b::INT AS x, b * 1.25::DOUBLE + 0.3::DOUBLE AS u, a * 1.25::DOUBLE + 0.6::DOUBLE AS t FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b)),
n AS (SELECT raster, g.y, g.x, {w('u - s.x')} * {w('t - s.y')} AS w, v FROM g JOIN tile s ON s.x BETWEEN floor(u) + {1 - reach} AND floor(u) + {reach} AND s.y BETWEEN floor(t) + {1 - reach} AND floor(t) + {reach})
SELECT raster, y, x, round((sum(w * v) / sum(w))::FLOAT::DOUBLE, 6) + 0.0::DOUBLE AS value FROM n GROUP BY 1, 2, 3"""


def _resampled(spark, sf, method: str):
    src, targets = _src_targets(spark, sf)
    out = grid.resample(src, targets, F.col("x") * 1.25 + 0.3, F.col("y") * 1.25 + 0.6, ["raster"], "v", method)
    return out.select("raster", "y", "x", F.round(F.col("v").cast("double"), 6).alias("value"))


@query(_kernel_sql("greatest(1 - abs{d}, 0)", 1))
def resample_bilinear(spark, sf):
    return _resampled(spark, sf, "bilinear")


@query(_kernel_sql("CASE WHEN abs{d} < 1 THEN (1.5 * abs{d} - 2.5) * abs{d} * abs{d} + 1 WHEN abs{d} < 2 THEN ((-0.5 * abs{d} + 2.5) * abs{d} - 4) * abs{d} + 2 ELSE 0 END", 2))
def resample_cubic(spark, sf):
    return _resampled(spark, sf, "cubic")


# --- labels and patches ---


@query(f"""WITH {V.TILE_SQL} SELECT a.raster, a.y, a.x, (coalesce((b.v * 100)::FLOAT - (a.v * 100)::FLOAT >= 10::FLOAT, false))::TINYINT AS label FROM tile a LEFT JOIN tile b ON b.raster = a.raster + 1 AND a.y = b.y AND a.x = b.x""")
def change_labels(spark, sf):
    return _labels(spark, sf)


def _labels(spark, sf):
    rows = V.tiles(spark, sf).select("raster", "y", "x", (F.col("v") * 100).cast("float").alias("density"))
    return patches.change_labels(rows, rows.withColumn("raster", F.col("raster") - 1), ["raster"])


@query(f"""WITH {V.TILE_SQL} SELECT a.raster, round(100.0 * sum((coalesce((b.v * 100)::FLOAT - (a.v * 100)::FLOAT >= 10::FLOAT, false))::INT) / count(*), 6) AS change_rate FROM tile a LEFT JOIN tile b ON b.raster = a.raster + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1""")
def change_rate(spark, sf):
    return patches.change_rate(_labels(spark, sf), ["raster"]).withColumn("change_rate", F.round("change_rate", 6))


_PATCH_SQL = f"""{V.TILE_SQL}, pix AS (SELECT a.raster, a.y, a.x, CASE WHEN a.v > 0.25 THEN NULL ELSE a.v END AS v, (coalesce(b.v - a.v >= 0.1::FLOAT, false))::INT AS label FROM tile a LEFT JOIN tile b ON b.raster = a.raster + 1 AND a.y = b.y AND a.x = b.x),
win AS (SELECT r::INT AS row_start, c::INT AS col_start FROM (SELECT unnest([0, 2, 4]) AS r), (SELECT unnest([0, 2, 4]) AS c))"""


def _patches(spark, sf, limit: float):
    a = V.tiles(spark, sf).select("raster", "y", "x", "v")
    b = a.select((F.col("raster") - 1).alias("raster"), "y", "x", F.col("v").alias("after"))
    rows = a.join(b, ["raster", "y", "x"], "left").select("raster", "y", "x", F.when(~(F.col("v") > 0.25), F.col("v")).alias("v_1"), F.col("after").alias("v_2"), R.at_least(F.col("after") - F.col("v"), 0.1).cast("int").alias("label"))
    out = patches.extract_patches(rows, ["raster"], ["v"], 8, 8, 4, 2, limit)
    return out.select("raster", "row_start", "col_start", "n_missing", F.aggregate("label", F.lit(0), lambda s, x: s + x).alias("n_change"), F.size("t1").alias("n_values"))


@query(f"WITH {_PATCH_SQL} SELECT raster, row_start, col_start, count(*) - count(v) AS n_missing, sum(label)::INT AS n_change, count(*)::INT AS n_values FROM pix JOIN win ON y >= row_start AND y < row_start + 4 AND x >= col_start AND x < col_start + 4 GROUP BY 1, 2, 3")
def extract_patches(spark, sf):
    return _patches(spark, sf, 1.0)


@query(f"WITH {_PATCH_SQL} SELECT raster, row_start, col_start, count(*) - count(v) AS n_missing, sum(label)::INT AS n_change, count(*)::INT AS n_values FROM pix JOIN win ON y >= row_start AND y < row_start + 4 AND x >= col_start AND x < col_start + 4 GROUP BY 1, 2, 3 HAVING count(*) - count(v) <= 0.0625 * 16")
def patch_nan_filter(spark, sf):
    return _patches(spark, sf, 0.0625)


@query("""SELECT c_custkey, n_name, CASE WHEN n_nationkey % 6 IN (0, 1, 2, 3) THEN 'train' WHEN n_nationkey % 6 = 4 THEN 'val' ELSE 'test' END AS split FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def split_assignment(spark, sf):
    cities = [c for part in ("train", "val", "test") for c in patches.SPLITS[part]]
    city = F.element_at(F.array(*map(F.lit, cities)), (F.col("n_nationkey") % 6 + 1).cast("int"))
    nations = V.table(spark, sf, "nation").select("n_nationkey", "n_name", patches.split_of(city).alias("split"))
    customers = V.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return customers.join(F.broadcast(nations), "n_nationkey").select("c_custkey", "n_name", "split")


@query(f"WITH {V.TILE_SQL} SELECT raster, y, x, round((coalesce(CASE WHEN v > 0.25 THEN NULL ELSE v END, 0)::DOUBLE - 0.02) / (0.12 + 1e-8), 6) AS z FROM tile")
def zscore_normalize(spark, sf):
    v = F.when(~(F.col("v") > 0.25), F.col("v").cast("double"))
    return V.tiles(spark, sf).select("raster", "y", "x", F.round(R.z_score(v, F.lit(0.02), F.lit(0.12)), 6).alias("z"))


@query(f"""WITH {V.TILE_SQL}, f AS (SELECT raster, raster % 4 AS k, CASE WHEN raster % 3 = 0 THEN 7 - x ELSE x END AS x, CASE WHEN raster % 5 = 0 THEN 7 - y ELSE y END AS y, v FROM tile)
SELECT raster, (CASE k WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y ELSE x END)::INT AS y, (CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x ELSE 7 - y END)::INT AS x, v FROM f""")
def augment_flip_rot(spark, sf):
    r = F.col("raster")
    y, x = patches.turned(F.col("y"), F.col("x"), 8, r % 3 == 0, r % 5 == 0, r % 4)
    return V.tiles(spark, sf).select("raster", y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


# --- tiling and blending ---


@query(f"""WITH {V.TILE_SQL}, i AS (SELECT p, CASE WHEN p % 14 < 8 THEN p % 14 ELSE 14 - p % 14 END AS s FROM (SELECT unnest(range(10)) AS p)) SELECT raster, a.p::INT AS y, b.p::INT AS x, v FROM tile JOIN i a ON a.s = y JOIN i b ON b.s = x""")
def reflect_pad(spark, sf):
    return tiling.pad_reflect(V.tiles(spark, sf).select("raster", "y", "x", "v"), ["raster"], 8, 8, 6, 4).select("raster", "y", "x", "v")


@query(f"""WITH {V.TILE_SQL}, s AS (SELECT unnest([0, 2, 4]) AS s) SELECT raster, a.s::INT AS row_start, b.s::INT AS col_start, count(*) AS n, round(sum(v), 4) AS total FROM tile JOIN s a ON y >= a.s AND y < a.s + 4 JOIN s b ON x >= b.s AND x < b.s + 4 GROUP BY 1, 2, 3""")
def tile_starts(spark, sf):
    rows = tiling.to_tiles(V.tiles(spark, sf), 8, 8, 4, 2).groupBy("raster", "row_start", "col_start")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double")), 4).alias("total"))


@query(f"""WITH {V.TILE_SQL}, s AS (SELECT unnest([0, 2, 4]) AS s), t AS (SELECT raster, y, x, v, a.s AS r, b.s AS c FROM tile JOIN s a ON y >= a.s AND y < a.s + 4 JOIN s b ON x >= b.s AND x < b.s + 4),
m AS (SELECT *, avg(8 * v::DOUBLE) OVER (PARTITION BY raster, r, c) AS logit, exp(-((y - r - 1.5) ** 2 + (x - c - 1.5) ** 2) / 2.0) AS w FROM t)
SELECT raster, y, x, round((sum(w / (1 + exp(-logit))) / sum(w))::FLOAT::DOUBLE, 5) AS prob FROM m GROUP BY 1, 2, 3""")
def gaussian_blend(spark, sf):
    rows = tiling.to_tiles(V.tiles(spark, sf), 8, 8, 4, 2)
    tiled = rows.withColumn("logit", F.avg(8 * F.col("v").cast("double")).over(Window.partitionBy("raster", "row_start", "col_start")))
    return tiling.blend(tiled, ["raster"], 4, 8, 8).withColumn("prob", F.round(F.col("prob").cast("double"), 5))


# --- morphology, components, polygons ---


@query(f"WITH {V.TILE_SQL} SELECT raster, y, x, prob >= 0.6::FLOAT AS \"on\" FROM tile")
def threshold_mask(spark, sf):
    return grid.threshold(V.tiles(spark, sf), "prob", 0.6).select("raster", "y", "x", "on")


def _pass(src: str, to: str, grow: bool) -> str:
    f = "greatest" if grow else "least"
    n = lambda kind, part, order: f"{kind}(b, 1, 0) OVER (PARTITION BY raster, {part} ORDER BY {order})"
    return f"{to} AS (SELECT raster, y, x, {f}(b, {n('lag', 'y', 'x')}, {n('lead', 'y', 'x')}, {n('lag', 'x', 'y')}, {n('lead', 'x', 'y')}) AS b FROM {src})"


_ON = f"{V.TILE_SQL}, m0 AS (SELECT raster, y, x, (prob >= 0.45::FLOAT)::INT AS b FROM tile)"
_CLEAN = f"{_ON}, {_pass('m0', 'm1', False)}, {_pass('m1', 'm2', True)}, {_pass('m2', 'm3', True)}, {_pass('m3', 'm4', False)}"


def _mask(spark, sf):
    return grid.threshold(V.tiles(spark, sf), "prob", 0.45)


@query(f"WITH {_ON}, {_pass('m0', 'm1', False)}, {_pass('m1', 'm2', True)} SELECT raster, y, x, b = 1 AS \"on\" FROM m2")
def morph_open(spark, sf):
    return grid.morphology(_mask(spark, sf), ["raster"], grid.OPEN)


@query(f"WITH {_ON}, {_pass('m0', 'm1', True)}, {_pass('m1', 'm2', False)} SELECT raster, y, x, b = 1 AS \"on\" FROM m2")
def morph_close(spark, sf):
    return grid.morphology(_mask(spark, sf), ["raster"], grid.CLOSE)


@query(f"WITH {_CLEAN} SELECT raster, y, x, b = 1 AS \"on\" FROM m4")
def open_close(spark, sf):
    return grid.morphology(_mask(spark, sf), ["raster"])


def _comp_sql(src: str) -> str:
    rec = f"""s AS (SELECT raster, y * 8 + x AS p, y, x FROM {src} WHERE b = 1),
r AS (SELECT raster, p, y, x, p AS c FROM s UNION SELECT s.raster, s.p, s.y, s.x, r.c FROM r JOIN s ON s.raster = r.raster AND abs(s.y - r.y) + abs(s.x - r.x) = 1),
lab AS (SELECT raster, y, x, min(c)::BIGINT AS component FROM r GROUP BY 1, 2, 3)"""
    return rec


@query(f"WITH RECURSIVE {_ON}, {_comp_sql('m0')} SELECT * FROM lab")
def connected_components(spark, sf):
    return grid.connected_components(_mask(spark, sf), ["raster"], 8, height=8)


@query(SQL["open_close"])
def open_close_chunks(spark, sf):
    """The same over chunks of three pixels a side, so that halos and edges of chunks count."""
    return grid.morphology(_mask(spark, sf), ["raster"], size=3)


@query(SQL["connected_components"])
def connected_components_chunks(spark, sf):
    """The same over chunks of three pixels a side, whose labels have to be united."""
    return grid.connected_components(_mask(spark, sf), ["raster"], 8, size=3, height=8)


_POLY_SQL = f"WITH RECURSIVE {_CLEAN}, {_comp_sql('m4')}, poly AS (SELECT raster, component, round(avg(prob), 5) AS confidence, count(*) AS n_pixels, count(*) * 100.0::DOUBLE AS area_m2, '2018-06/2021-06' AS detection_period FROM lab JOIN tile USING (raster, y, x) GROUP BY 1, 2 HAVING count(*) * 100.0 >= 200)"


def _polygons(spark, sf):
    members = vectorize.change_members(V.tiles(spark, sf).select("raster", "y", "x", "prob"), ["raster"], 8, 0.45, height=8)
    return members, vectorize.change_polygons(members, ["raster"], 100.0, 200.0, "2018-06/2021-06")


@query(f"{_POLY_SQL} SELECT * FROM poly")
def change_polygons(spark, sf):
    return _polygons(spark, sf)[1].withColumn("confidence", F.round("confidence", 5))


@query(f"{_POLY_SQL} SELECT raster, component, (n_pixels * 100.0)::DOUBLE AS ring_area FROM poly")
def polygon_ring_areas(spark, sf):
    """Areas by the traced rings (outer minus holes): they must equal the pixels'."""
    members, polygons = _polygons(spark, sf)
    header = {"x0": 297000.0, "y0": 6690000.0, "res_x": 10.0, "res_y": -10.0}
    rings = vectorize.polygon_rings(members.join(polygons.select("raster", "component"), ["raster", "component"], "left_semi"), ["raster"], header)
    cross = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), F.lit(0.0), lambda s, i: s + (F.get(F.get(r, i), F.lit(0)) - 297000.0) * (F.get(F.get(r, i + 1), F.lit(1)) - 6690000.0) - (F.get(F.get(r, i + 1), F.lit(0)) - 297000.0) * (F.get(F.get(r, i), F.lit(1)) - 6690000.0))
    return rings.select("raster", "component", F.round(F.abs(F.aggregate("rings", F.lit(0.0), lambda s, r: s + cross(r))) / 2, 3).alias("ring_area"))


# --- boxes ---


@query(f"WITH {V.BOX_SQL} SELECT c.id, round(coalesce(sum(common), 0), 4) AS overlap_area, round(coalesce(sum(common), 0) / ((xmax - xmin) * (ymax - ymin)), 6) AS overlap FROM change c LEFT JOIN pair ON change_id = c.id GROUP BY c.id, xmin, xmax, ymin, ymax")
def building_overlap(spark, sf):
    out = spatial.building_overlap(V.changes(spark, sf), V.buildings(spark, sf), "id", 50.0)
    return out.select("id", F.round("overlap_area", 4).alias("overlap_area"), F.round("overlap", 6).alias("overlap"))


# changes without area (every seventh) and without shape (every eleventh) among the others
_ODD_SQL = """odd AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE xmin END AS xmin, ymin, CASE WHEN id % 7 = 0 THEN xmin ELSE xmax END AS xmax, ymax FROM change),
shape AS (SELECT id, xmin, ymin, xmax, ymax, (xmax - xmin) * (ymax - ymin) AS area FROM odd),
cover AS (SELECT s.id, sum(greatest(least(s.xmax, b.xmax) - greatest(s.xmin, b.xmin), 0) * greatest(least(s.ymax, b.ymax) - greatest(s.ymin, b.ymin), 0)) AS common
 FROM shape s JOIN building b ON s.xmin < b.xmax AND b.xmin < s.xmax AND s.ymin < b.ymax AND b.ymin < s.ymax GROUP BY 1)"""


@query(f"""WITH {V.BOX_SQL}, {_ODD_SQL} SELECT id, CASE WHEN area IS NULL OR area = 0 THEN 'other' WHEN coalesce(common, 0) / area >= 0.3 THEN 'new_building' ELSE 'new_paving' END AS change_type
FROM shape LEFT JOIN cover USING (id)""")
def change_type(spark, sf):
    odd = V.changes(spark, sf).withColumn("xmax", F.when(F.col("id") % 7 == 0, F.col("xmin")).otherwise(F.col("xmax"))).withColumn("xmin", F.when(F.col("id") % 11 != 0, F.col("xmin")))
    overlaps = spatial.building_overlap(odd, V.buildings(spark, sf), "id", 50.0)
    return spatial.change_type(overlaps).select("id", "change_type")


@query(f"WITH {V.BOX_SQL} SELECT change_id, building_id, round(common / (ca + ba - common), 6) AS iou FROM pair WHERE common > 0")
def polygon_iou_pairs(spark, sf):
    out = spatial.iou_pairs(V.changes(spark, sf), V.buildings(spark, sf), 50.0, digits=6)
    return out.select(F.col("a_id").alias("change_id"), F.col("b_id").alias("building_id"), "iou")


@query(f"WITH {V.BOX_SQL} SELECT id, xmin, ymin, xmax, ymax FROM building WHERE xmin <= 200 AND xmax >= 100 AND ymin <= 150 AND ymax >= 50")
def footprints_in_box(spark, sf):
    return spatial.footprints_in(V.buildings(spark, sf), 100.0, 50.0, 200.0, 150.0)


_GREEDY_SQL = f"""WITH RECURSIVE {V.BOX_SQL},
near AS (SELECT change_id, list({{'t': building_id, 'iou': iou}} ORDER BY iou DESC, building_id) AS l, max(iou) AS m FROM (SELECT change_id, building_id, common / (ca + ba - common) AS iou FROM pair WHERE common > 0) GROUP BY 1),
ordered AS (SELECT row_number() OVER (ORDER BY m DESC, change_id DESC) AS k, l FROM near),
step AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken, 0::BIGINT AS tp, 0::DOUBLE AS total
 UNION ALL SELECT k, CASE WHEN c.iou > 0.3 THEN list_append(taken, c.t) ELSE taken END, tp + CASE WHEN c.iou > 0.3 THEN 1 ELSE 0 END, total + CASE WHEN c.iou > 0.3 THEN c.iou ELSE 0 END
 FROM (SELECT o.k, taken, tp, total, list_filter(l, lambda x: NOT list_contains(taken, x.t))[1] AS c FROM step JOIN ordered o ON o.k = step.k + 1)),
n AS (SELECT (SELECT count(*) FROM change) AS p, (SELECT count(*) FROM building) AS g, tp, total FROM step ORDER BY k DESC LIMIT 1)
SELECT 'all' AS area, round(tp / p, 6) AS polygon_precision, round(tp / g, 6) AS polygon_recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (p + g) ELSE 0 END, 6) AS polygon_f1,
 round(CASE WHEN tp > 0 THEN total / tp ELSE 0 END, 6) AS mean_iou, p AS n_pred_polygons, g AS n_gt_polygons, 0.3::DOUBLE AS threshold FROM n"""


@query(_GREEDY_SQL)
def greedy_match_metrics(spark, sf):
    """Greedy matching is sequential; so is its SQL, which walks the predictions by recursion."""
    pred, truth = (df.withColumn("area", F.lit("all")) for df in (V.changes(spark, sf), V.buildings(spark, sf)))
    a, b = spatial.box_classes(pred, ["area"], "a"), spatial.box_classes(truth, ["area"], "b")
    matches = validate.greedy_class_matches(spatial.iou_classes(a, b, 50.0, ["area"]), a, b, ["area"], "id")
    out = validate.polygon_metrics(matches, pred, truth, ["area"])
    return out.withColumns({c: F.round(c, 6) for c in ("polygon_precision", "polygon_recall", "polygon_f1", "mean_iou")})


# --- validation ---

_SWEEP = "(SELECT unnest(range(7)) AS ord, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9]::DOUBLE[]) AS threshold)"
_SWEEP_SQL = f"""WITH {V.GT_SQL}, c AS (SELECT ord::INT AS ord, threshold, count(CASE WHEN prob >= threshold::FLOAT AND gt = 1 THEN 1 END) AS tp, count(CASE WHEN prob >= threshold::FLOAT AND gt = 0 THEN 1 END) AS fp, count(CASE WHEN prob < threshold::FLOAT AND gt = 1 THEN 1 END) AS fn FROM score, {_SWEEP} GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c),
sweep AS (SELECT ord, threshold, tp, fp, fn, round(pr, 6) AS pixel_precision, round(re, 6) AS pixel_recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS pixel_f1 FROM p)"""


def _sweep(spark, sf):
    out = validate.threshold_sweep(V.scores(spark, sf), [0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9])
    return out.withColumns({c: F.round(c, 6) for c in ("pixel_precision", "pixel_recall", "pixel_f1")})


@query(f"{_SWEEP_SQL} SELECT threshold, tp, fp, fn, pixel_precision, pixel_recall, pixel_f1 FROM sweep WHERE ord = 4")
def pixel_metrics(spark, sf):
    out = validate.pixel_metrics(V.scores(spark, sf), 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("pixel_precision", "pixel_recall", "pixel_f1")})


@query(f"{_SWEEP_SQL} SELECT * FROM sweep")
def threshold_sweep(spark, sf):
    return _sweep(spark, sf)


@query(f"{_SWEEP_SQL} SELECT * FROM sweep ORDER BY pixel_f1 DESC, ord LIMIT 1")
def best_threshold(spark, sf):
    return validate.best_threshold(_sweep(spark, sf))


@query(f"""{_SWEEP_SQL} SELECT threshold, '| ' || threshold || ' | ' || printf('%.4f', pixel_precision) || ' | ' || printf('%.4f', pixel_recall) || ' | ' || printf('%.4f', pixel_f1) || ' | ' || tp || ' |' AS line FROM sweep""")
def metrics_table(spark, sf):
    return validate.metrics_lines(_sweep(spark, sf), "threshold", ["pixel_precision", "pixel_recall", "pixel_f1", "tp"])


_SERIES = "'2018-' || lpad((label + 1)::VARCHAR, 2, '0')"


@query(f"""WITH {V.TILE_SQL}, s AS (SELECT raster % 20 AS area, {_SERIES} AS m, max(prob) AS p FROM tile GROUP BY 1, 2) SELECT area, min(CASE WHEN m >= '2018-03' AND p >= 0.9::FLOAT THEN m END) AS detection_month, min(CASE WHEN m >= '2018-03' AND p >= 0.9::FLOAT THEN m[6:7]::INT END) - 3 AS latency_months FROM s GROUP BY 1""")
def detection_latency(spark, sf):
    month = F.concat(F.lit("2018-"), F.lpad((F.col("label") + 1).cast("string"), 2, "0"))
    series = V.tiles(spark, sf).select((F.col("raster") % 20).alias("area"), month.alias("year_month"), "prob")
    return validate.detection_latency(series, "2018-03", 0.9, ["area"])


@query(f"""WITH {V.TILE_SQL} SELECT raster, y, x, round((CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w)::DOUBLE / (max(v) OVER w - min(v) OVER w)::DOUBLE ELSE 0 END)::FLOAT::DOUBLE, 5) AS r FROM tile WINDOW w AS (PARTITION BY raster)""")
def rgb_stretch(spark, sf):
    out = validate.rgb_stretch(V.tiles(spark, sf), ["raster"], ["v"])
    return out.select("raster", "y", "x", F.round(F.col("r").cast("double"), 5).alias("r"))


@query(f"WITH {V.TILE_SQL} SELECT m AS year_month, max_prob, round(m[1:4]::INT + (m[6:7]::INT - 1) / 12, 6) AS year FROM (SELECT {_SERIES} AS m, max(prob) AS max_prob FROM tile GROUP BY 1)")
def latency_plot_data(spark, sf):
    month = F.concat(F.lit("2018-"), F.lpad((F.col("label") + 1).cast("string"), 2, "0"))
    out = validate.latency_plot(V.tiles(spark, sf).select(month.alias("year_month"), "prob"), [])
    return out.withColumn("year", F.round("year", 6))


# --- training and whole runs ---


@query()
def trained_scorer(spark, sf):
    """A fitted model's scores: coefficients follow the optimiser's path, so a test checks what it has learned instead."""
    from ..operators import train

    a = V.tiles(spark, sf).select("raster", "y", "x", F.col("v").alias("v_1"))
    b = a.select((F.col("raster") - 1).alias("raster"), "y", "x", F.col("v_1").alias("v_2"))
    rows = a.join(b, ["raster", "y", "x"]).withColumn("label", R.at_least(F.col("v_2") - F.col("v_1"), 0.1).cast("int"))
    model = train.train_scorer(rows, ["v"], {"v": (0.0, 1.0)}, pos_weight=2.0)
    return model.transform(train.features(rows, ["v"], {"v": (0.0, 1.0)})).select("raster", "y", "x", "label", F.col("prediction").cast("int").alias("predicted"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS tile_id, count(*) AS n_scenes, sum(json_extract_string(props, '$.k')::DOUBLE) AS cloud FROM events GROUP BY 1, 2""")
def streaming_clearness(spark, sf):
    """An extension: the same counts from a stream."""
    from ..streaming.composites import arrived_clearness

    return arrived_clearness(spark, f"{sf}/event[s].parquet")


@query(f"""WITH {V.TILE_SQL}, t AS (SELECT a.raster, a.y, a.x, 4 * (b.v::DOUBLE - a.v::DOUBLE) AS logit, r.s AS r, c.s AS c FROM tile a JOIN tile b ON b.raster = a.raster + 1 AND a.y = b.y AND a.x = b.x,
 (SELECT unnest([0, 2, 4]) AS s) r, (SELECT unnest([0, 2, 4]) AS s) c WHERE a.y >= r.s AND a.y < r.s + 4 AND a.x >= c.s AND a.x < c.s + 4)
SELECT raster, y, x, round((sum(exp(-((y - r - 1.5) ** 2 + (x - c - 1.5) ** 2) / 2.0) / (1 + exp(-logit))) / sum(exp(-((y - r - 1.5) ** 2 + (x - c - 1.5) ** 2) / 2.0)))::FLOAT::DOUBLE, 4) AS prob FROM t GROUP BY 1, 2, 3""")
def predict_change(spark, sf):
    """Tiles through a scorer and back: pad, tile, score, blend."""
    a = V.tiles(spark, sf).select("raster", "y", "x", F.col("v").alias("v_1"))
    b = a.select((F.col("raster") - 1).alias("raster"), "y", "x", F.col("v_1").alias("v_2"))
    out = tiling.predict_change(a.join(b, ["raster", "y", "x"]), ["v"], {"v": (0.0, 1.0 - 1e-8)}, 8, 8, tiling.index_scorer([4.0]), ["raster"], 4, 2)
    return out.select("raster", "y", "x", F.round(F.col("prob").cast("double"), 4).alias("prob"))

"""Files, whole runs, the command line, and the registered queries against their SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.operators import spatial
from terradelta.plans import cli, pipeline
from terradelta.plans import queries as Q
from terradelta.schema import PipelineError
from terradelta.sources import geotiff, vector

SF = "/root/testdata/sf0.001"
HEADER = {"epsg": 32632, "x0": 297000.0, "y0": 6690640.0, "res_x": 10.0, "res_y": -10.0}


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16, np.float32])
def test_geotiff_round_trip(compress, dtype):
    a = np.random.default_rng(1).integers(0, 200, (3, 70, 41)).astype(dtype)
    head, b = geotiff.decode(geotiff.encode(a, HEADER | {"nodata": 255}, compress))
    assert np.array_equal(a, b) and head["nodata"] == 255 and all(head[k] == v for k, v in HEADER.items())
    with pytest.raises(ValueError):
        geotiff.decode(b"not a file at all")


def test_geotiff_through_spark(spark, tmp_path):
    a = np.arange(600, dtype=np.float32).reshape(1, 20, 30)
    a[0, 3, 4] = np.nan
    (tmp_path / "2018-06.tif").write_bytes(geotiff.encode(a, HEADER))
    rows = geotiff.geotiff_pixels(geotiff.read_geotiff(spark, str(tmp_path), chunk=8, glob="2018-*.tif")).collect()
    got = {(r.y, r.x): r["value"] for r in rows}
    assert len(got) == 600 and got[3, 4] is None and all(v == a[0, y, x] for (y, x), v in got.items() if v is not None)
    whole = spark.createDataFrame([("p", 32632, 297000.0, 6690640.0, 10.0, -10.0, 2, 2, [[1.0, None, 3.0, 4.0]])], "raster string, epsg int, x0 double, y0 double, res_x double, res_y double, height int, width int, data array<array<float>>")
    path = geotiff.write_geotiff(whole, str(tmp_path / "out")).first().path
    head, v = geotiff.decode(open(path, "rb").read())
    assert head["epsg"] == 32632 and np.isnan(v[0, 0, 1]) and v[0, 1, 1] == 4


def test_catalogue_files(spark, tmp_path):
    item = {"id": "S2_T32VKM_a", "properties": {"datetime": "2024-06-01T10:50:21Z", "eo:cloud_cover": 3}, "geometry": {"type": "Polygon"}, "assets": {"B02": {"href": "x", "other": 1}}}
    (tmp_path / "a.json").write_text(json.dumps(item, indent=1))
    r = vector.read_catalogue(spark, str(tmp_path)).first()
    assert (r.cloud_cover, r.tile_id, r.assets["B02"], r.datetime.hour) == (3.0, "T32VKM", "x", 10)


def test_footprints(spark, tmp_path):
    spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0)], "id long, xmin double, ymin double, xmax double, ymax double").write.parquet(str(tmp_path / "b"))
    assert [r.id for r in vector.read_footprints(spark, str(tmp_path / "b"), (0.5, 0.5, 2.0, 2.0)).collect()] == [1]


def test_polygon_clipping():
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
    assert spatial.area_in_box([square], (1, 1, 10, 10)) == 9
    assert spatial.area_in_box([square, hole], (0, 0, 2, 2)) == 3
    assert spatial.area_in_box([[[0.0, 0.0], [4.0, 0.0], [0.0, 4.0], [0.0, 0.0]]], (0, 0, 2, 2)) == 4
    assert spatial.area_in_box([square], (5, 5, 6, 6)) == 0
    assert vector.wkb_rings(vector.polygon_wkb([square, hole])) == [square, hole]


def test_change_type_cases(spark):
    change = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 40.0), (2, 200.0, 0.0, 300.0, 30.0), (3, 500.0, 0.0, 500.0, 9.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    houses = spark.createDataFrame([(1, 0.0, 0.0, 37.5, 40.0), (2, 200.0, 0.0, 230.0, 30.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    out = {r.id: r.change_type for r in spatial.change_type(spatial.building_overlap(change, houses, "id", 25.0)).collect()}
    assert out == {1: "new_building", 2: "new_building", 3: "other"}
    assert {r.change_type for r in spatial.change_type(spatial.building_overlap(change, houses, "id", 25.0), 0.5).collect()} == {"new_paving", "other"}
    assert {r.change_type for r in spatial.change_type(spatial.building_overlap(change, houses.limit(0), "id", 25.0), any_buildings=False).collect()} == {"new_paving"}


def observations(spark, months, size=16):
    """Scenes where a block loses its green in the last month."""
    rows, scenes = [], []
    for m in months:
        for s in range(3):
            name = f"{m}-{s}"
            scenes.append((name, f"{m}-0{s + 3} 10:00:00", 10.0 * s))
            for y in range(size):
                for x in range(size):
                    built = m == months[-1] and 4 <= y < 12 and 4 <= x < 12
                    red, nir, swir = (0.3, 0.2, 0.5) if built else (0.05, 0.5, 0.2)
                    rows.append((name, y, x, 4 if (x + y + s) % 7 else 9, 0.1, 0.1, red, nir, swir, 0.1))
    obs = spark.createDataFrame(rows, "scene_id string, y int, x int, scl int, B02 double, B03 double, B04 double, B08 double, B11 double, B12 double")
    return obs, spark.createDataFrame(scenes, "scene_id string, datetime string, cloud_cover double").withColumn("datetime", F.to_timestamp("datetime"))


def test_pipeline_end_to_end(spark, tmp_path):
    obs, scenes = observations(spark, ["2018-06", "2018-07", "2018-08"])
    scorer = lambda a, b: 10 * ((b - a)[:, 7] - (b - a)[:, 6]) - 5
    houses = spark.createDataFrame([(1, 297040.0, 6690520.0, 297120.0, 6690600.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    path = pipeline.run_pipeline(spark, "bergen", "2018-06", "2018-08", obs, scenes, str(tmp_path), height=16, width=16, header=HEADER, tile=8, overlap=2, scorer=scorer, buildings=houses)
    found = vector.read_geojson(str(path))
    assert [f["properties"]["detection_period"] for f in found] == ["2018-07/2018-08"]
    f = found[0]["properties"]
    assert f["area_m2"] == 6000.0 and f["confidence"] > 0.9 and f["change_type"] == "new_building"
    rows = vector.read_geopackage(str(path.with_suffix(".gpkg")))
    assert len(rows) == 1 and rows[0]["rings"] == found[0]["geometry"]["coordinates"] and rows[0]["detection_period"] == "2018-07/2018-08"
    prob, _, polygons = pipeline.detect(pipeline.month_pairs(pipeline.monthly_composites(obs, scenes, "2018-06", "2018-08")), 16, 16, scorer=scorer, tile=8, overlap=2)
    truth = spark.range(256).selectExpr("cast(id div 16 as int) as y", "cast(id % 16 as int) as x").withColumn("gt", (F.col("y").between(4, 11) & F.col("x").between(4, 11)).cast("int"))
    best = {r.detection_period: r.pixel_f1 for r in pipeline.validation_report(prob, truth, 16, 16)[1].collect()}
    assert best["2018-07/2018-08"] == 1.0 and polygons.count() == 1


def test_pipeline_errors(spark, tmp_path):
    obs, scenes = observations(spark, ["2018-06"], 4)
    more = {"height": 4, "width": 4, "header": HEADER}
    for area, start in (("nowhere", "2018-06"), ("bergen", "2018-06"), ("bergen", "2020-01")):
        with pytest.raises(PipelineError):
            pipeline.run_pipeline(spark, area, start, start, obs, scenes, str(tmp_path), **more)


def test_acquire_and_years(spark):
    obs, scenes = observations(spark, ["2018-06", "2021-06"], 8)
    scenes = scenes.withColumn("city", F.lit("oslo")).withColumn("tile_id", F.lit("T32VNM"))
    out = pipeline.acquire(scenes, obs, {"oslo": "T32VNM"}, 2021, [6], k=2)
    assert out.count() == 64 and {r.n_scenes for r in out.collect()} == {2}
    every = pipeline.monthly_composites(obs, scenes, "2018-06", "2021-06")
    prob, _, _ = pipeline.infer_years(every, "2018", "2021", 8, 8, tile=8, overlap=2)
    assert {r.detection_period for r in prob.collect()} == {"2018-06_to_2021-06"}
    density = spark.range(128).selectExpr("'oslo' as city", "case when id < 64 then '2018' else '2021' end as year", "cast((id % 64) div 8 as int) as y", "cast(id % 8 as int) as x", "cast(case when id >= 64 and id % 8 > 3 then 50 else 5 end as float) as density")
    patch = pipeline.label_patches(every.withColumn("city", F.lit("oslo")), density, "2018", "2021", 8, 8, 4, 4)
    assert sorted(sum(r.label) for r in patch.collect()) == [0, 0, 16, 16]


def test_command_line(spark, tmp_path):
    obs, scenes = observations(spark, ["2018-06", "2018-07"], 8)
    obs.write.parquet(str(tmp_path / "obs"))
    scenes.write.parquet(str(tmp_path / "scenes"))
    args = ["--aoi", "bergen", "--observations", str(tmp_path / "obs"), "--scenes", str(tmp_path / "scenes"), "--grid", json.dumps(HEADER | {"height": 8, "width": 8}), "--output", str(tmp_path / "out")]
    assert cli.main([*args, "--start", "2018-06", "--end", "2018-07"]) == 0
    assert cli.main([*args, "--start", "2019-06", "--end", "2019-07"]) == 1


def _rows(df):
    import pandas as pd

    df = df[sorted(df.columns)]
    show = lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(float(v)) if isinstance(v, (float, np.floating)) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_against_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_queries_without_sql(spark):
    for name in sorted(set(Q.QUERIES) - set(Q.SQL)):
        assert Q.QUERIES[name](spark, SF).count() > 0

"""Hand-computed cases of the raster operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.functions import projection
from terradelta.functions import raster as R
from terradelta.operators import catalog, composite, grid, patches, spatial, tiling, train, validate, vectorize

F32 = "cast({} as float)"


def grid_of(spark, values, name="prob", kind="float"):
    rows = [(int(y), int(x), None if v is None or (isinstance(v, float) and math.isnan(v)) else v) for y, row in enumerate(values) for x, v in enumerate(row)]
    return spark.createDataFrame([("a", *r) for r in rows], f"k string, y int, x int, {name} {kind}")


def to_array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = np.nan if r[name] is None else r[name]
    return out


def test_normalized_difference(spark):
    pairs = [(0.8, 0.2, 0.6), (0.6, 0.4, 0.2), (0.0, 0.0, 0.0), (1.0, 0.0, 1.0), (0.0, 1.0, -1.0), (None, 1.0, None), (1.0, None, None)]
    df = spark.createDataFrame(pairs, "a double, b double, want double")
    for r in df.select(R.normalized_difference(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert r.got is None if r.want is None else abs(r.got - r.want) < 1e-6


def test_cloud_mask(spark):
    df = spark.createDataFrame([(i,) for i in range(12)], "scl int")
    assert {r.scl for r in df.filter(~R.is_clear(F.col("scl"))).collect()} == {3, 7, 8, 9, 10}


def test_median_composite(spark):
    rows = [("s1", 0, 0, 4, 100.0), ("s2", 0, 0, 4, 200.0), ("s3", 0, 0, 4, 300.0), ("s1", 0, 1, 4, 100.0), ("s2", 0, 1, 4, 200.0), ("s3", 0, 1, 9, 999.0), ("s1", 0, 2, 3, 5.0)]
    df = spark.createDataFrame(rows, "scene string, y int, x int, scl int, B08 double")
    got = {r.x: r for r in composite.median_composite(df, ["B08"], ["y", "x"]).collect()}
    assert (got[0].B08, got[1].B08, got[2].B08) == (200.0, 150.0, None)
    assert [got[i].clear_obs_count for i in range(3)] == [3, 2, 0]
    assert all(r.reliable and r.n_scenes == 3 for r in got.values())  # the month's scenes, also where one does not reach


def test_scenes_of_a_month_count_everywhere(spark):
    rows = [(m, s, 0, x, 4, 1.0) for m, scenes in (("a", 3), ("b", 2), (None, 1)) for s in range(scenes) for x in range(4) if s == 0 or x == s]
    df = spark.createDataFrame(rows, "year_month string, scene int, y int, x int, scl int, B08 double")
    got = composite.median_composite(df, ["B08"], ["year_month", "y", "x"]).collect()
    assert len(got) == 12 and {(r.year_month, r.n_scenes, r.reliable) for r in got} == {("a", 3, True), ("b", 2, False), (None, 1, False)}


def test_labels(spark):
    a, b = grid_of(spark, [[0.0, 50.0], [80.0, 30.0]], "density"), grid_of(spark, [[50.0, 20.0], [80.0, 45.0]], "density")
    assert to_array(patches.change_labels(a, b, ["k"]), "label", (2, 2)).tolist() == [[1, 0], [0, 1]]
    exact, missing = grid_of(spark, [[10.0, None]], "density"), grid_of(spark, [[20.0, 90.0]], "density")
    assert to_array(patches.change_labels(exact, missing, ["k"]), "label", (1, 2)).tolist() == [[1, 0]]


@pytest.mark.parametrize(("size", "tile", "overlap", "pad", "tiles"), [(1000, 256, 64, 24, 5), (200, 64, 16, 8, 4), (100, 64, 16, 12, 2), (128, 64, 32, 0, 3), (32, 256, 64, 224, 1), (300, 128, 64, 20, 4)])
def test_tiling(size, tile, overlap, pad, tiles):
    stride = tiling.check_overlap(tile, overlap)
    assert tiling.required_pad(size, tile, stride) == pad
    assert len(tiling.tile_starts(size + pad, tile, stride)) == tiles


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        tiling.check_overlap(64, 64)


def test_reflection_is_numpys(spark):
    df = grid_of(spark, np.arange(12.0).reshape(3, 4).tolist(), "v", "double")
    got = to_array(tiling.pad_reflect(df, ["k"], 3, 4, 6, 4), "v", (6, 6))
    assert np.array_equal(got, np.pad(np.arange(12.0).reshape(3, 4), ((0, 3), (0, 2)), mode="reflect"))


def stencil(a, passes):
    for p in passes:
        q = np.pad(a, 1)
        five = [q[1:-1, 1:-1], q[:-2, 1:-1], q[2:, 1:-1], q[1:-1, :-2], q[1:-1, 2:]]
        a = np.logical_or.reduce(five) if p == "dilate" else np.logical_and.reduce(five)
    return a


@pytest.mark.parametrize("size", [256, 7])
def test_morphology_over_chunks(spark, size):
    a = np.random.default_rng(1).random((23, 31)) > 0.3
    df = grid_of(spark, a.tolist(), "on", "boolean")
    for passes in (grid.OPEN, grid.CLOSE, grid.OPEN + grid.CLOSE):
        assert np.array_equal(to_array(grid.morphology(df, ["k"], passes, size=size), "on", a.shape) == 1, stencil(a, passes))


def flood(a, width):
    out = np.full(a.shape, -1, np.int64)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            if a[y, x] and out[y, x] < 0:
                todo, out[y, x] = [(y, x)], y * width + x
                while todo:
                    i, j = todo.pop()
                    for u, v in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                        if 0 <= u < a.shape[0] and 0 <= v < a.shape[1] and a[u, v] and out[u, v] < 0:
                            out[u, v] = out[y, x]
                            todo.append((u, v))
    return out


@pytest.mark.parametrize("size", [256, 5])
def test_components_over_chunks(spark, size):
    a = np.random.default_rng(2).random((18, 22)) > 0.42
    got = grid.connected_components(grid_of(spark, a.tolist(), "on", "boolean"), ["k"], 22, size=size)
    assert np.array_equal(np.nan_to_num(to_array(got, "component", a.shape), nan=-1), flood(a, 22))


def polygons(spark, prob, min_area=200.0):
    h, w = prob.shape
    members = vectorize.change_members(grid_of(spark, prob.tolist()), ["k"], w, height=h)
    return members, vectorize.change_polygons(members, ["k"], 100.0, min_area)


@pytest.mark.parametrize(
    ("boxes", "areas"),
    [([(10, 10, 10, 10)], [9600]), ([(5, 5, 1, 1)], []), ([(0, 0, 50, 50)], [230400]), ([(10, 10, 10, 10), (40, 40, 1, 1)], [9600]), ([(5, 5, 6, 6), (30, 30, 6, 6)], [3200, 3200]), ([(8, 8, 3, 3)], [500])],
)
def test_polygons(spark, boxes, areas):
    prob = np.full((50, 50), 0.1, np.float32)
    for y, x, h, w in boxes:
        prob[y : y + h, x : x + w] = 0.9
    members, out = polygons(spark, prob)
    assert sorted(r.area_m2 for r in out.collect()) == areas
    header = {"x0": 1000.0, "y0": 5000.0, "res_x": 10.0, "res_y": -10.0}
    for r in vectorize.polygon_rings(members, ["k"], header).collect():
        assert all(ring[0] == ring[-1] for ring in r.rings)


def test_hole_is_filled_and_small_areas_go(spark):
    prob = np.full((50, 50), 0.1, np.float32)
    prob[10:30, 10:30] = 0.9
    prob[20, 20] = 0.1
    assert [r.area_m2 for r in polygons(spark, prob)[1].collect()] == [39600]
    prob[:] = 0.1
    prob[8:11, 8:11] = 0.5
    assert [polygons(spark, prob, m)[1].count() for m in (1000.0, 100.0)] == [0, 1]


def test_rings_with_hole_and_touching_corners():
    ring = [(y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    found = vectorize.rings(vectorize.cell_sides(ring))
    assert [abs(vectorize._area(r)) for r in found] == [9, 1]
    assert sorted(abs(vectorize._area(r)) for r in vectorize.rings(vectorize.cell_sides([(0, 0), (1, 1)]))) == [1, 1]


def test_pixel_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.3), (0, 0.7), (0, 0.1)], "gt int, prob float")
    r = validate.pixel_metrics(df, 0.5).first()
    assert (r.pixel_precision, r.pixel_recall, r.pixel_f1) == (0.5, 0.5, 0.5)
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 0, 0], [0.9, 0.8, 0.6, 0.4, 0.2, 0.1], strict=True)), "gt int, prob float")
    rows = validate.threshold_sweep(df, [0.3, 0.5, 0.75]).orderBy("ord").collect()
    assert [round(r.pixel_precision, 6) for r in rows] == [0.5, 0.666667, 1.0]
    assert validate.best_threshold(validate.threshold_sweep(df, [0.3, 0.5, 0.75])).first().threshold == 0.75
    assert validate.threshold_sweep(df, []).count() == 0
    assert validate.pixel_metrics(spark.createDataFrame([(1, 0.7)], "gt int, prob float"), 0.7).first().tp == 1


def test_latency(spark):
    rows = [("a", "2020-01", 0.1), ("a", "2020-02", 0.2), ("a", "2020-03", 0.9), ("b", "2019-12", 0.9), ("b", "2020-01", 0.5), ("c", "2020-05", 0.4), ("d", "2021-06", 0.8)]
    df = spark.createDataFrame(rows, "area string, year_month string, prob float")
    got = {r.area: (r.detection_month, r.latency_months) for r in validate.detection_latency(df, "2020-01", 0.5, ["area"]).collect()}
    assert got == {"a": ("2020-03", 2), "b": ("2020-01", 0), "c": (None, None), "d": ("2021-06", 17)}


def test_greedy_matching(spark):
    pairs = [("x", 1, 1, 0.9), ("x", 1, 2, 0.5), ("x", 2, 1, 0.8), ("x", 2, 3, 0.4), ("x", 3, 4, 0.3), ("x", 4, 5, 0.3000001)]
    df = spark.createDataFrame(pairs, "k string, p long, t long, iou double")
    got = {(r.pred, r.truth) for r in validate.greedy_matches(df, ["k"], "p", "t").collect()}
    assert got == {(1, 1), (2, 3), (4, 5)}
    preds, truths = (spark.createDataFrame([("x", i) for i in range(n)], "k string, i int") for n in (4, 8))
    m = validate.polygon_metrics(validate.greedy_matches(df, ["k"], "p", "t"), preds, truths, ["k"]).first()
    assert (m.polygon_precision, m.polygon_recall, m.n_pred_polygons, m.n_gt_polygons) == (0.75, 0.375, 4, 8)
    empty = validate.polygon_metrics(validate.greedy_matches(df.limit(0), ["k"], "p", "t"), preds, truths.limit(0), ["k"]).first()
    assert (empty.polygon_f1, empty.mean_iou, empty.n_pred_polygons, empty.n_gt_polygons) == (0.0, 0.0, 4, 0)


def boxes_with_copies(spark, n, n_boxes, seed):
    """Ids in no order over few boxes; some ids have several boxes, some boxes no side, sizes are such that overlaps tie."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), "k", *map(float, (x, y, x + w, y + 2))) for i, (x, y, w) in zip(rng.permutation(n), rng.integers([0, 0, 1], [8, 5, 5], (n_boxes, 3))[rng.integers(0, n_boxes, n)], strict=True)]
    rows += [(0, "k", 3.0, 1.0, 6.0, 3.0), (0, "k", 3.0, 1.0, 6.0, 3.0), (n, "k", None, 1.0, 6.0, 3.0), (n, "k", 4.0, 1.0, 4.0, 3.0)]
    return rows, spark.createDataFrame(rows, "id long, k string, xmin double, ymin double, xmax double, ymax double")


def all_pairs(preds, truths):
    for p in preds:
        for t in truths:
            if None not in p + t:
                common = max(min(p[4], t[4]) - max(p[2], t[2]), 0) * max(min(p[5], t[5]) - max(p[3], t[3]), 0)
                if common > 0:
                    yield p[0], t[0], common / ((p[4] - p[2]) * (p[5] - p[3]) + (t[4] - t[2]) * (t[5] - t[3]) - common)


@pytest.mark.parametrize("class_rows", [1000, 2])
def test_equal_boxes_are_compared_once(spark, monkeypatch, class_rows):
    monkeypatch.setattr(spatial, "CLASS_ROWS", class_rows)
    (preds, a), (truths, b) = boxes_with_copies(spark, 40, 6, 1), boxes_with_copies(spark, 60, 9, 2)
    got = [(r.a_id, r.b_id, r.iou) for r in spatial.iou_pairs(a, b, 2.0, ["k"]).collect()]
    assert sorted(got) == sorted(all_pairs(preds, truths))
    assert spatial.iou_pairs(a, b, 2.0, ["k"]).columns == ["k", "a_id", "a_xmin", "a_ymin", "a_xmax", "a_ymax", "b_id", "b_xmin", "b_ymin", "b_xmax", "b_ymax", "common", "iou"]
    classes = [spatial.box_classes(df, ["k"], p) for df, p in ((a, "a"), (b, "b"))]
    if class_rows == 1000:
        assert spatial.iou_classes(*classes, 2.0, ["k"]).count() <= 8 * 11 < len(got) / 4
    else:
        assert max(len(r.rows) for c in classes for r in c.collect()) < 20
    assert spatial.iou_pairs(a.limit(0), b, 2.0, ["k"]).count() == 0


@pytest.mark.parametrize("seed", [3, 5])
def test_greedy_matching_by_classes(spark, seed):
    (preds, a), (truths, b) = boxes_with_copies(spark, 50, 7, seed), boxes_with_copies(spark, 40, 8, seed + 1)
    by = {}
    for p, t, iou in all_pairs(preds, truths):
        by.setdefault(p, []).append((-iou, t))
    want, taken = set(), set()
    for p in sorted(by, key=lambda p: (-min(by[p])[0], p), reverse=True):
        free = [x for x in sorted(by[p]) if x[1] not in taken]
        if free and -free[0][0] > 0.3:
            taken.add(free[0][1])
            want.add((p, free[0][1], -free[0][0]))
    classes = [spatial.box_classes(df, ["k"], p) for df, p in ((a, "a"), (b, "b"))]
    pairs = spatial.iou_classes(*classes, 2.0, ["k"])
    assert {(r.pred, r.truth, r.iou) for r in validate.greedy_class_matches(pairs, *classes, ["k"], "id").collect()} == want and want
    pairs = spatial.iou_pairs(a, b, 2.0, ["k"])
    assert {(r.pred, r.truth, r.iou) for r in validate.greedy_matches(pairs, ["k"], "a_id", "b_id").collect()} == want


def test_metrics_table(spark):
    df = spark.createDataFrame([("run", 0.5, 3)], "name string, f1 double, n long")
    assert validate.metrics_table(df, "name", ["f1", "n"]).splitlines()[-1] == "| run | 0.5000 | 3 |"
    assert len(validate.metrics_table(df.limit(0), "name", ["f1", "n"]).splitlines()) == 2


def test_metrics_are_rounded_as_c_rounds_them(spark):
    """0.64325 is less than its decimal, 0.03125 a true half; a formatter that rounds the shortest decimal gives 0.6433, 0.0313."""
    values = [0.64325, 0.03125, 0.09375, 0.12345, 0.99995, 0.00005, 0.0, 1.0, 7.00015, 12345678.03125, -0.64325, -0.00001, 2.0**52 + 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "name long, f1 double")
    got = {r.name: r.line for r in validate.metrics_lines(df, "name", ["f1"]).collect()}
    assert [got[i] for i in range(len(values))] == [f"| {i} | {v:.4f} |" for i, v in enumerate(values)]
    every = spark.range(0, 1000001, 50).withColumn("v", F.col("id") / 1000000.0).select("id", validate.four_decimals(F.col("v")).alias("s"))
    assert [(r.id, r.s) for r in every.collect() if r.s != f"{r.id / 1e6:.4f}"] == []


def test_splits(spark):
    df = spark.createDataFrame([(c,) for c in ("bergen", "oslo", "dublin", "houston", "dublin")], "city string")
    assert [patches.in_split(df, s).count() for s in ("train", "val", "test", None)] == [2, 2, 1, 5]
    with pytest.raises(ValueError):
        patches.in_split(df, "other")
    assert train.training_splits(df.limit(0), df, df)[0].count() == 5


def test_augmentation_is_one_of_eight(spark):
    a = np.arange(16.0).reshape(4, 4)
    df = grid_of(spark, a.tolist(), "v", "double")
    want = [np.rot90(f, k) for f in (a, a[:, ::-1], a[::-1], a[::-1, ::-1]) for k in range(4)]
    for hflip, vflip, k in ((False, False, 1), (True, False, 0), (True, True, 3), (False, True, 2)):
        y, x = patches.turned(F.col("y"), F.col("x"), 4, F.lit(hflip), F.lit(vflip), F.lit(k))
        b = a[:, ::-1] if hflip else a
        b = b[::-1] if vflip else b
        got = to_array(df.select(y.alias("y"), x.alias("x"), "v"), "v", (4, 4))
        assert np.array_equal(got, np.rot90(b, k))
    for seed in range(3):
        got = to_array(patches.augment(df, ["k"], 4, seed), "v", (4, 4))
        assert any(np.array_equal(got, w) for w in want)


def test_patches(spark):
    rows = spark.range(64).selectExpr("'o' as city", "cast(id div 8 as int) as y", "cast(id % 8 as int) as x", "case when id % 8 >= 4 then null else cast(id as float) end as v_1", "cast(id as float) as v_2", "1 as label")
    assert patches.extract_patches(rows, ["city"], ["v"], 8, 8, 4, 4).count() == 2
    full = rows.fillna(0.0, ["v_1"])
    assert patches.extract_patches(full, ["city"], ["v"], 8, 8, 4, 2).count() == 9
    first = patches.extract_patches(full, ["city"], ["v"], 8, 8, 4, 4).filter("row_start = 4 AND col_start = 0").first()
    assert first.t2[:5] == [32.0, 33.0, 34.0, 35.0, 40.0] and len(first.label) == 16


def test_catalogue_items(spark):
    row = ("S2_T32VKM_x", '{"datetime":"2024-06-01T10:50:21Z","eo:cloud_cover":12.5}', None, {"B02": ("s3://a/b",)})
    df = spark.createDataFrame([row, ("plain", "{}", "{}", {})], catalog.STAC_ITEM)
    got = {r.scene_id: r for r in catalog.scenes_from_items(df).collect()}
    a = got["S2_T32VKM_x"]
    assert (a.cloud_cover, a.product_id, a.tile_id, a.assets) == (12.5, "S2_T32VKM_x", "T32VKM", {"B02": "s3://a/b"})
    assert got["plain"].cloud_cover == 0.0 and got["plain"].tile_id == ""


def test_windows_of_search():
    assert catalog.search_window("2018-06", "2019-02") == ("2018-06-01", "2019-02-28")
    assert catalog.search_window("2018-06", "2020-02", True) == ("2018-06-01", "2020-02-29")
    assert catalog.acquire_window(2018, 12) == ("2018-12-01", "2019-01-01")


def test_projections(spark):
    """Known points: UTM zone centre and a published LAEA example; round distances along a meridian."""
    df = spark.createDataFrame([(9.0, 0.0), (9.0, 60.0), (10.0, 52.0), (5.0, 50.0)], "lon double, lat double")
    x, y = projection.to_utm(F.col("lon"), F.col("lat"), 32632)
    u, v = projection.to_laea_europe(F.col("lon"), F.col("lat"))
    got = df.select(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")).collect()
    assert abs(got[0].x - 500000) < 1e-6 and abs(got[0].y) < 1e-6
    assert abs(got[1].y - 0.9996 * 6654072.819) < 0.01  # meridian arc to 60 degrees
    assert abs(got[2].u - 4321000) < 1e-6 and abs(got[2].v - 3210000) < 1e-6
    assert abs(got[3].u - 3962799.45) < 0.05 and abs(got[3].v - 2999718.85) < 0.05
    w, z = projection.to_albers_conus(F.lit(-96.0), F.lit(23.0))
    r = df.select(w.alias("w"), z.alias("z")).first()
    assert abs(r.w) < 1e-6 and abs(r.z) < 1e-6
    with pytest.raises(ValueError):
        projection.utm_zone(3035)


def test_resampling(spark):
    a = np.random.default_rng(3).random((6, 6)).astype(np.float32)
    df = grid_of(spark, a.tolist(), "value")
    at = grid_of(spark, [[0.0] * 6] * 6, "dummy").drop("dummy")
    for method in ("nearest", "bilinear", "cubic", "lanczos"):
        same = to_array(grid.resample(df, at, F.col("x").cast("double"), F.col("y").cast("double"), ["k"], method=method), "value", (6, 6))
        assert np.allclose(same, a, atol=1e-5)
    half = grid.resample(df, at.filter("y < 5 AND x < 5"), F.col("x") + 0.5, F.col("y") + 0.5, ["k"])
    assert np.allclose(to_array(half, "value", (5, 5)), (a[:-1, :-1] + a[1:, :-1] + a[:-1, 1:] + a[1:, 1:]) / 4, atol=1e-6)
    with pytest.raises(ValueError):
        grid.resample(df, at, F.col("x"), F.col("y"), ["k"], method="other")


def test_reproject_and_clip(spark):
    header = {"epsg": 32632, "x0": 500000.0, "y0": 6700000.0, "res_x": 10.0, "res_y": -10.0}
    df = grid_of(spark, [[1.0, 2.0], [3.0, None]], "value")
    assert grid.clip(df, header, 500000, 6699990, 500010, 6700000).count() == 1
    at = spark.createDataFrame([("a", 9.0001, 60.43)], "k string, lon double, lat double")
    x, y = projection.to_utm(F.col("lon"), F.col("lat"), 32632)
    r = at.select(x.alias("x"), y.alias("y")).first()
    near = dict(header, x0=r.x - 5.0, y0=r.y + 5.0)
    assert grid.reproject(df, near, at, F.col("lon"), F.col("lat"), ["k"]).first()["value"] == 1.0
    assert to_array(grid.nodata_to_null(grid_of(spark, [[255.0, 7.0]], "v"), "v", [255]), "v", (1, 2)).tolist()[0][1] == 7.0


def test_blend_of_constant_tiles(spark):
    pairs = spark.range(100).selectExpr("'p' as k", "cast(id div 10 as int) as y", "cast(id % 10 as int) as x", "cast(id as float) as v_1", "cast(1 as float) as v_2")
    zero = lambda a, b: np.zeros((len(a), *a.shape[2:]))
    got = to_array(tiling.predict_change(pairs, ["v"], {"v": (0.0, 1.0)}, 10, 10, zero, ["k"], 4, 2), "prob", (10, 10))
    assert np.allclose(got, 0.5)


def test_trained_scorer(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), int(b - a > 0.1)) for a, b in rng.random((2000, 2))]
    df = spark.createDataFrame(rows, "v_1 double, v_2 double, label int")
    model = train.train_scorer(df, ["v"], {"v": (0.0, 1.0)})
    hits = model.transform(train.features(df, ["v"], {"v": (0.0, 1.0)})).filter("prediction = label").count()
    assert hits > 1900
    assert train.tile_scorer(model)(np.zeros((1, 1, 2, 2)), np.ones((1, 1, 2, 2))).min() > 0


def test_checkpoints():
    assert train.best_epoch({"a": 0.1, "b": 0.3, "c": 0.2, "d": 0.05}, "z") == ["b", "c", "a", "z"]
    assert train.checkpoint_to_load(None, None, ["y", "x"]) == "x"
    with pytest.raises(RuntimeError):
        train.checkpoint_to_load(None, None, [])

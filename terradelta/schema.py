"""Constants that are part of the engine's semantics, and the schemas of its tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
MASKED_CLASSES = (3, 7, 8, 9, 10)
BANDS_10M = ("B02", "B03", "B04", "B08")
BANDS_20M = ("B11", "B12", "SCL")
SPECTRAL = ("B02", "B03", "B04", "B08", "B11", "B12")
INDICES = ("NDVI", "NDBI", "NDWI")
CHANNELS = SPECTRAL + INDICES
MIN_SCENES = 3
MAX_CLOUD, MAX_CLOUD_ACQUIRE = 50.0, 40.0
SCENES_PER_MONTH = 5
PROB_THRESHOLD, MIN_AREA_M2 = 0.5, 200.0
TILE, OVERLAP = 256, 64
LABEL_THRESHOLD = 10.0
PATCH, STRIDE, MAX_MISSING = 256, 128, 0.5
OVERLAP_THRESHOLD, IOU_THRESHOLD = 0.3, 0.3
EPSILON = 1e-8
SPLITS = {"train": ("bergen", "oslo", "amsterdam", "warsaw"), "val": ("dublin",), "test": ("houston",)}

AOI = T.StructType([T.StructField("name", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("west", "south", "east", "north")), T.StructField("epsg", T.IntegerType())])

SCENE = "scene_id string, datetime timestamp, cloud_cover double, product_id string, tile_id string, geometry string, assets map<string,string>"

#: A raster's grid: pixel centre is x0 + (x + 0.5) * res_x, y0 + (y + 0.5) * res_y; res_y is negative (north up).
GRID_HEADER = "raster string, epsg int, x0 double, y0 double, res_x double, res_y double, height int, width int"


class PipelineError(RuntimeError):
    """A run cannot go on: no scenes, or fewer than two months."""

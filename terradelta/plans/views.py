"""The generic tables read as the engine's own: observations, scenes, tiles, scores, boxes. Each view has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.raster import sigmoid
from ..operators.grid import pixels_of

BANDS = ["B03", "B04", "B08", "B11"]
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixel observations: the supplier is the pixel, the order the scene, the line number the class."""
    f = lambda c: F.expr(c).cast("float")
    return table(spark, sf_dir, "lineitem").select(
        F.expr("cast(l_suppkey div 10 as int)").alias("y"), F.expr("cast(l_suppkey % 10 as int)").alias("x"), F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("scl"),
        F.date_format("l_shipdate", "yyyy-MM").alias("year_month"), f("l_quantity").alias("B03"), f("l_discount * 100").alias("B04"), f("l_extendedprice / 1000").alias("B08"), f("l_tax * 100").alias("B11"),
    )


OBS_SQL = """obs AS (SELECT (l_suppkey // 10)::INT AS y, (l_suppkey % 10)::INT AS x, l_orderkey AS scene, l_linenumber AS scl, strftime(l_shipdate, '%Y-%m') AS year_month,
 l_quantity::FLOAT AS B03, (l_discount * 100)::FLOAT AS B04, (l_extendedprice / 1000)::FLOAT AS B08, (l_tax * 100)::FLOAT AS B11 FROM lineitem)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a scene catalogue; the cloud cover is a number in their JSON."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("scene_id"), F.col("ts").alias("datetime"), F.col("event_type").alias("tile_id"), F.get_json_object("props", "$.k").cast("double").alias("cloud_cover")
    )


SCENE_SQL = "scene AS (SELECT event_id AS scene_id, ts AS datetime, event_type AS tile_id, json_extract_string(props, '$.k')::DOUBLE AS cloud_cover FROM events)"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 values as rasters of 8 by 8 pixels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster"), "label", "embedding")
    return pixels_of(rows, "embedding", F.lit(SIDE), name="v").withColumn("prob", sigmoid(8 * F.col("v").cast("double")).cast("float"))


TILE_SQL = """tile AS (SELECT raster, label, (pos // 8)::INT AS y, (pos % 8)::INT AS x, v, (1.0::DOUBLE / (1 + exp(-8 * v::DOUBLE)))::FLOAT AS prob
 FROM (SELECT vec_id AS raster, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scores against a ground truth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 5000, F.lit(1.0)).cast("float").alias("prob"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "prob", F.col("quality").alias("gt"))


GT_SQL = "score AS (SELECT doc_id, least(n_chars / 5000, 1.0)::FLOAT AS prob, quality AS gt FROM labels JOIN documents USING (doc_id))"


def _boxes(rows: DataFrame, key: str, size: str) -> DataFrame:
    k = F.col(key)
    x, y = (k * 37 % 400).cast("double"), (k * 53 % 300).cast("double")
    s = F.expr(size).cast("double")
    return rows.select(k.alias("id"), x.alias("xmin"), y.alias("ymin"), (x + s).alias("xmax"), (y + s * 0.5).alias("ymax"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(table(spark, sf_dir, "part"), "p_partkey", "p_size")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(table(spark, sf_dir, "supplier"), "s_suppkey", "10 + s_suppkey % 30")


BOX_SQL = """building AS (SELECT id, x AS xmin, y AS ymin, x + s AS xmax, y + s * 0.5 AS ymax FROM (SELECT p_partkey AS id, (p_partkey * 37 % 400)::DOUBLE AS x, (p_partkey * 53 % 300)::DOUBLE AS y, p_size::DOUBLE AS s FROM part)),
change AS (SELECT id, x AS xmin, y AS ymin, x + s AS xmax, y + s * 0.5 AS ymax FROM (SELECT s_suppkey AS id, (s_suppkey * 37 % 400)::DOUBLE AS x, (s_suppkey * 53 % 300)::DOUBLE AS y, (10 + s_suppkey % 30)::DOUBLE AS s FROM supplier)),
pair AS (SELECT c.id AS change_id, b.id AS building_id, greatest(least(c.xmax, b.xmax) - greatest(c.xmin, b.xmin), 0) * greatest(least(c.ymax, b.ymax) - greatest(c.ymin, b.ymin), 0) AS common,
 (c.xmax - c.xmin) * (c.ymax - c.ymin) AS ca, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS ba FROM change c JOIN building b ON c.xmin < b.xmax AND b.xmin < c.xmax AND c.ymin < b.ymax AND b.ymin < c.ymax)"""

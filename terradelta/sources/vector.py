"""Vector and metadata files: catalogue items, footprints, WKB, GeoJSON, GeoPackage."""

from __future__ import annotations

import json
import sqlite3
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import STAC_ITEM, scenes_from_items
from ..operators.spatial import footprints_in


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue items, one JSON document each, as scenes."""
    return scenes_from_items(spark.read.schema(STAC_ITEM).option("multiLine", True).json(path))


def read_footprints(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Footprints (Parquet with ``xmin, ymin, xmax, ymax``), whole shapes that meet the box."""
    rows = spark.read.parquet(path)
    return footprints_in(rows, *bbox) if bbox else rows


def polygon_wkb(rings: list[list[list[float]]]) -> bytes:
    """A polygon as little-endian well-known binary."""
    out = struct.pack("<BII", 1, 3, len(rings))
    for ring in rings:
        out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p[:2]) for p in ring)
    return out


def wkb_rings(raw: bytes) -> list[list[list[float]]]:
    order = "<" if raw[0] == 1 else ">"
    kind, n = struct.unpack_from(order + "II", raw, 1)
    if kind != 3:
        raise ValueError("not a polygon")
    at, out = 9, []
    for _ in range(n):
        k = struct.unpack_from(order + "I", raw, at)[0]
        flat = struct.unpack_from(f"{order}{2 * k}d", raw, at + 4)
        out.append([list(flat[i : i + 2]) for i in range(0, 2 * k, 2)])
        at += 4 + 16 * k
    return out


def features(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Each polygon as a GeoJSON feature (``feature``)."""
    others = [c for c in polygons.columns if c != rings]
    shape = F.struct(F.lit("Polygon").alias("type"), F.col(rings).alias("coordinates"))
    return polygons.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*others).alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(polygons: DataFrame, path: str, epsg: int | None = None) -> None:
    """One file of all features, written line by line as they come from the cluster."""
    with Path(path).open("w") as out:
        crs = f'"crs": {{"type": "name", "properties": {{"name": "urn:ogc:def:crs:EPSG::{epsg}"}}}}, ' if epsg else ""
        out.write(f'{{"type": "FeatureCollection", {crs}"features": [')
        for i, row in enumerate(features(polygons).toLocalIterator()):
            out.write((",\n" if i else "\n") + row["feature"])
        out.write("\n]}\n")


def read_geojson(path: str) -> list[dict]:
    return json.loads(Path(path).read_text())["features"]


SQLITE_KINDS = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.BooleanType: "BOOLEAN"}


def write_geopackage(polygons: DataFrame, path: str, epsg: int, layer: str = "changes") -> None:
    """One GeoPackage (an SQLite file) with a polygon layer; rows stream from the cluster."""
    Path(path).unlink(missing_ok=True)
    fields = [f for f in polygons.schema.fields if f.name != "rings"]
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 0x47504B47")
        db.execute("PRAGMA user_version = 10300")
        db.executescript(
            """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));"""
        )
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", [("Undefined Cartesian", -1, "NONE", -1), ("Undefined geographic", 0, "NONE", 0), (f"EPSG {epsg}", epsg, "EPSG", epsg)])
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, last_change, srs_id) VALUES (?, 'features', ?, strftime('%Y-%m-%dT%H:%M:%fZ', 'now'), ?)", (layer, layer, epsg))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, epsg))
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB' + "".join(f', "{f.name}" {SQLITE_KINDS.get(type(f.dataType), "TEXT")}' for f in fields) + ")")
        head = b"GP" + struct.pack("<BBi", 0, 1, epsg)
        marks = ", ".join("?" * (len(fields) + 1))
        columns = ", ".join(["geom", *(f'"{f.name}"' for f in fields)])
        rows = ((head + polygon_wkb(r["rings"]), *(r[f.name] for f in fields)) for r in polygons.toLocalIterator())
        db.executemany(f'INSERT INTO "{layer}" ({columns}) VALUES ({marks})', rows)
    db.close()


def read_geopackage(path: str, layer: str = "changes") -> list[dict]:
    with sqlite3.connect(path) as db:
        db.row_factory = sqlite3.Row
        return [dict(r) | {"rings": wkb_rings(r["geom"][8:])} for r in db.execute(f'SELECT * FROM "{layer}"')]

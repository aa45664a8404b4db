"""GeoTIFF files: an own reader (classic and big files; strips or tiles; stored, deflate or LZW; predictors 1 to 3;
integers and floats) and writer (classic, deflate strips).

Files come through Spark's ``binaryFile`` reader, so that any store works; decoding runs in Arrow batches, one file at a
time in a task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the TIFF and GeoTIFF formats.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
PROJECTED_KEY, GEOGRAPHIC_KEY = 3072, 2048
KINDS = {1: "u", 2: "i", 3: "f"}


def lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first, one wider when the next code but one needs it."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, bits, have, last = [], 9, 0, 0, b""
    for byte in raw:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == 256:
            table, width, last = table[:258], 9, b""
            continue
        if code == 257:
            break
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("damaged LZW data")
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
        last = word
    return b"".join(out)


def decode(raw: bytes) -> tuple[dict, np.ndarray]:
    """Header (epsg, x0, y0, res_x, res_y, height, width, nodata) and values (bands, height, width)."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    version = struct.unpack_from(order + "H", raw, 2)[0] if order and len(raw) > 16 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    # classic files count and point by four bytes, big ones by eight
    word, head, per_entry = ("I", 4, 12) if version == 42 else ("Q", 8, 20)
    size_of = struct.calcsize(order + word)
    tags: dict[int, tuple] = {}
    at = struct.unpack_from(order + word, raw, head)[0]
    first = at + struct.calcsize(order + ("H" if version == 42 else "Q"))
    for k in range(struct.unpack_from(order + ("H" if version == 42 else "Q"), raw, at)[0]):
        begin = first + per_entry * k
        tag, kind, n = struct.unpack_from(order + "HH" + word, raw, begin)
        fmt = FIELD.get(kind)
        if fmt is None:
            continue
        full = f"{order}{n}s" if fmt == "s" else f"{order}{n * len(fmt)}{fmt[0]}"
        place = begin + 4 + size_of
        tags[tag] = struct.unpack_from(full, raw, place if struct.calcsize(full) <= size_of else struct.unpack_from(order + word, raw, place)[0])
    one = lambda t, d=None: tags[t][0] if t in tags else d
    width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    dtype = np.dtype(f"{order}{KINDS[one(SAMPLE_FORMAT, 1)]}{one(BITS, 8) // 8}")
    method = one(COMPRESSION, 1)
    predictor = one(PREDICTOR, 1)
    if method not in (1, 5, 8, 32946):
        raise ValueError(f"TIFF compression {method} is not supported")
    if predictor not in (1, 2, 3) or (predictor == 3 and dtype.kind != "f"):
        raise ValueError(f"TIFF predictor {predictor} is not supported")
    planar = one(PLANAR, 1) == 2
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
    across, down = -(-width // bw), -(-height // bh)
    out = np.empty((bands, height, width), dtype.newbyteorder("="))
    samples = 1 if planar else bands
    for i, (begin, size) in enumerate(zip(offsets, sizes, strict=True)):
        part = raw[begin : begin + size]
        part = part if method == 1 else lzw(part) if method == 5 else zlib.decompress(part)
        plane, k = divmod(i, across * down)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        if predictor == 3:  # differences of bytes, the highest bytes of a row's values first
            steps = np.frombuffer(part, np.uint8, rows * bw * samples * dtype.itemsize).reshape(rows, -1, samples)
            planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, bw * samples)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{dtype.itemsize}").reshape(rows, bw, samples)
        else:
            block = np.frombuffer(part, dtype, rows * bw * samples).reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        block = block[: height - y, : width - x].transpose(2, 0, 1)
        if planar:
            out[plane, y : y + bh, x : x + bw] = block[0]
        else:
            out[:, y : y + bh, x : x + bw] = block
    scale, tie, keys = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), tags.get(TIE_POINT, (0.0,) * 6), tags.get(GEO_KEYS, ())
    codes = {keys[j]: keys[j + 3] for j in range(4, len(keys) - 3, 4) if keys[j + 1] == 0}
    missing = tags[NODATA][0].split(b"\0")[0].decode().strip() if NODATA in tags else ""
    return {
        "epsg": codes.get(PROJECTED_KEY, codes.get(GEOGRAPHIC_KEY)), "x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1],
        "res_x": scale[0], "res_y": -scale[1], "height": height, "width": width, "nodata": float(missing) if missing else None,
    }, out


def encode(values: np.ndarray, header: dict, compress: bool = True, rows_per_strip: int = 64) -> bytes:
    """A file of bands one after another, in strips."""
    bands, height, width = values.shape
    values = values.astype(values.dtype.newbyteorder("<"))
    strips = [values[b, y : y + rows_per_strip].tobytes() for b in range(bands) for y in range(0, height, rows_per_strip)]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    epsg = header.get("epsg") or 0
    geographic = epsg == 4326
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, epsg]
    entries: list[tuple[int, int, str, list]] = [
        (WIDTH, 4, "I", [width]), (HEIGHT, 4, "I", [height]), (BITS, 3, "H", [values.dtype.itemsize * 8] * bands), (COMPRESSION, 3, "H", [8 if compress else 1]), (PHOTOMETRIC, 3, "H", [1]),
        (STRIP_OFFSETS, 4, "I", [0] * len(strips)), (SAMPLES, 3, "H", [bands]), (ROWS_PER_STRIP, 4, "I", [rows_per_strip]), (STRIP_SIZES, 4, "I", [len(s) for s in strips]), (PLANAR, 3, "H", [2]),
        (SAMPLE_FORMAT, 3, "H", [{v: k for k, v in KINDS.items()}[values.dtype.kind]] * bands), (PIXEL_SCALE, 12, "d", [header["res_x"], -header["res_y"], 0.0]),
        (TIE_POINT, 12, "d", [0.0, 0.0, 0.0, header["x0"], header["y0"], 0.0]), (GEO_KEYS, 3, "H", keys),
    ]
    if header.get("nodata") is not None:
        text = f"{header['nodata']:g}".encode() + b"\0"
        entries.append((NODATA, 2, "s", [text]))
    size = lambda e: len(e[3][0]) if e[2] == "s" else struct.calcsize(f"<{len(e[3])}{e[2]}")
    spill = 8 + 2 + 12 * len(entries) + 4
    data = spill + sum(size(e) + size(e) % 2 for e in entries if size(e) > 4)
    offsets, at = [], data
    for s in strips:
        offsets.append(at)
        at += len(s)
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for tag, kind, fmt, v in sorted(entries):
        v = offsets if tag == STRIP_OFFSETS else v
        body = v[0] if fmt == "s" else struct.pack(f"<{len(v)}{fmt}", *v)
        n = len(body) if fmt == "s" else len(v)
        if len(body) <= 4:
            head += struct.pack("<HHI4s", tag, kind, n, body.ljust(4, b"\0"))
        else:
            head += struct.pack("<HHII", tag, kind, n, spill + len(tail))
            tail += body + b"\0" * (len(body) % 2)
    return head + b"\0" * 4 + tail + b"".join(strips)


CHUNKS = "path string, epsg int, x0 double, y0 double, res_x double, res_y double, height int, width int, band int, y0_px int, x0_px int, h int, w int, data array<float>"


#: What a damaged or unknown file raises.
UNREADABLE = (ValueError, KeyError, IndexError, OverflowError, struct.error, zlib.error)


def _scan(spark: SparkSession, paths: str | list[str], chunk: int, glob: str | None, skip: bool) -> DataFrame:
    """CHUNKS and ``error``: one row without values for a file that cannot be read, if such files are to be skipped."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths).select("path", "content")
    names = [f.split()[0] for f in CHUNKS.split(", ")] + ["error"]
    kinds = [pa.string(), pa.int32(), *[pa.float64()] * 4, *[pa.int32()] * 7, pa.list_(pa.float32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    head, values = decode(raw.as_py())
                except UNREADABLE as e:
                    if not skip:
                        raise
                    yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.nulls(1, k) for k in kinds[1:-1]), pa.array([f"{type(e).__name__}: {e}"])], names)
                    continue
                missing = head.pop("nodata")
                for b in range(values.shape[0]):
                    for y in range(0, head["height"], chunk):
                        for x in range(0, head["width"], chunk):
                            v = values[b, y : y + chunk, x : x + chunk].astype(np.float32)
                            flat = v.ravel()
                            gone = np.isnan(flat) | (flat == np.float32(missing) if missing is not None else False)
                            whole = [path, *(head[k] for k in ("epsg", "x0", "y0", "res_x", "res_y", "height", "width")), b + 1, y, x, *v.shape]
                            data = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, pa.float32(), mask=gone))
                            yield pa.RecordBatch.from_arrays([*(pa.array([w], k) for w, k in zip(whole, kinds, strict=False)), data, pa.nulls(1, pa.string())], names)

    return files.mapInArrow(run, f"{CHUNKS}, error string")


def read_geotiff(spark: SparkSession, paths: str | list[str], chunk: int = 256, glob: str | None = None, on_error: str = "raise") -> DataFrame:
    """Chunks of all bands of all files: header, place and values; no-data and NaN are NULL. With ``on_error="skip"`` a
    file that cannot be read has no chunks and does not stop the others; ``geotiff_rejects`` names it."""
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error is 'raise' or 'skip'")
    return _scan(spark, paths, chunk, glob, on_error == "skip").filter("error IS NULL").drop("error")


def geotiff_rejects(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """``path``, ``error`` of the files that cannot be read; Spark's reader leaves out files of no bytes."""
    return _scan(spark, paths, 1 << 20, glob, True).filter("error IS NOT NULL").select("path", "error")


def geotiff_pixels(chunks: DataFrame) -> DataFrame:
    """Chunks to pixels: ``path``, ``band``, ``y``, ``x``, ``value``."""
    from pyspark.sql import functions as F

    from ..operators.grid import pixels_of

    return pixels_of(chunks.select("path", "band", "y0_px", "x0_px", "w", "data"), "data", F.col("w"), F.col("y0_px"), F.col("x0_px")).select("path", "band", "y", "x", "value")


def write_geotiff(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes one file for each ``raster`` of a table of whole rasters (``raster``, header columns, ``data``: list of
    bands), in tasks, to a folder in any store that all executors share; gives the paths. Missing values are written as
    NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(folder)
        store.create_dir(base)
        for batch in batches:
            rows = batch.drop_columns(["data"]).to_pylist()
            for r, bands in zip(rows, batch.column(batch.schema.get_field_index("data")), strict=True):
                flat = bands.values.flatten().to_numpy(zero_copy_only=False).astype(np.float32)  # nulls: NaN
                path = f"{base}/{r['raster']}.tif"
                with store.open_output_stream(path) as out:
                    out.write(encode(flat.reshape(len(bands.values), r["height"], r["width"]), r))
                yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return chunks.mapInArrow(run, "path string")

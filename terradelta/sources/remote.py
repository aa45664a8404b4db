"""Services that scenes and label maps come from: tokens, product lookup, downloads with retries, map exports.

All addresses are parameters. Requests are made in tasks where they are many (``download_assets``: one row is one file),
else by the driver. A token is fetched by the driver and goes to the tasks; user name and password never do.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.raster import nodes_path

# Fixed values of the services' protocols.
RETRYABLE = (429, 500, 502, 503, 504)
EXPIRY_BUFFER, DEFAULT_EXPIRY = 60.0, 300.0
MAX_EXPORT_PIXELS = 4000
CLIENT_ID = "cdse-public"

#: Bytes that are moved at once.
CHUNK = 1 << 20


class AuthenticationError(RuntimeError):
    """The token service refuses the user."""


class DownloadError(RuntimeError):
    """A file cannot be had."""


def credentials(user: str = "CDSE_USERNAME", password: str = "CDSE_PASSWORD", env_file: str | None = None) -> tuple[str, str]:
    """User name and password from the environment, or from a file of NAME=value lines for what is unset there."""
    values = {}
    if env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as lines:
            pairs = (x.split("=", 1) for x in lines if "=" in x and not x.lstrip().startswith("#"))
            values = {k.strip(): v.strip().strip("\"'") for k, v in pairs}
    found = [(os.environ.get(name) or values.get(name) or "").strip() for name in (user, password)]
    for name, value in zip((user, password), found, strict=True):
        if not value:
            raise ValueError(f"{name} is not set")
    return found[0], found[1]


def _open(url: str, data: dict | None = None, token: str | None = None, timeout: float = 120):
    """The response; HTTP errors are responses too."""
    body = urllib.parse.urlencode(data).encode() if data is not None else None
    request = urllib.request.Request(url, body, {"Authorization": f"Bearer {token}"} if token else {})
    try:
        return urllib.request.urlopen(request, timeout=timeout)  # noqa: S310 - addresses are the caller's
    except urllib.error.HTTPError as e:
        return e


def _checked(response, url: str):
    if response.status >= 400:
        raise DownloadError(f"{url}: HTTP status {response.status}")
    return response


@dataclass
class Tokens:
    """One token, fetched anew when less than EXPIRY_BUFFER seconds of it are left."""

    url: str
    user: str
    password: str = field(repr=False)
    client: str = CLIENT_ID
    clock: Callable[[], float] = time.monotonic
    _token: str | None = field(default=None, repr=False)
    _until: float = 0.0

    def get(self) -> str:
        if self._token is None or self.clock() >= self._until:
            with _open(self.url, {"client_id": self.client, "grant_type": "password", "username": self.user, "password": self.password}, timeout=30) as r:
                if r.status == 401:
                    raise AuthenticationError("the token service refuses user name or password")
                answer = json.load(_checked(r, self.url))
            self._token = answer["access_token"]
            self._until = self.clock() + answer.get("expires_in", DEFAULT_EXPIRY) - EXPIRY_BUFFER
        return self._token


def product_id(catalogue: str, name: str, token: str | None = None) -> str:
    """The id that a catalogue has for a product's name (``.SAFE`` is added where it is missing)."""
    name = name if name.endswith(".SAFE") else f"{name}.SAFE"
    url = f"{catalogue}Products?{urllib.parse.urlencode({'$filter': f'Name eq {chr(39)}{name}{chr(39)}'})}"
    with _open(url, token=token, timeout=30) as r:
        found = json.load(_checked(r, url)).get("value", [])
    if not found:
        raise DownloadError(f"no product {name}")
    return found[0]["Id"]


def download(url: str, write: Callable[[bytes], object], token: str | None = None, max_retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> int:
    """Hands a file on in chunks; returns its size. Busy services are asked again after what they say, else after 1, 2,
    4 ... seconds; other errors end it at once."""
    status = 0
    for attempt in range(max_retries + 1):
        with _open(url, token=token) as r:
            status = r.status
            if status == 200:
                size = 0
                while part := r.read(CHUNK):
                    write(part)
                    size += len(part)
                return size
            if status not in RETRYABLE:
                raise DownloadError(f"{url}: HTTP status {status}")
            wait = r.headers.get("Retry-After")
        if attempt < max_retries:
            sleep(float(wait) if wait else 2.0**attempt)
    raise DownloadError(f"{url}: HTTP status {status} after {max_retries} retries")


def with_product_ids(assets: DataFrame, catalogue: str, token: str | None = None) -> DataFrame:
    """Adds ``product_uuid`` to rows with ``product_id``: each product is looked up once, in tasks, and joined back;
    null, with ``lookup_error``, where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    rows.append((name, product_id(catalogue, name, token), None))
                except DownloadError as e:
                    rows.append((name, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3, ["product_id", "product_uuid", "lookup_error"])

    names = assets.select("product_id").filter("product_id IS NOT NULL").distinct()
    return assets.join(names.mapInArrow(run, "product_id string, product_uuid string, lookup_error string"), "product_id", "left")


def download_assets(assets: DataFrame, folder: str, root: str, token: str | None = None, max_retries: int = 5) -> DataFrame:
    """Fetches each row's file (``scene_id``, ``band``, ``href``, ``product_uuid``) to ``<folder>/<scene>/<band>`` in a
    store that all executors share. Per row: ``path`` and ``size``, or ``error``: a file that cannot be had does not
    stop the others."""
    rows = assets.select("scene_id", "band", nodes_path(F.col("href"), F.col("product_uuid"), root).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                path, size, error = f"{base}/{r['scene_id']}/{r['band']}", None, None
                try:
                    if not r["url"]:
                        raise DownloadError("no address")
                    store.create_dir(f"{base}/{r['scene_id']}")
                    # written beside its place and moved, so that a lost task leaves no half file there
                    with store.open_output_stream(f"{path}.part") as out:
                        size = download(r["url"], out.write, token, max_retries)
                    store.move(f"{path}.part", path)
                except (DownloadError, OSError) as e:
                    path, error = None, str(e)
                yield pa.RecordBatch.from_pylist([{"scene_id": r["scene_id"], "band": r["band"], "path": path, "size": size, "error": error}], pa.schema([("scene_id", pa.string()), ("band", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("error", pa.string())]))

    return rows.mapInArrow(run, "scene_id string, band string, path string, size long, error string")


def _pixels(box: tuple[float, float, float, float], resolution: float) -> tuple[int, int]:
    return int((box[2] - box[0]) / resolution), int((box[3] - box[1]) / resolution)


def export_image(service: str, box: tuple[float, float, float, float], epsg: int, write: Callable[[bytes], object], resolution: float = 10.0) -> int:
    """An image service's raster of a box (xmin, ymin, xmax, ymax in ``epsg``) as TIFF, of at most MAX_EXPORT_PIXELS a side."""
    width, height = (min(n, MAX_EXPORT_PIXELS) for n in _pixels(box, resolution))
    ask = {"bbox": ",".join(map(str, box)), "bboxSR": epsg, "imageSR": epsg, "size": f"{width},{height}", "format": "tiff", "pixelType": "U8", "noData": 255, "interpolation": "+RSP_NearestNeighbor", "f": "json"}
    url = f"{service}?{urllib.parse.urlencode(ask)}"
    with _open(url, timeout=60) as r:
        answer = json.load(_checked(r, url))
    if "href" not in answer:
        raise DownloadError(f"the export failed: {answer}")
    return download(answer["href"], write, max_retries=0)


def get_map(service: str, layer: str, box: tuple[float, float, float, float], epsg: int, write: Callable[[bytes], object], resolution: float = 10.0) -> int:
    """A web map service's GeoTIFF of a box (xmin, ymin, xmax, ymax); the service takes it north first."""
    width, height = _pixels(box, resolution)
    xmin, ymin, xmax, ymax = box
    ask = {"service": "WMS", "version": "1.3.0", "request": "GetMap", "layers": layer, "crs": f"EPSG:{epsg}", "bbox": f"{ymin},{xmin},{ymax},{xmax}", "width": width, "height": height, "format": "image/geotiff"}
    url = f"{service}?{urllib.parse.urlencode(ask)}"
    with _open(url) as r:
        if "tiff" not in _checked(r, url).headers.get("content-type", ""):
            raise DownloadError(f"no TIFF but: {r.read(200)!r}")
        body = r.read()
    write(body)
    return len(body)

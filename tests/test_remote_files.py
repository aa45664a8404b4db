"""Services, on a small server of this test; GeoTIFF variants; damaged files; checkpoints; places of scenes."""

import json
import struct
import threading
import urllib.parse
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.operators import catalog, train
from terradelta.plans import pipeline
from terradelta.sources import geotiff, remote


@pytest.fixture
def server():
    """Answers by path; counts requests."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status, body=b"", **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            seen.append(("token", form))
            if form["password"] != ["right"]:
                return self.answer(401)
            self.answer(200, json.dumps({"access_token": f"t{len(seen)}", "expires_in": 100}).encode())

        def do_GET(self):
            path, _, query = self.path.partition("?")
            ask = urllib.parse.parse_qs(query)
            seen.append((path, ask, self.headers.get("Authorization")))
            times = sum(x[0] == path for x in seen)
            if path == "/odata/Products":
                name = ask["$filter"][0].split("'")[1]
                self.answer(200, json.dumps({"value": [{"Id": f"id-{name}"}] if name != "none.SAFE" else []}).encode())
            elif path == "/busy":
                self.answer(200, b"x" * 3_000_000) if times > 2 else self.answer(503 if times == 1 else 429, Retry_After="7") if times == 2 else self.answer(503)
            elif path == "/always":
                self.answer(500)
            elif path == "/gone":
                self.answer(404)
            elif path == "/export":
                host = f"http://127.0.0.1:{self.server.server_port}"
                self.answer(200, json.dumps({"href": f"{host}/file"} if ask["size"][0] != "1,1" else {"error": 1}).encode())
            elif path == "/wms":
                self.answer(200, b"II*\0map", Content_Type="image/tiff" if ask["layers"] == ["good"] else "text/xml")
            else:
                self.answer(200, path.encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_tokens(server):
    url, seen = server
    now = [0.0]
    tokens = remote.Tokens(f"{url}/token", "me", "right", clock=lambda: now[0])
    assert tokens.get() == tokens.get() == "t1" and seen[0][1]["grant_type"] == ["password"]
    now[0] = 39.0
    assert tokens.get() == "t1"
    now[0] = 40.0  # 60 seconds before its end
    assert tokens.get() == "t2"
    with pytest.raises(remote.AuthenticationError):
        remote.Tokens(f"{url}/token", "me", "wrong").get()
    assert "right" not in repr(tokens) and "t2" not in repr(tokens)


def test_credentials(monkeypatch, tmp_path):
    monkeypatch.delenv("CDSE_USERNAME", raising=False)
    monkeypatch.setenv("CDSE_PASSWORD", " p ")
    with pytest.raises(ValueError, match="CDSE_USERNAME"):
        remote.credentials()
    (tmp_path / "env").write_text("# no\nCDSE_USERNAME = 'u'\nCDSE_PASSWORD=q\n")
    assert remote.credentials(env_file=str(tmp_path / "env")) == ("u", "p")
    monkeypatch.setenv("CDSE_USERNAME", "  ")
    with pytest.raises(ValueError):
        remote.credentials()


def test_download_retries(server):
    url, seen = server
    waits, parts = [], []
    assert remote.download(f"{url}/busy", parts.append, "tok", sleep=waits.append) == 3_000_000
    assert waits == [1.0, 7.0] and len(parts) > 1 and seen[0][2] == "Bearer tok"
    waits.clear()
    with pytest.raises(remote.DownloadError, match="500 after 3 retries"):
        remote.download(f"{url}/always", parts.append, max_retries=3, sleep=waits.append)
    assert waits == [1.0, 2.0, 4.0]
    with pytest.raises(remote.DownloadError, match="404"):
        remote.download(f"{url}/gone", parts.append, sleep=waits.append)
    assert len(waits) == 3


def test_assets_are_fetched_in_tasks(spark, server, tmp_path):
    url, seen = server
    rows = [("s1", "P1", "B02", "s3://b/x/P1.SAFE/G/f.jp2"), ("s1", "P1", "B03", "s3://b/x/P1.SAFE/G/g.jp2"), ("s2", "none", "B02", f"{url}/gone"), ("s3", "P3.SAFE", "B02", f"{url}/plain")]
    assets = remote.with_product_ids(spark.createDataFrame(rows, "scene_id string, product_id string, band string, href string"), f"{url}/odata/")
    assert {r.product_id: r.product_uuid for r in assets.collect()} == {"P1": "id-P1.SAFE", "none": None, "P3.SAFE": "id-P3.SAFE"}
    got = {(r.scene_id, r.band): r for r in remote.download_assets(assets, str(tmp_path), f"{url}/zip").collect()}
    assert (tmp_path / "s1" / "B03").read_text() == "/zip/Products(id-P1.SAFE)/Nodes(P1.SAFE)/Nodes(G)/Nodes(g.jp2)/$value"
    assert got["s3", "B02"].size == len("/plain") and got["s1", "B02"].error is None
    assert got["s2", "B02"].path is None and "404" in got["s2", "B02"].error


def test_map_services(server):
    url, seen = server
    out = []
    assert remote.export_image(f"{url}/export", (0.0, 0.0, 50_000.0, 200.0), 3035, out.append) == len(b"/file") and out == [b"/file"]
    assert seen[0][1]["size"] == ["4000,20"] and seen[0][1]["bbox"] == ["0.0,0.0,50000.0,200.0"]
    with pytest.raises(remote.DownloadError):
        remote.export_image(f"{url}/export", (0.0, 0.0, 10.0, 10.0), 3035, out.append)
    assert remote.get_map(f"{url}/wms", "good", (1.0, 2.0, 101.0, 52.0), 3035, out.append) == 7 and out[-1] == b"II*\0map"
    ask = next(x[1] for x in seen if x[0] == "/wms")
    assert ask["bbox"] == ["2.0,1.0,52.0,101.0"] and (ask["width"], ask["height"]) == (["10"], ["5"])
    with pytest.raises(remote.DownloadError, match="TIFF"):
        remote.get_map(f"{url}/wms", "bad", (0.0, 0.0, 10.0, 10.0), 3035, out.append)


def lzw_encode(raw):
    """Codes as a decoder of the format expects them; a clear code when the table is full."""
    out, bits, have = bytearray(), 0, 0
    table, sent = {}, 0

    def put(code):
        nonlocal bits, have
        known = 258 + max(0, sent - 1)  # what the decoder has by now
        width = 9 + (known >= 511) + (known >= 1023) + (known >= 2047)
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    def fresh():
        nonlocal sent
        put(256)
        table.clear()
        table.update({bytes([i]): i for i in range(256)})
        sent = 0

    fresh()
    word = b""
    for k in range(len(raw)):
        more = word + raw[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        sent += 1
        table[more] = 258 + sent - 1
        word = raw[k : k + 1]
        if 258 + sent >= 4094:
            put(table[word])
            sent += 1
            fresh()
            word = b""
    if word:
        put(table[word])
        sent += 1
    put(257)
    put(0)
    return bytes(out)


def tiff(values, method, predictor, big, order="<"):
    """One band in one strip, by hand."""
    kind = {"f": 3, "u": 1, "i": 2}[values.dtype.kind]
    height, width = values.shape
    body = values.astype(values.dtype.newbyteorder(order))
    if predictor == 2:
        raw = np.diff(values, axis=1, prepend=values.dtype.type(0)).astype(body.dtype).tobytes()
    elif predictor == 3:
        size = values.dtype.itemsize
        planes = values.astype(f">f{size}").view(np.uint8).reshape(height, width, size).transpose(0, 2, 1).reshape(height, -1)
        raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    else:
        raw = body.tobytes()
    raw = {1: bytes, 5: lzw_encode, 8: zlib.compress}[method](raw)
    word = "Q" if big else "I"
    entries = [(256, 4, width), (257, 4, height), (258, 3, values.dtype.itemsize * 8), (259, 3, method), (273, 16 if big else 4, 0), (277, 3, 1), (278, 4, height), (279, 4, len(raw)), (317, 3, predictor), (339, 3, kind)]
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    count = struct.pack(order + ("Q" if big else "H"), len(entries))
    pad = struct.calcsize(order + word)
    at = len(head) + len(count) + (4 + 2 * pad) * len(entries) + pad
    ifd = count
    for tag, typ, v in entries:
        v = at if tag == 273 else v
        ifd += struct.pack(order + "HH" + word, tag, typ, 1) + struct.pack(order + {3: "H", 4: "I", 16: "Q"}[typ], v).ljust(pad, b"\0")
    return head + ifd + b"\0" * pad + raw


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("method", [1, 5, 8])
@pytest.mark.parametrize(("dtype", "predictor"), [("u1", 1), ("u2", 2), ("f4", 1), ("f4", 3), ("f8", 3), ("i2", 2)])
def test_geotiff_variants(big, method, dtype, predictor):
    rng = np.random.default_rng(3)
    values = (rng.normal(0, 50, (70, 90)).cumsum(axis=1) % 200).astype(dtype)
    for order in "<>":
        assert np.array_equal(geotiff.decode(tiff(values, method, predictor, big, order))[1][0], values)


def test_geotiff_that_cannot_be_read(spark, tmp_path):
    values = np.arange(12, dtype=np.float32).reshape(3, 4)
    good = tiff(values, 8, 3, False)
    for name, raw in (("a.tif", good), ("b.tif", b"nothing"), ("c.tif", b""), ("d.tif", good[:120]), ("e.tif", tiff(values, 8, 4, False)), ("f.tif", tiff(values.astype("u4"), 1, 3, False))):
        (tmp_path / name).write_bytes(raw)
    rows = geotiff.read_geotiff(spark, str(tmp_path), on_error="skip").collect()
    assert [r.path[-5:] for r in rows] == ["a.tif"] and rows[0].data == list(range(12))
    rejects = {r.path[-5:]: r.error for r in geotiff.geotiff_rejects(spark, str(tmp_path)).collect()}
    assert set(rejects) == {"b.tif", "d.tif", "e.tif", "f.tif"} and "predictor 4" in rejects["e.tif"]
    with pytest.raises(Exception, match="TIFF"):
        geotiff.read_geotiff(spark, str(tmp_path), glob="b.tif").collect()


def test_checkpoints(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), int(b - a > 0)) for a, b in rng.normal(size=(80, 2))]
    pixels = spark.createDataFrame(rows, "NDBI_1 double, NDBI_2 double, label int")
    model = train.train_scorer(pixels, ["NDBI"], {"NDBI": (0.0, 1.0)})
    folder = str(tmp_path / "models")
    for epoch, score in enumerate([0.2, 0.5, 0.1, 0.4, 0.3]):
        kept = train.save_checkpoint(model, folder, epoch, score)
    assert kept == ["change-epoch=001-score=0.5000", "change-epoch=003-score=0.4000", "change-epoch=004-score=0.3000", "last"]
    assert sorted(p.name for p in (tmp_path / "models").iterdir()) == sorted(kept)
    back = train.load_checkpoint(folder)
    assert np.allclose(back.coefficients.toArray(), model.coefficients.toArray())
    with pytest.raises(RuntimeError):
        train.load_checkpoint(str(tmp_path / "none"))


def test_places_of_scenes(spark):
    shapes = ['{"type":"Polygon","coordinates":[[[5.2, 60.3],[5.5,60.3],[5.5,60.5],[5.2,60.5],[5.2,60.3]]]}', '{"type":"MultiPolygon","coordinates":[[[[-1e1,2],[3,2.5],[3,4]]],[[[8,-9],[9,-8],[8,-8]]]]}', '{"type":"Point","coordinates":[5.3,60.4]}', "{}", None]
    items = spark.createDataFrame([(str(i), '{"datetime":"2018-06-03T10:00:00Z"}', g, {}) for i, g in enumerate(shapes)], catalog.STAC_ITEM)
    scenes = catalog.scenes_from_items(items)
    got = {r.scene_id: (r.west, r.south, r.east, r.north) for r in scenes.collect()}
    assert got == {"0": (5.2, 60.3, 5.5, 60.5), "1": (-10.0, -9.0, 9.0, 4.0), "2": (5.3, 60.4, 5.3, 60.4), "3": (None,) * 4, "4": (None,) * 4}
    found = catalog.search(scenes, "2018-06-01", "2018-06-30", bbox=pipeline.area("bergen")[:4])
    assert {r.scene_id for r in found.collect()} == {"0", "2"}


def test_changes_are_typed_by_shapes(spark):
    """An L-shaped building whose box covers a change that it does not touch."""
    header = {"x0": 0.0, "y0": 40.0, "res_x": 10.0, "res_y": -10.0}
    members = spark.createDataFrame([("p", 1, 0, 2), ("p", 1, 0, 3), ("p", 2, 3, 0), ("p", 2, 3, 1)], "detection_period string, component int, y int, x int")
    polygons = members.groupBy("detection_period", "component").agg((F.count("*") * 100.0).alias("area_m2"))
    ring = [[0.0, 0.0], [40.0, 0.0], [40.0, 10.0], [10.0, 10.0], [10.0, 40.0], [0.0, 40.0], [0.0, 0.0]]
    houses = spark.createDataFrame([(0.0, 0.0, 40.0, 40.0, [ring])], "xmin double, ymin double, xmax double, ymax double, rings array<array<array<double>>>")
    kind = lambda b: {r.component: r.change_type for r in pipeline.typed_changes(members, ["detection_period"], polygons, b, header).collect()}
    assert kind(houses) == {1: "new_paving", 2: "new_building"}
    assert kind(houses.drop("rings")) == {1: "new_building", 2: "new_building"}
    assert kind(houses.limit(0)) == {1: "new_paving", 2: "new_paving"}

"""Headers and lens correction lists of hand-made bytes, and lens corrections against plain NumPy."""

import struct

import numpy as np
import pytest

from burstlake.frames import optics
from burstlake.sources import headers, opcodes

from .test_frames import close, picture, table, whole


def tiff(order="<", ifds=None, extra=b""):
    """ifds: lists of (tag, kind, count, value bytes or number); a number is written as kind says, longer values after the directories."""
    at, blocks, tail = 8, [], b""
    starts = []
    for entries in ifds:
        starts.append(at)
        at += 2 + 12 * len(entries) + 4
    for entries in ifds:
        out = struct.pack(f"{order}H", len(entries))
        for tag, kind, count, value in entries:
            if isinstance(value, tuple):  # a pointer to the n-th directory
                value = struct.pack(f"{order}I", starts[value[0]])
            if len(value) > 4:
                place, tail = at + len(tail), tail + value
                value = struct.pack(f"{order}I", place)
            out += struct.pack(f"{order}HHI", tag, kind, count) + value.ljust(4, b"\0")
        blocks.append(out + b"\0\0\0\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8) + b"".join(blocks) + tail + extra


def sample(order="<"):
    """The reference's own sample: a camera, a lens of 24 to 70 mm, a place and a maker's note; two directories that point to each other."""
    s, r = (lambda v: struct.pack(f"{order}H", v)), lambda *v: struct.pack(f"{order}{len(v)}I", *v)
    image = [(271, 2, 8, b"Example\0"), (272, 2, 15, b"Example Camera\0"), (274, 3, 1, s(6)), (34665, 4, 1, (1,)), (34853, 4, 1, (2,))]
    exif = [
        (33434, 5, 1, r(1, 250)), (33437, 5, 1, r(28, 10)), (34855, 3, 1, s(400)), (37386, 5, 1, r(50, 1)), (37500, 7, 12, b"private data"),
        (42034, 5, 4, r(24, 1, 70, 1, 28, 10, 28, 10)), (40965, 4, 1, (0,)), (34665, 4, 1, (1,)), (50000, 5, 1, r(1, 0)), (50001, 2, 3, b"\xff\xfe\0"),
    ]
    return tiff(order, [image, exif, [(2, 5, 3, r(22, 1, 32, 1, 0, 1)), (1, 2, 2, b"N\0")]])


def jpeg(body, w=640, h=480):
    app = b"Exif\0\0" + body
    frame = struct.pack(">BHHB", 8, h, w, 3) + b"\x01\x11\x00" * 3
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\0\4" + b"\0" * 500


def png(body, w=30, h=20):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0" * 4
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"eXIf", body) + chunk(b"IDAT", b"x" * 100) + chunk(b"IEND", b"")


WANT = {"iso": 400, "aperture": 2.8, "exposure_time": 0.004, "focal_length": 50, "lens_focal_range": [24, 70], "focal_length_35mm": None, "lens_focal_range_35mm": None, "camera_model": "Example Camera"}


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_of_a_folder(spark, tmp_path, order):
    headers.register_source(spark)
    (tmp_path / "b.jpg").write_bytes(jpeg(sample(order)))
    (tmp_path / "a.PNG").write_bytes(png(sample(order)))
    (tmp_path / "c.dng").write_bytes(sample(order))
    (tmp_path / "d.jpeg").write_bytes(b"\xff\xd8\xff\xe1\x00")
    (tmp_path / "e.tif").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"no photo")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.jpg").write_bytes(jpeg(sample(order)))
    read = spark.read.format("photo_headers").option("filesPerTask", 2)
    rows = read.load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3 and read.option("recursive", "true").load(str(tmp_path)).count() == 6
    got = {r["path"].rpartition("/")[2]: r for r in rows.collect()}
    assert list(got) == ["a.PNG", "b.jpg", "c.dng", "d.jpeg", "e.tif"]
    assert got["d.jpeg"]["error"] and got["e.tif"]["error"] and not got["b.jpg"]["error"]
    tags = {(t["directory"], t["name"]) for t in got["b.jpg"]["tags"]}
    assert ("gps", "GPSLatitude") in tags and not any(n in ("MakerNote", "50000", "50001") for _, n in tags) and len(got["b.jpg"]["tags"]) == len(tags)
    seen = {r["filename"]: r.asDict() for r in headers.photo_metadata(rows).collect()}
    assert {k: seen["b.jpg"][k] for k in WANT} == WANT and (seen["b.jpg"]["width"], seen["b.jpg"]["height"]) == (480, 640)
    assert seen["b.jpg"]["size_bytes"] == (tmp_path / "b.jpg").stat().st_size
    assert {k: seen["a.PNG"][k] for k in WANT} == WANT and (seen["a.PNG"]["width"], seen["a.PNG"]["height"]) == (20, 30)
    assert {k: seen["c.dng"][k] for k in WANT} == WANT and seen["e.tif"]["camera_model"] is None


def test_bytes_of_a_column_and_every_cut(spark):
    body = jpeg(sample())
    rows = [(n, body[:n]) for n in range(0, len(body) - 499, 7)] + [(-1, None), (-2, body)]
    got = {r["k"]: r for r in headers.tag_rows(spark.createDataFrame(rows, "k int, body binary"), "k", "body").collect()}
    assert len(got) == len(rows) and len(got[-2]["tags"]) == 10 and got[-1]["tags"] == []
    assert all(len(a["tags"]) <= len(b["tags"]) for a, b in zip([got[k] for k, _ in rows[:-2]], [got[k] for k, _ in rows[1:-2]], strict=False))
    many = tiff("<", [[(34665, 4, 1, (k + 1,))] for k in range(40)] + [[(272, 2, 4, b"end\0")]])
    header, tags = headers.read_header(lambda at, n: many[at : at + n])
    assert tags == [] and "too many" in header.error


# ---- lists of lens corrections ----


def record(opcode, data, flags=0, version=0x01030000):
    return struct.pack(">4I", opcode, version, flags, len(data)) + data


def listed(*records):
    return struct.pack(">I", len(records)) + b"".join(records)


def gain_map(grid, spacing=(0.5, 0.25), area=(0, 0, 64, 64), planes=3):
    v, h, p = grid.shape
    return struct.pack(">10I4dI", *area, 0, planes, 1, 1, v, h, *spacing, 0.0, 0.0, p) + grid.astype(">f4").tobytes()


def warp(k, cx=0.5, cy=0.5):
    k = np.atleast_2d(k)
    return struct.pack(f">I{6 * len(k) + 2}d", len(k), *k.ravel(), cx, cy)


GRID = 1 + np.arange(45).reshape(3, 5, 3) % 8 / 8
K = np.array([1.0, 0.0625, -0.015625, 0.0039, 0.004, 0.002])


def test_sound_and_damaged_lists(spark):
    g, w = record(9, gain_map(GRID), 1), record(1, warp(K))
    lists = {
        "both": listed(g, w), "gain": listed(g), "none": listed(), "other": listed(record(77, b"abc", 1), w), "must": listed(record(77, b"abc"), w), "old": listed(record(1, warp(K), version=1)),
        "two warps": listed(w, w), "two gains": listed(g, g, w), "after": listed(w, g), "null": None,
        "short": listed(g)[:-1], "long": listed(g) + b"\0", "head": listed(g, w)[: 4 + len(g) + 9], "empty": b"", "many": struct.pack(">I", 65), "nan": listed(record(9, gain_map(GRID * np.nan))),
        "negative": listed(record(9, gain_map(-GRID))), "flat": listed(record(9, gain_map(GRID, area=(5, 0, 5, 9)))), "spacing": listed(record(9, gain_map(GRID, spacing=(0, 1)))),
        "centre": listed(record(1, warp(K, 1.5))), "planes": listed(record(1, struct.pack(">I", 2) + b"\0" * 112)), "beyond": struct.pack(">5I", 1, 9, 0, 0, 1 << 31),
    }
    rows = opcodes.opcode_rows(spark.createDataFrame(list(lists.items()), "k string, p binary"), "k", "p").cache()
    by = {}
    for r in rows.collect():
        by.setdefault(r["k"], []).append(r)
    bad = {"short", "long", "head", "empty", "many", "nan", "negative", "flat", "spacing", "centre", "planes", "beyond"}
    assert {k for k, rs in by.items() if any(r["error"] for r in rs)} == bad and all(len(by[k]) == 1 for k in bad) and set(lists) - set(by) == {"none", "null"}
    maps = {r["k"]: r for r in opcodes.gain_maps(rows, "k").collect()}
    assert set(maps) == {"both", "gain", "after"} and np.allclose(maps["gain"]["values"], GRID.ravel()) and maps["gain"]["map"]["points_h"] == 5
    found = {r["k"]: r for r in opcodes.warps(rows, "k").collect()}
    assert set(found) == {"both", "other", "after"} and found["both"]["gain_first"] and not found["after"]["gain_first"] and np.allclose(found["both"]["coefficients"], np.tile(K, 3))


@pytest.mark.parametrize("edge", [64, 256])
def test_lens_corrections_of_tiles(spark, edge):
    rgb = picture()
    h, w = rgb[0].shape
    planes = np.stack([K, K * [1, 1.1, 1, 1, 1, 1], K * [1, 0.9, 1, 1, 1, 1]])
    rows = opcodes.opcode_rows(spark.createDataFrame([("a", listed(record(9, gain_map(GRID)), record(1, warp(planes, 0.4, 0.55))))], "image string, p binary"), "image", "p").cache()
    df = table(spark, {"a": dict(zip("rgb", rgb, strict=True))}, edge)
    y = np.clip((np.arange(h) + 0.5) / h / 0.5, 0, 2)
    x = np.clip((np.arange(w) + 0.5) / w / 0.25, 0, 4)
    at = lambda v, n: (np.floor(v).astype(int), np.minimum(np.floor(v).astype(int) + 1, n), v - np.floor(v))
    (a, b, fy), (c, d, fx) = at(y, 2), at(x, 4)
    for spare in (False, True):
        got = optics.with_gains(df, opcodes.gain_maps(rows, "image"), "rgb", spare).cache()
        z = 1 - (1 - np.clip(np.max(rgb, axis=0) / 0.55, 0, 1)) ** 2 if spare else 0.0
        for k, band in enumerate("rgb"):
            g = GRID[:, :, k]
            rows_ = g[a] * (1 - fy)[:, None] + g[b] * fy[:, None]
            gain = rows_[:, c] * (1 - fx) + rows_[:, d] * fx
            assert close(whole(got, band), np.clip(rgb[k] * gain / (1 + (gain - 1) * z), 0, 1))
    got = optics.warped(df, opcodes.warps(rows, "image"), ["r", "g", "b"]).cache()
    cx, cy = 0.4 * w, 0.55 * h
    radius = np.hypot(max(cx, w - cx), max(cy, h - cy))
    dx, dy = np.arange(w)[None, :] - cx, np.arange(h)[:, None] - cy
    r2 = np.minimum((dx**2 + dy**2) / radius**2, 1)
    for k, band in enumerate("rgb"):
        q = planes[k]
        f = q[0] + q[1] * r2 + q[2] * r2**2 + q[3] * r2**3
        sx = np.clip(cx + dx * f + radius * (q[5] * (r2 + 2 * (dx / radius) ** 2) + 2 * q[4] * dx * dy / radius**2), 0, w - 1)
        sy = np.clip(cy + dy * f + radius * (q[4] * (r2 + 2 * (dy / radius) ** 2) + 2 * q[5] * dx * dy / radius**2), 0, h - 1)
        ix, iy = np.floor(sx).astype(int), np.floor(sy).astype(int)
        jx, jy = np.minimum(ix + 1, w - 1), np.minimum(iy + 1, h - 1)
        v = (rgb[k][iy, ix] * (1 - sx + ix) + rgb[k][iy, jx] * (sx - ix)) * (1 - sy + iy) + (rgb[k][jy, ix] * (1 - sx + ix) + rgb[k][jy, jx] * (sx - ix)) * (sy - iy)
        assert close(whole(got, band), v, 1e-9)


@pytest.mark.parametrize("name", ["header_metadata", "header_tags", "opcode_records", "gain_map_points", "tiled_gain_map", "tiled_warp"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    from burstlake.plans.packets import catalog

    con = duckdb.connect()
    for t in ("embeddings", "orders", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.queries[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracles[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key) and want

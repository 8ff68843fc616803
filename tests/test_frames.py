"""Operators on tiled images against plain NumPy on whole images, for several tile sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.frames import canvases, haze, quantiles, scenes, sharpness, tiles

H, W = 384, 512
LUMA = np.array([0.2126, 0.7152, 0.0722])


def picture(h=H, w=W, seed=5):
    """A scene: bright sky, a skyline of towers, textured land, a few lights; r, g, b of 0 to 1."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    line = h * (0.4 + 0.12 * np.sin(x[0] / 37.0) + 0.1 * (x[0] // 60 % 2))
    land = y > line[None, :]
    gray = np.where(land, 0.22 + 0.1 * rng.random((h, w)) + 0.05 * ((x // 6 + y // 6) % 2), 0.75 - 0.1 * y / h + 0.004 * rng.random((h, w)))
    gray = np.where(rng.random((h, w)) > 0.998, 0.5, gray)
    return [np.clip(gray * k + 0.01 * rng.random((h, w)), 0, 1) for k in (0.95, 1.0, 1.05)]


def table(spark, images, edge, key="string"):
    rows = [(str(k), len(next(iter(b.values()))), len(next(iter(b.values()))[0]), *[a.ravel().tolist() for a in b.values()]) for k, b in images.items()]
    bands = list(next(iter(images.values())))
    df = spark.createDataFrame(rows, "image string, height int, width int, " + ", ".join(f"{b} array<double>" for b in bands))
    return tiles.cut(df, bands, edge)


def whole(df, band, h=H, w=W, image=None):
    out = np.full((h, w), np.nan)
    rows = df.where(F.col("image") == image).collect() if image else df.collect()
    for r in rows:
        n = min(w - r["x0"], r["edge"])
        part = np.array(r[band]).reshape(-1, n)
        assert np.isnan(out[r["y0"] : r["y0"] + len(part), r["x0"] : r["x0"] + n]).all()
        out[r["y0"] : r["y0"] + len(part), r["x0"] : r["x0"] + n] = part
    assert not np.isnan(out).any()
    return out


def brute_filter(a, radius, how):
    for axis in (0, 1):
        pads = [(radius, radius) if k == axis else (0, 0) for k in (0, 1)]
        wide = np.pad(a, pads, mode="reflect")
        shifts = [np.take(wide, range(i, i + a.shape[axis]), axis) for i in range(2 * radius + 1)]
        a = how(shifts)
    return a


def brute_box(a, radius):
    return brute_filter(a, radius, lambda s: sum(s) / len(s))


def brute_blur(a, sy, sx=None):
    for axis, sigma in ((0, sy), (1, sy if sx is None else sx)):
        r = (round(sigma * 8 + 1) | 1) // 2
        k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
        wide = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
        a = sum(q / sum(k) * np.take(wide, range(i, i + a.shape[axis]), axis) for i, q in enumerate(k))
    return a


def step(low, high, x):
    t = np.clip((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def close(a, b, tol=1e-9):
    return np.abs(np.asarray(a) - np.asarray(b)).max() < tol


@pytest.mark.parametrize("edge", [64, 100, 256])
def test_filters_have_no_seams(spark, edge):
    a = picture()[0]
    df = table(spark, {"a": {"r": a}}, edge).cache()
    for radius in (7, 40):
        assert close(whole(haze.filtered(df, "r", radius, "m"), "m"), brute_box(a, radius))
        assert close(whole(haze.filtered(df, "r", radius, "m", "least"), "m"), brute_filter(a, radius, lambda s: np.min(s, axis=0)))
        assert close(whole(haze.filtered(df, "r", radius, "m", "most"), "m"), brute_filter(a, radius, lambda s: np.max(s, axis=0)))


def test_margins_wider_than_images_and_tiles(spark):
    rng = np.random.default_rng(1)
    images = {f"{h}x{w}": {"r": rng.random((h, w))} for h, w in ((1, 1), (1, 9), (5, 3), (17, 40), (9, 9))}
    df = table(spark, images, 4).cache()
    for radius in (1, 6, 13):
        got = haze.filtered(df, "r", radius, "m").cache()
        for k, b in images.items():
            h, w = b["r"].shape
            at = lambda n: [(lambda i: i if i < n else 2 * n - 2 - i)(abs(j) % max(1, 2 * n - 2)) for j in range(-radius, n + radius)]
            wide = b["r"][np.ix_(at(h), at(w))]
            want = [[wide[y : y + 2 * radius + 1, x : x + 2 * radius + 1].mean() for x in range(w)] for y in range(h)]
            assert close(whole(got, "m", h, w, k), want)


def test_the_time_of_a_filter_does_not_follow_its_radius():
    import time

    from burstlake.frames import kernels as K

    a = np.random.default_rng(0).random((1024, 1024))

    def seconds(run):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        return best

    for make in (lambda r: K.box(a, r), lambda r: K.extreme(a, r, True)):
        assert seconds(lambda: make(60)) < 3 * seconds(lambda: make(4))  # noqa: B023


@pytest.mark.parametrize("edge", [64, 100, 256])
def test_guided_filter(spark, edge):
    g, e, _ = picture()
    got = haze.guided_filter(table(spark, {"a": {"g": g, "e": e}}, edge), "g", "e").cache()
    mg, me = brute_box(g, 12), brute_box(e, 12)
    a = (brute_box(g * e, 12) - mg * me) / np.maximum(brute_box(g * g, 12) - mg * mg + 0.002, 1e-7)
    assert close(whole(got, "slope"), brute_box(a, 12), 1e-7) and close(whole(got, "intercept"), brute_box(me - a * mg, 12), 1e-7)


def brute_sharpness(gray, region):
    x, y, w, h = region
    roi = gray[y : y + h, x : x + w].astype(float)
    at = lambda n, by: [(lambda i: i if i < n else 2 * n - 2 - i)(abs(j + by) % max(1, 2 * n - 2)) for j in range(n)]
    n = {(i, j): roi[np.ix_(at(h, j), at(w, i))] for i in (-1, 0, 1) for j in (-1, 0, 1)}
    lap = n[-1, 0] + n[1, 0] + n[0, -1] + n[0, 1] - 4 * roi
    sx = n[1, -1] + 2 * n[1, 0] + n[1, 1] - n[-1, -1] - 2 * n[-1, 0] - n[-1, 1]
    sy = n[-1, 1] + 2 * n[0, 1] + n[1, 1] - n[-1, -1] - 2 * n[0, -1] - n[1, -1]
    return lap.var() + (sx**2 + sy**2).mean()


@pytest.mark.parametrize("edge", [16, 23, 256])
def test_sharpness_of_regions(spark, edge):
    """Shapes and regions of the reference's own cases, and the grid of a 256 x 256 and a 33 x 41 image."""
    rng = np.random.default_rng(3)
    shapes = {(2, 2): (0, 0, 2, 2), (19, 31): (0, 0, 31, 19), (64, 80): (7, 11, 47, 39), (256, 256): (100, 3, 1, 200), (33, 41): (30, 25, 11, 8)}
    images = {f"{h}x{w}": {"gray": rng.integers(0, 256, (h, w)).astype(float)} for h, w in shapes}
    df = table(spark, images, edge).cache()
    of = lambda h, w: [*sharpness.whole(h, w), *sharpness.centre(h, w), *sharpness.thirds(h, w), shapes[h, w]]
    got = {(r["image"], r["region"]): r["sharpness"] for r in sharpness.region_sharpness(df, of).collect()}
    for k, b in images.items():
        h, w = b["gray"].shape
        for i, region in enumerate(of(h, w)):
            if region[2] > 0 and region[3] > 0:
                assert got[k, i] == pytest.approx(brute_sharpness(b["gray"], region), rel=1e-9, abs=1e-7)
            else:
                assert (k, i) not in got
    shown = {r["image"]: r["exposure"] for r in sharpness.exposure(df).collect()}
    for k, b in images.items():
        assert shown[k] == pytest.approx(min(1.0, max(0.0, 1 - 2 * (b["gray"] >= 250).mean() - 0.5 * (b["gray"] <= 5).mean())))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    images = {
        "noise": rng.random((200, 150)), "flat": np.full((90, 90), 0.25), "two": np.where(np.arange(6400).reshape(80, 80) % 3, 1.0, 0.0), "one": np.array([[4.5]]),
        "wide": np.exp(rng.normal(0, 30, (70, 70))) * rng.choice([-1, 1], (70, 70)), "steps": rng.integers(0, 65536, (300, 250)) / 65535.0,
    }
    shares = [0.0, 0.01, 0.25, 0.5, 0.65, 0.9, 0.99, 0.999, 1.0]
    df = table(spark, {k: {"v": a} for k, a in images.items()}, 64)
    got = {r["image"]: r for r in quantiles.image_quantiles(df, "v", shares).collect()}
    for k, a in images.items():
        assert got[k]["n"] == a.size and np.allclose(got[k]["q"], np.quantile(a, shares), rtol=1e-12, atol=1e-300), k
    assert quantiles.image_quantiles(df.limit(0), "v", [0.5]).count() == 0


def brute_skyline(y):
    h, w = y.shape
    ref = brute_blur(np.median(y[: max(4, round(h * 0.12))], axis=0)[None, :].repeat(1, 0), 1e-3, max(2.0, w / 96))[0]
    base = np.maximum(ref, 0.025)
    calm = brute_blur(y, 0.6, 1.0)
    line = np.full(w, h * 0.94)
    for x in range(w):
        for row in range(max(4, round(h * 0.06)), min(max(max(4, round(h * 0.06)) + 1, round(h * 0.88)), h - 8)):
            above, below, on = (calm[a:b, x].mean() / base[x] for a, b in ((row - 3, row), (row, row + 4), (row, row + 8)))
            if below <= 0.95 and above - below >= 0.025 and on <= 0.96:
                line[x] = row
                break
    return brute_blur(line[None, :], 1e-3, max(1.0, w / 256))[0], ref


def brute_texture(y, radius):
    m = brute_box(y, radius)
    return np.sqrt(np.maximum(brute_box(y * y, radius) - m * m, 0)), np.sqrt(np.maximum(brute_box(y * y, radius) - m * m, 0)) / (m + 0.025)


@pytest.mark.parametrize("edge", [100, 256])
def test_a_skyline_is_found(spark, edge):
    rgb = picture()
    y = sum(k * a for k, a in zip(LUMA, rgb, strict=True))
    row = haze.sky_of(haze.with_luma(table(spark, {"a": dict(zip("rgb", rgb, strict=True))}, edge))).first()
    line, ref = brute_skyline(y)
    assert close(row["skyline"], line, 1e-6) and close(row["column_ref"], ref, 1e-6)
    truth = H * (0.4 + 0.12 * np.sin(np.arange(W) / 37.0) + 0.1 * (np.arange(W) // 60 % 2))
    assert np.median(np.abs(line - truth)) < 12 and len(np.unique(np.round(line))) > 40
    support = step(-3.5, 3.5, line[None, :] - np.arange(H)[:, None])
    sky = support * step(0.84, 0.99, y / np.maximum(ref, 0.025)) * (0.85 + 0.15 * (1 - step(0.12, 0.38, brute_texture(y, 7)[1])))
    got = np.array(row["sky"]).reshape(H, W)
    assert close(got, sky, 1e-6) and got[:60].mean() > 0.8 and got[-60:].max() < 1e-6


def brute_supports(rgb):
    y = sum(k * a for k, a in zip(LUMA, rgb, strict=True))
    h = len(y)
    dev, rel = brute_texture(y, 7)
    shadow = brute_blur(step(0.12, 0.45, brute_box(step(0.025, 0.060, rel), 20)), 4.0) * step(0.08, 0.20, np.linspace(0, 1, h)[:, None])
    shadow = shadow * step(0.10, 0.30, shadow.mean())
    out = brute_blur(step(0.10, 0.36, brute_box(step(0.025, 0.060, rel) * step(0.0012, 0.0045, dev), 10)), 1.5)
    ex, ey = np.zeros_like(y), np.zeros_like(y)
    ex[:, 1:], ey[1:] = np.abs(np.diff(y, axis=1)), np.abs(np.diff(y, axis=0))
    ex, ey = brute_box(ex, 4), brute_box(ey, 4)
    out = out * step(0.12, 0.60, 2 * np.minimum(ex, ey) / (ex + ey + 1e-5))
    rows = np.arange(h)[:, None]
    out = out * step(0.08 * h, 0.20 * h, rows) * step(-0.012 * h, 0.045 * h, rows - brute_skyline(y)[0][None, :])
    return shadow, np.clip(out, 0, 1)


@pytest.mark.parametrize("edge", [64, 100, 256])
def test_detail_protection_and_structure(spark, edge):
    rgb = picture()
    result = [np.clip(a * 0.82 - 0.03 * (1 - a), 0, 1) for a in rgb]
    df = table(spark, {"a": dict(zip("rgb", rgb, strict=True)) | {f"v{c}": a for c, a in zip("rgb", result, strict=True)}}, edge)
    ready = haze.supports(df).cache()
    shadow, structure = brute_supports(rgb)
    assert close(whole(ready, "shadow"), shadow, 1e-7) and close(whole(ready, "structure"), structure, 1e-6)
    assert structure.max() > 0.5 and shadow.max() > 0.5
    src, res = np.stack(rgb), np.stack(result)
    lum = lambda s: np.tensordot(LUMA, s, 1)
    y = lum(src)
    up, peak = y[: H // 4], src.max(axis=0)[: H // 4]
    valid = (up > 0.04) & (up < 0.40) & (peak < 0.70)
    target = float(np.clip(np.median(lum(res)[: H // 4][valid] / up[valid]), 0.82, 1)) if valid.sum() >= 16 else 1.0
    assert ready.transform(lambda d: haze.bright_targets(d)).first()["bright_scale"] == pytest.approx(target)
    least = y * (1 - 0.05 * 0.8 * (1 - step(0.06, 0.30, y)))
    out = res + (src - res) * np.clip((least - lum(res)) / np.maximum(y - lum(res), 1e-6), 0, 1) * shadow
    out = out * np.minimum(1, y / np.maximum(lum(out), 1e-6))
    if target < 1:
        high = step(0.008, 0.035, y - brute_box(y, 2)) * (1 - step(0.55, 0.80, src.max(axis=0)))
        out = out + (src * target - out) * high * (lum(out) > y * target)
    out = np.clip(out, 0, 1)
    got = haze.protect_details(ready, 0.8).cache()
    for k, c in enumerate("rgb"):
        assert close(whole(got, f"v{c}"), out[k], 1e-6)
    v = lum(out)
    gain = (v - brute_box(v, 2)) * (1.65 * 0.25 * 0.8 * (1.20 - 0.30 * 0.70)) * structure
    gain = np.clip(gain, -np.minimum(0.04 * v, 0.004), np.minimum(0.08 * v, 0.012))
    final = np.clip(out * (np.clip(v + gain, 0, 1) / np.maximum(v, 1e-6)), 0, 1)
    got = haze.protected(df, 0.8).cache()
    for k, c in enumerate("rgb"):
        assert close(whole(got, f"v{c}"), final[k], 1e-6)
    assert np.abs(final - out).max() > 1e-3


def brute_scene(rgb, cp=0.6, bp=0.7):
    """Written from the description of the estimates, with plain loops over shifts."""
    rgb = np.stack(rgb)
    h = rgb.shape[1]
    up = rgb[:, : round(h * 0.45)]
    y = np.tensordot(LUMA, up, 1)
    var = np.maximum(brute_box(y * y, 5) - brute_box(y, 5) ** 2, 0)
    take = (y >= np.percentile(y, 70)) & (y <= np.percentile(y, 96)) & (var <= np.percentile(var, 65)) & (up.max(0) < 0.94)
    pool = up[:, take].T
    air = np.median(pool, 0)
    lum = air @ LUMA
    spread = np.median(np.linalg.norm(pool - air, axis=1)) / max(lum, 0.025)
    trust = 0.15 + 0.85 * min(1, take.sum() / y.size / 0.12) * (1 - step(0.12, 0.6, spread)) * step(0.025, 0.12, lum)
    mix = cp * (0.35 + 0.35 * (1 - trust))
    air = air * (1 - mix) + lum * mix
    weight = 1 - step(0.025, 0.12, air @ LUMA)
    if weight > 0:
        dark = brute_filter(rgb.min(0), 5, lambda s: np.min(s, axis=0))
        open_ = brute_filter((rgb.max(0) >= 0.94) * 1.0, 5, lambda s: np.max(s, axis=0)) == 0
        pool = np.stack([brute_box(c, 5) for c in rgb])[:, open_ & (dark >= np.percentile(dark[open_], 99))].T
        broad = np.median(pool, 0)
        lum = broad @ LUMA
        sure = 0.15 + 0.85 * (1 - step(0.12, 0.6, np.median(np.linalg.norm(pool - broad, axis=1)) / lum)) * step(0.001, 0.006, lum)
        mix = cp * (0.35 + 0.35 * (1 - sure))
        air = air * (1 - weight) + (broad * (1 - mix) + lum * mix) * weight
        trust = trust * (1 - weight) + sure * weight
    y = np.tensordot(LUMA, rgb, 1)
    clip = (up.max(0) > 0.95).mean()
    ratio = np.median(y[: round(h * 0.45)]) / max(np.median(y[h // 2 :]), 0.001)
    sun = step(0.005, 0.015, clip) * (1 - step(0.15, 0.35, clip)) * step(8, 14, ratio) * step(0.05, 0.1, np.median(y[: round(h * 0.45)]))
    back = 1 - 0.85 * bp * (1 - step(0.65, 0.85, trust)) * sun
    floor = np.percentile(y[: round(h * 0.3)], 90) * 1.25 * (1 - step(0.065, 0.09, air @ LUMA))
    omega = 0.8 * (0.66 - 0.14 * 0.2) * (0.9 + 0.1 * 0.3) * (0.92 + 0.08 * np.clip((np.percentile(rgb.min(0), 75) - 0.03) / 0.92, 0.12, 0.92))
    return [*air, trust, np.clip(1 - omega, 0.27 + 0.21 * 0.2 + 0.11 * 0.7, 1), back, floor]


def test_scenes_by_day_night_and_against_the_sun(spark):
    from burstlake.frames import scenes

    day, h, w = picture(), 120, 160
    rng = np.random.default_rng(8)
    night = [0.02 * rng.random((h, w)) + 0.01 for _ in range(3)]
    sun = [np.where(np.arange(h)[:, None] < 60, 0.05 + 0.89 * rng.random((h, w)), 0.02 + 0.01 * rng.random((h, w))) for _ in range(3)]
    for c in sun:
        c[:4, :60] = 1.0
    images = {"day": day, "night": night, "sun": sun}
    df = table(spark, {k: dict(zip("rgb", v, strict=True)) for k, v in images.items()}, 50).cache()
    got = {r["image"]: r for r in scenes.estimates(df).collect()}
    for k, v in images.items():
        assert np.allclose([got[k][c] for c in scenes.ESTIMATES[:7]], brute_scene(v), atol=1e-7), k
    assert got["sun"]["backlight"] < 0.9 and got["day"]["backlight"] == 1 and got["night"]["dark_floor"] > 0.01 and got["day"]["trust"] > 0.8
    stops = {r["image"]: (r["ev"], r["reason"]) for r in scenes.exposure_stops(df).collect()}
    assert stops["night"] == (2.0, "applied") and stops["day"] == (0.0, "target_reached") and stops["sun"][1] in ("target_reached", "highlight_limited")
    lit = whole(scenes.exposed(df), "r", h, w, "night")
    assert close(lit, night[0] * 4)
    light = {r["image"]: r for r in scenes.haziest_light(df).collect()}
    flat = np.stack(day).reshape(3, -1)
    order = np.lexsort((np.arange(flat.shape[1]), -(LUMA @ flat), -flat.min(0)))[: max(16, flat.shape[1] // 1000)]
    order = order[np.lexsort((order, -(LUMA @ flat)[order]))][: len(order) // 8]
    assert np.allclose([light["day"][f"air_{c}"] for c in "rgb"], np.clip(np.median(flat[:, order], axis=1), 0.35, 1))


def test_reduced_and_enlarged(spark):
    rng = np.random.default_rng(2)
    a = rng.random((900, 1100))
    df = table(spark, {"a": {"v": a}}, 256).cache()
    low = canvases.reduced(df, ["v"]).first()
    h, w = round(900 * 768 / 1100), 768
    assert (low["rows"], low["cols"]) == (h, w)
    weights = lambda n, m: np.array([[max(0.0, min(i + 1, (j + 1) * n / m) - max(i, j * n / m)) * m / n for i in range(n)] for j in range(m)])
    small = weights(900, h) @ a @ weights(1100, w).T
    assert close(np.array(low["v"]).reshape(h, w), small)
    back = whole(canvases.laid_over(df.select(*tiles.PLACE), canvases.reduced(df, ["v"]), ["v"]), "v", 900, 1100)

    def line(n, m):
        out = np.zeros((n, m))
        for i in range(n):
            s = min(max((i + 0.5) * m / n - 0.5, 0), m - 1)
            out[i, int(s)] += 1 - s + int(s)
            out[i, min(int(s) + 1, m - 1)] += s - int(s)
        return out

    assert close(back, line(900, h) @ small @ line(1100, w).T)
    s = round(1100 / 768)
    assert close(np.array(canvases.sampled(df, ["v"]).first()["v"]), a[::s, ::s].ravel())


def test_pixels_and_back(spark):
    rng = np.random.default_rng(4)
    a = rng.random((30, 41))
    df = table(spark, {"a": {"v": a}}, 16)
    px = tiles.to_pixels(df, ["v"]).cache()
    assert {(r["y"], r["x"]): r["v"] for r in px.collect()} == {(y, x): a[y, x] for y in range(30) for x in range(41)}
    again = tiles.from_pixels(px.select("image", F.lit(30).alias("height"), F.lit(41).alias("width"), "y", "x", "v"), ["v"], 16)
    assert close(whole(again, "v", 30, 41), a)
    with pytest.raises(Exception, match="two tiles"):
        haze.filtered(df.unionAll(df), "v", 1, "m").collect()


@pytest.mark.parametrize("name", ["tiled_sharpness", "tiled_exposure", "tiled_quantiles", "tiled_box_mean", "tiled_extremes", "tiled_guided_filter", "tiled_skyline", "tiled_sky_mask", "tiled_exposure_stops", "tiled_haziest_light"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    from burstlake.plans.framed import catalog

    con = duckdb.connect()
    for t in ("embeddings", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.queries[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracles[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key) and want


def test_tiles_are_never_broadcast(spark):
    import re

    df = table(spark, {"a": dict(zip("rgb", picture(40, 30), strict=True))}, 16)
    for c in "rgb":
        df = df.withColumn(f"v{c}", F.transform(c, lambda v: v * 0.9))
    ready = haze.supports(df)
    joined = [ready, haze.protect_details(ready, 0.8), scenes.exposed(df), scenes.haziest_light(df), canvases.laid_over(df, haze.sky_of(haze.with_luma(df)), ["sky"])]
    for plan in (d._jdf.queryExecution().executedPlan().toString() for d in joined):
        assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin|BroadcastNestedLoopJoin", plan)


def test_batches_are_worked_on_in_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([[float(k)] * 40_000 for k in range(50)])], names=["k", "v"])
    got = list(tiles.pieces([batch, batch.slice(0, 0), batch.slice(3, 1)]))
    assert len(got) > 4 and max(p.num_rows * 320_000 for p in got) <= tiles.PIECE
    assert [k for p in got for k in p.column("k").to_pylist()] == [*range(50), 3]
    assert all(tiles._values(p.column("v"), i)[0] == p.column("k")[i].as_py() for p in got for i in range(p.num_rows))

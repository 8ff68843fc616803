"""Sky, detail and structure of hazy images of any size, and the protection of detail after haze is removed.

Scenes are judged on the reduced version of an image (see canvases); masks are then enlarged to its tiles.  What works at
full size (detail protection, structure enhancement, filters) works on tiles with margins.  Values are 0 to 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.sources.scratch import written

from . import kernels as K
from .canvases import laid_over, reduced, sampled, with_bands
from .kernels import smooth
from .tiles import Bands, Frame, mapped, windowed

RGB = ("r", "g", "b")
REFERENCE_EDGE, DETAIL_RADIUS, STRUCTURE_RADIUS = 1800, 4, 8


def with_luma(tiles: DataFrame) -> DataFrame:
    """The tiles with the band luma beside r, g and b."""
    return mapped(tiles, lambda a, f: {**a, "luma": K.luma(a["r"], a["g"], a["b"])}, RGB, (*RGB, "luma"), kept=tiles.columns[6:] and [c for c in tiles.columns[6:] if c not in RGB])


def filtered(tiles: DataFrame, band: str, radius: int, to: str, kind: str = "mean") -> DataFrame:
    """A band's mean, smallest or largest value in a square, mirrored at the image's border; constant time a pixel."""
    make = {"mean": K.box, "least": lambda a, r: K.extreme(a, r, False), "most": lambda a, r: K.extreme(a, r, True)}[kind]
    return windowed(tiles, radius, lambda a, f: {to: make(a[band], radius)}, [band], [to])


def guided_filter(tiles: DataFrame, guide: str, estimate: str, radius: int = 12, epsilon: float = 0.002) -> DataFrame:
    """slope and intercept of the gray guided filter of one band by another."""

    def make(a: Bands, f: Frame) -> Bands:
        slope, intercept = K.guided(a[guide], a[estimate], radius, epsilon)
        return {"slope": slope, "intercept": intercept}

    return windowed(tiles, 2 * radius, make, [guide, estimate], ["slope", "intercept"])


def mirrored_by(a: np.ndarray, radius: int, make) -> np.ndarray:
    """make(a) with a margin of the mirrored image, cut off again."""
    r = radius
    return make(np.pad(a, r, mode="reflect"))[r : r + a.shape[0], r : r + a.shape[1]] if r else make(a)


def box(a: np.ndarray, radius: int) -> np.ndarray:
    return mirrored_by(a, radius, lambda x: K.box(x, radius))


def blur(a: np.ndarray, *sigmas: float) -> np.ndarray:
    return mirrored_by(a, max(K.reach(s) for s in sigmas), lambda x: K.blur(x, *sigmas))


def texture(luma: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviation of a square and its share of the mean."""
    mean = box(luma, radius)
    deviation = np.sqrt(np.maximum(box(luma * luma, radius) - mean * mean, 0.0))
    return deviation, deviation / (mean + 0.025)


def skyline(luma: np.ndarray) -> dict[str, np.ndarray]:
    """sky (how much each place is sky), column_ref (luma of a column's top) and skyline (row, smoothed) of a whole image.

    For each column the first row where luma falls, against the column's top, and stays low.
    """
    h, w = luma.shape
    reference = K.mirrored_blur(np.median(luma[: max(4, round(h * 0.12))], axis=0), max(2.0, w / 96))
    base = np.maximum(reference, 0.025)
    calm = blur(luma, 0.6, 1.0)
    first = max(4, round(h * 0.06))
    last = min(max(first + 1, round(h * 0.88)), h - 8)
    line = np.full(w, h * 0.94)
    if last > first:
        sums = np.concatenate([np.zeros((1, w)), np.cumsum(calm, axis=0)])
        rows = np.arange(first, last)
        mean = lambda a, b: (sums[rows + b] - sums[rows + a]) / (b - a) / base
        above, below, onward = mean(-3, 0), mean(0, 4), mean(0, 8)
        falls = (below <= 0.95) & (above - below >= 0.025) & (onward <= 0.96)
        line = np.where(falls.any(axis=0), rows[np.argmax(falls, axis=0)], line)
    line = K.mirrored_blur(line, max(1.0, w / 256))
    support = smooth(-3.5, 3.5, line[None, :] - np.arange(h)[:, None])
    calmness = 0.85 + 0.15 * (1.0 - smooth(0.12, 0.38, texture(luma, 7)[1]))
    return {"sky": support * smooth(0.84, 0.99, luma / base[None, :]) * calmness, "column_ref": reference, "skyline": line}


def sky_of(tiles: DataFrame) -> DataFrame:
    """sky, column_ref and skyline of each image's reduced version, one row per image; tiles have a band luma."""
    return with_bands(reduced(tiles, ["luma"]), lambda a: skyline(a["luma"]), ["luma"], ["sky"], ["column_ref", "skyline"])


def daylight(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: is this a scene by day."""
    y, h = K.luma(r, g, b), r.shape[0]
    scene, top = np.median(y), np.median(y[: max(1, h // 5)])
    peak = np.percentile(np.maximum(np.maximum(r, g), b)[: max(1, h // 2)], 99)
    return max(float(smooth(0.06, 0.10, scene) * smooth(0.09, 0.13, top)), float(smooth(0.16, 0.24, top)), float(smooth(0.75, 0.95, peak)))


def shadow_support(luma: np.ndarray) -> np.ndarray:
    """Detailed land: texture over a broad area, fading out towards the top."""
    h = luma.shape[0]
    dense = box(smooth(0.025, 0.060, texture(luma, 7)[1]), 20)
    return blur(smooth(0.12, 0.45, dense), 4.0) * smooth(0.08, 0.20, np.linspace(0.0, 1.0, h)[:, None])


def structure_support(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Broad textured land with detail in both directions; by day only below the skyline."""
    y = K.luma(r, g, b)
    h = y.shape[0]
    deviation, relative = texture(y, 7)
    out = blur(smooth(0.10, 0.36, box(smooth(0.025, 0.060, relative) * smooth(0.0012, 0.0045, deviation), 10)), 1.5)
    steps = [np.zeros_like(y), np.zeros_like(y)]
    steps[0][:, 1:], steps[1][1:] = np.abs(np.diff(y, axis=1)), np.abs(np.diff(y, axis=0))
    across, down = (box(s, 4) for s in steps)
    out = out * smooth(0.12, 0.60, 2.0 * np.minimum(across, down) / (across + down + 1e-5))
    rows = np.arange(h)[:, None]
    out = out * smooth(0.08 * h, 0.20 * h, rows)
    if daylight(r, g, b) > 1e-6:
        out = out * smooth(-0.012 * h, 0.045 * h, rows - skyline(y)["skyline"][None, :])
    return np.clip(out, 0.0, 1.0)


def supports(tiles: DataFrame) -> DataFrame:
    """The tiles (r, g, b) with the bands shadow and structure."""
    make = lambda a: {"shadow": shadow_support(K.luma(*(a[c] for c in RGB))), "structure": structure_support(*(a[c] for c in RGB))}
    wide = written(laid_over(tiles, with_bands(reduced(tiles, RGB), make, RGB, ["shadow", "structure"]), ["shadow", "structure"]), "supports")
    # In scenes with little texture as a whole no shadow counts: the mean is that of the enlarged mask.
    means = wide.select("image", F.size("shadow").alias("n"), F.aggregate("shadow", F.lit(0.0), lambda a, x: a + x).alias("s"))
    means = means.groupBy(F.col("image").alias("of")).agg((F.sum("s") / F.sum("n")).alias("texture"))
    joined = wide.join(means.hint("merge"), wide["image"].eqNullSafe(means["of"])).drop("of")
    scaled = lambda a, f: {"shadow": a["shadow"] * smooth(0.10, 0.30, np.float64(f.scalars["texture"]))}
    return mapped(joined, scaled, ["shadow"], ["shadow"], kept=[c for c in wide.columns[6:] if c != "shadow"], scalars=["texture"])


def bright_targets(tiles: DataFrame) -> DataFrame:
    """image and bright_scale: how much darker the result (vr, vg, vb) made the upper quarter of a scene by day, 0.82 to 1."""

    def scale(a: Bands) -> dict[str, float]:
        n = max(1, a["r"].shape[0] // 4)
        y, peaks = K.luma(*(a[c] for c in RGB)), np.maximum(np.maximum(a["r"], a["g"]), a["b"])[:n]
        upper = y[:n]
        day = (np.median(upper) > 0.11 and np.median(y) > 0.06) or np.percentile(peaks, 99) > 0.95
        valid = (upper > 0.04) & (upper < 0.40) & (peaks < 0.70)
        if not day or valid.sum() < 16:
            return {"bright_scale": 1.0}
        return {"bright_scale": float(np.clip(np.median(K.luma(*(a[f"v{c}"] for c in RGB))[:n][valid] / upper[valid]), 0.82, 1.0))}

    bands = [*RGB, *(f"v{c}" for c in RGB)]
    return with_bands(sampled(tiles, bands), scale, bands, scalars=["bright_scale"]).select("image", "bright_scale")


def bright_support(r: np.ndarray, g: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Fine bright detail, without glare and saturated highlights."""
    y = K.luma(r, g, b)
    return smooth(0.008, 0.035, y - K.box(y, radius)) * (1.0 - smooth(0.55, 0.80, np.maximum(np.maximum(r, g), b)))


def _radius(at_reference: int):
    return lambda h, w: max(2, round(at_reference * max(h, w) / REFERENCE_EDGE))


def _stepped(a: np.ndarray, peak: float | None) -> np.ndarray:
    return np.clip(np.rint(a * peak), 0, peak) / peak if peak else np.clip(a, 0.0, 1.0)


def protect_details(tiles: DataFrame, strength: float, peak: float | None = None) -> DataFrame:
    """Results vr, vg, vb of tiles that have r, g, b (source), vr, vg, vb (result) and shadow: dark detail is kept, bright structures don't glow.

    ``peak`` rounds results to that many steps.  Other bands stay.
    """
    scales = bright_targets(tiles).withColumnRenamed("image", "of")
    joined = tiles.join(scales.hint("merge"), tiles["image"].eqNullSafe(scales["of"])).drop("of")
    radius, results = _radius(DETAIL_RADIUS), [f"v{c}" for c in RGB]

    def make(a: Bands, f: Frame) -> Bands:
        source, result = np.stack([a[c] for c in RGB]), np.stack([a[c] for c in results])
        y, v = K.luma(*source), K.luma(*result)
        least = y * (1.0 - 0.05 * strength * (1.0 - smooth(0.06, 0.30, y)))
        result = result + (source - result) * np.clip((least - v) / np.maximum(y - v, 1e-6), 0.0, 1.0) * a["shadow"]
        result = result * np.minimum(1.0, y / np.maximum(K.luma(*result), 1e-6))
        target = f.scalars["bright_scale"]
        if target < 1.0:
            bright = bright_support(*source, radius(f.height, f.width)) * (K.luma(*result) > y * target)
            result = result + (source * target - result) * bright
        return dict(zip(results, _stepped(result, peak), strict=True))

    return windowed(joined, radius, make, [*RGB, *results, "shadow"], results, kept=[c for c in tiles.columns[6:] if c not in results and c != "shadow"], scalars=["bright_scale"])


def enhance_structure(tiles: DataFrame, strength: float, local_contrast: float = 0.25, naturalness: float = 0.70, peak: float | None = None, bands: Sequence[str] = RGB) -> DataFrame:
    """Luma detail of three bands amplified where the band structure says so, within narrow limits either way."""
    unit = lambda x: min(1.0, max(0.0, x))
    amount = 1.65 * unit(local_contrast) * unit(strength) * (1.20 - 0.30 * unit(naturalness))
    radius = _radius(STRUCTURE_RADIUS)
    if amount <= 1e-6:
        return tiles

    def make(a: Bands, f: Frame) -> Bands:
        y = K.luma(*(a[c] for c in bands))
        gain = (y - K.box(y, radius(f.height, f.width))) * amount * a["structure"]
        gain = np.clip(gain, -np.minimum(0.04 * y, 0.004), np.minimum(0.08 * y, 0.012))
        scale = np.clip(y + gain, 0.0, 1.0) / np.maximum(y, 1e-6)
        return {c: _stepped(a[c] * scale, peak) for c in bands}

    return windowed(tiles, radius, make, [*bands, "structure"], list(bands), kept=[c for c in tiles.columns[6:] if c not in bands and c != "structure"])


def protected(tiles: DataFrame, strength: float, local_contrast: float = 0.25, naturalness: float = 0.70, peak: float | None = None) -> DataFrame:
    """Both steps on tiles of a source (r, g, b) and a result (vr, vg, vb)."""
    ready = supports(tiles)
    return enhance_structure(protect_details(ready, strength, peak), strength, local_contrast, naturalness, peak, [f"v{c}" for c in RGB])

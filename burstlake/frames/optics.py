"""Lens corrections of tiles from tables of gain maps and warps (see burstlake.sources.opcodes)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import PLACE, Bands, Frame, _array, _rows, _schema, _values, windowed

#: Where highlights begin to be spared, as a share of full scale.
ONSET = 0.55


def with_gains(tiles: DataFrame, maps: DataFrame, bands: Sequence[str], spare_highlights: bool = False) -> DataFrame:
    """Bands (values 0 to 1, one for each of the map's planes) times their gains; images without a map stay as they are.

    maps: image, map, values.  Gains are read bilinearly at each pixel's place in the frame.  With ``spare_highlights`` the gain of a bright
    pixel is bent so that it levels out at full scale.
    """
    maps = maps.select(F.col("image").alias("of"), "map.points_v", "map.points_h", "map.spacing_v", "map.spacing_h", "map.origin_v", "map.origin_h", "map.map_planes", F.col("values").alias("gains"))
    joined = tiles.join(maps, tiles["image"].eqNullSafe(maps["of"]), "left")
    others = [c for c in tiles.columns if c not in PLACE and c not in bands]
    scalars = ["points_v", "points_h", "spacing_v", "spacing_h", "origin_v", "origin_h", "map_planes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list[np.ndarray]] = {b: [] for b in bands}
            for i, f in _rows(batch, scalars):
                own = [_values(batch.column(b), i).reshape(f.y1 - f.y0, f.x1 - f.x0) for b in bands]
                s = f.scalars
                if s["points_v"] is not None:
                    grid = _values(batch.column("gains"), i).reshape(int(s["points_v"]), int(s["points_h"]), int(s["map_planes"]))
                    y = np.clip(((np.arange(f.y0, f.y1) + 0.5) / f.height - s["origin_v"]) / s["spacing_v"], 0, grid.shape[0] - 1)
                    x = np.clip(((np.arange(f.x0, f.x1) + 0.5) / f.width - s["origin_h"]) / s["spacing_h"], 0, grid.shape[1] - 1)
                    iy, ix = np.floor(y).astype(int), np.floor(x).astype(int)
                    fy, fx = (y - iy)[:, None, None], (x - ix)[None, :, None]
                    jy, jx = np.minimum(iy + 1, grid.shape[0] - 1), np.minimum(ix + 1, grid.shape[1] - 1)
                    rows = grid[iy] * (1 - fy) + grid[jy] * fy
                    gain = rows[:, ix] * (1 - fx) + rows[:, jx] * fx
                    if spare_highlights:
                        z = 1 - (1 - np.clip(np.maximum.reduce(own) / ONSET, 0, 1))[:, :, None] ** 2
                        gain = np.where((gain == 0) & (z == 1), 1.0, gain)
                        gain = gain / (1 + (gain - 1) * z)
                    own = [np.clip(a * gain[:, :, min(k, gain.shape[2] - 1)], 0.0, 1.0) for k, a in enumerate(own)]
                for b, a in zip(bands, own, strict=True):
                    made[b].append(a)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*PLACE, *others)] + [_array(made[b], pa.float64()) for b in bands], names=[*PLACE, *others, *bands])

    return joined.mapInArrow(run, _schema(tiles, others, bands))


def _sources(f: Frame, k: Sequence[float], cx: float, cy: float, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pixels of these rows and columns come from."""
    centre_x, centre_y = f.width * cx, f.height * cy
    radius = np.hypot(max(centre_x, f.width - centre_x), max(centre_y, f.height - centre_y))
    dx, dy = columns - centre_x, rows - centre_y
    nx, ny = dx / radius, dy / radius
    r2 = np.minimum(nx * nx + ny * ny, 1.0)
    ratio = k[0] + r2 * (k[1] + r2 * (k[2] + r2 * k[3]))
    x = centre_x + dx * ratio + radius * (k[5] * (r2 + 2 * nx * nx) + 2 * k[4] * nx * ny)
    y = centre_y + dy * ratio + radius * (k[4] * (r2 + 2 * ny * ny) + 2 * k[5] * nx * ny)
    return np.clip(y, 0, f.height - 1), np.clip(x, 0, f.width - 1)


def farthest(height: int, width: int, coefficients: Sequence[float], cx: float, cy: float) -> int:
    """How far any pixel of a frame of this size is moved, on a mesh that is fine enough, and two pixels more."""
    f = Frame(height, width, 0, height, 0, width, 0, {})
    rows, columns = (np.unique(np.linspace(0, n - 1, min(n, 257))) for n in (height, width))
    most = 0.0
    for plane in range(3):
        y, x = _sources(f, coefficients[6 * plane : 6 * plane + 6], cx, cy, rows[:, None], columns[None, :])
        most = max(most, np.abs(y - rows[:, None]).max(), np.abs(x - columns[None, :]).max())
    mesh = max(1.0, (max(height, width) - 1) / 256)  # between two places of the mesh the shift changes by less than this
    return int(np.ceil(most + mesh)) + 2


def warped(tiles: DataFrame, warps: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Three bands with radial and tangential distortion taken out: bilinear, clamped at the frame.  Images without a warp are left out.

    warps: image, coefficients, centre_x, centre_y.  Each tile gets a margin as wide as the warp moves its image's pixels.
    """
    warps = warps.select(F.col("image").alias("of"), "coefficients", "centre_x", "centre_y")
    joined = tiles.join(warps, tiles["image"].eqNullSafe(warps["of"])).drop("of")
    ks = [f"k{i}" for i in range(18)]
    flat = joined.select(*tiles.columns, *[F.col("coefficients")[i].alias(k) for i, k in enumerate(ks)], "centre_x", "centre_y")

    def make(a: Bands, f: Frame) -> Bands:
        out = {}
        for plane, b in enumerate(bands):
            y, x = _sources(f, [f.scalars[k] for k in ks[6 * plane : 6 * plane + 6]], f.scalars["centre_x"], f.scalars["centre_y"], np.arange(f.y0, f.y1)[:, None], np.arange(f.x0, f.x1)[None, :])
            iy, ix = np.floor(y).astype(int), np.floor(x).astype(int)
            jy, jx = np.minimum(iy + 1, f.height - 1), np.minimum(ix + 1, f.width - 1)
            at = lambda r, c, w=a[b]: w[r - f.y0 + f.margin, c - f.x0 + f.margin]
            fx, fy = x - ix, y - iy
            out[b] = (at(iy, ix) * (1 - fx) + at(iy, jx) * fx) * (1 - fy) + (at(jy, ix) * (1 - fx) + at(jy, jx) * fx) * fy
        return out

    reach = lambda h, w, s: farthest(h, w, [s[k] for k in ks], s["centre_x"], s["centre_y"])
    return windowed(flat, reach, make, bands, bands, kept=[c for c in tiles.columns if c not in PLACE and c not in bands], scalars=[*ks, "centre_x", "centre_y"], whole_result=True, reach_by_scalars=True)

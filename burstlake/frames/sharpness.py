"""Sharpness and exposure of regions of images of any size.

A region's sharpness is the variance of its Laplacian (four neighbours) plus the mean of its squared gradient, with the
region mirrored at its own border.  Each tile, with a margin of one, adds up what it holds of each region; regions are put
together from a handful of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .tiles import PLACE, Bands, Frame, windowed

Region = tuple[int, int, int, int]
CENTRE, WHITE, BLACK = 0.6, 250, 5


def whole(height: int, width: int) -> list[Region]:
    """(x, y, width, height) of the regions of an image of this size; here the image itself."""
    return [(0, 0, width, height)]


def centre(height: int, width: int) -> list[Region]:
    """The middle 60 percent."""
    y, x = int(height * (1 - CENTRE) / 2), int(width * (1 - CENTRE) / 2)
    return [(x, y, width - 2 * x, height - 2 * y)]


def thirds(height: int, width: int) -> list[Region]:
    """Three rows of three."""
    ys, xs = ([round(n * k / 3) for k in range(4)] for n in (height, width))
    return [(xs[c], ys[r], xs[c + 1] - xs[c], ys[r + 1] - ys[r]) for r in range(3) for c in range(3)]


def _sums(window: np.ndarray, f: Frame, region: Region) -> list[float] | None:
    x0, y0, w, h = region
    ya, yb, xa, xb = max(y0, f.y0), min(y0 + h, f.y1), max(x0, f.x0), min(x0 + w, f.x1)
    if ya >= yb or xa >= xb:
        return None
    index = lambda lo, hi, start, n, by, first: start + K.mirrored(np.arange(lo, hi) - start + by, n) - first + f.margin
    rows = {k: index(ya, yb, y0, h, k, f.y0) for k in (-1, 0, 1)}
    cols = {k: index(xa, xb, x0, w, k, f.x0) for k in (-1, 0, 1)}
    n = {(x, y): window[np.ix_(rows[y], cols[x])] for x in (-1, 0, 1) for y in (-1, 0, 1)}
    lap = n[-1, 0] + n[1, 0] + n[0, -1] + n[0, 1] - 4 * n[0, 0]
    sx = n[1, -1] + 2 * n[1, 0] + n[1, 1] - n[-1, -1] - 2 * n[-1, 0] - n[-1, 1]
    sy = n[-1, 1] + 2 * n[0, 1] + n[1, 1] - n[-1, -1] - 2 * n[0, -1] - n[1, -1]
    return [lap.size, lap.sum(), (lap * lap).sum(), (sx * sx + sy * sy).sum()]


def region_sharpness(tiles: DataFrame, regions: Callable[[int, int], list[Region]], band: str = "gray") -> DataFrame:
    """image, region (number) and sharpness."""

    def sums(window: Bands, f: Frame) -> Bands:
        # One row of five numbers per region stands in for the tile's own values.
        found = [(k, s) for k, region in enumerate(regions(f.height, f.width)) if (s := _sums(window[band], f, region))]
        return {"sums": np.array([[k, *s] for k, s in found]).reshape(-1, 5)}

    parts = windowed(tiles, 1, sums, [band], ["sums"], whole_result=True)
    five = F.transform(F.sequence(F.lit(1), F.size("sums"), F.lit(5)), lambda i: F.slice("sums", i, 5))
    rows = parts.where(F.size("sums") > 0).select("image", F.explode(five).alias("s"))
    total = rows.groupBy("image", F.col("s")[0].cast("int").alias("region")).agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(1, 5)])
    mean = F.col("s2") / F.col("s1")
    return total.select("image", "region", (F.col("s3") / F.col("s1") - mean * mean + F.col("s4") / F.col("s1")).alias("sharpness"))


def exposure(tiles: DataFrame, band: str = "gray") -> DataFrame:
    """image and exposure, 0 to 1: white places (250 and more of 255) count against it twice, black ones (5 and less) by half."""
    narrow = tiles.select(*PLACE, band)
    schema = T.StructType([tiles.schema["image"]]).add("n", "long").add("white", "long").add("black", "long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(band)[i].values.to_numpy() for i in range(batch.num_rows)]
            counts = [[len(v) for v in values], [int((v >= WHITE).sum()) for v in values], [int((v <= BLACK).sum()) for v in values]]
            yield pa.RecordBatch.from_arrays([batch.column("image"), *[pa.array(c, pa.int64()) for c in counts]], names=schema.names)

    got = narrow.mapInArrow(counted, schema).groupBy("image").agg(*[F.sum(c).alias(c) for c in ("n", "white", "black")])
    raw = 1.0 - 2.0 * F.col("white") / F.col("n") - 0.5 * F.col("black") / F.col("n")
    return got.select("image", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("exposure"))

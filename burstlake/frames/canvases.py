"""Small versions of large images: area means and regular samples of bounded size, one row per image, and back to tiles.

Scene decisions are made on a version of at most ``ANALYSIS_EDGE`` places along its longer side, whatever the image's size; so
one row per image is bounded (some 5 MB a band).  Tiles reduce themselves; only what is reduced is exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .tiles import PLACE, Bands, Frame, _array, _rows, _schema, _values, pieces

ANALYSIS_EDGE = 768
Size = Callable[[int, int], tuple[int, int]]


def analysis_size(height: int, width: int) -> tuple[int, int]:
    scale = min(1.0, ANALYSIS_EDGE / max(height, width))
    return max(1, round(height * scale)), max(1, round(width * scale))


def sample_step(height: int, width: int) -> int:
    return max(1, round(max(height, width) / ANALYSIS_EDGE))


def _gathered(tiles: DataFrame, bands: Sequence[str], size: Size, part: Callable[[np.ndarray, Frame], tuple[int, int, np.ndarray]]) -> DataFrame:
    """image, height, width, rows, cols and the bands: the parts of an image's tiles added up on a canvas."""
    narrow = tiles.select(*PLACE, *bands)
    sent, out = (T.StructType([tiles.schema[c] for c in PLACE[:3]]) for _ in range(2))
    out = out.add("rows", "integer").add("cols", "integer")
    for c in ("py", "px", "ph", "pw"):
        sent = sent.add(c, "integer")
    for b in bands:
        sent, out = sent.add(b, T.ArrayType(T.DoubleType())), out.add(b, T.ArrayType(T.DoubleType()))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at, parts = [], {b: [] for b in bands}
            for i, f in _rows(batch, ()):
                for b in bands:
                    y, x, block = part(_values(batch.column(b), i).reshape(f.y1 - f.y0, f.x1 - f.x0), f)
                    parts[b].append(block)
                at.append((y, x, *block.shape))
            places = [pa.array([a[k] for a in at], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in PLACE[:3]] + places + [_array(parts[b], pa.float64()) for b in bands], names=sent.names)

    def added(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        h, w = size(table.column("height")[0].as_py(), table.column("width")[0].as_py())
        whole = {b: np.zeros((h, w)) for b in bands}
        places = [table.column(c).to_pylist() for c in ("py", "px", "ph", "pw")]
        for i, (y, x, ph, pw) in enumerate(zip(*places, strict=True)):
            for b in bands:
                whole[b][y : y + ph, x : x + pw] += _values(table.column(b).chunk(0), i).reshape(ph, pw)
        row = table.slice(0, 1)
        sizes = [pa.array([h], pa.int32()), pa.array([w], pa.int32())]
        return pa.table([row.column(c) for c in PLACE[:3]] + sizes + [_array([whole[b]], pa.float64()) for b in bands], names=out.names)

    return narrow.mapInArrow(reduced, sent).groupBy(*PLACE[:3]).applyInArrow(added, out)


def reduced(tiles: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Area means of at most ANALYSIS_EDGE places along the longer side; smaller images as they are."""

    def part(a: np.ndarray, f: Frame) -> tuple[int, int, np.ndarray]:
        h, w = analysis_size(f.height, f.width)
        y, rows = K.area_weights(f.height, h, f.y0, f.y1)
        x, cols = K.area_weights(f.width, w, f.x0, f.x1)
        return y, x, rows @ a @ cols.T

    return _gathered(tiles, bands, analysis_size, part)


def sampled(tiles: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Every n-th place of every n-th row, n so that about ANALYSIS_EDGE places remain along the longer side."""
    size = lambda h, w: tuple(-(-n // sample_step(h, w)) for n in (h, w))

    def part(a: np.ndarray, f: Frame) -> tuple[int, int, np.ndarray]:
        s = sample_step(f.height, f.width)
        return -(-f.y0 // s), -(-f.x0 // s), a[-f.y0 % s :: s, -f.x0 % s :: s]

    return _gathered(tiles, bands, size, part)


def with_bands(canvas: DataFrame, make: Callable[[Bands], dict[str, np.ndarray | float]], read: Sequence[str], bands: Sequence[str] = (), lines: Sequence[str] = (), scalars: Sequence[str] = ()) -> DataFrame:
    """image, height, width, rows, cols and new bands, lines (one value per column) and numbers of each canvas."""
    names = ["image", "height", "width", "rows", "cols"]
    out = T.StructType([canvas.schema[c] for c in names])
    for c in (*bands, *lines):
        out = out.add(c, T.ArrayType(T.DoubleType()))
    for c in scalars:
        out = out.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shape = batch.column("rows")[i].as_py(), batch.column("cols")[i].as_py()
                got = make({b: _values(batch.column(b), i).reshape(shape) for b in read})
                arrays = [_array([np.asarray(got[c])], pa.float64()) for c in (*bands, *lines)] + [pa.array([float(got[c])], pa.float64()) for c in scalars]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, 1) for c in names] + arrays, names=out.names)

    return canvas.select(*names, *read).mapInArrow(run, out)


def laid_over(tiles: DataFrame, canvas: DataFrame, bands: Sequence[str]) -> DataFrame:
    """The tiles with bands of the canvas enlarged linearly to the image; each tile is sent the part that it needs.

    Spark can't foresee the size of what Python makes, and would take canvases or tiles for small enough to be broadcast: tiles are joined by sorting.
    """
    edge = tiles.select("image", "edge").dropDuplicates(["image"]).withColumnRenamed("image", "of")
    wide = canvas.join(edge.hint("merge"), canvas["image"].eqNullSafe(edge["of"])).select("image", "height", "width", "edge", "rows", "cols", *bands)
    crop = T.StructType([wide.schema["image"]])
    for c in ("y0", "x0", "py", "px", "ph", "pw", "low_rows", "low_cols"):
        crop = crop.add(c, "integer")
    for b in bands:
        crop = crop.add(f"low_{b}", T.ArrayType(T.DoubleType()))

    def crops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, e, rows, cols = (batch.column(c)[i].as_py() for c in ("height", "width", "edge", "rows", "cols"))
                whole = [_values(batch.column(b), i).reshape(rows, cols) for b in bands]
                for y in range(0, h, e):
                    ya, yb = K.stretch_needs(rows, h, y, min(h, y + e))
                    need = [(x, *K.stretch_needs(cols, w, x, min(w, x + e))) for x in range(0, w, e)]
                    n = len(need)
                    ints = [[y] * n, [x for x, *_ in need], [ya] * n, [a for _, a, _ in need], [yb - ya] * n, [b - a for _, a, b in need], [rows] * n, [cols] * n]
                    image = batch.column("image").take(pa.array([i] * n, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [image, *[pa.array(c, pa.int32()) for c in ints], *[_array([a[ya:yb, xa:xb] for _, xa, xb in need], pa.float64()) for a in whole]], names=crop.names
                    )

    small = wide.mapInArrow(crops, crop)
    small = small.select([small[c].alias({"image": "of", "y0": "oy", "x0": "ox"}.get(c, c)) for c in small.columns])
    joined = tiles.join(small.hint("merge"), tiles["image"].eqNullSafe(small["of"]) & (tiles["y0"] == small["oy"]) & (tiles["x0"] == small["ox"])).drop("of", "oy", "ox")
    others = [c for c in tiles.columns if c not in PLACE and c not in bands]

    def enlarged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made: dict[str, list[np.ndarray]] = {b: [] for b in bands}
            for i, f in _rows(batch, ()):
                py, px, ph, pw, rows, cols = (batch.column(c)[i].as_py() for c in ("py", "px", "ph", "pw", "low_rows", "low_cols"))
                for b in bands:
                    a = K.stretched(_values(batch.column(f"low_{b}"), i).reshape(ph, pw), py, rows, f.height, f.y0, f.y1, 0)
                    made[b].append(K.stretched(a, px, cols, f.width, f.x0, f.x1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*PLACE, *others)] + [_array(made[b], pa.float64()) for b in bands], names=[*PLACE, *others, *bands])

    return joined.mapInArrow(enlarged, _schema(tiles, others, bands))

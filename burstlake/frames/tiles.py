"""Images of any size as tables of tiles.

A tile table has one row per tile: ``image`` (any key), the image's ``height`` and ``width``, the ``edge`` of its tiles, the
tile's first row and column ``y0`` and ``x0``, and one array of doubles per band, row by row.  Tiles at the right and lower
border are smaller.  Columns of one value per tile or image may stand beside them.

``windowed`` gives a function each tile with a margin.  Each tile sends its neighbours the strips that their
margins need (an exchange of tiles and strips by tile, no more), and margins outside the image are mirrored at the
border without repeating the border cells.  Filters of several steps need one exchange with the sum of their reaches: mirrored
margins stay mirrored under filters, so the core is what the whole image would give, and there are no seams.

Defined results: an image without values has no tile; tiles of one place given twice are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = 256
#: Bytes of a batch that are worked on, and sent on, at once.
PIECE = 4 << 20
PLACE = ("image", "height", "width", "edge", "y0", "x0")
Bands = dict[str, np.ndarray]
Reach = int | Callable[..., int]


@dataclass(frozen=True)
class Frame:
    """Where a tile or window lies: the tile's rows y0..y1 and columns x0..x1 in an image, with a margin around it."""

    height: int
    width: int
    y0: int
    y1: int
    x0: int
    x1: int
    margin: int
    scalars: dict[str, float]

    @property
    def rows(self) -> np.ndarray:
        """Row numbers of the window, as a column; margins outside the image have numbers outside it."""
        return np.arange(self.y0 - self.margin, self.y1 + self.margin)[:, None]

    @property
    def columns(self) -> np.ndarray:
        return np.arange(self.x0 - self.margin, self.x1 + self.margin)[None, :]

    def core(self, a: np.ndarray) -> np.ndarray:
        m = self.margin
        return a[m : a.shape[0] - m, m : a.shape[1] - m] if m else a


def _values(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _rows(part: pa.RecordBatch | pa.Table, scalars: Sequence[str]) -> Iterator[tuple[int, Frame]]:
    places = {c: part.column(c).to_pylist() for c in (*PLACE[1:], *scalars)}
    for i in range(part.num_rows):
        h, w, e, y0, x0 = (places[c][i] for c in PLACE[1:])
        yield i, Frame(h, w, y0, min(h, y0 + e), x0, min(w, x0 + e), 0, {c: places[c][i] for c in scalars})


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some PIECE bytes: what is made of one stays small however many rows Spark sends at once."""
    for batch in batches:
        n = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


def _array(parts: list[np.ndarray], to: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([p.size for p in parts])]).astype(np.int32)
    flat = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, to))


def _schema(tiles: DataFrame, kept: Sequence[str], bands: Sequence[str]) -> T.StructType:
    out = T.StructType([tiles.schema[c] for c in (*PLACE, *kept)])
    for b in bands:
        out = out.add(b, T.ArrayType(T.DoubleType()))
    return out


def cut(images: DataFrame, bands: Sequence[str], edge: int = EDGE) -> DataFrame:
    """Tiles of a table of whole small images: image, height, width and one array of values per band."""
    shape = images.select("image", F.col("height").cast("int"), F.col("width").cast("int"), *[F.col(b).cast("array<double>").alias(b) for b in bands])
    return drawn(shape, lambda a, h, w: {b: a[b].reshape(h, w) for b in bands}, bands, bands, edge)


def drawn(images: DataFrame, make: Callable[[Bands, int, int], Bands], read: Sequence[str], bands: Sequence[str], edge: int = EDGE) -> DataFrame:
    """Tiles of small images (image, height, width and the arrays ``read``) that make draws: arrays of height x width, one per band."""
    shape = images.select("image", F.col("height").cast("int"), F.col("width").cast("int"), *read).where("height > 0 AND width > 0")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                got = make({c: _values(batch.column(c), i) for c in read}, h, w)
                whole = [got[b] for b in bands]
                at = [(y, x) for y in range(0, h, edge) for x in range(0, w, edge)]
                n = len(at)
                key = batch.column(0).take(pa.array([i] * n, pa.int32()))
                ints = [pa.array(c, pa.int32()) for c in ([h] * n, [w] * n, [edge] * n, [y for y, _ in at], [x for _, x in at])]
                yield pa.RecordBatch.from_arrays([key, *ints, *[_array([a[y : y + edge, x : x + edge] for y, x in at], pa.float64()) for a in whole]], names=[*PLACE, *bands])

    out = T.StructType([shape.schema["image"]])
    for c in PLACE[1:]:
        out = out.add(c, "integer")
    for b in bands:
        out = out.add(b, T.ArrayType(T.DoubleType()))
    return shape.mapInArrow(tiles, out)


def from_pixels(pixels: DataFrame, bands: Sequence[str], edge: int = EDGE) -> DataFrame:
    """Tiles of a table of pixels: image, height, width, y, x and one number per band; a tile's pixels meet in one task."""
    at = lambda c: (F.floor(F.col(c) / edge) * edge).cast("int")
    key = [F.col("image"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.lit(edge).alias("edge"), at("y").alias("y0"), at("x").alias("x0")]
    listed = F.array_sort(F.collect_list(F.struct("y", "x", *bands)))
    tiles = pixels.groupBy(*key).agg(listed.alias("p"))
    of = lambda b: F.transform("p", lambda v: v[b].cast("double")).alias(b)
    return tiles.select(*PLACE, *map(of, bands))


def to_pixels(tiles: DataFrame, bands: Sequence[str]) -> DataFrame:
    """image, y, x and the bands, one row per pixel."""
    cols = F.least(F.col("edge"), F.col("width") - F.col("x0"))
    flat = tiles.select("image", "y0", "x0", cols.alias("cols"), F.posexplode(F.arrays_zip(*bands)).alias("p", "v"))
    y, x = F.col("y0") + F.floor(F.col("p") / F.col("cols")), F.col("x0") + F.col("p") % F.col("cols")
    return flat.select("image", y.cast("int").alias("y"), x.cast("int").alias("x"), *[F.col("v")[b].alias(b) for b in bands])


def mapped(tiles: DataFrame, make: Callable[[Bands, Frame], Bands], read: Sequence[str], made: Sequence[str], kept: Sequence[str] = (), scalars: Sequence[str] = ()) -> DataFrame:
    """New bands of each tile from its own values; no exchange."""
    keep = [c for c in tiles.columns if c in kept]
    narrow = tiles.select(*PLACE, *dict.fromkeys((*keep, *scalars, *read)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: dict[str, list[np.ndarray]] = {b: [] for b in made}
            for i, f in _rows(batch, scalars):
                shape = (f.y1 - f.y0, f.x1 - f.x0)
                for b, a in make({b: _values(batch.column(b), i).reshape(shape) for b in read}, f).items():
                    out[b].append(np.broadcast_to(a, shape))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*PLACE, *keep)] + [_array(out[b], pa.float64()) for b in made], names=[*PLACE, *keep, *made])

    return narrow.mapInArrow(run, _schema(tiles, keep, made))


def _overlap(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return max(a[0], b[0]), min(a[1], b[1])


def windowed(
    tiles: DataFrame, reach: Reach, make: Callable[[Bands, Frame], Bands], read: Sequence[str], made: Sequence[str], kept: Sequence[str] = (), scalars: Sequence[str] = (),
    whole_result: bool = False, reach_by_scalars: bool = False,
) -> DataFrame:
    """New bands of each tile from a window that is ``reach`` wider on all sides (a number, or a function of height and width).

    ``make`` gets the windows of the bands ``read`` and returns arrays of the window's size, of which the core is taken.
    With ``whole_result`` they are arrays of any size and taken whole.  With ``reach_by_scalars`` the reach is a function of height, width and
    the scalars, which have to be the same for all tiles of an image.  Columns ``kept`` and ``scalars`` (numbers per tile that make sees) go along with the tile itself only.
    """
    given = reach if callable(reach) else lambda h, w: reach
    reach_of = given if reach_by_scalars else lambda h, w, s: given(h, w)
    keep = [c for c in tiles.columns if c in kept]
    beside = [c for c in dict.fromkeys((*keep, *scalars)) if c not in read]
    narrow = tiles.select(*PLACE, *beside, *read)
    key, strip = [*PLACE], T.StructType([tiles.schema[c] for c in PLACE]).add("sy", "integer").add("sx", "integer").add("sh", "integer").add("sw", "integer")
    for c in beside:
        strip = strip.add(c, tiles.schema[c].dataType)
    for b in read:
        strip = strip.add(f"s_{b}", T.ArrayType(T.DoubleType()))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, f in _rows(batch, scalars if reach_by_scalars else ()):
                e, r = batch.column("edge")[i].as_py(), reach_of(f.height, f.width, f.scalars)
                own = {b: _values(batch.column(b), i).reshape(f.y1 - f.y0, f.x1 - f.x0) for b in read}
                to: list[tuple[int, ...]] = []
                parts: dict[str, list[np.ndarray]] = {b: [] for b in read}
                near = lambda lo, hi, n: range(max(0, lo - r) // e * e, min(n, hi + r), e)
                for ty in near(f.y0, f.y1, f.height):
                    for tx in near(f.x0, f.x1, f.width):
                        ya, yb = _overlap((f.y0, f.y1), (ty - r, min(f.height, ty + e) + r))
                        xa, xb = _overlap((f.x0, f.x1), (tx - r, min(f.width, tx + e) + r))
                        if ya < yb and xa < xb:
                            to.append((ty, tx, ya, xa, yb - ya, xb - xa))
                            for b, a in own.items():
                                parts[b].append(a[ya - f.y0 : yb - f.y0, xa - f.x0 : xb - f.x0])
                n, mine = len(to), [t[0] == f.y0 and t[1] == f.x0 for t in to]
                same = pa.array([i] * n, pa.int32())
                head = [batch.column(c).take(same) for c in PLACE[:4]] + [pa.array([t[k] for t in to], pa.int32()) for k in range(6)]
                own_only = pa.array([i if m else None for m in mine], pa.int32())
                extra = [batch.column(c).take(same if reach_by_scalars and c in scalars else own_only) for c in beside]
                yield pa.RecordBatch.from_arrays([*head, *extra, *[_array(parts[b], pa.float64()) for b in read]], names=strip.names)

    def put_together(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        places = {c: table.column(c).to_pylist() for c in ("sy", "sx", "sh", "sw")}
        _, f = next(_rows(table.slice(0, 1), scalars if reach_by_scalars else ()))
        r = reach_of(f.height, f.width, f.scalars)
        (ya, yb), (xa, xb) = _overlap((0, f.height), (f.y0 - r, f.y1 + r)), _overlap((0, f.width), (f.x0 - r, f.x1 + r))
        windows = {b: np.zeros((yb - ya, xb - xa)) for b in read}
        own = None
        for i in range(table.num_rows):
            sy, sx, sh, sw = (places[c][i] for c in ("sy", "sx", "sh", "sw"))
            if (sy, sx, sh, sw) == (f.y0, f.x0, f.y1 - f.y0, f.x1 - f.x0):
                if own is not None:
                    raise ValueError(f"two tiles at row {f.y0} and column {f.x0} of one image")
                own = i
            for b in read:
                windows[b][sy - ya : sy - ya + sh, sx - xa : sx - xa + sw] = _values(table.column(f"s_{b}").chunk(0), i).reshape(sh, sw)
        if own is None:
            return pa.table({n: pa.array([], t) for n, t in zip(out_names, out_types(table), strict=True)})  # strips of a tile that is not there
        pads = ((ya - f.y0 + r, f.y1 + r - yb), (xa - f.x0 + r, f.x1 + r - xb))
        windows = {b: np.pad(a, pads, mode="reflect") for b, a in windows.items()}
        frame = Frame(f.height, f.width, f.y0, f.y1, f.x0, f.x1, r, {c: table.column(c)[own].as_py() for c in scalars})
        result = make(windows, frame)
        row = table.slice(own, 1)
        return pa.table([row.column(c if c in beside or c in PLACE else f"s_{c}") for c in (*PLACE, *keep)] + [_array([result[b] if whole_result else frame.core(result[b])], pa.float64()) for b in made], names=out_names)

    out_names = [*PLACE, *keep, *made]

    def out_types(table: pa.Table) -> list[pa.DataType]:
        return [table.schema.field(c if c in beside or c in PLACE else f"s_{c}").type for c in (*PLACE, *keep)] + [pa.list_(pa.float64())] * len(made)

    return narrow.mapInArrow(dealt, strip).groupBy(*key).applyInArrow(put_together, _schema(tiles, keep, made))

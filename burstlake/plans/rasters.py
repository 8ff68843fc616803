"""Small images as arrays in one row: neighbourhoods, statistics and fields without any join or exchange.

A ``Picture`` is a query that grows by columns.  An image of h x w values is one array, row by row; the channels of a
photo are the arrays r, g, b, and l is their luma.  Filters along an axis are products with a constant matrix, which
covers means and Gaussians of any width and mirrored borders alike.
"""

from __future__ import annotations

import math

from .dialect import Dialect
from .views import photos

EDGE = 8
LUMA = (0.2126, 0.7152, 0.0722)


def mirrored(i: int, n: int) -> int:
    """An index outside 0..n-1 mirrored at the border without repeating the border cell."""
    i = abs(i) % max(1, 2 * n - 2)
    return i if i < n else 2 * n - 2 - i


def spread(n: int, weights: list[float]) -> list[list[float]]:
    """The n x n matrix of a filter with these weights around each place, mirrored at the border."""
    out = [[0.0] * n for _ in range(n)]
    reach = len(weights) // 2
    for i in range(n):
        for o, w in enumerate(weights):
            out[i][mirrored(i + o - reach, n)] += w
    return out


def box(n: int, radius: int) -> list[list[float]]:
    return spread(n, [1 / (2 * radius + 1)] * (2 * radius + 1))


def gauss(n: int, sigma: float) -> list[list[float]]:
    """A Gaussian that reaches four sigma."""
    reach = (round(sigma * 8 + 1) | 1) // 2
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-reach, reach + 1)]
    return spread(n, [w / sum(raw) for w in raw])


def clip(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"greatest({low}, least({high}, {x}))"


def smooth(x: str, low: float, high: float) -> str:
    """0 below low, 1 above high, and a cubic with level ends in between."""
    t = clip(f"(({x}) - ({low!r})) / CAST({high - low:.10g} AS DOUBLE)")
    return f"({t} * {t} * (3.0 - 2.0 * {t}))"


def luma_of(r: str, g: str, b: str) -> str:
    return f"({LUMA[0]} * {r} + {LUMA[1]} * {g} + {LUMA[2]} * {b})"


class Raster:
    """Expressions over arrays of h x w values."""

    def __init__(self, d: Dialect, h: int = EDGE, w: int = EDGE) -> None:
        self.d, self.h, self.w, self.n = d, h, w, h * w

    def map(self, body, var: str = "p") -> str:
        """The array of body(p) at all places p."""
        return self.d.each(self.d.range(self.n), var, body(var))

    def where(self, test, var: str = "p") -> str:
        """The places where the test holds, in order."""
        return self.d.keep(self.d.range(self.n), var, test(var))

    def take(self, array: str, places: str, var: str = "q") -> str:
        return self.d.each(places, var, self.d.at(array, var))

    def x(self, p: str = "p") -> str:
        if self.d.spark and self.w & (self.w - 1) == 0:
            return f"({p} & {self.w - 1})"
        return f"({p} % {self.w})"

    def y(self, p: str = "p") -> str:
        if self.d.spark and self.w & (self.w - 1) == 0:
            return f"shiftright({p}, {self.w.bit_length() - 1})"
        return self.d.div(p, str(self.w))

    def beside(self, array: str, dx: int, dy: int, p: str = "p") -> str:
        """The value dx, dy away from place p, mirrored at the border."""
        if self.d.spark:
            places = [self.w * mirrored(q // self.w + dy, self.h) + mirrored(q % self.w + dx, self.w) for q in range(self.n)]
            return self.d.at(array, self.d.at(self.d.list(*map(str, places)), p))
        col = f"({self.w - 1} - abs({self.w - 1} - abs({self.x(p)} + ({dx}))))"
        row = f"({self.h - 1} - abs({self.h - 1} - abs({self.y(p)} + ({dy}))))"
        return self.d.at(array, f"{self.w} * {row} + {col}")

    def _constants(self, matrix: list[list[float]]) -> str:
        return self.d.list(*[f"CAST({v!r} AS DOUBLE)" for row in matrix for v in row])

    # Spark goes through lambdas term by term, so its forms have no arithmetic of places: rows and columns are arrays, and a
    # product with a matrix is a product of arrays.  Terms are added up in the same order.

    def _rows(self, array: str) -> str:
        return f"transform(sequence(0, {self.h - 1}), y_ -> slice({array}, {self.w} * y_ + 1, {self.w}))"

    def _columns(self, array: str) -> str:
        return f"transform(sequence(0, {self.w - 1}), x_ -> transform(sequence(0, {self.h - 1}), y_ -> get({array}, {self.w} * y_ + x_)))"

    def _matrix(self, matrix: list[list[float]]) -> str:
        return self.d.list(*[self.d.list(*[f"CAST({v!r} AS DOUBLE)" for v in row]) for row in matrix])

    def _product(self, a: str, b: str) -> str:
        return self.d.total(f"zip_with({a}, {b}, (u_, v_) -> u_ * v_)")

    def along_rows(self, array: str, matrix: list[list[float]]) -> str:
        if self.d.spark:
            return f"flatten(transform({self._rows(array)}, l_ -> transform({self._matrix(matrix)}, k_ -> {self._product('k_', 'l_')})))"
        k = self._constants(matrix)
        terms = [f"{self.d.at('k_', f'{self.x()} * {self.w} + {j}')} * {self.d.at(array, f'{self.y()} * {self.w} + {j}')}" for j in range(self.w)]
        return self.d.let(k, "k_", self.map(lambda p: " + ".join(terms)))

    def along_columns(self, array: str, matrix: list[list[float]]) -> str:
        if self.d.spark:
            return self.d.let(self._columns(array), "c_", f"flatten(transform({self._matrix(matrix)}, k_ -> transform(c_, l_ -> {self._product('k_', 'l_')})))")
        k = self._constants(matrix)
        terms = [f"{self.d.at('k_', f'{self.y()} * {self.h} + {j}')} * {self.d.at(array, f'{j} * {self.w} + {self.x()}')}" for j in range(self.h)]
        return self.d.let(k, "k_", self.map(lambda p: " + ".join(terms)))

    def extreme(self, array: str, radius: int, most: bool, rows: bool) -> str:
        """The largest or smallest value up to ``radius`` away along one axis, inside the image."""
        d = self.d
        if d.spark:
            size = self.w if rows else self.h
            ends = [(max(0, i - radius), min(size - 1, i + radius)) for i in range(size)]
            near = d.list(*[d.record(a=str(lo + 1), n=str(hi - lo + 1)) for lo, hi in ends])
            best = f"{'array_max' if most else 'array_min'}(slice(l_, n_.a, n_.n))"
            if rows:
                return f"flatten(transform({self._rows(array)}, l_ -> transform({near}, n_ -> {best})))"
            return d.let(self._columns(array), "c_", f"flatten(transform({near}, n_ -> transform(c_, l_ -> {best})))")
        here, n = (self.x(), self.w) if rows else (self.y(), self.h)
        place = f"{self.y()} * {self.w} + j" if rows else f"j * {self.w} + {self.x()}"
        near = d.keep(d.range(n), "j", f"abs(j - {here}) <= {radius}")
        values = d.each(near, "j", d.at(array, place))
        return self.map(lambda p: d.most_of(values) if most else d.least_of(values))


class Picture:
    """A query of one row per photo that grows by columns."""

    def __init__(self, d: Dialect, sql: str) -> None:
        self.d, self.sql = d, sql

    def add(self, **columns: str) -> Picture:
        return Picture(self.d, self.d.levels(self.sql, **columns))

    def filtered(self, rows: list[list[float]], columns: list[list[float]], **arrays: str) -> Picture:
        """New arrays: the named ones filtered along rows, then along columns."""
        r = Raster(self.d, len(columns), len(rows))
        one = self.add(**{f"{n}_h": r.along_rows(a, rows) for n, a in arrays.items()})
        return one.add(**{n: r.along_columns(f"{n}_h", columns) for n in arrays})

    def stretched(self, radius: int, most: bool, h: int = EDGE, w: int = EDGE, **arrays: str) -> Picture:
        """New arrays: the largest (or smallest) value in a square around each place."""
        r = Raster(self.d, h, w)
        one = self.add(**{f"{n}_h": r.extreme(a, radius, most, True) for n, a in arrays.items()})
        return one.add(**{n: r.extreme(f"{n}_h", radius, most, False) for n in arrays})

    def select(self, columns: str) -> str:
        return f"SELECT {columns} FROM ({self.sql})"

    def pixels(self, columns: str, n: int = EDGE * EDGE, w: int = EDGE) -> str:
        """One row per pixel: columns may use p, x and y."""
        d = self.d
        return f"SELECT {columns} FROM (SELECT *, CAST(p % {w} AS INT) AS x, CAST({d.div('p', str(w))} AS INT) AS y FROM ({self.sql}) {d.series(n, 'p')})"


def planes(d: Dialect, scale: float = 1.0) -> Picture:
    """shot_id, folder, captured_at and the arrays r, g, b, l: three rotations of the gray image as channels."""
    r = Raster(d)
    channel = lambda k: r.map(lambda p: f"{d.at('gray', f'(p + {k}) % 64')} / CAST(255 AS DOUBLE) * {scale!r}")
    one = Picture(d, photos(d)).add(r=channel(0), g=channel(9), b=channel(18))
    return one.add(l=r.map(lambda p: luma_of(*(d.at(c, p) for c in "rgb"))))


# ---- detail of a photo ----------------------------------------------------------------------------------------------

#: Thirds of the edge, and the central 60 percent: what is cut off is floor(edge * 0.4 / 2).
THIRDS = [round(EDGE * k / 3) for k in range(4)]
GRID = [(THIRDS[c], THIRDS[r], THIRDS[c + 1] - THIRDS[c], THIRDS[r + 1] - THIRDS[r]) for r in range(3) for c in range(3)]
_CUT = int(EDGE * 0.4 / 2)
WHOLE, CENTRE = [(0, 0, EDGE, EDGE)], [(_CUT, _CUT, EDGE - 2 * _CUT, EDGE - 2 * _CUT)]


def _places(region: tuple[int, int, int, int]) -> list[int]:
    x0, y0, w, h = region
    return [EDGE * y + x for y in range(y0, y0 + h) for x in range(x0, x0 + w)]


def with_gradients(p: Picture, regions: list[tuple[int, int, int, int]], to: str) -> Picture:
    """to + _lap (four neighbours), _lap3 (3 x 3) and _sob (squared gradient) of gray; each region is mirrored at its own border."""
    d, r = p.d, Raster(p.d)
    where = {q: region for region in regions for q in _places(region)}

    def beside(dx: int, dy: int) -> str:
        index = []
        for q in range(EDGE * EDGE):
            x0, y0, w, h = where.get(q, (q % EDGE, q // EDGE, 1, 1))
            index.append(EDGE * (y0 + mirrored(q // EDGE - y0 + dy, h)) + x0 + mirrored(q % EDGE - x0 + dx, w))
        return d.at("gray", d.at(d.list(*map(str, index)), "p"))

    n = {(dx, dy): beside(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
    sx = f"({n[1, -1]} + 2 * {n[1, 0]} + {n[1, 1]} - {n[-1, -1]} - 2 * {n[-1, 0]} - {n[-1, 1]})"
    sy = f"({n[-1, 1]} + 2 * {n[0, 1]} + {n[1, 1]} - {n[-1, -1]} - 2 * {n[0, -1]} - {n[1, -1]})"
    p = p.add(**{f"{to}_sx": r.map(lambda q: sx), f"{to}_sy": r.map(lambda q: sy)})
    at = lambda a: f"CAST({d.at(f'{to}_{a}', 'p')} AS DOUBLE)"
    return p.add(**{
        f"{to}_lap": r.map(lambda q: f"CAST({n[-1, 0]} + {n[1, 0]} + {n[0, -1]} + {n[0, 1]} - 4 * {n[0, 0]} AS DOUBLE)"),
        f"{to}_lap3": r.map(lambda q: f"CAST(2 * ({n[-1, -1]} + {n[1, -1]} + {n[-1, 1]} + {n[1, 1]}) - 8 * {n[0, 0]} AS DOUBLE)"),
        f"{to}_sob": r.map(lambda q: f"{at('sx')} * {at('sx')} + {at('sy')} * {at('sy')}"),
    })


def detail(d: Dialect, to: str, region: tuple[int, int, int, int]) -> str:
    """Variance of the Laplacian and mean squared gradient of a region."""
    r, places = Raster(d), d.list(*map(str, _places(region)))
    lap = r.take(f"{to}_lap", places)
    variance = d.let(lap, "v_", f"({d.mean(d.each('v_', 'u', 'u * u'))} - pow({d.mean('v_')}, 2))")
    return f"({variance} + {d.mean(r.take(f'{to}_sob', places, 'w'))})"


def with_cells(p: Picture) -> Picture:
    """cells: the detail of each of 3 x 3 regions."""
    p = with_gradients(p, GRID, "grid")
    return p.add(cells=p.d.list(*[detail(p.d, "grid", g) for g in GRID]))


def with_absolute(p: Picture) -> Picture:
    """quality, 0 to 1: 90th percentiles of 3 x 3 Laplacian and gradient on a 0 to 1 image, gated by texture."""
    d, r = p.d, Raster(p.d)
    p = with_gradients(p, WHOLE, "whole")
    p = p.add(lap90=d.quantile(r.map(lambda q: f"abs({d.at('whole_lap3', q)}) / 255"), 0.9), grad90=d.quantile(r.map(lambda q: f"sqrt({d.at('whole_sob', q)}) / 255"), 0.9))
    unit = r.map(lambda q: f"{d.at('gray', q)} / CAST(255 AS DOUBLE)")
    spread = d.let(unit, "v_", f"sqrt(greatest(0.0, {d.mean(d.each('v_', 'u', 'u * u'))} - pow({d.mean('v_')}, 2)))")
    p = p.add(texture=clip(f"{spread} / 0.1"))
    return p.add(quality=clip(f"(0.45 * {clip('lap90')} + 0.55 * {clip('grad90 / 3.0')}) * texture"))


def exposure_of(d: Dialect) -> str:
    r = Raster(d)
    share = lambda test: f"{d.size(r.where(lambda q: f'{d.at("gray", q)} {test}'))} / CAST({r.n} AS DOUBLE)"
    return clip(f"1.0 - 2.0 * {share('>= 250')} - 0.5 * {share('<= 5')}")


def hash_bits(d: Dialect) -> str:
    """64 bits as text: the photo at nine columns, linear in between; is each pixel brighter than the one on its right?"""
    def column(y: int, i: int) -> str:
        x = min(max((i + 0.5) * EDGE / (EDGE + 1) - 0.5, 0.0), EDGE - 1.0)
        lo, f = int(x), x - int(x)
        left, right = (d.at("gray", str(EDGE * y + min(k, EDGE - 1))) for k in (lo, lo + 1))
        return f"round({left} * {1 - f!r} + {right} * {f!r})"

    bits = ", ".join(f"CASE WHEN {column(y, i)} > {column(y, i + 1)} THEN '1' ELSE '0' END" for y in range(EDGE) for i in range(EDGE))
    return f"concat({bits})"

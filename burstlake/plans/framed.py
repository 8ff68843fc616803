"""Queries over images of any size (burstlake.frames), and the same in SQL that is written independently of them.

There are no image files among the test tables.  A *sheet* stacks the 64 values of neighbouring ``embeddings`` rows of a label: 64
columns and as many rows as the data have.  A *panorama* has one column for each of 200 neighbouring customers: sky down to a
height that follows the account balance, textured land below.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.frames import haze, quantiles, scenes, sharpness, tiles
from burstlake.frames import kernels as K
from burstlake.frames.canvases import laid_over
from burstlake.sources.scratch import written
from burstlake.sources.tables import table

from .dialect import Catalog

catalog = Catalog()
EDGE, SHEET_IDS, PANORAMA, HIGH = 24, 400, 200, 64
SHARES = (0.01, 0.25, 0.5, 0.9, 0.99)


def _register(run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    catalog.queries[run.__name__] = run
    if sql:
        catalog.oracles[run.__name__] = sql


# ---- images ---------------------------------------------------------------------------------------------------------


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of gray (0 to 255) and of r, g, b (0 to 1): three rotations of a sheet's rows."""
    gray = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128.5 + 400 * v.cast("double")).cast("int"))))
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(
        (F.col("label").cast("long") * 1_000_000 + F.floor(F.col("vec_id") / SHEET_IDS)).alias("image"), "vec_id", gray.alias("v")
    )
    stacked = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("s"))  # at most SHEET_IDS rows of 64

    def band(turn: int, scale: float) -> Column:
        return F.flatten(F.transform("s", lambda r: F.transform(F.concat(F.slice(r["v"], turn + 1, 64), F.slice(r["v"], 1, turn)) if turn else r["v"], lambda x: x / F.lit(scale))))

    images = stacked.select("image", F.size("s").alias("height"), F.lit(64).alias("width"), band(0, 1.0).alias("gray"), *[band(9 * k, 255.0).alias(c) for k, c in enumerate("rgb")])
    return tiles.cut(images, ["gray", "r", "g", "b"], EDGE)


SHEETS = f"""e AS (SELECT CAST(label AS BIGINT) * 1000000 + vec_id // {SHEET_IDS} AS image, vec_id,
        list_transform(embedding, lambda v: CAST(greatest(0, least(255, floor(128.5 + 400 * CAST(v AS DOUBLE)))) AS INTEGER)) AS v FROM embeddings WHERE label IS NOT NULL),
    s AS (SELECT image, CAST(count(*) AS INTEGER) AS h, 64 AS w, flatten(list(v ORDER BY vec_id)) AS gray FROM e GROUP BY image),
    rgb AS (SELECT image, h, w, gray, {", ".join(f"list_transform(range(h * w), lambda p: gray[1 + p - p % 64 + (p % 64 + {9 * k}) % 64] / CAST(255 AS DOUBLE)) AS {c}" for k, c in enumerate("rgb"))} FROM s)"""


def _panoramas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of r, g, b; the channels differ by a constant factor."""
    share = (F.col("c_acctbal").cast("double") + 999.99) / 10999.98
    line = (20 + F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * 24)).cast("int")
    column = F.struct("c_custkey", line.alias("line"), F.col("c_nationkey").cast("int").alias("n"))
    wide = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / PANORAMA).alias("image")).agg(F.array_sort(F.collect_list(column)).alias("s"))  # at most PANORAMA columns

    def draw(a: tiles.Bands, h: int, w: int) -> tiles.Bands:
        y, x = np.mgrid[:h, :w]
        gray = np.where(y < a["line"], 0.8 - 0.001 * y, 0.25 + 0.1 * ((7 * x + 13 * y + a["n"]) % 5) / 5)
        return {c: k * gray for k, c in ((0.95, "r"), (1.0, "g"), (1.05, "b"))}

    columns = wide.select("image", F.lit(HIGH).alias("height"), F.size("s").alias("width"), F.col("s.line").alias("line"), F.col("s.n").alias("n"))
    return tiles.drawn(columns, draw, ["line", "n"], ["r", "g", "b"], EDGE)


PANORAMAS = f"""c AS (SELECT c_custkey // {PANORAMA} AS image, c_custkey, c_nationkey AS n, CAST(20 + floor(least(1.0, greatest(0.0, (CAST(c_acctbal AS DOUBLE) + 999.99) / 10999.98)) * 24) AS INTEGER) AS line FROM customer),
    o AS (SELECT image, CAST(count(*) AS INTEGER) AS w, {HIGH} AS h, list(line ORDER BY c_custkey) AS line, list(CAST(n AS INTEGER) ORDER BY c_custkey) AS n FROM c GROUP BY image),
    rgb AS (SELECT image, h, w, {", ".join(f"list_transform(range(h * w), lambda p: {k} * CASE WHEN p // w < line[1 + p % w] THEN CAST(0.8 AS DOUBLE) - CAST(0.001 AS DOUBLE) * (p // w) ELSE CAST(0.25 AS DOUBLE) + CAST(0.1 AS DOUBLE) * ((7 * (p % w) + 13 * (p // w) + n[1 + p % w]) % 5) / 5 END) AS {c}" for k, c in (("CAST(0.95 AS DOUBLE)", "r"), ("CAST(1.0 AS DOUBLE)", "g"), ("CAST(1.05 AS DOUBLE)", "b")))} FROM o)"""
LUMA = "list_transform(range(h * w), lambda p: CAST(0.2126 AS DOUBLE) * r[p + 1] + CAST(0.7152 AS DOUBLE) * g[p + 1] + CAST(0.0722 AS DOUBLE) * b[p + 1])"


# ---- SQL over lists of h x w values ---------------------------------------------------------------------------------


def _mirror(i: str, n: str) -> str:
    around = f"(abs({i}) % greatest(1, 2 * {n} - 2))"
    return f"(CASE WHEN {around} < {n} THEN {around} ELSE 2 * {n} - 2 - {around} END)"


def _along(a: str, radius: int, how: str, rows: bool, weights: list[float] | None = None) -> str:
    """A list put through a window of 2 radius + 1 places along rows or columns."""
    at = f"p - p % w + {_mirror(f'(p % w + o - {radius})', 'w')}" if rows else f"{_mirror(f'(p // w + o - {radius})', 'h')} * w + p % w"
    value = f"{a}[1 + {at}]" + (f" * [{', '.join(map(repr, weights))}][o + 1]" if weights else "")
    return f"list_transform(range(h * w), lambda p: {how}(list_transform(range({2 * radius + 1}), lambda o: {value})))"


def _step(x: str, low: float, high: float) -> str:
    t = f"greatest(0.0, least(1.0, ({x} - ({low!r})) / CAST({high - low!r} AS DOUBLE)))"
    return f"({t} * {t} * (3 - 2 * {t}))"


class Steps:
    """A chain of common tables, each adding columns to the one before."""

    def __init__(self, start: str, of: str) -> None:
        self.parts, self.last, self.n = [start], of, 0

    def add(self, **columns: str) -> Steps:
        self.n += 1
        self.parts.append(f"q{self.n} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {self.last})")
        self.last = f"q{self.n}"
        return self

    def each(self, expression: str) -> str:
        return f"list_transform(range(h * w), lambda p: {expression})"

    def filtered(self, radius: int, how: str = "list_avg", weights: tuple[list[float] | None, list[float] | None] = (None, None), **arrays: str) -> Steps:
        self.add(**{f"{n}_rows": _along(a, radius, how, True, weights[0]) for n, a in arrays.items()})
        return self.add(**{n: _along(f"{n}_rows", radius, how, False, weights[1]) for n in arrays})

    def pixels(self, *columns: str, digits: int = 6) -> str:
        values = ", ".join(f"round({c}[1 + p], {digits}) AS {c}" for c in columns)
        return f"WITH {', '.join(self.parts)} SELECT image, CAST(p // w AS INTEGER) AS y, CAST(p % w AS INTEGER) AS x, {values} FROM (SELECT *, unnest(range(h * w)) AS p FROM {self.last})"

    def select(self, columns: str) -> str:
        return f"WITH {', '.join(self.parts)} SELECT {columns} FROM {self.last}"


def _rounded(df: DataFrame, *bands: str, digits: int = 6) -> DataFrame:
    return tiles.to_pixels(df, bands).select("image", "y", "x", *[F.round(b, digits).alias(b) for b in bands])


# ---- queries --------------------------------------------------------------------------------------------------------


def tiled_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sheet, its middle and its nine parts."""
    regions = lambda h, w: [*sharpness.whole(h, w), *sharpness.centre(h, w), *sharpness.thirds(h, w)]
    got = sharpness.region_sharpness(_sheets(spark, sf_dir).select(*tiles.PLACE, "gray"), regions)
    return got.select("image", "region", F.round("sharpness", 5).alias("sharpness"))


def _sharpness_sql() -> str:
    third = lambda n, k: f"CAST(round({n} * {k} / CAST(3 AS DOUBLE)) AS INTEGER)"
    cut = lambda n: f"CAST(floor({n} * CAST(0.4 AS DOUBLE) / 2) AS INTEGER)"
    boxes = ["(0, 0, 0, w, h)", f"(1, {cut('w')}, {cut('h')}, w - 2 * {cut('w')}, h - 2 * {cut('h')})"]
    boxes += [f"({2 + 3 * r + c}, {third('w', c)}, {third('h', r)}, {third('w', c + 1)} - {third('w', c)}, {third('h', r + 1)} - {third('h', r)})" for r in range(3) for c in range(3)]
    parts = [b[1:-1].split(", ") for b in boxes]
    listed = ", ".join("{" + ", ".join(f"'{n}': {v}" for n, v in zip(("k", "x0", "y0", "rw", "rh"), p, strict=True)) + "}" for p in parts)
    at = lambda i, j: f"gray[1 + (y0 + {_mirror(f'(p // rw + {j})', 'rh')}) * w + x0 + {_mirror(f'(p % rw + {i})', 'rw')}]"
    values = ", ".join(f"{at(i, j)} AS n{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))
    return f"""WITH {SHEETS}, b AS (SELECT image, w, gray, unnest([{listed}], recursive := true) FROM s),
        n AS (SELECT image, k, {values} FROM (SELECT *, unnest(range(rw * rh)) AS p FROM b)),
        l AS (SELECT image, k, CAST(n01 + n21 + n10 + n12 - 4 * n11 AS DOUBLE) AS lap, CAST(n20 + 2 * n21 + n22 - n00 - 2 * n01 - n02 AS DOUBLE) AS sx, CAST(n02 + 2 * n12 + n22 - n00 - 2 * n10 - n20 AS DOUBLE) AS sy FROM n)
        SELECT image, CAST(k AS INTEGER) AS region, round(avg(lap * lap) - avg(lap) * avg(lap) + avg(sx * sx + sy * sy), 5) AS sharpness FROM l GROUP BY image, k"""


_register(tiled_sharpness, _sharpness_sql())


def tiled_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharpness.exposure(_sheets(spark, sf_dir).select(*tiles.PLACE, "gray"))
    return got.select("image", F.round("exposure", 6).alias("exposure"))


_register(tiled_exposure, f"""WITH {SHEETS} SELECT image, round(greatest(0.0, least(1.0, 1.0 - 2.0 * len(list_filter(gray, lambda v: v >= 250)) / CAST(h * w AS DOUBLE)
    - 0.5 * len(list_filter(gray, lambda v: v <= 5)) / CAST(h * w AS DOUBLE))), 6) AS exposure FROM s""")  # fmt: skip


def tiled_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each sheet's luma, without gathering an image."""
    luma = haze.with_luma(_sheets(spark, sf_dir).select(*tiles.PLACE, "r", "g", "b")).select(*tiles.PLACE, "luma")
    got = quantiles.image_quantiles(written(luma, "tiles"), "luma", SHARES)
    return got.select("image", "n", *[F.round(F.col("q")[k], 9).alias(f"q{int(100 * s)}") for k, s in enumerate(SHARES)])


_register(tiled_quantiles, f"""WITH {SHEETS}, y AS (SELECT image, h * w AS n, unnest({LUMA}) AS v FROM rgb)
    SELECT image, CAST(count(*) AS BIGINT) AS n, {", ".join(f"round(quantile_cont(v, {s}), 9) AS q{int(100 * s)}" for s in SHARES)} FROM y GROUP BY image""")  # fmt: skip


def tiled_box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of squares of radius 7 and 40, wider than a tile; 40 is wider than many sheets are high."""
    red = _sheets(spark, sf_dir).select(*tiles.PLACE, "r")
    near = haze.filtered(red, "r", 7, "mean_7")
    far = haze.filtered(red, "r", 40, "mean_40").select(F.col("image").alias("i"), F.col("y0").alias("i_y"), F.col("x0").alias("i_x"), "mean_40")
    both = near.join(far, (F.col("image") == F.col("i")) & (F.col("y0") == F.col("i_y")) & (F.col("x0") == F.col("i_x")))
    return _rounded(both, "mean_7", "mean_40")


_register(tiled_box_mean, Steps(SHEETS, "rgb").filtered(7, mean_7="r").filtered(40, mean_40="r").pixels("mean_7", "mean_40"))


def tiled_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest and largest values of squares of radius 5."""
    red = _sheets(spark, sf_dir).select(*tiles.PLACE, "r")
    return _rounded(tiles.windowed(red, 5, lambda a, f: {"least": K.extreme(a["r"], 5, False), "most": K.extreme(a["r"], 5, True)}, ["r"], ["least", "most"]), "least", "most")


_register(tiled_extremes, Steps(SHEETS, "rgb").filtered(5, "list_min", least="r").filtered(5, "list_max", most="r").pixels("least", "most"))


def tiled_guided_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(haze.guided_filter(_sheets(spark, sf_dir).select(*tiles.PLACE, "r", "g"), "r", "g", 12), "slope", "intercept")


def _guided_sql() -> str:
    q = Steps(SHEETS, "rgb")
    q.add(rr=q.each("r[p + 1] * r[p + 1]"), rg=q.each("r[p + 1] * g[p + 1]")).filtered(12, mr="r", mg="g", mrr="rr", mrg="rg")
    q.add(a0=q.each("(mrg[p + 1] - mr[p + 1] * mg[p + 1]) / greatest(mrr[p + 1] - mr[p + 1] * mr[p + 1] + CAST(0.002 AS DOUBLE), 1e-7)"))
    q.add(b0=q.each("mg[p + 1] - a0[p + 1] * mr[p + 1]"))
    return q.filtered(12, slope="a0", intercept="b0").pixels("slope", "intercept")


_register(tiled_guided_filter, _guided_sql())


def tiled_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skyline of each panorama, column by column."""
    got = haze.sky_of(haze.with_luma(_panoramas(spark, sf_dir)))
    flat = got.select("image", F.posexplode(F.arrays_zip("skyline", "column_ref")).alias("x", "v"))
    return flat.select("image", F.col("x").cast("int").alias("x"), F.round("v.skyline", 5).alias("skyline"), F.round("v.column_ref", 6).alias("column_ref"))


def tiled_sky_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each place of a panorama is sky, laid over its tiles."""
    panoramas = written(haze.with_luma(_panoramas(spark, sf_dir)), "tiles")
    return _rounded(laid_over(panoramas.select(*tiles.PLACE), haze.sky_of(panoramas), ["sky"]), "sky")


def _line(a: str, weights: list[float]) -> str:
    """A list of one value per column, blurred and mirrored at its ends."""
    r = len(weights) // 2
    return f"list_transform(range(w), lambda p: list_sum(list_transform(range({2 * r + 1}), lambda o: {a}[1 + {_mirror(f'(p + o - {r})', 'w')}] * [{', '.join(map(repr, weights))}][o + 1])))"


def _bell(sigma: float) -> list[float]:
    r = (round(sigma * 8 + 1) | 1) // 2
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(raw) for x in raw]


def _sky_sql() -> Steps:
    """Of panoramas of at most 200 columns, whose blurs have fixed widths: 200 / 96 columns and 200 / 256 are near 2 and below 1."""
    q = Steps(PANORAMAS, "rgb").add(l=LUMA)
    top = max(4, round(HIGH * 0.12))
    q.add(ref0=f"list_transform(range(w), lambda c: list_median(list_transform(range({top}), lambda k: l[1 + k * w + c])))")
    q.add(column_ref=f"CASE WHEN w = {PANORAMA} THEN {_line('ref0', _bell(max(2.0, PANORAMA / 96)))} ELSE {_line('ref0', _bell(2.0))} END")
    along, down = _bell(1.0), _bell(0.6)
    wide = (len(along) - len(down)) // 2
    q.filtered(len(along) // 2, "list_sum", (along, [0.0] * wide + down + [0.0] * wide), calm="l")
    first, last = max(4, round(HIGH * 0.06)), min(max(5, round(HIGH * 0.88)), HIGH - 8)
    mean = lambda a, b: f"(list_avg(list_transform(range({b} - ({a})), lambda k: calm[1 + (y + {a} + k) * w + c])) / greatest(column_ref[1 + c], CAST(0.025 AS DOUBLE)))"
    falls = f"{mean(0, 4)} <= CAST(0.95 AS DOUBLE) AND {mean(-3, 0)} - {mean(0, 4)} >= CAST(0.025 AS DOUBLE) AND {mean(0, 8)} <= CAST(0.96 AS DOUBLE)"
    q.add(line0=f"list_transform(range(w), lambda c: coalesce(CAST(list_min(list_filter(range({first}, {last}), lambda y: {falls})) AS DOUBLE), CAST({HIGH * 0.94!r} AS DOUBLE)))")
    q.add(skyline=_line("line0", _bell(1.0)))
    q.add(ll=q.each("l[p + 1] * l[p + 1]")).filtered(7, m="l", mm="ll")
    rough = "sqrt(greatest(mm[p + 1] - m[p + 1] * m[p + 1], 0.0)) / (m[p + 1] + CAST(0.025 AS DOUBLE))"
    calm = f"(CAST(0.85 AS DOUBLE) + CAST(0.15 AS DOUBLE) * (1 - {_step(rough, 0.12, 0.38)}))"
    bright = _step("l[p + 1] / greatest(column_ref[1 + p % w], CAST(0.025 AS DOUBLE))", 0.84, 0.99)
    return q.add(sky=q.each(f"{_step('(skyline[1 + p % w] - p // w)', -3.5, 3.5)} * {bright} * {calm}"))


_register(tiled_skyline, f"""SELECT image, CAST(x AS INTEGER) AS x, round(skyline[1 + x], 5) AS skyline, round(column_ref[1 + x], 6) AS column_ref
    FROM (SELECT image, skyline, column_ref, unnest(range(w)) AS x FROM ({_sky_sql().select("image, w, skyline, column_ref")}))""")
_register(tiled_sky_mask, _sky_sql().pixels("sky"))


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panoramas and what a haze removal might make of them (vr, vg, vb): darker, bright places more so."""
    make = lambda a, f: {f"v{c}": 0.9 * a[c] * (1.0 - 0.1 * K.luma(a["r"], a["g"], a["b"])) for c in "rgb"}
    return written(tiles.mapped(_panoramas(spark, sf_dir), make, ["r", "g", "b"], ["vr", "vg", "vb"], kept=["r", "g", "b"]), "tiles")


def tiled_detail_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark detail kept and bright structures held back in the panoramas' results."""
    return _rounded(haze.protect_details(haze.supports(_removed(spark, sf_dir)), 0.8), "vr", "vg", "vb")


def tiled_structure_enhancement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both steps: detail protection, then structure enhancement."""
    return _rounded(haze.protected(_removed(spark, sf_dir), 0.8), "vr", "vg", "vb")


_register(tiled_detail_protection)
_register(tiled_structure_enhancement)


def tiled_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airlight and its trust, transmission, backlight and dark floor of sheets and panoramas."""
    both = _sheets(spark, sf_dir).select(*tiles.PLACE, "r", "g", "b").unionAll(_panoramas(spark, sf_dir).withColumn("image", -1 - F.col("image")))
    return scenes.estimates(both).select("image", *[F.round(c, 5).alias(c) for c in scenes.ESTIMATES])


def tiled_exposure_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of automatic exposure of darkened panoramas, and why."""
    dark = tiles.mapped(_panoramas(spark, sf_dir), lambda a, f: {c: v * (0.1 + f.width % 7 / 10) for c, v in a.items()}, ["r", "g", "b"], ["r", "g", "b"])
    return scenes.exposure_stops(written(dark, "tiles")).select("image", F.round("ev", 5).alias("ev"), "reason")


def tiled_haziest_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light of the haziest places of each sheet."""
    return scenes.haziest_light(written(_sheets(spark, sf_dir).select(*tiles.PLACE, "r", "g", "b"), "tiles")).select("image", *[F.round(f"air_{c}", 6).alias(f"air_{c}") for c in "rgb"])


_register(tiled_scenes)
_register(tiled_exposure_stops, f"""WITH {PANORAMAS}, d AS (SELECT image, w, h, {", ".join(f"list_transform({c}, lambda v: v * (CAST(0.1 AS DOUBLE) + w % 7 / CAST(10 AS DOUBLE))) AS {c}" for c in "rgb")} FROM rgb),
    m AS (SELECT image, list_median({LUMA}) AS y, greatest(list_max(r), list_max(g), list_max(b)) AS p FROM d),
    s AS (SELECT *, log2(CAST(0.18 AS DOUBLE) / y) AS want, log2(CAST(0.95 AS DOUBLE) / p) AS room FROM m)
    SELECT image, round(CASE WHEN want <= 0 OR room <= 1e-8 THEN 0.0 ELSE greatest(0.0, least(want, room, 2.0)) END, 5) AS ev,
        CASE WHEN want <= 0 THEN 'target_reached' WHEN room <= 1e-8 OR room < least(want, 2.0) - 1e-7 THEN 'highlight_limited' ELSE 'applied' END AS reason FROM s""")  # fmt: skip
_register(tiled_haziest_light, f"""WITH {SHEETS}, p AS (SELECT image, h * w AS n, unnest(range(h * w)) AS place, unnest(r) AS r, unnest(g) AS g, unnest(b) AS b FROM rgb),
    l AS (SELECT *, least(n, greatest(16, n // 1000)) AS k, least(r, g, b) AS dark, CAST(0.2126 AS DOUBLE) * r + CAST(0.7152 AS DOUBLE) * g + CAST(0.0722 AS DOUBLE) * b AS y FROM p),
    c AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY image ORDER BY dark DESC, y DESC, place) <= k),
    t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY image ORDER BY y DESC, place) <= greatest(1, k // 8))
    SELECT image, {", ".join(f"round(greatest(0.35, least(1.0, median({c}))), 6) AS air_{c}" for c in "rgb")} FROM t GROUP BY image""")  # fmt: skip

"""Haze that varies over the frame: transmission map, sky, detail and structure supports and their protection."""

from __future__ import annotations

from .dialect import Catalog, Dialect
from .physical import SHOWN, UPPER, Settings, _each, _median_colour, _peak, as_bytes, rounded
from .rasters import EDGE, Picture, Raster, box, clip, gauss, luma_of, planes, smooth

catalog = Catalog()
R = EDGE


def _variance(p: Picture, of: str, to: str, radius: int) -> Picture:
    """to + _mean and to + _var: mean and variance in a square around each place."""
    d, r = p.d, Raster(p.d)
    p = p.add(**{f"{to}_sq": r.map(lambda q: f"{d.at(of, q)} * {d.at(of, q)}")})
    p = p.filtered(box(R, radius), box(R, radius), **{f"{to}_mean": of, f"{to}_msq": f"{to}_sq"})
    m, v = (d.at(f"{to}_{x}", "p") for x in ("mean", "msq"))
    return p.add(**{f"{to}_var": r.map(lambda q: f"greatest({v} - {m} * {m}, 0.0)")})


def with_guided(p: Picture, guide: str, estimate: str, radius: int, to: str, epsilon: float = 0.002) -> Picture:
    """to + _slope and to + _intercept of the gray guided filter, both smoothed once more."""
    d, r = p.d, Raster(p.d)
    at = lambda n: d.at(n, "p")
    p = p.add(**{f"{to}_gg": r.map(lambda q: f"{at(guide)} * {at(guide)}"), f"{to}_ge": r.map(lambda q: f"{at(guide)} * {at(estimate)}")})
    p = p.filtered(box(R, radius), box(R, radius), **{f"{to}_mg": guide, f"{to}_me": estimate, f"{to}_mgg": f"{to}_gg", f"{to}_mge": f"{to}_ge"})
    mg, me, mgg, mge = (at(f"{to}_{x}") for x in ("mg", "me", "mgg", "mge"))
    p = p.add(**{f"{to}_a": r.map(lambda q: f"({mge} - {mg} * {me}) / greatest({mgg} - {mg} * {mg} + {epsilon}, 1e-7)")})
    p = p.add(**{f"{to}_b": r.map(lambda q: f"{me} - {at(f'{to}_a')} * {mg}")})
    return p.filtered(box(R, radius), box(R, radius), **{f"{to}_slope": f"{to}_a", f"{to}_intercept": f"{to}_b"})


def _row_blur(p: Picture, sigma: float, **arrays: str) -> Picture:
    """Arrays of one value per column, blurred across columns."""
    r = Raster(p.d, 1, R)
    return p.add(**{n: r.along_rows(a, gauss(R, sigma)) for n, a in arrays.items()})


def with_sky(p: Picture) -> Picture:
    """sky (how much each place is sky), column_ref (luma of each column's top) and skyline (row, smoothed), from l.

    For each column the first row where luma falls, against the column's top, and stays low; rows too near to both ends do
    not count, so a frame of few rows has the default line only.
    """
    d, r, one = p.d, Raster(p.d), Raster(p.d, 1, R)
    top = max(4, round(R * 0.12))
    column = lambda x: d.median(d.each(d.range(top), "k", d.at("l", f"k * {R} + {x}")))
    p = _row_blur(p.add(ref0=one.map(column)), max(2.0, R / 96), column_ref="ref0")
    p = p.filtered(gauss(R, 1.0), gauss(R, 0.6), calm="l")
    first, last = max(4, round(R * 0.06)), max(max(4, round(R * 0.06)) + 1, round(R * 0.88))
    stop = min(last, R - 8)
    mean = lambda a, b: d.mean(d.each(d.keep(d.range(R), "k", f"k >= ({a}) AND k < ({b})"), "k", d.at("calm", f"k * {R} + c")))
    base = f"greatest({d.at('column_ref', 'c')}, 0.025)"
    above, below, onward = (f"({mean(a, b)} / {base})" for a, b in (("y - 3", "y"), ("y", "y + 4"), ("y", "y + 8")))
    falls = f"y >= {first} AND y < {stop} AND {below} <= 0.95 AND {above} - {below} >= 0.025 AND {onward} <= 0.96"
    line = f"coalesce(CAST({d.least_of(d.keep(d.range(R), 'y', falls))} AS DOUBLE), {R * 0.94!r})"
    p = _row_blur(p.add(line0=d.each(d.range(R), "c", line)), max(1.0, R / 256), skyline="line0")
    p = _variance(p, "l", "sk", 7)
    ref = f"greatest({d.at('column_ref', r.x())}, 0.025)"
    support = smooth(f"{d.at('skyline', r.x())} - {r.y()}", -3.5, 3.5)
    rough = f"sqrt({d.at('sk_var', 'p')}) / ({d.at('sk_mean', 'p')} + 0.025)"
    calm = f"(0.85 + 0.15 * (1.0 - {smooth(rough, 0.12, 0.38)}))"
    return p.add(sky=r.map(lambda q: f"{support} * {smooth(d.at('l', q) + f' / {ref}', 0.84, 0.99)} * {calm}"))


def with_daylight(p: Picture) -> Picture:
    """sky_ref, scene_median, upper_peak and daylight: is this a day scene, and how bright its top."""
    d = p.d
    peaks = d.each(d.range(R * max(1, R // 2)), "q", _peak(d, "q"))
    p = p.add(top_median=d.median(d.head("l", R * max(1, R // 5))), scene_median=d.median("l"), upper_peak=d.quantile(peaks, 0.99))
    return p.add(daylight=f"greatest({smooth('scene_median', 0.06, 0.10)} * {smooth('top_median', 0.09, 0.13)}, {smooth('top_median', 0.16, 0.24)}, {smooth('upper_peak', 0.75, 0.95)})")


def with_edges(p: Picture) -> Picture:
    """edge: 0 to 1 around strong gradients of l, widened and blurred."""
    d, r = p.d, Raster(p.d)
    n = lambda dx, dy: r.beside("l", dx, dy)
    gx = f"({n(1, -1)} + 2 * {n(1, 0)} + {n(1, 1)} - {n(-1, -1)} - 2 * {n(-1, 0)} - {n(-1, 1)})"
    gy = f"({n(-1, 1)} + 2 * {n(0, 1)} + {n(1, 1)} - {n(-1, -1)} - 2 * {n(0, -1)} - {n(1, -1)})"
    p = p.add(grad=r.map(lambda q: f"greatest(abs({gx}), abs({gy}))"))
    p = p.add(edge0=r.map(lambda q: smooth(d.at("grad", q), 0.035, 0.14)))
    return p.stretched(2, True, edge1="edge0").filtered(gauss(R, 2.0), gauss(R, 2.0), edge="edge1")


def with_transmission_map(p: Picture, s: Settings = SHOWN) -> Picture:
    """t_map: bounded transmission of each place; needs global_t.  Sky and hard silhouettes keep the global one."""
    d, r = p.d, Raster(p.d)
    p = with_edges(with_sky(with_daylight(_variance(p, "l", "tm", 7))))
    at = lambda n: d.at(n, "p")
    depth = smooth(f"0.86 - {r.y()} / CAST({max(1, R - 1)} AS DOUBLE)", 0.02, 0.78)
    dark = clip(f"least({', '.join(at(c) for c in 'rgb')}) / greatest(greatest(top_median, 0.025), 0.05)")
    flat = f"(1.0 - {smooth(f'sqrt({at("tm_var")}) / ({at("tm_mean")} + 0.025)', 0.08, 0.35)})"
    p = p.add(haze_cue=r.map(lambda q: f"0.52 * {depth} + 0.28 * {smooth(dark, 0.08, 0.58)} + 0.20 * {flat}"))
    p = p.add(sky_now=r.map(lambda q: f"CASE WHEN daylight > 1e-6 THEN {at('sky')} * daylight ELSE 0.0 END"))
    p = p.add(offset0=r.map(lambda q: f"(0.25 - {at('haze_cue')}) * (0.70 * (1.0 - global_t)) * (1.0 - {at('sky_now')}) * daylight"))
    p = with_guided(p, "l", "offset0", 12, "of")
    p = p.add(offset1=r.map(lambda q: f"({at('of_slope')} * {at('l')} + {at('of_intercept')}) * (1.0 - {at('edge')}) * (1.0 - {at('sky_now')})"))
    floor = 0.20 + 0.16 * s.fog_retention + 0.08 * s.naturalness
    limit = "least(0.18, 0.38 * (1.0 - global_t))"
    boost = f"{0.10 * s.strength!r} * {smooth('upper_peak', 0.75, 0.95)} * {smooth(at('l'), 0.04, 0.22)}"
    p = p.add(t_map0=r.map(lambda q: clip(f"global_t + greatest(-{limit}, least({limit}, {at('offset1')})) - {boost}", repr(floor))))
    p = with_sky_protection(p, "sky_now")
    keep = f"({at('sky_keep')} * {smooth('greatest(top_median, 0.025)', 0.22, 0.55)})"
    bounded = clip(f"{at('t_map0')} * (1.0 - {keep}) + {keep}", repr(floor))
    return p.add(t_map=r.map(lambda q: f"CASE WHEN daylight > 1e-6 THEN {bounded} ELSE {at('t_map0')} END"))


def with_sky_protection(p: Picture, support: str) -> Picture:
    """sky_keep: the sky once more against local evidence, without silhouettes, blurred."""
    d, r = p.d, Raster(p.d)
    p = _variance(p, "l", "sp", max(2, min(9, round(R / 96))))
    at = lambda n: d.at(n, "p")
    ref = f"greatest({d.at('column_ref', r.x())}, 0.025)"
    bright = smooth(f"{at('l')} / {ref}", 0.84, 0.99)
    flat = f"(1.0 - {smooth(f'sqrt({at("sp_var")}) / ({at("sp_mean")} + 0.025)', 0.10, 0.34)})"
    upper = f"(1.0 - {smooth(f'{r.y()} / CAST({R - 1} AS DOUBLE)', 0.90, 0.99)})"
    p = p.add(keep0=r.map(lambda q: f"{clip(at(support))} * {bright} * {flat} * {upper} * (1.0 - {clip(at('edge'))})"))
    p = p.filtered(gauss(R, 2.0), gauss(R, 2.0), keep1="keep0")
    return p.add(sky_keep=r.map(lambda q: clip(at("keep1"))))


def with_shadow_support(p: Picture) -> Picture:
    """shadow_support: detailed land, from texture over a broad area; nothing in scenes with little of it."""
    d, r = p.d, Raster(p.d)
    at = lambda n: d.at(n, "p")
    p = _variance(p, "l", "ss", 7)
    p = p.add(ss_tex=r.map(lambda q: smooth(f"sqrt({at('ss_var')}) / ({at('ss_mean')} + 0.025)", 0.025, 0.060)))
    p = p.filtered(box(R, 20), box(R, 20), ss_den="ss_tex").add(ss_0=r.map(lambda q: smooth(at("ss_den"), 0.12, 0.45)))
    p = p.filtered(gauss(R, 4.0), gauss(R, 4.0), ss_1="ss_0")
    p = p.add(ss_2=r.map(lambda q: f"{at('ss_1')} * {smooth(f'{r.y()} / CAST({R - 1} AS DOUBLE)', 0.08, 0.20)}"))
    p = p.add(ss_all=d.mean("ss_2"))
    return p.add(shadow_support=r.map(lambda q: f"{at('ss_2')} * {smooth('ss_all', 0.10, 0.30)}"))


def with_structure_support(p: Picture) -> Picture:
    """structure_support: texture of absolute and relative contrast in both directions, below a daylight skyline; needs with_sky and with_daylight."""
    d, r = p.d, Raster(p.d)
    at = lambda n: d.at(n, "p")
    p = _variance(p, "l", "st", 7)
    sd = f"sqrt({at('st_var')})"
    p = p.add(st_tex=r.map(lambda q: f"{smooth(f'{sd} / ({at("st_mean")} + 0.025)', 0.025, 0.060)} * {smooth(sd, 0.0012, 0.0045)}"))
    left, up = d.at("l", "p - 1"), d.at("l", f"p - {R}")
    p = p.add(
        st_dx=r.map(lambda q: f"CASE WHEN {r.x()} = 0 THEN 0.0 ELSE abs({at('l')} - {left}) END"),
        st_dy=r.map(lambda q: f"CASE WHEN {r.y()} = 0 THEN 0.0 ELSE abs({at('l')} - {up}) END"),
    )
    p = p.filtered(box(R, 10), box(R, 10), st_den="st_tex").filtered(box(R, 4), box(R, 4), st_ex="st_dx", st_ey="st_dy")
    p = p.add(st_0=r.map(lambda q: smooth(at("st_den"), 0.10, 0.36))).filtered(gauss(R, 1.5), gauss(R, 1.5), st_1="st_0")
    balance = f"2.0 * least({at('st_ex')}, {at('st_ey')}) / ({at('st_ex')} + {at('st_ey')} + 1e-5)"
    land = smooth(f"{r.y()} - {d.at('skyline', r.x())}", -0.012 * R, 0.045 * R)
    body = f"{at('st_1')} * {smooth(balance, 0.12, 0.60)} * {smooth(f'CAST({r.y()} AS DOUBLE)', 0.08 * R, 0.20 * R)} * CASE WHEN daylight > 1e-6 THEN {land} ELSE 1.0 END"
    return p.add(structure_support=r.map(lambda q: clip(body)))


def with_bright_support(p: Picture, radius: int = 2) -> Picture:
    """bright_support: bright fine detail that is neither glare nor saturated."""
    d, r = p.d, Raster(p.d)
    p = p.filtered(box(R, radius), box(R, radius), br_mean="l")
    high = f"{d.at('l', 'p')} - {d.at('br_mean', 'p')}"
    return p.add(bright_support=r.map(lambda q: f"{smooth(high, 0.008, 0.035)} * (1.0 - {smooth(_peak(d, q), 0.55, 0.80)})"))


def protected(sql: str, strength: float, of: str, to: str) -> str:
    """Pixel rows (r, g, b, of + channel, shadow_support, bright_support, bright_scale): dark detail comes back, and nothing gets
    brighter than its source; fine bright structures follow their darker background."""
    y1 = lambda x: luma_of(*(f"{x}{c}" for c in "rgb"))
    one = f"SELECT *, {luma_of('r', 'g', 'b')} AS sy, {y1(of)} AS ry0 FROM ({sql})"
    least = f"sy * (1.0 - 0.05 * {strength} * (1.0 - {smooth('sy', 0.06, 0.30)}))"
    two = f"SELECT *, {clip(f'({least} - ry0) / greatest(sy - ry0, 1e-6)')} * shadow_support AS back FROM ({one})"
    three = f"SELECT *, {_each(f'{of}# + (# - {of}#) * back AS e_#')} FROM ({two})"
    four = f"SELECT *, least(1.0, sy / greatest({y1('e_')}, 1e-6)) AS top FROM ({three})"
    five = f"SELECT *, {_each('e_# * top AS f_#')} FROM ({four})"
    six = f"SELECT *, CASE WHEN bright_scale < 1.0 AND {y1('f_')} > sy * bright_scale THEN bright_support ELSE 0.0 END AS fix FROM ({five})"
    return f"SELECT *, {_each(f'f_# + (# * bright_scale - f_#) * fix AS {to}#')} FROM ({six})"


@catalog.add
def scene_airlight(d: Dialect) -> str:
    """Median colour of calm places of the upper frame between two luma percentiles, of any texture if those are few."""
    r = Raster(d, UPPER, EDGE)
    p = planes(d).add(ul=d.head("l", r.n)).add(ull=r.map(lambda q: f"{d.at('ul', q)} * {d.at('ul', q)}"))
    p = p.filtered(box(EDGE, 5), box(UPPER, 5), um="ul", umm="ull")
    p = p.add(uv=r.map(lambda q: f"greatest({d.at('umm', q)} - {d.at('um', q)} * {d.at('um', q)}, 0.0)"))
    p = p.add(lo=d.quantile("ul", 0.70), hi=d.quantile("ul", 0.96), uv65=d.quantile("uv", 0.65))
    between = f"{d.at('ul', 'p')} >= lo AND {d.at('ul', 'p')} <= hi"
    p = p.add(calm=r.where(lambda q: f"{between} AND {d.at('uv', q)} <= uv65"), mid=r.where(lambda q: between), every=d.range(r.n))
    p = p.add(pool=f"CASE WHEN {d.size('calm')} >= 8 THEN calm WHEN {d.size('mid')} >= 1 THEN mid ELSE every END")
    p = p.add(**_median_colour(d, r, "pool", "a_"))
    return p.select(f"shot_id, CAST({d.size('calm')} AS INT) AS places, " + ", ".join(f"round({clip(f'a_{c}', '0.01')}, 6) AS {c}" for c in "rgb"))


def _array_rows(p: Picture, **columns: str) -> str:
    d = p.d
    slim = Picture(d, f"SELECT shot_id, {', '.join(sorted(set(columns.values())))} FROM ({p.sql})")
    return slim.pixels("shot_id, x, y, " + ", ".join(f"round({d.at(a, 'p')}, 6) + 0.0 AS {n}" for n, a in columns.items()))


@catalog.add
def guided_coefficients(d: Dialect) -> str:
    """Slope and intercept of the gray guided filter (3 x 3, epsilon 0.002), smoothed once more."""
    return _array_rows(with_guided(planes(d), "l", "r", 1, "g1"), slope="g1_slope", intercept="g1_intercept")


@catalog.add
def sky_mask(d: Dialect) -> str:
    return _array_rows(with_sky(planes(d)), sky="sky")


@catalog.add
def skyline_rows(d: Dialect) -> str:
    p = with_sky(planes(d))
    slim = Picture(d, f"SELECT shot_id, skyline, column_ref FROM ({p.sql})")
    return slim.pixels(f"shot_id, x, round({d.at('skyline', 'p')}, 6) AS skyline, round({d.at('column_ref', 'p')}, 6) AS reference", R, R)


@catalog.add
def sky_protection(d: Dialect) -> str:
    return _array_rows(with_sky_protection(with_edges(with_sky(planes(d))), "sky"), protection="sky_keep", edge="edge")


@catalog.add
def transmission_map(d: Dialect) -> str:
    from .physical import with_global_transmission

    return _array_rows(with_transmission_map(with_global_transmission(planes(d))), transmission="t_map")


@catalog.add
def transmission_regularised(d: Dialect) -> str:
    """A transmission map smoothed as optical depth by the guided filter (radius 8), inside its own range."""
    from .physical import with_global_transmission

    r = Raster(d)
    p = with_transmission_map(with_global_transmission(planes(d)))
    p = p.add(depth=r.map(lambda q: f"-ln({clip(d.at('t_map', q), '1e-4')})"))
    p = with_guided(p, "l", "depth", 8, "rg").add(lo=d.least_of("depth"), hi=d.most_of("depth"))
    fine = f"exp(-greatest(lo, least(hi, {d.at('rg_slope', 'p')} * {d.at('l', 'p')} + {d.at('rg_intercept', 'p')})))"
    return _array_rows(p.add(smooth_t=r.map(lambda q: f"CASE WHEN lo = hi THEN {d.at('t_map', q)} ELSE {fine} END")), transmission="smooth_t")


@catalog.add
def shadow_support(d: Dialect) -> str:
    return _array_rows(with_shadow_support(planes(d)), support="shadow_support")


@catalog.add
def structure_support(d: Dialect) -> str:
    return _array_rows(with_structure_support(with_sky(with_daylight(planes(d)))), support="structure_support")


@catalog.add
def bright_structure_support(d: Dialect) -> str:
    return _array_rows(with_bright_support(planes(d, 0.6)), support="bright_support")


def _supports(d: Dialect, p: Picture) -> str:
    slim = Picture(d, f"SELECT shot_id, r AS rs, g AS gs0, b AS bs, shadow_support AS s0, bright_support AS b0, bright_scale FROM ({p.sql})")
    at = lambda n: d.at(n, "p")
    return slim.pixels(f"shot_id, x, y AS row_, bright_scale, {at('rs')} AS r, {at('gs0')} AS g, {at('bs')} AS b, {at('s0')} AS shadow_support, {at('b0')} AS bright_support")


@catalog.add
def spatial_detail_protection(d: Dialect) -> str:
    """Against a result of 0.7 times the source, with a bright structures' target of 0.9."""
    p = with_bright_support(with_shadow_support(planes(d))).add(bright_scale="CAST(0.9 AS DOUBLE)")
    rows = f"SELECT *, {_each('# * 0.7 AS v#')} FROM ({_supports(d, p)})"
    return f"SELECT shot_id, x, row_ AS y, {as_bytes('o_')} FROM ({protected(rows, SHOWN.strength, 'v', 'o_')})"


@catalog.add
def dark_detail_protection(d: Dialect) -> str:
    """The same with the target measured on the upper quarter of day scenes: how much darker the result made it."""
    p = with_daylight(with_bright_support(with_shadow_support(planes(d))))
    n = EDGE * max(1, EDGE // 4)
    r = Raster(d)
    p = p.add(up=d.head("l", n), peaks=d.each(d.range(n), "q", _peak(d, "q")), dim=r.map(lambda q: f"{d.at('l', q)} * 0.9 * (1.0 - 0.1 * {d.at('l', q)})"))
    p = p.add(day=f"({d.median('up')} > 0.11 AND scene_median > 0.06) OR {d.quantile('peaks', 0.99)} > 0.95")
    p = p.add(valid=d.keep(d.range(n), "q", f"{d.at('up', 'q')} > 0.04 AND {d.at('up', 'q')} < 0.40 AND {d.at('peaks', 'q')} < 0.70"))
    ratio = d.median(d.each("valid", "q", f"{d.at('dim', 'q')} / {d.at('up', 'q')}"))
    p = p.add(bright_scale=f"CASE WHEN day AND {d.size('valid')} >= 16 THEN {clip(ratio, '0.82')} ELSE 1.0 END")
    dark = f"(0.9 * (1.0 - 0.1 * {luma_of('r', 'g', 'b')}))"
    rows = f"SELECT *, {_each(f'# * {dark} AS v#')} FROM ({_supports(d, p)})"
    return f"SELECT shot_id, x, row_ AS y, {as_bytes('o_')} FROM ({protected(rows, SHOWN.strength, 'v', 'o_')})"


@catalog.add
def structure_enhancement(d: Dialect) -> str:
    """Luma detail amplified where there is structure, within narrow limits either way (square of radius 2)."""
    s, r = SHOWN, Raster(d)
    amount = 1.65 * s.local_contrast * s.strength * (1.20 - 0.30 * s.naturalness)
    p = with_structure_support(with_sky(with_daylight(planes(d)))).filtered(box(R, 2), box(R, 2), base="l")
    at = lambda n: d.at(n, "p")
    delta = f"({at('l')} - {at('base')}) * ({amount!r} * {at('structure_support')})"
    kept = f"greatest(-least(0.04 * {at('l')}, 0.004), least(least(0.08 * {at('l')}, 0.012), {delta}))"
    p = p.add(gain_=r.map(lambda q: f"{clip(f'{at("l")} + {kept}')} / greatest({at('l')}, 1e-6)"))
    slim = Picture(d, f"SELECT shot_id, r, g, b, gain_ FROM ({p.sql})")
    return slim.pixels("shot_id, x, y, " + ", ".join(f"round({clip(f'{at(c)} * {at("gain_")}')}, 6) AS {c}" for c in "rgb"))

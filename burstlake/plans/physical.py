"""Haze removal in linear light: airlight, scene strength, bounded inversion and its guards.

Scene statistics are arrays of one row per photo (see rasters); the inversion itself runs over pixel rows.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from .dialect import Catalog, Dialect
from .rasters import EDGE, Picture, Raster, box, clip, luma_of, planes, smooth

catalog = Catalog()
LUMA = luma_of("r", "g", "b")


@dataclass(frozen=True)
class Settings:
    """The nine sliders, each 0 to 1."""

    strength: float = 0.0
    naturalness: float = 0.70
    fog_retention: float = 0.55
    local_contrast: float = 0.25
    color_recovery: float = 0.35
    color_protection: float = 0.80
    highlight_protection: float = 0.75
    shadow_protection: float = 0.75
    brightness_protection: float = 0.70

    def normalised(self) -> Settings:
        """Clipped to 0..1; what is not finite becomes 1 if it is positive infinity, else 0."""
        def one(v: float) -> float:
            v = float(v)
            return min(1.0, max(0.0, v)) if v - v == 0 else float(v > 0)

        return Settings(**{k: one(v) for k, v in asdict(self).items()})

    @property
    def gain(self) -> float:
        """The largest amplification of the inversion."""
        return 1 + 0.8 * self.strength * (1 - 0.35 * self.naturalness)

    @property
    def retention(self) -> float:
        return 0.10 + 0.45 * self.brightness_protection + 0.10 * self.shadow_protection

    def with_field(self) -> Settings:
        """The settings once a reliable non-local field is at hand."""
        return replace(
            self, naturalness=self.naturalness * 0.25, brightness_protection=self.brightness_protection**3, shadow_protection=self.shadow_protection**2,
            color_protection=1.0, color_recovery=0.0,
        )


#: What the registered queries use.
SHOWN = Settings(0.7, 0.5, 0.3, 0.4, 0.35, 0.6, 0.6, 0.4, 0.5)
UPPER = max(1, round(EDGE * 0.45))


def _peak(d: Dialect, p: str) -> str:
    return f"greatest({', '.join(d.at(c, p) for c in 'rgb')})"


def _median_colour(d: Dialect, r: Raster, places: str, to: str, of: str = "") -> dict[str, str]:
    return {f"{to}{c}": d.median(r.take(f"{c}{of}", places)) for c in "rgb"}


def _scatter(d: Dialect, places: str, air: str, of: str = "") -> str:
    """Median distance of the colours at some places from a colour."""
    far = " + ".join(f"pow({d.at(c + of, 'q')} - {air}{c}, 2)" for c in "rgb")
    return d.median(d.each(places, "q", f"sqrt({far})"))


def _towards_gray(air: str, confidence: str, s: Settings, low: str, when: str = "TRUE") -> dict[str, str]:
    """The airlight with less colour the less it is trusted."""
    mix = f"({s.color_protection} * (0.35 + 0.35 * (1.0 - {confidence})))"
    gray = luma_of(*(f"{air}{c}" for c in "rgb"))
    return {f"{air}{c}2": f"CASE WHEN {when} THEN {clip(f'{air}{c} * (1.0 - {mix}) + {gray} * {mix}', low)} END" for c in "rgb"}


def with_upper_air(p: Picture, s: Settings) -> Picture:
    """upper_r/g/b and upper_conf: median colour of unsaturated, smooth places of the upper frame between two luma percentiles."""
    d, r = p.d, Raster(p.d, UPPER, EDGE)
    p = p.add(ul=d.head("l", r.n)).add(ull=r.map(lambda q: f"{d.at('ul', q)} * {d.at('ul', q)}"))
    p = p.filtered(box(EDGE, 5), box(UPPER, 5), um="ul", umm="ull")
    p = p.add(uv=r.map(lambda q: f"greatest({d.at('umm', q)} - {d.at('um', q)} * {d.at('um', q)}, 0.0)"))
    p = p.add(u70=d.quantile("ul", 0.70), u96=d.quantile("ul", 0.96), uv65=d.quantile("uv", 0.65))
    pale = f"{_peak(d, 'p')} < 0.94"
    p = p.add(
        chosen=r.where(lambda q: f"{d.at('ul', q)} >= u70 AND {d.at('ul', q)} <= u96 AND {d.at('uv', q)} <= uv65 AND {pale}"),
        pale=r.where(lambda q: pale), every=d.range(r.n),
    )
    p = p.add(pool=f"CASE WHEN {d.size('chosen')} >= 8 THEN chosen WHEN {d.size('pale')} > 0 THEN pale ELSE every END", enough=f"{d.size('chosen')} >= 8")
    p = p.add(**_median_colour(d, r, "pool", "ua_"))
    p = p.add(ua_l=luma_of("ua_r", "ua_g", "ua_b"), ua_far=_scatter(d, "pool", "ua_"))
    sure = f"0.15 + 0.85 * {clip(f'{d.size("chosen")} / CAST({r.n} AS DOUBLE) / 0.12')} * (1.0 - {smooth('ua_far / greatest(ua_l, 0.025)', 0.12, 0.60)}) * {smooth('ua_l', 0.025, 0.12)}"
    p = p.add(upper_conf=f"CASE WHEN enough THEN {sure} ELSE 0.15 END", **{f"uc_{c}": clip(f"ua_{c}", "0.005") for c in "rgb"})
    got = _towards_gray("uc_", "upper_conf", s, "-1e9")
    return p.add(**{f"upper_{c}": got[f"uc_{c}2"].replace("least(1.0,", "least(1e9,") for c in "rgb"})


def with_broad_air(p: Picture, s: Settings) -> Picture:
    """broad_r/g/b and broad_conf, null without enough places: bright ends of the eroded dark channel, away from clipped light."""
    d, r = p.d, Raster(p.d)
    p = p.add(dark0=r.map(lambda q: f"least({', '.join(d.at(c, q) for c in 'rgb')})"), clip0=r.map(lambda q: f"CASE WHEN {_peak(d, q)} >= 0.94 THEN 1.0 ELSE 0.0 END"))
    p = p.stretched(5, False, dark="dark0").stretched(5, True, near_clip="clip0")
    p = p.filtered(box(EDGE, 5), box(EDGE, 5), r_box="r", g_box="g", b_box="b")
    p = p.add(open_=r.where(lambda q: f"{d.at('near_clip', q)} < 0.5"))
    p = p.add(d99=d.quantile(r.take("dark", "open_"), 0.99))
    p = p.add(bright=f"CASE WHEN {d.size('open_')} >= 8 THEN {d.keep('open_', 'q', d.at('dark', 'q') + ' >= d99')} END")
    p = p.add(**_median_colour(d, r, "bright", "ba_", "_box"))
    p = p.add(ba_l=luma_of("ba_r", "ba_g", "ba_b"), ba_far=_scatter(d, "bright", "ba_", "_box"))
    p = p.add(broad_conf=f"0.15 + 0.85 * (1.0 - {smooth('ba_far / greatest(ba_l, 1e-6)', 0.12, 0.60)}) * {smooth('ba_l', 0.001, 0.006)}")
    got = _towards_gray("ba_", "broad_conf", s, "0.00001", "ba_l IS NOT NULL")
    return p.add(**{f"broad_{c}": got[f"ba_{c}2"] for c in "rgb"})


def with_air(p: Picture, s: Settings = SHOWN) -> Picture:
    """ar, ag, ab and confidence: the upper frame's airlight, blended with the broad one where it is dark."""
    p = with_broad_air(with_upper_air(p, s), s)
    p = p.add(weight=f"CASE WHEN broad_r IS NULL THEN 0.0 ELSE 1.0 - {smooth(luma_of('upper_r', 'upper_g', 'upper_b'), 0.025, 0.12)} END")
    mixed = lambda c: f"upper_{c} * (1.0 - weight) + coalesce(broad_{c}, 0.0) * weight"
    return p.add(
        confidence="upper_conf * (1.0 - weight) + coalesce(broad_conf, 0.0) * weight",
        **{f"a{c}": f"CASE WHEN weight > 0 THEN {clip(mixed(c), '0.00001')} ELSE upper_{c} END" for c in "rgb"},
    )


def with_global_transmission(p: Picture, s: Settings = SHOWN) -> Picture:
    """global_t and its floor, from the 75th percentile of the dark channel."""
    d, r = p.d, Raster(p.d)
    haze = clip(f"({d.quantile(r.map(lambda q: f'least({", ".join(d.at(c, q) for c in "rgb")})'), 0.75)} - 0.03) / 0.92", "0.12", "0.92")
    omega = s.strength * (0.66 - 0.14 * s.fog_retention) * (0.90 + 0.10 * (1 - s.naturalness))
    floor = 0.27 + 0.21 * s.fog_retention + 0.11 * s.naturalness
    return p.add(haze_level=haze).add(global_t=clip(f"1.0 - {omega!r} * (0.92 + 0.08 * haze_level)", repr(floor)))


def with_backlight(p: Picture, s: Settings = SHOWN) -> Picture:
    """upper_luma, lower_luma, clipped and backlit_scale: less inversion against a clipped, bright sky over a very dark ground."""
    d, r = p.d, Raster(p.d)
    up = r.w * UPPER
    clipped = d.size(d.keep(d.range(up), "q", _peak(d, "q") + " > 0.95"))
    lower = d.each(d.keep(d.range(r.n), "q", f"q >= {r.w * (r.h // 2)}"), "q", d.at("l", "q"))
    p = p.add(upper_luma=d.median(d.head("l", up)), lower_luma=f"greatest({d.median(lower)}, 0.001)", clipped=f"{clipped} / CAST({up} AS DOUBLE)")
    sun = f"{smooth('clipped', 0.005, 0.015)} * (1.0 - {smooth('clipped', 0.15, 0.35)})"
    back = f"{sun} * {smooth('upper_luma / lower_luma', 8, 14)} * {smooth('upper_luma', 0.05, 0.10)}"
    unsure = f"(1.0 - {smooth('confidence', 0.65, 0.85)})"
    off = s.strength <= 1e-6 or s.brightness_protection <= 0
    return p.add(backlit_scale="1.0" if off else f"1.0 - {0.85 * s.brightness_protection!r} * {unsure} * {back}")


def gate(p: Picture, s: Settings, mode: str, spatial: bool) -> str:
    """Why a photo may not use the non-local field, the first reason that holds; empty if it may."""
    d, r = p.d, Raster(p.d)
    if mode == "off":
        return "''"
    if s.strength <= 1e-6:
        return "'zero_strength'"
    if not spatial:
        return "'manual_mode'"
    air = luma_of("ar", "ag", "ab")
    share = f"{d.size(r.where(lambda q: _peak(d, q) + ' >= 0.95'))} / CAST({r.n} AS DOUBLE)"
    least = 0.20 if mode == "strong" else 0.12
    return f"CASE WHEN {air} < {least} THEN 'low_airlight' WHEN confidence < 0.85 THEN 'uncertain_airlight' WHEN backlit_scale <> 1.0 THEN 'backlit_scene' WHEN {share} >= 0.002 THEN 'clipped_highlights' ELSE '' END"


def with_scene(p: Picture, s: Settings = SHOWN, spatial: bool = False, mode: str = "off") -> Picture:
    """t (one transmission for the photo), the airlight and what led to them.  spatial: from the median of a transmission map."""
    p = with_global_transmission(with_air(p, s), s)
    if spatial:
        from .spatial import with_transmission_map

        p, d, r = with_transmission_map(p, s), p.d, Raster(p.d)
        p = p.add(requested=d.median(r.map(lambda q: f"least({d.at('t_map', q)}, global_t)")))
    else:
        p = p.add(requested="global_t")
    p = with_backlight(p, s)
    p = p.add(t0="1.0 - (1.0 - requested) * confidence", optical_scale="backlit_scale" if spatial else "CAST(1 AS DOUBLE)")
    return p.add(t=f"CASE WHEN optical_scale < 1.0 THEN exp(ln({clip('t0', '1e-4')}) * optical_scale) ELSE t0 END", fallback_reason=gate(p, s, mode, spatial))


# ---- pixel rows -----------------------------------------------------------------------------------------------------


def inverse(t: str, s: Settings, peak: str = "greatest(r, g, b)") -> str:
    """A smooth majorant of max(t, floor) that backs off in highlights."""
    floor = 1 / s.gain
    width = 0.015 * (1 - floor)
    knee = f"greatest({t}, {floor!r})" + (f" + pow(greatest({width!r} - abs(({t}) - {floor!r}), 0.0), 2) / {4 * width!r}" if width > 0 else "")
    return clip(f"({knee}) + (1.0 - ({knee})) * {smooth(peak, 0.55, 0.95)} * {s.highlight_protection}", "1e-4")


def _each(expression: str) -> str:
    """Three columns from one expression with # for the channel."""
    return ", ".join(expression.replace("#", c) for c in "rgb")


def gamut(sql: str, of: str, to: str) -> str:
    """Colour scaled as a whole, at its luma, until no channel leaves 0 to 1."""
    y = luma_of(*(f"{of}{c}" for c in "rgb"))
    gy, gs = f"{to}gy", f"{to}gs"
    room = lambda c: f"CASE WHEN {of}{c} - {gy} > 0 THEN (1.0 - {gy}) / greatest({of}{c} - {gy}, 1e-7) ELSE {gy} / greatest({gy} - {of}{c}, 1e-7) END"
    one = f"SELECT *, {y} AS {gy} FROM ({sql})"
    two = f"SELECT *, {clip('least(' + ', '.join(room(c) for c in 'rgb') + ')')} AS {gs} FROM ({one})"
    return f"SELECT *, {_each(f'{clip(f"{gy} + ({of}# - {gy}) * {gs}")} AS {to}#')} FROM ({two})"


def ceiling(sql: str, of: str, to: str) -> str:
    """Added colour bounded at a luma that is not above the source's."""
    y1 = luma_of(*(f"{of}{c}" for c in "rgb"))
    ck, cs = f"{to}ck", f"{to}cs"
    one = f"SELECT *, least({y1}, y) / greatest(y, 1e-20) AS {ck} FROM ({sql})"
    room = lambda c: f"CASE WHEN {of}{c} - {c} * {ck} > 0 THEN greatest({c} - {c} * {ck}, 0.0) / greatest({of}{c} - {c} * {ck}, 1e-20) ELSE {c} * {ck} / greatest({c} * {ck} - {of}{c}, 1e-20) END"
    two = f"SELECT *, {clip('least(' + ', '.join(room(c) for c in 'rgb') + ')')} AS {cs} FROM ({one})"
    return f"SELECT *, {_each(f'{clip(f"# * {ck} + ({of}# - # * {ck}) * {cs}")} AS {to}#')} FROM ({two})"


def dehazed(sql: str, s: Settings, to: str = "o_") -> str:
    """Pixel rows (r, g, b, t, ar, ag, ab) with y and o_ + channel: the bounded inversion.

    Below the airlight a budget that vanishes at black bounds the loss: exact for its first half, then an
    exponential shoulder.  Above it a shoulder keeps white.  Colour follows the source the more it is protected.
    """
    one = f"SELECT *, {LUMA} AS y, {inverse('t', s)} AS e FROM ({sql})"
    deficit = "greatest(a# - #, 0.0)"
    loss = f"((1.0 / e - 1.0) * {deficit} * {deficit} / ({deficit} + 0.025 * a# + 1e-8))"
    budget = f"({1 - s.retention!r} * # * # / (# + 0.12 * a# + 1e-8) * {s.strength})"
    two = f"SELECT *, {_each(f'{loss} AS loss_#, {budget} AS budget_#')} FROM ({one})"
    part = "loss_# / greatest(budget_#, 1e-8)"
    bounded = f"(CASE WHEN {part} <= 0.5 THEN {part} ELSE 1.0 - 0.5 * exp(-2.0 * greatest({part} - 0.5, 0.0)) END)"
    above = "(a# + (# - a#) / (e + (1.0 - e) * greatest(# - a#, 0.0) / greatest(1.0 - a#, 1e-4)))"
    three = f"SELECT *, {_each(f'CASE WHEN # < a# THEN # - budget_# * {bounded} ELSE {above} END AS v_#')} FROM ({two})"
    spread = "sqrt(pow(r - y, 2) + pow(g - y, 2) + pow(b - y, 2))"
    four = f"SELECT *, {luma_of('v_r', 'v_g', 'v_b')} AS vy, {smooth(spread, 0.005, 0.08)} AS sure FROM ({three})"
    own = f"({(1 - s.color_protection) * (0.28 + 0.72 * (1 - s.naturalness))!r} * sure)"
    five = f"SELECT *, {_each(f'v_# * {own} + # * (vy / greatest(y, 1e-6)) * (1.0 - {own}) AS w_#')} FROM ({four})"
    six = f"SELECT *, {luma_of('w_r', 'w_g', 'w_b')} AS wy FROM ({five})"
    contrast = f"({0.15 * s.local_contrast * s.strength!r} * wy * (1.0 - wy) * (2.0 * wy - 1.0))"
    tone = clip(f"wy + greatest(-0.02 * wy, least(0.02 * (1.0 - wy), {contrast}))")
    more = f"(1.0 + {0.25 * s.color_recovery * s.strength!r} * sure)"
    seven = gamut(f"SELECT *, {_each(f'{tone} + (w_# - wy) * {more} AS x_#')} FROM ({six})", "x_", "z_")
    eight = f"SELECT *, least(1.0, y / greatest({luma_of('z_r', 'z_g', 'z_b')}, 1e-6)) AS dim FROM ({seven})"
    return ceiling(f"SELECT *, {_each('z_# * dim AS q_#')} FROM ({eight})", "q_", to)


def guarded(sql: str, of: str, to: str) -> str:
    """Dark background keeps its exposure: a floor on luma that follows the source, with a smooth handoff, on the source's hue."""
    one = f"SELECT *, {luma_of(*(f'{of}{c}' for c in 'rgb'))} AS ry, floor_level * (1.0 - exp(-y / greatest(floor_level, 1e-12))) AS fy FROM ({sql})"
    up = "greatest(ry, fy) + pow(greatest(0.02 * floor_level - abs(ry - fy), 0.0), 2) / (0.08 * greatest(floor_level, 1e-12)) - ry"
    two = f"SELECT *, CASE WHEN floor_level <= 1e-8 THEN 0.0 ELSE greatest({up}, 0.0) END AS lift FROM ({one})"
    three = ceiling(f"SELECT *, {_each(f'{of}# + # * (lift / greatest(y, 1e-20)) AS h_#')} FROM ({two})", "h_", "k_")
    return f"SELECT *, {_each(f'CASE WHEN lift > 0 THEN k_# ELSE {of}# END AS {to}#')} FROM ({three})"


def with_floor(p: Picture, s: Settings = SHOWN) -> Picture:
    """floor_level: 90th percentile of luma in the upper three tenths, times 1.25, protection and how dark the airlight is."""
    d = p.d
    top = d.quantile(d.head("l", EDGE * max(1, round(EDGE * 0.30))), 0.9)
    authority = f"(1.0 - {smooth(luma_of('ar', 'ag', 'ab'), 0.065, 0.09)})"
    return p.add(floor_level="CAST(0 AS DOUBLE)" if s.brightness_protection <= 0 else f"{top} * {1.25 * s.brightness_protection / 0.70!r} * {authority}")


def image_rows(p: Picture, *keep: str) -> str:
    """Pixel rows with r, g, b and the named columns of the photo."""
    d = p.d
    kept = "".join(f", {k}" for k in keep)
    slim = Picture(d, f"SELECT shot_id, r AS rs, g AS gs0, b AS bs{kept} FROM ({p.sql})")
    return slim.pixels(f"shot_id, x, y AS row_{kept}, {d.at('rs', 'p')} AS r, {d.at('gs0', 'p')} AS g, {d.at('bs', 'p')} AS b")


def as_bytes(of: str) -> str:
    return ", ".join(f"CAST({clip(f'floor({of}{c} * 255 + 0.5)', '0', '255')} AS INT) AS {c}" for c in "rgb")


# ---- queries --------------------------------------------------------------------------------------------------------


def rounded(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


@catalog.add
def upper_airlight(d: Dialect) -> str:
    p = with_upper_air(planes(d), SHOWN)
    return p.select(f"shot_id, CAST({d.size('chosen')} AS INT) AS places, " + rounded("upper_r upper_g upper_b upper_conf"))


@catalog.add
def broad_airlight(d: Dialect) -> str:
    p = with_broad_air(planes(d, 0.9), SHOWN)
    return p.select(f"shot_id, CAST({d.size('open_')} AS INT) AS places, " + rounded("d99 broad_r broad_g broad_b broad_conf"))


@catalog.add
def blended_airlight(d: Dialect) -> str:
    """On photos of a tenth of the light, where both estimates count."""
    return with_air(planes(d, 0.1)).select("shot_id, " + rounded("weight ar ag ab confidence"))


@catalog.add
def global_transmission(d: Dialect) -> str:
    """Transmission of a whole image from the 75th percentile of its dark channel."""
    return with_global_transmission(planes(d)).select("shot_id, round(global_t, 6) AS transmission")


@catalog.add
def backlit_medians(d: Dialect) -> str:
    """Median luma above and below, the clipped share above, and the scale of the inversion that follows."""
    p = with_backlight(with_air(planes(d)))
    return p.select("shot_id, " + rounded("upper_luma lower_luma clipped backlit_scale"))


@catalog.add
def nonlocal_gate(d: Dialect) -> str:
    p = with_scene(planes(d, 0.9), SHOWN, True, "strong")
    return p.select("shot_id, CASE WHEN fallback_reason = '' THEN 'eligible' ELSE fallback_reason END AS reason")


@catalog.add
def scene_estimate(d: Dialect) -> str:
    return with_scene(planes(d), SHOWN, True).select("shot_id, " + rounded("requested confidence optical_scale t ar ag ab"))


@catalog.add
def dark_background_floor(d: Dialect) -> str:
    """On photos of a tenth of the light: brighter airlight gives no floor."""
    return with_floor(with_air(planes(d, 0.1))).select("shot_id, round(floor_level, 8) AS floor_level")


@catalog.add
def inverse_transmission(d: Dialect) -> str:
    """Transmission with a smooth floor that backs off in highlights."""
    rows = image_rows(planes(d))
    return f"SELECT shot_id, x, row_ AS y, round({inverse('(1.0 - 0.6 * least(r, g, b))', SHOWN)}, 6) AS transmission FROM ({rows})"


@catalog.add
def gamut_scaling(d: Dialect) -> str:
    """Photos of 1.8 times their colour, brought back into range."""
    wide = f"SELECT shot_id, x, row_, {_each(f'{LUMA} + (# - {LUMA}) * 1.8 AS v#')} FROM ({image_rows(planes(d))})"
    return f"SELECT shot_id, x, row_ AS y, {_each('round(o_#, 5) AS #')} FROM ({gamut(wide, 'v', 'o_')})"


@catalog.add
def source_colour_ceiling(d: Dialect) -> str:
    """Added colour bounded at fixed luma."""
    rows = f"SELECT *, {LUMA} AS y, r * 0.9 AS vr, g * 0.8 AS vg, b * 1.1 AS vb FROM ({image_rows(planes(d))})"
    return f"SELECT shot_id, x, row_ AS y, {_each('round(o_#, 5) AS #')} FROM ({ceiling(rows, 'v', 'o_')})"


@catalog.add
def physical_pixels(d: Dialect) -> str:
    """Haze inversion of single pixels with a fixed airlight."""
    rows = f"SELECT *, {clip('1.0 - 0.5 * least(r, g, b)', '0.3')} AS t, 0.9 AS ar, 0.85 AS ag, 0.8 AS ab FROM ({image_rows(planes(d))})"
    return f"SELECT shot_id, x, row_ AS y, {_each('round(o_#, 5) AS #')} FROM ({dehazed(rows, SHOWN)})"


@catalog.add
def dark_background_guard(d: Dialect) -> str:
    rows = f"SELECT *, {LUMA} AS y, # FROM ({image_rows(with_floor(with_air(planes(d, 0.1))), 'floor_level')})".replace("#", _each("# * 0.6 AS v#"))
    return f"SELECT shot_id, x, row_ AS y, {_each('round(o_#, 6) AS #')} FROM ({guarded(rows, 'v', 'o_')})"


def physical(d: Dialect, s: Settings, spatial: bool, scale: float = 1.0) -> str:
    """Pixel rows with all columns and d_ + channel: the whole operator."""
    p = with_floor(with_scene(planes(d, scale), s, spatial), s)
    return guarded(dehazed(image_rows(p, "t", "ar", "ag", "ab", "floor_level"), s), "o_", "d_")


@catalog.add
def physical_dehaze(d: Dialect) -> str:
    return f"SELECT shot_id, x, row_ AS y, {as_bytes('d_')} FROM ({physical(d, SHOWN, False)})"


@catalog.add
def physical_dehaze_dark(d: Dialect) -> str:
    """The same on photos of a tenth of the light, where the guard counts."""
    return f"SELECT shot_id, x, row_ AS y, {_each('round(d_#, 5) AS #')} FROM ({physical(d, SHOWN, False, 0.1)})"


@catalog.add
def spatial_dehaze(d: Dialect) -> str:
    """The same with the scene's strength from a transmission map."""
    return f"SELECT shot_id, x, row_ AS y, {as_bytes('d_')} FROM ({physical(d, SHOWN, True)})"


@catalog.add
def physical_diagnostics(d: Dialect) -> str:
    r = Raster(d)
    p = with_floor(with_scene(planes(d), SHOWN, True))
    p = p.add(used=r.map(lambda q: inverse("t", SHOWN, _peak(d, q))))
    p = p.add(operator_min=d.least_of("used"), operator_median=d.median("used"))
    constant = f"round({SHOWN.gain!r}, 6) AS max_inverse_gain, round({1 - (1 - SHOWN.retention) * SHOWN.strength!r}, 6) AS shadow_retention_floor"
    return p.select(f"shot_id, {constant}, " + rounded("confidence t operator_min operator_median floor_level optical_scale"))

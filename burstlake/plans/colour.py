"""Colour work on pixel rows: the older haze removal, basic controls, tone and colour grading, film looks and camera profiles."""

from __future__ import annotations

import math

from .dialect import END, LEVEL, Catalog, Dialect
from .numeric import channel_fit, two_renderings
from .physical import SHOWN, Settings, as_bytes
from .rasters import clip, luma_of, smooth
from .views import rgb

catalog = Catalog()
LUMA = luma_of("r", "g", "b")


def then(sql: str, **columns: str) -> str:
    """The rows with more columns."""
    return f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM ({LEVEL}{sql}{END})"


def each(sql: str, **columns: str) -> str:
    """The same with one column per channel for each name; # stands for the channel in name and expression."""
    return then(sql, **{n.replace("_c", f"_{c}"): e.replace("#", c) for n, e in columns.items() for c in "rgb"})


def luma(prefix: str) -> str:
    return luma_of(*(f"{prefix}{c}" for c in "rgb"))


def shown(sql: str, of: str, digits: int = 5) -> str:
    return f"SELECT shot_id, x, y, {', '.join(f'round({of}{c}, {digits}) + 0.0 AS {c}' for c in 'rgb')} FROM ({sql})"


def soft_scale(room: str) -> str:
    """A smooth minimum of 1 and the room there is."""
    return clip(f"0.5 * (1.0 + {room} - sqrt((1.0 - {room}) * (1.0 - {room}) + 1e-10))")


def capped(sql: str, of: str, to: str, cap: str = "1.0") -> str:
    """Colour scaled as a whole at its luma until no channel is above its cap or below 0; # in cap is the channel."""
    y = f"{to}y"
    room = lambda c: f"CASE WHEN {of}{c} - {y} > 1e-7 THEN ({cap.replace('#', c)} - {y}) / ({of}{c} - {y}) WHEN {of}{c} - {y} < -1e-7 THEN {y} / ({y} - {of}{c}) ELSE 1e30 END"
    sql = then(sql, **{y: luma(of)})
    sql = then(sql, **{f"{to}room0": f"least({', '.join(map(room, 'rgb'))})"})
    sql = then(sql, **{f"{to}room": f"CASE WHEN {to}room0 >= 1e29 THEN 1.0 ELSE {to}room0 END"})
    sql = then(sql, **{f"{to}scale": soft_scale(f"{to}room")})
    return then(sql, **{f"{to}{c}": f"{y} + ({of}{c} - {y}) * {to}scale" for c in "rgb"})


# ---- the older haze removal -----------------------------------------------------------------------------------------


def brightened(sql: str, d: Dialect, of: str, to: str, s: Settings) -> str:
    """A curve for the whole photo where its mid-tones lost more light than allowed; rows with shot_id and r, g, b."""
    sql = then(sql, sl=LUMA, il=luma(of))
    mid = "CASE WHEN sl > 0.08 AND sl < 0.88 THEN {} END"
    over = "OVER (PARTITION BY shot_id)"
    median = lambda x: d.percentile(mid.format(x), 0.5) + f" {over}"
    sql = then(sql, s_mid=median("sl"), i_mid=median("il"), n_mid=f"count({mid.format('1')}) {over}")
    excess = f"greatest(0.0, log2(s_mid / i_mid) - {0.08 + 0.22 * s.strength!r})"
    sql = then(sql, stops=f"CASE WHEN n_mid >= 8 AND s_mid > 1e-5 AND i_mid > 1e-5 THEN least(0.40, {excess} * {s.brightness_protection}) ELSE 0.0 END")
    sql = then(sql, lift_="pow(CAST(2 AS DOUBLE), stops)")
    sql = then(sql, k_="CASE WHEN il > 1e-6 THEN lift_ / (1.0 + (lift_ - 1.0) * il) ELSE 1.0 END")
    sql = capped(then(sql, **{f"u_{c}": clip(f"{of}{c} * k_") for c in "rgb"}), "u_", "m_")
    keep = s.brightness_protection <= 1e-6
    return then(sql, **{f"{to}{c}": f"{of}{c}" if keep else f"CASE WHEN stops > 1e-6 THEN m_{c} ELSE {of}{c} END" for c in "rgb"})


def legacy(d: Dialect, s: Settings = SHOWN) -> str:
    """Pixel rows with final_ + channel: one transmission for the photo, blended, with colour recovery and guards."""
    bright = f"SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY least(r, g, b) DESC, y DESC, x DESC) AS n FROM ({rgb(d)})"
    top = f"SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY {LUMA} DESC, y DESC, x DESC) AS k FROM ({bright}) WHERE n <= 16"
    haze = clip(f"({d.percentile('least(r, g, b)', 0.75)} - 0.03) / 0.92", "0.12", "0.92")
    omega = s.strength * (0.66 - 0.14 * s.fog_retention) * (0.90 + 0.10 * (1 - s.naturalness))
    floor = 0.27 + 0.21 * s.fog_retention + 0.11 * s.naturalness
    scene = f"SELECT shot_id AS i, {clip(f'1.0 - {omega!r} * (0.92 + 0.08 * {haze})', repr(floor))} AS t FROM ({rgb(d)}) GROUP BY shot_id"
    air = f"SELECT shot_id AS j, {', '.join(f'{clip(d.percentile(c, 0.5), '0.35')} AS a0_{c}' for c in 'rgb')} FROM ({top}) WHERE k <= 2 GROUP BY shot_id"
    sql = f"SELECT shot_id, x, y, r, g, b, t, a0_r, a0_g, a0_b FROM ({rgb(d)}) p JOIN ({scene}) z ON z.i = p.shot_id JOIN ({air}) q ON q.j = p.shot_id"
    mix = 0.45 * s.color_protection * (0.65 + 0.35 * s.naturalness)
    sql = each(sql, a_c=clip(f"a0_# * {1 - mix!r} + (a0_r + a0_g + a0_b) / 3.0 * {mix!r}", "0.35"))
    sql = each(then(sql, y0=LUMA), rec_c=clip("a_# + (# - a_#) / (t + (1.0 - t) * greatest(# - a_#, 0.0) / greatest(1.0 - a_#, 1e-4))"))
    blend = min(0.82, max(0.0, s.strength * (0.78 - 0.28 * s.fog_retention) * (0.90 + 0.10 * (1 - s.naturalness))))
    sql = then(each(sql, n0_c=f"# * {1 - blend!r} + rec_# * {blend!r}"), y1=luma("n0_"))
    hold = s.color_protection * (0.72 + 0.28 * s.naturalness)
    sql = each(sql, n1_c=f"n0_# * {1 - hold!r} + {clip('# * (y1 / greatest(y0, 1e-4))')} * {hold!r}")
    high, low = smooth("y0", 0.58, 0.98), f"({smooth('0.26 - y0', 0.0, 0.26)})"
    sql = then(sql, high=high, low=low)
    if s.color_recovery > 1e-6:
        amount = s.color_recovery * s.strength
        sql = then(sql, sc="sqrt(pow(r - y0, 2) + pow(g - y0, 2) + pow(b - y0, 2))", y2=luma("n1_"))
        sql = then(sql, sure=smooth("sc", 0.006, 0.09), nc="sqrt(pow(n1_r - y2, 2) + pow(n1_g - y2, 2) + pow(n1_b - y2, 2))")
        sql = each(sql, way_c="(# - y0) / greatest(sc, 1e-6)")
        along = "greatest(0.0, " + " + ".join(f"(n1_{c} - y2) * way_{c}" for c in "rgb") + ")"
        sql = then(sql, goal=f"greatest({along} * sure, nc * (1.0 + {0.30 * amount!r} * sure) * sure, sc * (1.0 + {1.80 * s.color_recovery!r} * sure))")
        sql = then(sql, guard=f"(1.0 - high * {s.highlight_protection}) * (1.0 - low * {s.shadow_protection})")
        asked = clip(f"{amount!r} * guard * (0.95 + 0.35 * (1.0 - sure))", "0.0", "0.95")
        neutral = f"{s.color_protection * s.strength * (1.08 + 0.12 * s.naturalness)!r} * (1.0 - sure) * guard"
        sql = then(sql, fix=clip(f"greatest({asked}, {neutral})", "0.0", "0.95"))
        sql = capped(each(sql, n2_c="y2 + (n1_# - y2) * (1.0 - fix) + way_# * goal * fix"), "n2_", "n3_")
    else:
        sql = each(sql, n3_c="n1_#")
    if s.local_contrast > 1e-6:
        sql = then(sql, y3=luma("n3_"))
        curve = f"y3 + {0.55 * s.local_contrast * s.strength!r} * (2.0 * y3 - 1.0) * y3 * (1.0 - y3)"
        sql = each(sql, n4_c=f"n3_# * (({curve}) / greatest(y3, 1e-4))")
    else:
        sql = each(sql, n4_c="n3_#")
    back = lambda x, w: f"({x} * (1.0 - {w}) + # * {w})"
    sql = each(sql, n5_c=back(back("n4_#", f"(high * {s.highlight_protection})"), f"(low * {s.shadow_protection})"))
    sql = brightened(sql, d, "n5_", "n6_", s)
    near = 0.97 - 1.5 / 255
    sql = then(sql, dim=f"least(1.0, (CASE WHEN y0 < 0.97 THEN {near!r} ELSE 1.0 END) / greatest({luma('n6_')}, 1e-4))")
    cap = f"(CASE WHEN # < 0.97 THEN {near!r} ELSE 1.0 END)"
    sql = each(sql, n7_c="n6_# * dim")
    return capped(sql, "n7_", "final_", cap) if s.color_recovery > 1e-6 else each(sql, final_c=f"least(n7_#, {cap})")


@catalog.add
def legacy_dehaze(d: Dialect) -> str:
    return f"SELECT shot_id, x, y, {as_bytes('final_')} FROM ({legacy(d)})"


@catalog.add
def brightness_protection(d: Dialect) -> str:
    """On results that are the square of their source."""
    rows = each(rgb(d), v_c="# * #")
    return shown(brightened(rows, d, "v_", "w_", SHOWN), "w_")


@catalog.add
def smooth_chroma_caps(d: Dialect) -> str:
    """Photos of 1.5 times their colour under a cap of 0.9 per channel."""
    rows = each(then(rgb(d), l0=LUMA), v_c="l0 + (# - l0) * 1.5")
    return shown(capped(rows, "v_", "w_", "0.9"), "w_")


@catalog.add
def dehaze_dispatch(d: Dialect) -> str:
    """Which path a request takes: none at zero strength, else the first backend of its list that is there, else the processor."""
    asked = d.at(d.list("'auto'", "'cuda'", "'mps'", "'opencl'", "'cpu'", "'other'"), "event_id % 6")
    has = lambda n, m: f"(user_id % {n} = {m})"
    first = f"CASE WHEN {has(5, 0)} THEN 'cuda' WHEN {has(7, 0)} THEN 'mps' WHEN {has(3, 0)} THEN 'opencl' ELSE 'cpu' END"
    own = f"CASE WHEN wish = 'cuda' AND {has(5, 0)} THEN 'cuda' WHEN wish = 'mps' AND {has(7, 0)} THEN 'mps' WHEN wish = 'opencl' AND {has(3, 0)} THEN 'opencl' ELSE 'cpu' END"
    one = f"SELECT event_id, user_id, {asked} AS wish, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE 0.5 END AS strength FROM events"
    return f"SELECT event_id, wish, CASE WHEN strength <= 1e-6 THEN 'unchanged' WHEN wish IN ('auto', 'other') THEN {first} ELSE {own} END AS path FROM ({one})"


# ---- tone and colour controls ---------------------------------------------------------------------------------------


def exposed(c: str, stops: float) -> str:
    """Stops in linear light on display values."""
    if not stops:
        return c
    lin = f"((CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END) * {2.0**stops!r})"
    return f"(CASE WHEN {lin} <= 0.0031308 THEN {lin} * 12.92 ELSE 1.055 * pow({lin}, {1 / 2.4!r}) - 0.055 END)"


def at_luma(sql: str, of: str, to: str, now: str, goal: str) -> str:
    """Channels scaled alike to a new luma, at most until the first of them is 1; black becomes gray."""
    scale = f"least(({goal}) / (CASE WHEN {now} > 1e-8 THEN {now} ELSE 1.0 END), 1.0 / (CASE WHEN {to}max > 1e-8 THEN {to}max ELSE 1.0 END))"
    sql = then(sql, **{f"{to}max": f"greatest({', '.join(f'{of}{c}' for c in 'rgb')})"})
    sql = then(sql, **{f"{to}k": scale})
    return then(sql, **{f"{to}{c}": f"CASE WHEN {now} <= 1e-8 THEN {goal} ELSE {of}{c} * {to}k END" for c in "rgb"})


@catalog.add
def luma_preserving_adjust(d: Dialect) -> str:
    return shown(at_luma(then(rgb(d), l0=LUMA, goal="pow(" + LUMA + ", 0.8)"), "", "v_", "l0", "goal"), "v_")


@catalog.add
def basic_controls(d: Dialect) -> str:
    """Exposure 0.3, contrast 20, highlights -25, shadows 30, whites 10, blacks -15, vibrance 15, saturation 10."""
    sql = each(rgb(d), a_c=f"({exposed('#', 0.3)} - 0.5) * 1.2 + 0.5")
    up = 30 * 0.0022 - 15 * 0.0008
    high = -25 * 0.0018 + 10 * 0.0008
    sql = then(sql, l1=luma("a_"))
    sql = then(sql, tone=f"{up!r} * pow({clip('(0.62 - l1) / 0.62')}, 1.5) + {high!r} * pow({clip('(l1 - 0.38) / 0.62')}, 1.5)")
    sql = then(each(sql, b_c="a_# + tone"), l2="0.2126 * (a_r + tone) + 0.7152 * (a_g + tone) + 0.0722 * (a_b + tone)")
    sql = then(sql, vib=f"1.0 + 0.15 * {clip('1.0 - greatest(abs(b_r - l2), abs(b_g - l2), abs(b_b - l2))')}")
    sql = each(sql, e_c="l2 + (b_# - l2) * 1.1 * vib")
    return f"SELECT shot_id, x, y, {as_bytes('e_')} FROM ({sql})"


#: Where the eight colour ranges have their middle, in degrees.
HUES = (0.0, 30.0, 60.0, 120.0, 180.0, 210.0, 275.0, 315.0)
#: What the registered queries move: hue, saturation and lightness for each range.
SHIFTS = ((10, 5, -5), (-5, 10, 0), (0, 20, 5), (8, -10, 0), (0, 0, 10), (-10, 15, 0), (5, 0, -10), (0, -20, 5))


def to_hsv(sql: str, of: str, to: str) -> str:
    r, g, b = (f"{of}{c}" for c in "rgb")
    mx, mn = f"{to}mx", f"{to}mn"
    sql = then(sql, **{mx: f"greatest({r}, {g}, {b})", mn: f"least({r}, {g}, {b})"})
    hue = f"CASE WHEN {mx} = {mn} THEN 0.0 WHEN {mx} = {r} THEN 60 * ({g} - {b}) / ({mx} - {mn}) WHEN {mx} = {g} THEN 120 + 60 * ({b} - {r}) / ({mx} - {mn}) ELSE 240 + 60 * ({r} - {g}) / ({mx} - {mn}) END"
    sql = then(sql, **{f"{to}h0": hue})
    return then(sql, **{f"{to}h": f"CASE WHEN {to}h0 < 0 THEN {to}h0 + 360 ELSE {to}h0 END", f"{to}s": f"CASE WHEN {mx} > 0 THEN ({mx} - {mn}) / {mx} ELSE 0.0 END", f"{to}v": mx})


def from_hsv(sql: str, h: str, s: str, v: str, to: str) -> str:
    """Channels from hue in degrees (any), saturation and value."""
    k = lambda n: f"({n} + {h} / 60.0) - 6.0 * floor(({n} + {h} / 60.0) / 6.0)"
    sql = then(sql, **{f"{to}k{c}": k(n) for c, n in zip("rgb", ("5.0", "3.0", "1.0"), strict=True)})
    return then(sql, **{f"{to}{c}": f"{v} - {v} * {s} * greatest(0.0, least({to}k{c}, 4.0 - {to}k{c}, 1.0))" for c in "rgb"})


def hsl_adjusted(sql: str, of: str, to: str, shifts=SHIFTS) -> str:
    """Eight overlapping colour ranges with Gaussian weights of 18 degrees."""
    sql = to_hsv(sql, of, f"{to}i")
    h, s, v = (f"{to}i{x}" for x in "hsv")
    w = lambda c: f"exp(-0.5 * pow((180 - abs(180 - abs({h} - {c!r}))) / 18.0, 2))"
    sql = then(sql, **{f"{to}w{n}": w(c) for n, c in enumerate(HUES)})
    total = f"greatest({' + '.join(f'{to}w{n}' for n in range(8))}, 1e-7)"
    part = lambda k: f"({' + '.join(f'{to}w{n} * ({m[k]})' for n, m in enumerate(shifts))}) / {total}"
    sql = then(sql, **{f"{to}dh": part(0), f"{to}ds": part(1), f"{to}dl": part(2)})
    sql = then(sql, **{f"{to}h": f"{h} + {to}dh", f"{to}s": clip(f"{s} * (1.0 + 1.75 * {to}ds / 100)"), f"{to}v": clip(f"{v} + 0.012 * {to}dl / 100 * {clip(f'{s} * 4.0')}")})
    return from_hsv(sql, f"{to}h", f"{to}s", f"{to}v", f"{to}_")


@catalog.add
def hsl_band_weights(d: Dialect) -> str:
    """The adjustments that each pixel gets, and its new saturation and value."""
    sql = hsl_adjusted(rgb(d), "", "q")
    return f"SELECT shot_id, x, y, round(qdh, 5) + 0.0 AS hue_shift, round(qs, 5) AS saturation, round(qv, 5) AS value FROM ({sql})"


@catalog.add
def hsl_adjustments(d: Dialect) -> str:
    return shown(hsl_adjusted(rgb(d), "", "q"), "q_")


def masks(lightness: str, balance: float = 0.0, blending: float = 50.0) -> dict[str, str]:
    """Shadows, mid-tones and highlights of a lightness in 0 to 1; wider the more they blend, darker the more balance favours highlights."""
    shift, width, high = 0.2 * balance / 100, 0.2 + 0.6 * blending / 100, 0.15 + 0.4 * blending / 100
    shadow = f"(1.0 - {smooth(lightness, 0.5 - shift - width / 2, 0.5 - shift + width / 2)})"
    highlight = smooth(lightness, 0.725 - shift - high / 2, 0.725 - shift + high / 2)
    return {"shadow": shadow, "highlight": highlight, "midtone": f"((1.0 - {shadow}) * (1.0 - {highlight}))"}


#: Linear sRGB to the white-relative tristimulus values and back.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FROM_XYZ = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)


def to_lab(sql: str, of: str, to: str) -> str:
    """to + l (0 to 100), a and b of display values."""
    lin = lambda c: f"(CASE WHEN {of}{c} <= 0.04045 THEN {of}{c} / 12.92 ELSE pow(({of}{c} + 0.055) / 1.055, 2.4) END)"
    sql = then(sql, **{f"{to}lin_{c}": lin(c) for c in "rgb"})
    sql = then(sql, **{f"{to}{n}": f"({' + '.join(f'{k} * {to}lin_{c}' for k, c in zip(m, 'rgb', strict=True))}) / {w}" for n, m, w in zip(("tx", "ty", "tz"), TO_XYZ, WHITE, strict=True)})
    f = lambda t: f"(CASE WHEN {t} > 0.008856 THEN pow({t}, {1 / 3!r}) ELSE 7.787 * {t} + {16 / 116!r} END)"
    sql = then(sql, **{f"{to}f{n}": f(f"{to}t{n}") for n in "xyz"})
    light = f"CASE WHEN {to}ty > 0.008856 THEN 116 * {to}fy - 16 ELSE 903.3 * {to}ty END"
    return then(sql, **{f"{to}l": light, f"{to}a": f"500 * ({to}fx - {to}fy)", f"{to}b": f"200 * ({to}fy - {to}fz)"})


def from_lab(sql: str, light: str, a: str, b: str, to: str) -> str:
    """Display values of L, a, b, in range or not."""
    ty = f"(CASE WHEN {light} > 8.0 THEN pow(({light} + 16) / 116, 3) ELSE {light} / 903.3 END)"
    sql = then(sql, **{f"{to}yy": ty})
    sql = then(sql, **{f"{to}fy": f"CASE WHEN {to}yy > 0.008856 THEN ({light} + 16) / 116 ELSE 7.787 * {to}yy + {16 / 116!r} END"})
    sql = then(sql, **{f"{to}fx": f"{to}fy + ({a}) / 500", f"{to}fz": f"{to}fy - ({b}) / 200"})
    back = lambda f: f"(CASE WHEN {f} > {6 / 29!r} THEN pow({f}, 3) ELSE ({f} - {16 / 116!r}) / 7.787 END)"
    sql = then(sql, **{f"{to}xx": f"{back(f'{to}fx')} * {WHITE[0]}", f"{to}zz": f"{back(f'{to}fz')} * {WHITE[2]}"})
    sql = then(sql, **{f"{to}lin_{c}": " + ".join(f"({k}) * {to}{n}" for k, n in zip(m, ("xx", "yy", "zz"), strict=True)) for c, m in zip("rgb", FROM_XYZ, strict=True)})
    out = lambda x: f"CASE WHEN {x} <= 0.0031308 THEN {x} * 12.92 ELSE 1.055 * pow({x}, {1 / 2.4!r}) - 0.055 END"
    return then(sql, **{f"{to}{c}": out(f"{to}lin_{c}") for c in "rgb"})


@catalog.add
def tone_masks(d: Dialect) -> str:
    m = masks("lstar / 100", 20.0, 60.0)
    return f"SELECT shot_id, x, y, {', '.join(f'round({e}, 6) AS {n}s' for n, e in m.items())} FROM ({then(to_lab(rgb(d), '', 'q'), lstar='ql')})"


#: Wheels of the registered queries: hue in degrees, saturation, tone range, and the shift in Lab that 100 stands for.
WHEELS = ((210.0, 30.0, "shadow", 14.0), (40.0, 25.0, "highlight", 10.0), (120.0, 20.0, "midtone", 6.0), (15.0, 5.0, None, 14.0))


def graded(sql: str, of: str, to: str, wheels=WHEELS, balance: float = 0.0, blending: float = 50.0) -> str:
    """Colour wheels as one shift of a and b by tone range; where a colour leaves the range its chroma is halved in until it fits."""
    sql = to_lab(each(sql, **{f"{to}in_c": clip(f"{of}#")}), f"{to}in_", f"{to}p")
    m = masks(f"({to}pl / 100)", balance, blending) | {None: "1.0"}
    shift = lambda turn: " + ".join(f"{m[part]} * {sat / 100 * amount * turn(math.radians(hue))!r}" for hue, sat, part, amount in wheels)
    sql = then(sql, **{f"{to}da": shift(math.cos), f"{to}db": shift(math.sin)})
    sql = then(sql, **{f"{to}a": f"{to}pa + {to}da", f"{to}b": f"{to}pb + {to}db", f"{to}lo0": "CAST(0 AS DOUBLE)", f"{to}hi0": "CAST(1 AS DOUBLE)"})
    inside = lambda x: f"least({x}r, {x}g, {x}b) >= 0 AND greatest({x}r, {x}g, {x}b) <= 1"
    sql = from_lab(sql, f"{to}pl", f"{to}a", f"{to}b", f"{to}z")
    for k in range(8):
        half = f"(({to}lo{k} + {to}hi{k}) * 0.5)"
        sql = from_lab(sql, f"{to}pl", f"{to}a * {half}", f"{to}b * {half}", f"{to}y{k}")
        sql = then(sql, **{f"{to}lo{k + 1}": f"CASE WHEN {inside(f'{to}y{k}')} THEN {half} ELSE {to}lo{k} END", f"{to}hi{k + 1}": f"CASE WHEN {inside(f'{to}y{k}')} THEN {to}hi{k} ELSE {half} END"})
    sql = from_lab(sql, f"{to}pl", f"{to}a * {to}lo8 * 0.995", f"{to}b * {to}lo8 * 0.995", f"{to}u")
    return each(sql, **{f"{to}_c": clip(f"CASE WHEN {inside(f'{to}z')} THEN {to}z# ELSE {to}u# END")})


@catalog.add
def colour_grading_lab(d: Dialect) -> str:
    return shown(graded(rgb(d), "", "w"), "w_", 4)


def interpolated(x: str, knots: list[tuple[float, float]]) -> str:
    """A piecewise linear curve, level outside its knots."""
    out = repr(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = f"CASE WHEN {x} < {float(x1)!r} THEN {float(y0)!r} + ({x} - {float(x0)!r}) * {(y1 - y0) / (x1 - x0)!r} ELSE {out} END"
    return f"(CASE WHEN {x} <= {float(knots[0][0])!r} THEN {float(knots[0][1])!r} ELSE {out} END)"


#: A film look of the registered queries: basic values, and curves in 0 to 255.
LOOK = {
    "exposure": 0.2, "contrast": 15.0, "shadows": 20.0, "highlights": -15.0, "whites": 5.0, "blacks": -10.0, "saturation": -8.0, "vibrance": 12.0, "temperature": 150.0, "tint": -40.0,
    "master": [(0, 8), (64, 58), (128, 132), (192, 200), (255, 248)], "r": [(0, 0), (128, 132), (255, 255)], "g": [(0, 0), (255, 255)], "b": [(0, 6), (128, 124), (255, 250)],
}


def film(sql: str, look: dict = LOOK, gray: bool = False) -> str:
    """Pixel rows with film_ + channel: white balance, exposure, tone by luma, colour ranges, wheels, then the curves."""
    t, tint = look["temperature"], look["tint"]
    gains = {"r": max(0.6, 1 + t / 10000 + tint / 20000), "g": max(0.6, 1 + tint / 10000), "b": max(0.6, 1 - t / 10000 + tint / 20000)}
    sql = then(sql, **{f"f0_{c}": exposed(f"({c} * {g!r})", look["exposure"]) for c, g in gains.items()})
    sql = then(sql, f_l0=luma("f0_"))
    c0 = clip("f_l0")
    sql = then(sql, f_goal0=clip(f"{c0} + {look['contrast'] / 100!r} * 16.0 * pow({c0}, 2) * pow(1.0 - {c0}, 2) * ({c0} - 0.5)"))
    sql = then(at_luma(sql, "f0_", "f1_", "f_l0", "f_goal0"), f_l1=luma("f1_"))
    low, high = f"pow({clip('(0.62 - f_l1) / 0.62')}, 1.5)", f"pow({clip('(f_l1 - 0.38) / 0.62')}, 1.5)"
    s = {k: look[k] / 100 for k in ("shadows", "highlights", "whites", "blacks")}
    sql = then(sql, f_goal1=clip(f"f_l1 + {s['shadows'] * 0.22 + s['blacks'] * 0.08!r} * {low} + {s['highlights'] * 0.18 + s['whites'] * 0.08!r} * {high}"))
    sql = at_luma(sql, "f1_", "f2_", "f_l1", "f_goal1")
    sql = then(sql, f_l2=luma("f2_"), f_lift=clip("greatest(f_goal1 - f_l1, 0.0) / greatest(f_goal1, 0.05)"))
    sql = each(sql, f3_c=clip("f_l2 + (f2_# - f_l2) * (1.0 - 0.6 * f_lift)"))
    if gray:
        sql = then(sql, f_l3=luma("f3_"))
        sql = each(sql, f6_c="f_l3")
    else:
        sql = hsl_adjusted(sql, "f3_", "f4")
        sql = then(sql, f_l3=luma("f4_"))
        sql = then(sql, f_vib=f"1.0 + {look['vibrance'] / 100!r} * {clip('1.0 - greatest(abs(f4_r - f_l3), abs(f4_g - f_l3), abs(f4_b - f_l3))')}")
        sql = graded(each(sql, f5_c=clip(f"f_l3 + (f4_# - f_l3) * {1 + look['saturation'] / 100!r} * f_vib")), "f5_", "f6")
        sql = then(sql, **{f"f7_{c}": interpolated(f"f6_{c}", [(a / 255, b / 255) for a, b in look[c]]) for c in "rgb"})
    last = "f6_" if gray else "f7_"
    sql = then(sql, f_l4=luma(last))
    sql = then(sql, f_goal2=interpolated("f_l4", [(a / 255, b / 255) for a, b in look["master"]]))
    return at_luma(sql, last, "film_", "f_l4", "f_goal2")


@catalog.add
def film_look(d: Dialect) -> str:
    return shown(film(rgb(d)), "film_", 4)


@catalog.add
def film_look_gray(d: Dialect) -> str:
    return f"SELECT shot_id, x, y, {as_bytes('film_')} FROM ({film(rgb(d), gray=True)})"


# ---- measured responses: a table of changes by range, saturation, lightness and hue --------------------------------


#: The grid of the table, and the rule that fills it in the registered queries; a measured table has the same columns.
SATS, LIGHTS = (0.10, 0.25, 0.45, 0.70, 0.95), (0.05, 0.20, 0.50, 0.80, 0.95)


def response_table(d: Dialect) -> str:
    """si, li, hue, dr, dg, db: what one slider changes at a grid point."""
    grid = f"SELECT si, li, hue FROM (SELECT 1 AS one) {d.series(len(SATS), 'si')} {d.series(len(LIGHTS), 'li')} {d.series(360, 'hue')}"
    near = "exp(-0.5 * pow((180 - abs(180 - abs(hue - 30))) / 25.0, 2))"
    s, l_ = (d.at(d.list(*[f"CAST({v} AS DOUBLE)" for v in values]), i) for values, i in ((SATS, "si"), (LIGHTS, "li")))
    return f"SELECT si, li, hue, 0.05 * {near} * {s} AS dr, -0.03 * {near} * {s} * {l_} AS dg, 0.02 * {near} * (1.0 - {l_}) AS db FROM ({grid})"


def to_hls(sql: str, of: str, to: str) -> str:
    sql = to_hsv(sql, of, f"{to}c")
    mx, mn = f"{to}cmx", f"{to}cmn"
    light = f"(({mx} + {mn}) / 2.0)"
    sat = f"CASE WHEN {mx} = {mn} THEN 0.0 WHEN {light} < 0.5 THEN ({mx} - {mn}) / ({mx} + {mn}) ELSE ({mx} - {mn}) / (2.0 - {mx} - {mn}) END"
    return then(sql, **{f"{to}h": f"{to}ch", f"{to}l": light, f"{to}s": sat})


@catalog.add
def measured_hsl_residual(d: Dialect) -> str:
    """Each pixel with the table's change at its hue, saturation and lightness, linear in all three; none outside the grid."""
    sql = to_hls(rgb(d), "", "q")
    cell = lambda x, knots: f"(CASE {' '.join(f'WHEN {x} < {k} THEN {n}' for n, k in enumerate(knots[1:-1]))} ELSE {len(knots) - 2} END)"
    value = lambda knots, i: d.at(d.list(*[f"CAST({v} AS DOUBLE)" for v in knots]), i)
    e = 2e-5
    sql = then(sql, inside=f"qs >= {SATS[0] - e!r} AND qs <= {SATS[-1] + e!r} AND ql >= {LIGHTS[0] - e!r} AND ql <= {LIGHTS[-1] + e!r}", s_=clip("qs", repr(SATS[0]), repr(SATS[-1])), l_=clip("ql", repr(LIGHTS[0]), repr(LIGHTS[-1])), h0="CAST(floor(qh) AS INT) % 360", hf="qh - floor(qh)")
    sql = then(sql, s0=cell("s_", SATS), l0=cell("l_", LIGHTS))
    sql = then(sql, sf=f"(s_ - {value(SATS, 's0')}) / ({value(SATS, 's0 + 1')} - {value(SATS, 's0')})", lf=f"(l_ - {value(LIGHTS, 'l0')}) / ({value(LIGHTS, 'l0 + 1')} - {value(LIGHTS, 'l0')})")
    corner = f"SELECT *, c % 2 AS ds, {d.div('c', '2')} % 2 AS dl, {d.div('c', '4')} AS dh FROM ({sql}) {d.series(8, 'c')}"
    part = lambda n, f: f"(CASE WHEN {n} = 1 THEN {f} ELSE 1.0 - {f} END)"
    keyed = f"SELECT shot_id, x, y, r, g, b, inside, s0 + ds AS ks, l0 + dl AS kl, (h0 + dh) % 360 AS kh, {part('ds', 'sf')} * {part('dl', 'lf')} * {part('dh', 'hf')} AS w FROM ({corner})"
    got = f"SELECT shot_id, x, y, r, g, b, inside, sum(w * dr) AS er, sum(w * dg) AS eg, sum(w * db) AS eb FROM ({keyed}) k JOIN ({response_table(d)}) t ON t.si = k.ks AND t.li = k.kl AND t.hue = k.kh GROUP BY shot_id, x, y, r, g, b, inside"
    return f"SELECT shot_id, x, y, {', '.join(f'round(CASE WHEN inside THEN {clip(f'{c} + e{c}')} ELSE {c} END, 6) AS {c}' for c in 'rgb')} FROM ({got})"


@catalog.add
def measured_gray_grading(d: Dialect) -> str:
    """The gray of each pixel, in steps of 1/4095, through a response of the gray ramp (here a rule)."""
    lin = lambda c: f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"
    sql = then(rgb(d), y_lin=luma_of(*map(lin, "rgb")))
    sql = then(sql, gray=f"CASE WHEN y_lin <= 0.0031308 THEN y_lin * 12.92 ELSE 1.055 * pow(y_lin, {1 / 2.4!r}) - 0.055 END")
    sql = then(sql, step=f"CAST({clip('floor(gray * 4095 + 0.5)', '0', '4095')} AS INT)")
    ramp = {"r": f"step / 4095.0 + 0.06 * (1.0 - {smooth('step / 4095.0', 0.2, 0.6)})", "g": "step / 4095.0", "b": f"step / 4095.0 - 0.04 * {smooth('step / 4095.0', 0.5, 0.9)}"}
    return f"SELECT shot_id, x, y, step, {', '.join(f'CAST(floor({clip(e)} * 255 + 0.5) AS INT) AS {c}' for c, e in ramp.items())} FROM ({sql})"


@catalog.add
def measured_grading_wheels(d: Dialect) -> str:
    """Lab changes of a gray ramp at each pixel's lightness, turned to the wheel's hue and scaled by its saturation (here rules)."""
    sql = to_lab(rgb(d), "", "q")
    shadow, high = f"(1.0 - {smooth('ql', 10.0, 60.0)})", smooth("ql", 50.0, 95.0)
    wheels = ((210.0, 40.0, {"l": f"0.5 * {shadow}", "a": f"9.0 * {shadow}", "b": f"1.0 * {shadow}"}), (45.0, -30.0, {"l": f"-0.3 * {high}", "a": f"7.0 * {high}", "b": f"0.5 * {high}"}))
    move = {"l": [], "a": [], "b": []}
    for hue, sat, change in wheels:
        c, s, k = math.cos(math.radians(hue)), math.sin(math.radians(hue)), sat / 100
        move["l"].append(f"{change['l']} * {k!r}")
        move["a"].append(f"({change['a']} * {c!r} - {change['b']} * {s!r}) * {k!r}")
        move["b"].append(f"({change['a']} * {s!r} + {change['b']} * {c!r}) * {k!r}")
    sql = then(sql, **{f"n{x}": f"q{x} + {' + '.join(parts)}" for x, parts in move.items()})
    return shown(each(from_lab(sql, "nl", "na", "nb", "z"), out_c=clip("z#")), "out_", 4)


# ---- camera profiles ------------------------------------------------------------------------------------------------


#: A profile of the registered queries: camera matrix, white, table sizes (hue, saturation, value), tone curve.
MATRIX = ((0.80, 0.15, 0.05), (0.10, 0.85, 0.05), (0.02, 0.18, 0.80))
WHITE_POINT, TABLE, TONE = (0.95, 1.0, 0.9), (12, 4, 3), [(0.0, 0.0), (0.05, 0.03), (0.25, 0.28), (0.5, 0.6), (0.8, 0.9), (1.0, 1.0)]
#: The wide working space to linear sRGB.
TO_SRGB = ((2.0340760, -0.7273340, -0.3067413), (-0.2288110, 1.2317190, -0.0029080), (-0.0085698, -0.1532860, 1.1618558))


def encoded(x: str) -> str:
    return f"(CASE WHEN {x} <= 0.0031308 THEN greatest({x}, 0.0) * 12.92 ELSE 1.055 * pow({x}, {1 / 2.4!r}) - 0.055 END)"


def decoded(x: str) -> str:
    return f"(CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END)"


def looked(sql: str, of: str, to: str, table: tuple[int, int, int] = TABLE) -> str:
    """Hue shift, saturation and value factors from a table over hue, saturation and encoded value, linear in between.

    The table is a rule of its indices here: shift 3 (h + s), factors that grow with s and v.
    """
    hues, sats, values = table
    sql = to_hsv(sql, of, f"{to}t")
    sql = then(sql, **{f"{to}e": clip(encoded(f"{to}tv"))})
    sql = then(sql, **{f"{to}hc": f"({to}th / 360.0) * {hues}", f"{to}sc": f"{clip(f'{to}ts')} * {sats - 1}", f"{to}vc": f"{to}e * {values - 1}"})
    sql = then(sql, **{f"{to}h0": f"CAST(floor({to}hc) AS INT) % {hues}", f"{to}hf": f"{to}hc - floor({to}hc)", f"{to}s0": f"CAST(least(floor({to}sc), {sats - 2}) AS INT)", f"{to}v0": f"CAST(least(floor({to}vc), {values - 2}) AS INT)"})
    sql = then(sql, **{f"{to}sf": f"{to}sc - {to}s0", f"{to}vf": f"{to}vc - {to}v0"})
    rule = {"dh": "3.0 * cos(({h}) * 0.5235987755982988) * ({s})", "ks": "1.0 + 0.05 * ({s}) - 0.02 * ({v})", "kv": "1.0 + 0.02 * ({v}) - 0.01 * ({s})"}
    def mixed(name: str) -> str:
        terms = []
        for k in range(8):
            i, j, m = k % 2, k // 2 % 2, k // 4
            w = " * ".join(f"{to}{f}f" if bit else f"(1.0 - {to}{f}f)" for f, bit in (("h", i), ("s", j), ("v", m)))
            terms.append(f"{w} * ({rule[name].format(h=f'({to}h0 + {i}) % {hues}', s=f'{to}s0 + {j}', v=f'{to}v0 + {m}')})")
        return " + ".join(terms)

    sql = then(sql, **{f"{to}{n}": mixed(n) for n in rule})
    sql = then(sql, **{f"{to}nh": f"{to}th + {to}dh", f"{to}ns": clip(f"{to}ts * {to}ks"), f"{to}nv": decoded(clip(f"{to}e * {to}kv"))})
    return from_hsv(sql, f"{to}nh", f"{to}ns", f"{to}nv", to)


def toned(sql: str, of: str, to: str, curve: list[tuple[float, float]] = TONE) -> str:
    """The curve on the smallest and largest channel; the one between keeps its place between them."""
    lo, hi = f"{to}lo", f"{to}hi"
    sql = then(sql, **{lo: f"least({of}r, {of}g, {of}b)", hi: f"greatest({of}r, {of}g, {of}b)"})
    sql = then(sql, **{f"{to}nlo": interpolated(lo, curve), f"{to}nhi": interpolated(hi, curve)})
    return then(sql, **{f"{to}{c}": f"{to}nlo + ({to}nhi - {to}nlo) * (CASE WHEN {hi} - {lo} > 1e-12 THEN ({of}{c} - {lo}) / ({hi} - {lo}) ELSE 0.0 END)" for c in "rgb"})


def projected(sql: str, of: str) -> str:
    """Working space to display bytes."""
    lin = {c: " + ".join(f"({k}) * {of}{i}" for k, i in zip(m, "rgb", strict=True)) for c, m in zip("rgb", TO_SRGB, strict=True)}
    sql = then(sql, **{f"pr_{c}": e for c, e in lin.items()})
    return f"SELECT shot_id, x, y, {', '.join(f'CAST({clip(f'floor({encoded(f'pr_{c}')} * 255 + 0.5)', '0', '255')} AS INT) AS {c}' for c in 'rgb')} FROM ({sql})"


@catalog.add
def profile_look(d: Dialect) -> str:
    return shown(looked(rgb(d), "", "k_"), "k_")


@catalog.add
def profile_tone(d: Dialect) -> str:
    return shown(toned(rgb(d), "", "k_"), "k_")


@catalog.add
def profile_project(d: Dialect) -> str:
    return projected(rgb(d), "")


@catalog.add
def profile_render(d: Dialect) -> str:
    """Camera values below the white point through matrix, half a stop, look, tone and projection."""
    sql = then(rgb(d), **{f"cw_{c}": f"least({c}, {w})" for c, w in zip("rgb", WHITE_POINT, strict=True)})
    sql = then(sql, **{f"base_{c}": clip(" + ".join(f"{k} * cw_{i}" for k, i in zip(m, "rgb", strict=True))) for c, m in zip("rgb", MATRIX, strict=True)})
    sql = each(sql, up_c=clip(f"base_# * {2**0.5!r}"))
    return projected(toned(looked(sql, "up_", "lk_"), "lk_", "tn_"), "tn_")


@catalog.add
def enhancement_transfer(d: Dialect) -> str:
    """What an enhancement changed in a reference rendering, carried to camera values: luma as a ratio, colour through the fitted matrix.

    The camera values are r, g, b, the reference is the second rendering and the enhanced one its square root; photos whose
    fit fails are left out.
    """
    fit = channel_fit(d, two_renderings(d), (0.30, 0.50, 0.75, 0.95), 12)
    p = {f"{a}{b}": f"c{a}{b}" for a in "rgb" for b in "rgb"}
    minor = lambda a, b: (lambda u, v: f"({p[u[0] + v[0]]} * {p[u[1] + v[1]]} - {p[u[0] + v[1]]} * {p[u[1] + v[0]]})")("rgb".replace(a, ""), "rgb".replace(b, ""))
    sign = lambda a, b: "-" if ("rgb".index(a) + "rgb".index(b)) % 2 else ""
    one = then(fit, det=f"crr * {minor('r', 'r')} - crg * {minor('r', 'g')} + crb * {minor('r', 'b')}")
    inverse = f"SELECT shot_id AS i, {', '.join(f'{sign(a, b)}{minor(b, a)} / det AS v{a}{b}' for a in 'rgb' for b in 'rgb')} FROM ({one})"
    sql = each(two_renderings(d), enh_c="sqrt(greatest(t#, 0.0))")
    sql = then(sql, ref_l=luma("t"), enh_l=luma("enh_"))
    sql = then(sql, ratio="CASE WHEN ref_l * 65535 < 1.0 THEN 0.0 ELSE enh_l / greatest(ref_l, 1.0 / 65535) END")
    sql = each(sql, res_c="CASE WHEN ref_l * 65535 < 1.0 THEN 0.0 ELSE enh_# - t# * ratio END")
    out = ", ".join(f"CAST({clip(f'floor(({c} * ratio + ' + ' + '.join(f'res_{a} * v{a}{c}' for a in 'rgb') + ') * 65535 + 0.5)', '0', '65535')} AS INT) AS {c}" for c in "rgb")
    return f"SELECT shot_id, x, y, {out} FROM ({sql}) q JOIN ({inverse}) z ON z.i = q.shot_id"


@catalog.add
def linear_to_u16(d: Dialect) -> str:
    return f"SELECT shot_id, x, y, {', '.join(f'CAST({clip(f'floor({decoded(c)} * 65535 + 0.5)', '0', '65535')} AS INT) AS {c}' for c in 'rgb')} FROM ({rgb(d)})"


@catalog.add
def colour_profile_transform(d: Dialect) -> str:
    """16-bit values of a matrix profile (gamma 2.2, wide primaries) as display values."""
    sql = each(rgb(d), lin_c="pow(#, 2.2)")
    sql = then(sql, **{f"s_{c}": " + ".join(f"({k}) * lin_{i}" for k, i in zip(m, "rgb", strict=True)) for c, m in zip("rgb", TO_SRGB, strict=True)})
    return f"SELECT shot_id, x, y, {', '.join(f'CAST({clip(f'floor({encoded(f's_{c}')} * 255 + 0.5)', '0', '255')} AS INT) AS {c}' for c in 'rgb')} FROM ({sql})"

"""Numeric operators over pixel tables: exposure, airlight, histograms, look-up tables, filters, colour algebra."""

from __future__ import annotations

from .dialect import Catalog, Dialect
from .rasters import EDGE, Picture, Raster, box, clip, gauss, luma_of, planes
from .views import neighbour, photos, reflected, rgb

catalog = Catalog()

LUMA = luma_of("r", "g", "b")


def with_exposure(p: Picture) -> Picture:
    """ev and reason: stops that lift the median luma to 0.18, held back by the brightest channel and by two stops."""
    d, r = p.d, Raster(p.d)
    p = p.add(m=d.median("l"), peak=d.most_of(r.map(lambda q: f"greatest({', '.join(d.at(c, q) for c in 'rgb')})")))
    p = p.add(goal="CASE WHEN m > 1e-8 THEN log2(0.18 / m) END", room="CASE WHEN peak <= 0 THEN 2.0 ELSE log2(0.95 / peak) END")
    why = "CASE WHEN m <= 1e-8 THEN 'black' WHEN goal <= 0 THEN 'target_reached' WHEN room <= 1e-8 THEN 'highlight_limited' WHEN room < least(goal, 2.0) - 1e-7 THEN 'highlight_limited' ELSE 'applied' END"
    return p.add(ev="CASE WHEN goal IS NULL OR goal <= 0 OR room <= 1e-8 THEN 0.0 ELSE least(goal, room, 2.0) END", reason=why)


@catalog.add
def auto_exposure_ev(d: Dialect) -> str:
    """On photos of three tenths of the light."""
    return with_exposure(planes(d, 0.3)).select("shot_id, round(ev, 6) AS ev, reason")


@catalog.add
def auto_exposure_apply(d: Dialect) -> str:
    """Each photo by its own estimate."""
    p = with_exposure(planes(d, 0.3))
    slim = Picture(d, f"SELECT shot_id, r AS rs, g AS gs, b AS bs, pow(CAST(2 AS DOUBLE), ev) AS gain FROM ({p.sql})")
    return slim.pixels("shot_id, x, y, " + ", ".join(f"round({d.at(c + 's', 'p')} * gain, 6) AS {c}" for c in "rgb"))


@catalog.add
def brightness_gain(d: Dialect) -> str:
    """How much to lift a result: its median drop against the source, in stops, beyond an allowance, at most 0.40; over mid-tones."""
    r = Raster(d)
    p = planes(d).add(after=r.map(lambda q: f"pow({d.at('l', q)}, 1.9)"), mid=r.where(lambda q: f"{d.at('l', q)} > 0.08 AND {d.at('l', q)} < 0.88"))
    p = p.add(before_m=d.median(r.take("l", "mid")), after_m=d.median(r.take("after", "mid")))
    drop = f"greatest(0.0, log2(before_m / after_m) - {0.08 + 0.22 * 0.7!r})"
    some = f"{d.size('mid')} >= 8 AND before_m > 1e-5 AND after_m > 1e-5"
    return p.select(f"shot_id, round(CASE WHEN {some} THEN pow(CAST(2 AS DOUBLE), least(0.40, {drop} * 0.5)) ELSE 1.0 END, 6) AS gain")


def binned(d: Dialect) -> str:
    """shot_id, bin, n, mx, my: 64 bins of red, with the means of red and green."""
    return f"SELECT shot_id, bin, count(*) AS n, avg(s) AS mx, avg(t) AS my FROM (SELECT shot_id, least(63, CAST(floor(r * 255 * (64 / CAST(256 AS DOUBLE))) AS INT)) AS bin, r * 255 AS s, g * 255 AS t FROM ({rgb(d)})) GROUP BY shot_id, bin"


@catalog.add
def binned_means_64(d: Dialect) -> str:
    return f"SELECT shot_id, bin, n, round(mx, 6) AS mean_x, round(my, 6) AS mean_y FROM ({binned(d)})"


def _pooled() -> str:
    """Blocks (n, s, c) of equal fit: weight, weighted sum and number of bins."""
    none = "CAST(array() AS ARRAY<STRUCT<n: DOUBLE, s: DOUBLE, c: INT>>)"
    fresh = "named_struct('n', CAST(v.n AS DOUBLE), 's', CAST(v.s AS DOUBLE), 'c', 1, 'm', 0, 'open', true)"
    grown = "named_struct('n', a.n + t.n, 's', a.s + t.s, 'c', a.c + t.c, 'm', a.m + 1, 'open', true)"
    shut = "named_struct('n', a.n, 's', a.s, 'c', a.c, 'm', a.m, 'open', false)"
    taken = f"aggregate(reverse(st), {fresh}, (a, t) -> CASE WHEN a.open AND t.s / t.n > a.s / a.n THEN {grown} WHEN a.open THEN {shut} ELSE a END)"
    push = f"transform(array({taken}), w -> concat(slice(st, 1, size(st) - w.m), array(named_struct('n', w.n, 's', w.s, 'c', w.c))))[0]"
    return f"aggregate(bins, {none}, (st, v) -> {push})"


def with_isotonic(d: Dialect) -> Picture:
    """shot_id, bins, many and fits: the weighted isotonic fit of each photo's binned means; bx are the means of red.

    In Spark by pooling: each bin is put on a stack of blocks and takes in those before it whose mean is higher.  In plain SQL at k
    it is the largest over i <= k of the smallest over j >= k of the mean of i..j, from running sums in one array.
    """
    at = d.at
    order = "array_sort(collect_list(struct(bin, CAST(n AS DOUBLE) AS n, n * my AS s, mx)))" if d.spark else "list_sort(list(struct_pack(bin := bin, n := CAST(n AS DOUBLE), s := n * my, mx := mx)))"
    p = Picture(d, f"SELECT shot_id, {order} AS bins FROM ({binned(d)}) GROUP BY shot_id").add(many=d.size("bins"))
    if d.spark:
        return p.add(bx=d.each("bins", "v", "v.mx"), blocks=_pooled()).add(fits="flatten(transform(blocks, k -> array_repeat(k.s / k.n, k.c)))")
    upto = lambda f: d.each(d.range("(many + 1)"), "k", "coalesce(" + d.total(d.each(d.head_of("bins", "k"), "v", f"v.{f}")) + ", 0.0)")
    p = p.add(cn=upto("n"), cs=upto("s"), bx=d.each("bins", "v", "v.mx"))
    mean = f"({at('cs', 'j + 1')} - {at('cs', 'i')}) / ({at('cn', 'j + 1')} - {at('cn', 'i')})"
    lows = d.least_of(d.each(d.keep(d.range("many"), "j0", "j0 >= k"), "j", mean))
    return p.add(fits=d.each(d.range("many"), "k", d.most_of(d.each(d.range("(k + 1)"), "i", lows))))


@catalog.add
def isotonic_minmax(d: Dialect) -> str:
    return f"SELECT shot_id, {d.at('bins', 'q')}.bin AS bin, round({d.at('fits', 'q')}, 5) AS fitted FROM ({with_isotonic(d).sql}) {d.series(64, 'q')} WHERE q < many"


@catalog.add
def curve_simplify(d: Dialect) -> str:
    """Knots of each photo's fitted curve, 16 at most: the point worst served by straight lines is added until all are within 0.75."""
    at = d.at
    p = with_isotonic(d)
    before = d.most_of(d.keep("s_.knots", "k", "k <= i"))
    after = d.least_of(d.keep("s_.knots", "k", "k >= i"))
    line = f"{at('fits', 'lo')} + CASE WHEN hi = lo THEN 0.0 ELSE ({at('bx', 'i')} - {at('bx', 'lo')}) * ({at('fits', 'hi')} - {at('fits', 'lo')}) / ({at('bx', 'hi')} - {at('bx', 'lo')}) END"
    off = d.each(d.range("many"), "i", d.let(before, "lo", d.let(after, "hi", f"abs({at('fits', 'i')} - ({line}))")))
    worst = d.least_of(d.keep(d.range("many"), "i", f"{at('o_', 'i')} = {d.most_of('o_')}"))
    grown = f"array_sort(array_append(s_.knots, CAST({worst} AS INT)))" if d.spark else f"list_sort(list_append(s_.knots, CAST({worst} AS INT)))"
    same, more = d.record(knots="s_.knots", done="1"), d.record(knots=grown, done="0")
    step = d.let(off, "o_", f"CASE WHEN {d.most_of('o_')} <= 0.75 THEN {same} ELSE {more} END")
    ends = f"CASE WHEN many = 1 THEN {d.list('CAST(0 AS INT)')} ELSE {d.list('CAST(0 AS INT)', 'CAST(many - 1 AS INT)')} END"
    p = p.add(start=ends)
    p = p.add(fitted=d.iterate(d.record(knots="start", done="0"), 14, "s_", f"CASE WHEN s_.done = 1 THEN s_ ELSE {step} END"))
    knot = at("fitted.knots", "q")
    return f"SELECT shot_id, q AS knot, round({at('bx', knot)}, 5) AS x, round({at('fits', knot)}, 5) AS y FROM ({p.sql}) {d.series(16, 'q')} WHERE q < {d.size('fitted.knots')}"


def channel_fit(d: Dialect, rows: str, uppers: tuple[float, ...], least: int) -> str:
    """shot_id, upper, and c + row + column: the 3 x 3 matrix that takes r, g, b to tr, tg, tb by least squares.

    From rows with all six above 0.01 and below an upper bound; of the bounds in order the first with enough rows, a well-conditioned
    solution (below 100) and a mean error of at most 0.003 counts.
    """
    pair = [(a, b) for n, a in enumerate("rgb") for b in "rgb"[n:]]
    sums = ", ".join([f"sum({a} * {b}) AS s{a}{b}" for a, b in pair] + [f"sum({a} * t{b}) AS q{a}{b}" for a in "rgb" for b in "rgb"])
    bounds = " UNION ALL ".join(f"SELECT {n} AS nth, CAST({u} AS DOUBLE) AS upper" for n, u in enumerate(uppers))
    use = f"SELECT * FROM ({rows}) JOIN ({bounds}) ON least(r, g, b) > 0.01 AND least(tr, tg, tb) > 0.01 AND greatest(r, g, b) < upper AND greatest(tr, tg, tb) < upper"
    gram = f"SELECT shot_id AS s, nth AS m, count(*) AS n, {sums} FROM ({use}) GROUP BY shot_id, nth"
    # The inverse of the symmetric Gram matrix, by cofactors.
    g = lambda a, b: f"s{a}{b}" if (a, b) in pair else f"s{b}{a}"
    rest = {"r": "gb", "g": "rb", "b": "rg"}
    def cofactor(a: str, b: str) -> str:
        (p, q), (u, v) = rest[a], rest[b]
        sign = "-" if ("rgb".index(a) + "rgb".index(b)) % 2 else ""
        return f"{sign}({g(p, u)} * {g(q, v)} - {g(p, v)} * {g(q, u)})"

    p = Picture(d, gram).add(**{f"k{a}{b}": cofactor(a, b) for a in "rgb" for b in "rgb"})
    p = p.add(det="srr * krr + srg * krg + srb * krb")
    p = p.add(**{f"c{a}{b}": f"({' + '.join(f'k{a}{x} * q{x}{b}' for x in 'rgb')}) / nullif(det, 0.0)" for a in "rgb" for b in "rgb"})
    # Condition from the eigenvalues of C'C in closed form.
    p = p.add(**{f"e{a}{b}": " + ".join(f"c{x}{a} * c{x}{b}" for x in "rgb") for a, b in pair}).add(mid="(err + egg + ebb) / 3.0")
    p = p.add(wide="sqrt((pow(err - mid, 2) + pow(egg - mid, 2) + pow(ebb - mid, 2) + 2.0 * (erg * erg + erb * erb + egb * egb)) / 6.0)")
    det3 = "((err - mid) * ((egg - mid) * (ebb - mid) - egb * egb) - erg * (erg * (ebb - mid) - egb * erb) + erb * (erg * egb - (egg - mid) * erb))"
    p = p.add(turn=f"CASE WHEN wide > 1e-12 THEN acos(greatest(-1.0, least(1.0, {det3} / (2.0 * wide * wide * wide)))) / 3.0 ELSE 0.0 END")
    p = p.add(large="mid + 2.0 * wide * cos(turn)", small="mid + 2.0 * wide * cos(turn + 2.0943951023931953)")
    eight = p.sql
    good = f"SELECT * FROM ({eight}) WHERE n >= {least} AND abs(det) > 1e-18 AND small > 0 AND sqrt(large / small) <= 100"
    miss = " + ".join(f"abs(r * cr{c} + g * cg{c} + b * cb{c} - t{c})" for c in "rgb")
    error = f"SELECT u.shot_id AS es, u.nth AS em, avg(({miss}) / 3.0) AS error FROM ({use}) u JOIN ({good}) f ON f.s = u.shot_id AND f.m = u.nth GROUP BY u.shot_id, u.nth"
    kept = f"SELECT f.*, error, row_number() OVER (PARTITION BY s ORDER BY m) AS first FROM ({good}) f JOIN ({error}) e ON e.es = f.s AND e.em = f.m WHERE error <= 0.003"
    return f"SELECT s AS shot_id, CAST(m AS INT) AS bound, {', '.join(f'c{a}{b}' for a in 'rgb' for b in 'rgb')}, error FROM ({kept}) WHERE first = 1"


def two_renderings(d: Dialect) -> str:
    """Pixel rows with a second rendering that is linear below 0.6 and bends above."""
    bend = lambda x: f"(CASE WHEN {x} < 0.6 THEN {x} ELSE 0.6 + 0.8 * ({x} - 0.6) END)"
    mixed = {"r": "0.8 * r + 0.1 * g + 0.1 * b", "g": "0.05 * r + 0.9 * g + 0.05 * b", "b": "0.1 * r + 0.15 * g + 0.75 * b"}
    return f"SELECT shot_id, x, y, r, g, b, {', '.join(f'{bend(e)} AS t{c}' for c, e in mixed.items())} FROM ({rgb(d)})"


@catalog.add
def normal_equations(d: Dialect) -> str:
    """Sums of products for the 3 x 3 least squares of two renderings, over their mid-tones."""
    use = f"SELECT * FROM ({two_renderings(d)}) WHERE least(r, g, b) > 0.01 AND greatest(r, g, b) < 0.75 AND greatest(tr, tg, tb) < 0.75"
    terms = ", ".join(f"round(sum({a} * {c}), 5) AS {a}{c}" for a in ("r", "g", "b") for c in ("r", "g", "b", "tr", "tg", "tb") if len(c) > 1 or c >= a)
    return f"SELECT shot_id, count(*) AS n, {terms} FROM ({use}) GROUP BY shot_id"


@catalog.add
def colour_fit(d: Dialect) -> str:
    """The solved matrix of each photo, with the first range of values that gives a good one (12 pixels at least)."""
    fit = channel_fit(d, two_renderings(d), (0.30, 0.50, 0.75, 0.95), 12)
    return f"SELECT shot_id, bound, {', '.join(f'round(c{a}{b}, 4) + 0.0 AS c{a}{b}' for a in 'rgb' for b in 'rgb')} FROM ({fit})"


@catalog.add
def box_filter_reflect(d: Dialect) -> str:
    """The mean of 3 x 3 neighbours of luma, mirrored at the border, read from the photo's own array."""
    p = planes(d).filtered(box(EDGE, 1), box(EDGE, 1), m="l")
    slim = Picture(d, f"SELECT shot_id, m FROM ({p.sql})")
    return slim.pixels(f"shot_id, x, y, round({d.at('m', 'p')}, 6) AS mean")


@catalog.add
def gaussian_axis_blur(d: Dialect) -> str:
    """A Gaussian of one pixel along rows and columns, mirrored at the border."""
    p = planes(d).filtered(gauss(EDGE, 1.0), gauss(EDGE, 1.0), m="g")
    slim = Picture(d, f"SELECT shot_id, m FROM ({p.sql})")
    return slim.pixels(f"shot_id, x, y, round({d.at('m', 'p')}, 6) AS g")


@catalog.add
def dark_channel_airlight(d: Dialect) -> str:
    """Median colour of the brightest eighth of the 16 pixels of highest dark channel, clipped to 0.35..1."""
    one = f"SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY least(r, g, b) DESC, y DESC, x DESC) AS n FROM ({rgb(d)})"
    two = f"SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY {LUMA} DESC, y DESC, x DESC) AS k FROM ({one}) WHERE n <= 16"
    out = ", ".join(f"round({clip(d.percentile(c, 0.5), '0.35')}, 6) AS {c}" for c in "rgb")
    return f"SELECT shot_id, {out} FROM ({two}) WHERE k <= 2 GROUP BY shot_id"


@catalog.add
def rgb_peak(d: Dialect) -> str:
    return f"SELECT shot_id, round(max(greatest(r, g, b)), 6) AS peak FROM ({rgb(d)}) GROUP BY shot_id"


@catalog.add
def piecewise_curve_apply(d: Dialect) -> str:
    """A tone curve through knots, linear in between: an interval join with a small table of segments."""
    knots = [(0, 0), (40, 20), (96, 100), (160, 190), (255, 255)]
    seg = " UNION ALL ".join(f"SELECT {a} AS x0, {b} AS y0, {c} AS x1, {e} AS y1" for (a, b), (c, e) in zip(knots, knots[1:], strict=False))
    return f"SELECT shot_id, x, y, round(y0 + (r * 255 - x0) * (y1 - y0) / CAST(x1 - x0 AS DOUBLE), 6) AS value FROM ({rgb(d)}) JOIN ({seg}) ON r * 255 >= x0 AND (r * 255 < x1 OR (x1 = 255 AND r * 255 <= 255))"


@catalog.add
def box_filter_array(d: Dialect) -> str:
    """The same 3 x 3 mean read straight from the image's array, without any join."""
    total = " + ".join(neighbour(d, dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return f"SELECT shot_id, x, y, round(({total}) / CAST(9 AS DOUBLE), 6) AS mean FROM (SELECT shot_id, gray, CAST(p % 8 AS INT) AS x, CAST({d.div('p', '8')} AS INT) AS y FROM ({photos(d)}) {d.series(64, 'p')})"


@catalog.add
def gaussian_kernel(d: Dialect) -> str:
    """Weights of the blurs that part sizes ask for (a tenth of the size is the width), taken four widths far."""
    sigma = "(size / 10.0)"
    wide = f"SELECT size, CAST(floor(round({sigma} * 8 + 1) / 2) AS INT) AS reach FROM (SELECT DISTINCT p_size AS size FROM part)"
    one = f"SELECT size, o - reach AS place, exp(-0.5 * pow((o - reach) / {sigma}, 2)) AS g FROM ({wide}) {d.series('(2 * reach + 1)', 'o')}"
    if not d.spark:
        one = f"SELECT size, o - reach AS place, exp(-0.5 * pow((o - reach) / {sigma}, 2)) AS g FROM (SELECT *, unnest(range(2 * reach + 1)) AS o FROM ({wide}))"
    return f"SELECT size, CAST(place AS INT) AS place, round(g / sum(g) OVER (PARTITION BY size), 6) AS weight FROM ({one})"


@catalog.add
def luminance(d: Dialect) -> str:
    return f"SELECT shot_id, x, y, round({LUMA}, 6) AS luma FROM ({rgb(d)})"


@catalog.add
def smooth_chroma_gamut(d: Dialect) -> str:
    """Chroma scaled by one smooth factor per pixel so that every channel stays in range."""
    src = f"SELECT shot_id, x, y, l, (r - l) * 1.8 AS cr, (g - l) * 1.8 AS cg, (b - l) * 1.8 AS cb FROM (SELECT *, {LUMA} AS l FROM ({rgb(d)}))"
    room = lambda c: f"CASE WHEN {c} > 1e-7 THEN (1.0 - l) / {c} WHEN {c} < -1e-7 THEN l / (-{c}) ELSE 1e30 END"
    one = f"SELECT *, least({room('cr')}, {room('cg')}, {room('cb')}) AS lim0 FROM ({src})"
    two = f"SELECT *, CASE WHEN lim0 >= 1e29 THEN 1.0 ELSE lim0 END AS lim FROM ({one})"
    three = f"SELECT *, {clip('0.5 * (1.0 + lim - sqrt((1.0 - lim) * (1.0 - lim) + 1e-10))')} AS s FROM ({two})"
    return f"SELECT shot_id, x, y, round(l + cr * s, 5) AS r, round(l + cg * s, 5) AS g, round(l + cb * s, 5) AS b FROM ({three})"


@catalog.add
def srgb_to_linear(d: Dialect) -> str:
    f = lambda c: f"round(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END, 6) AS {c}"
    return f"SELECT shot_id, x, y, {', '.join(map(f, 'rgb'))} FROM ({rgb(d)})"


@catalog.add
def widen_and_quantise(d: Dialect) -> str:
    """8 to 16 bits, down to 10 bits, and back to 16."""
    ten = "CAST(floor(v * 257 * 1023 / CAST(65535 AS DOUBLE) + 0.5) AS INT)"
    return f"SELECT shot_id, x, y, v * 257 AS wide, {ten} AS ten, CAST(floor({ten} * 65535 / CAST(1023 AS DOUBLE) + 0.5) AS INT) AS expanded FROM (SELECT shot_id, x, y, CAST(round(r * 255) AS INT) AS v FROM ({rgb(d)}))"


@catalog.add
def vignetting(d: Dialect) -> str:
    r2 = "((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) / 24.5"
    return f"SELECT shot_id, x, y, round(r / (1.0 - 0.3 * {r2} + 0.05 * {r2} * {r2}), 6) AS r FROM ({rgb(d)})"


@catalog.add
def lens_remap_bilinear(d: Dialect) -> str:
    """Radial distortion: source coordinates, then four mirrored corners of the image's array."""
    k = "(1.0 + 0.05 * ((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) / 24.5)"
    one = f"SELECT shot_id, gray, x, y, 3.5 + (x - 3.5) * {k} AS sx, 3.5 + (y - 3.5) * {k} AS sy FROM (SELECT shot_id, gray, CAST(p % 8 AS INT) AS x, CAST({d.div('p', '8')} AS INT) AS y FROM ({photos(d)}) {d.series(64, 'p')})"
    two = f"SELECT *, CAST(floor(sx) AS INT) AS ix, CAST(floor(sy) AS INT) AS iy FROM ({one})"
    g = lambda dx, dy: d.at("gray", f"8 * {reflected(f'(iy + {dy})', '8')} + {reflected(f'(ix + {dx})', '8')}")
    fx, fy = "(sx - ix)", "(sy - iy)"
    v = f"{g(0, 0)} * (1.0 - {fx}) * (1.0 - {fy}) + {g(1, 0)} * {fx} * (1.0 - {fy}) + {g(0, 1)} * (1.0 - {fx}) * {fy} + {g(1, 1)} * {fx} * {fy}"
    return f"SELECT shot_id, x, y, round({v}, 6) AS value FROM ({two})"


@catalog.add
def gain_map_bilinear(d: Dialect) -> str:
    """A 3 x 3 gain grid read bilinearly at each pixel, with a shoulder above 0.9."""
    grid = lambda i, j: f"(1.0 + 0.05 * (({i}) - 1) * (({i}) - 1) + 0.04 * ({j}))"
    one = f"SELECT shot_id, x, y, r, x * 2 / 7.0 AS gx, y * 2 / 7.0 AS gy FROM ({rgb(d)})"
    two = f"SELECT *, least(1, CAST(floor(gx) AS INT)) AS ix, least(1, CAST(floor(gy) AS INT)) AS iy FROM ({one})"
    fx, fy = "(gx - ix)", "(gy - iy)"
    gain = f"({grid('ix', 'iy')} * (1.0 - {fx}) * (1.0 - {fy}) + {grid('ix + 1', 'iy')} * {fx} * (1.0 - {fy}) + {grid('ix', 'iy + 1')} * (1.0 - {fx}) * {fy} + {grid('ix + 1', 'iy + 1')} * {fx} * {fy})"
    three = f"SELECT shot_id, x, y, r * {gain} AS v FROM ({two})"
    return f"SELECT shot_id, x, y, round(CASE WHEN v <= 0.9 THEN v ELSE 0.9 + 0.1 * (1.0 - exp(-(v - 0.9) / 0.1)) END, 6) AS v FROM ({three})"


@catalog.add
def warp_rectilinear(d: Dialect) -> str:
    """Radial and tangential distortion around the centre: source coordinates, then four mirrored corners."""
    one = f"SELECT shot_id, gray, x, y, (x - 3.5) / 4.95 AS u, (y - 3.5) / 4.95 AS v FROM (SELECT shot_id, gray, CAST(p % 8 AS INT) AS x, CAST({d.div('p', '8')} AS INT) AS y FROM ({photos(d)}) {d.series(64, 'p')})"
    two = f"SELECT *, u * u + v * v AS q FROM ({one})"
    f = "(1.0 + 0.03 * q - 0.01 * q * q + 0.002 * q * q * q)"
    three = f"SELECT shot_id, gray, x, y, 3.5 + 4.95 * (u * {f} + 2.0 * 0.004 * u * v + 0.003 * (q + 2.0 * u * u)) AS sx, 3.5 + 4.95 * (v * {f} + 2.0 * 0.003 * u * v + 0.004 * (q + 2.0 * v * v)) AS sy FROM ({two})"
    four = f"SELECT *, CAST(floor(sx) AS INT) AS ix, CAST(floor(sy) AS INT) AS iy FROM ({three})"
    g = lambda dx, dy: d.at("gray", f"8 * {reflected(f'(iy + {dy})', '8')} + {reflected(f'(ix + {dx})', '8')}")
    fx, fy = "(sx - ix)", "(sy - iy)"
    v = f"{g(0, 0)} * (1.0 - {fx}) * (1.0 - {fy}) + {g(1, 0)} * {fx} * (1.0 - {fy}) + {g(0, 1)} * (1.0 - {fx}) * {fy} + {g(1, 1)} * {fx} * {fy}"
    return f"SELECT shot_id, x, y, round({v}, 5) AS value FROM ({four})"


@catalog.add
def display_exposure(d: Dialect) -> str:
    """Half a stop in linear light on display values."""
    lin = lambda c: f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"
    up = lambda c: f"({lin(c)} * pow(CAST(2 AS DOUBLE), 0.5))"
    out = lambda c: f"round(CASE WHEN {up(c)} <= 0.0031308 THEN {up(c)} * 12.92 ELSE 1.055 * pow({up(c)}, 1.0 / 2.4) - 0.055 END, 6) AS {c}"
    return f"SELECT shot_id, x, y, {', '.join(map(out, 'rgb'))} FROM ({rgb(d)})"


@catalog.add
def cct_estimate(d: Dialect) -> str:
    """Correlated colour temperature of each photo's mean chromaticity, by a cubic, inside 1667 to 25000."""
    xyz = f"SELECT shot_id, avg(0.4124 * r + 0.3576 * g + 0.1805 * b) AS cx, avg(0.2126 * r + 0.7152 * g + 0.0722 * b) AS cy, avg(0.0193 * r + 0.1192 * g + 0.9505 * b) AS cz FROM ({rgb(d)}) GROUP BY shot_id"
    n = f"SELECT shot_id, (cx / (cx + cy + cz) - 0.3320) / (0.1858 - cy / (cx + cy + cz)) AS n FROM ({xyz})"
    return f"SELECT shot_id, round({clip('449.0 * n * n * n + 3525.0 * n * n + 6823.3 * n + 5520.33', '1667.0', '25000.0')}, 3) AS kelvin FROM ({n})"


@catalog.add
def orientation_permute(d: Dialect) -> str:
    """Pixels where a viewer sees them: orientation 2 to 8 as an index permutation."""
    o = "(shot_id % 8 + 1)"
    nx = f"CASE {o} WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y WHEN 8 THEN y ELSE x END"
    ny = f"CASE {o} WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x WHEN 8 THEN 7 - x ELSE y END"
    return f"SELECT shot_id, {nx} AS x, {ny} AS y, round(r, 6) AS v FROM ({rgb(d)})"

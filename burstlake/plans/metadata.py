"""Metadata scalars, validation and best-match joins over records made from the tables."""

from __future__ import annotations

from .dialect import Catalog, Dialect

catalog = Catalog()


def two(n: str, d: Dialect) -> str:
    return f"lpad(CAST({n} AS VARCHAR(9)), 2, '0')"


def exif_text(d: Dialect) -> str:
    """event_id, taken (capture time text, sometimes malformed), sub (fraction text), stored (file time)."""
    part = (lambda u: f"{u}(ts)") if d.spark else (lambda u: f"date_part('{u}', ts)")
    n = {u: f"CAST({part(u)} AS INT)" for u in ("year", "month", "day", "hour", "minute", "second")}
    good = f"concat(' ', CAST({n['year']} AS VARCHAR(9)), ':', {two(n['month'], d)}, ':', {two(n['day'], d)}, ' ', {two(n['hour'], d)}, ':', {two(n['minute'], d)}, ':', {two(n['second'], d)}, ' ')"
    sub = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' 5' WHEN 2 THEN '1234567' WHEN 3 THEN 'x1' ELSE concat('0', CAST(event_id % 100 AS VARCHAR(9))) END"
    return f"SELECT event_id, CASE WHEN event_id % 11 = 7 THEN '0000-00-00' ELSE {good} END AS taken, {sub} AS sub, ts AS stored FROM events"


def parsed(d: Dialect, x: str) -> str:
    return f"try_to_timestamp(trim({x}), 'yyyy:MM:dd HH:mm:ss')" if d.spark else f"try_strptime(trim({x}), '%Y:%m:%d %H:%M:%S')"


def fraction(d: Dialect, x: str) -> str:
    """Microseconds of a fraction text: its first six characters, filled up with zeros; 0 if it is no number."""
    cast = "try_cast" if d.spark else "TRY_CAST"
    return f"coalesce({cast}(rpad(substr(trim({x}), 1, 6), 6, '0') AS INT), 0)"


@catalog.add
def exif_datetime_parse(d: Dialect) -> str:
    """Capture time in microseconds with its fraction, else the file's own time."""
    t, s = (d.micros(x) for x in (parsed(d, "taken"), "stored"))
    return f"SELECT event_id, coalesce({t} + {fraction(d, 'sub')}, {s}) AS captured_us, {t} IS NULL AS from_file FROM ({exif_text(d)})"


@catalog.add
def subsec_parse(d: Dialect) -> str:
    return f"SELECT event_id, {fraction(d, 'sub')} AS micros FROM ({exif_text(d)})"


def lens_text(d: Dialect) -> str:
    """Lens names of several shapes, from part: "Brand#3 24-70 mm f/2.8", "35mm F1.8", "no lens"."""
    lo, hi = "CAST(10 + p_partkey % 60 AS VARCHAR(9))", "CAST(40 + p_size AS VARCHAR(9))"
    ap = "CAST(1 + p_partkey % 5 AS VARCHAR(9))"
    return f"""SELECT p_partkey, p_brand, p_size, CASE p_partkey % 6 WHEN 0 THEN concat(p_brand, ' ', {lo}, '-', {hi}, ' mm f/', {ap}, '.8') WHEN 1 THEN concat(p_brand, ' ', {lo}, '.5mm F1.8')
        WHEN 2 THEN concat({lo}, '-', {hi}, 'MM') WHEN 3 THEN p_name WHEN 4 THEN concat({lo}, 'mm f/', {ap}, '-', {ap}, '.6') ELSE NULL END AS lens FROM part"""


RANGE = r"([0-9]+(?:\.[0-9]+)?)\s*(?:[-\x{2013}]\s*([0-9]+(?:\.[0-9]+)?))?\s*[mM][mM]"


def focal(d: Dialect) -> str:
    a, b = (d.number(f"nullif({d.pick('lens', RANGE, k)}, '')") for k in (1, 2))
    return f"SELECT p_partkey, p_size, lens, a AS lo, coalesce(b, a) AS hi FROM (SELECT *, {a} AS a, {b} AS b FROM ({lens_text(d)}))"


@catalog.add
def lens_range_regex(d: Dialect) -> str:
    ok = "lo > 0 AND lo <= hi"
    return f"SELECT p_partkey, CASE WHEN {ok} THEN lo END AS min_focal, CASE WHEN {ok} THEN hi END AS max_focal FROM ({focal(d)})"


@catalog.add
def lens_specification_parse(d: Dialect) -> str:
    """Focal range and aperture range of a lens name; null unless an aperture is given."""
    full = RANGE.replace("[-\\x{2013}]", "-") + r"(?:\s+[fF]\s*/\s*([0-9]+(?:\.[0-9]+)?)(?:\s*-\s*([0-9]+(?:\.[0-9]+)?))?)?"
    n = [d.number(f"nullif({d.pick('lens', full, k)}, '')") for k in (1, 2, 3, 4)]
    one = f"SELECT p_partkey, {n[0]} AS a, {n[1]} AS b, {n[2]} AS c, {n[3]} AS e FROM ({lens_text(d)})"
    ok = "c IS NOT NULL AND a > 0 AND coalesce(b, a) >= a AND c > 0 AND coalesce(e, c) > 0"
    out = ", ".join(f"CASE WHEN {ok} THEN {x} END AS {y}" for x, y in (("a", "min_focal"), ("coalesce(b, a)", "max_focal"), ("c", "min_aperture"), ("coalesce(e, c)", "max_aperture")))
    return f"SELECT p_partkey, {out} FROM ({one})"


@catalog.add
def focal_35mm_scaling(d: Dialect) -> str:
    """The 35 mm range of a lens: scaled when the shot's focal length is in range, as it is within 5 % of full frame."""
    one = f"SELECT p_partkey, lo, hi, CAST(10 + p_size AS DOUBLE) AS f, CAST(CASE WHEN p_partkey % 4 = 0 THEN 10 + p_size ELSE 15 + p_size * 1.5 END AS DOUBLE) AS f35 FROM ({focal(d)})"
    ok = "lo > 0 AND lo <= hi AND f BETWEEN lo AND hi"
    s = "(CASE WHEN abs(f35 / f - 1.0) <= 0.05 THEN 1.0 ELSE f35 / f END)"
    return f"SELECT p_partkey, round(CASE WHEN {ok} THEN lo * {s} END, 6) AS lo35, round(CASE WHEN {ok} THEN hi * {s} END, 6) AS hi35 FROM ({one})"


@catalog.add
def number_parse(d: Dialect) -> str:
    """Numbers as cameras write them: "1/200", "24 mm", "f 2.8", "7/0"; a zero denominator leaves the first number."""
    raw = "CASE l_orderkey % 5 WHEN 0 THEN concat('1/', CAST(l_linenumber * 40 AS VARCHAR(9))) WHEN 1 THEN concat(CAST(l_quantity AS VARCHAR(20)), ' mm') WHEN 2 THEN '7/0' WHEN 3 THEN 'f 2.8' ELSE 'none' END"
    num = r"[-+]?[0-9]+(?:\.[0-9]+)?"
    frac = rf"^\s*({num})\s*/\s*({num})\s*$"
    a, b = (d.number(f"nullif({d.pick('raw', frac, k)}, '')") for k in (1, 2))
    first = d.number(f"nullif({d.pick('raw', num, 0)}, '')")
    return f"SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce({d.quotient(a, b)}, {first}), 6) AS number FROM (SELECT l_orderkey, l_linenumber, l_partkey, {raw} AS raw FROM lineitem)"


@catalog.add
def metadata_number(d: Dialect) -> str:
    """Positive finite number of a rational pair; null for a zero denominator or a value that is not positive."""
    q = d.quotient("l_quantity - 5", "l_linenumber - 1")
    return f"SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN {q} > 0 THEN {q} END, 6) AS number FROM lineitem"


@catalog.add
def orientation_swap(d: Dialect) -> str:
    return "SELECT p_partkey, CASE WHEN p_partkey % 9 IN (5, 6, 7, 8) THEN 480 + p_size ELSE 640 END AS width, CASE WHEN p_partkey % 9 IN (5, 6, 7, 8) THEN 640 ELSE 480 + p_size END AS height FROM part"


@catalog.add
def bit_depth_resolve(d: Dialect) -> str:
    """Sensor bits, else white level (less one, in bits, to the next of 8 10 12 14 16), else the tag, else 16; and from where."""
    src = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(8 + p_partkey % 9 AS INT) END AS sensor, CASE WHEN p_partkey % 3 = 0 THEN CAST(200 + p_size * 1300 AS INT) END AS white, CASE WHEN p_partkey % 5 = 0 THEN 14 END AS tag, p_size % 2 = 0 AS source_depth FROM part"
    bits = "ceil(log2(CAST(white AS DOUBLE)))"
    level = f"CASE WHEN white BETWEEN 1 AND 65536 THEN CASE WHEN {bits} <= 8 THEN 8 WHEN {bits} <= 10 THEN 10 WHEN {bits} <= 12 THEN 12 WHEN {bits} <= 14 THEN 14 ELSE 16 END END"
    one = f"SELECT *, {level} AS inferred FROM ({src})"
    origin = "CASE WHEN sensor IS NOT NULL THEN 'sensor_white_level' WHEN inferred IS NOT NULL THEN 'dng_white_level' WHEN tag IS NOT NULL THEN 'exif' ELSE 'fallback_16' END"
    return f"SELECT p_partkey, coalesce(sensor, inferred, tag, 16) AS raw_bits, CASE WHEN source_depth THEN coalesce(sensor, inferred, tag, 16) ELSE 16 END AS target_bits, {origin} AS origin FROM ({one})"


@catalog.add
def eye_state_classify(d: Dialect) -> str:
    """Faces of a photo: small ones and blink of 0.42 to 0.68 are uncertain, above that closed; a defect needs certainty."""
    faces = "SELECT l_orderkey AS photo, l_quantity / CAST(1000 AS DOUBLE) AS area, l_discount * 10 AS blink FROM lineitem"
    state = "CASE WHEN area < 0.012 THEN 'uncertain' WHEN blink >= 0.68 THEN 'closed' WHEN blink >= 0.42 THEN 'uncertain' ELSE 'open' END"
    n = lambda s: f"sum(CASE WHEN state = '{s}' THEN 1 ELSE 0 END)"
    return f"SELECT photo, count(*) AS faces, {n('closed')} AS closed, {n('uncertain')} AS uncertain, round(max(blink), 6) AS max_blink, {n('closed')} > 0 AND {n('uncertain')} = 0 AS eye_defect FROM (SELECT *, {state} AS state FROM ({faces})) GROUP BY photo"


@catalog.add
def face_area_ratio(d: Dialect) -> str:
    """Area of the box around a face's points."""
    return "SELECT l_orderkey AS face, round((max(l_discount) - min(l_discount)) * (max(l_tax) - min(l_tax)), 6) AS area FROM lineitem GROUP BY l_orderkey"


@catalog.add
def xmp_bool_parse(d: Dialect) -> str:
    raw = "CASE event_id % 6 WHEN 0 THEN ' True ' WHEN 1 THEN '1' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' WHEN 4 THEN '' ELSE NULL END"
    return f"SELECT event_id, coalesce(lower(trim({raw})) IN ('true', '1', 'yes'), FALSE) AS flag FROM events"


@catalog.add
def xmp_simple_value(d: Dialect) -> str:
    """A setting of a sidecar: the attribute, else the child element, else the default."""
    xml = "concat('<d', CASE WHEN event_id % 3 = 0 THEN concat(' e=\"', CAST(event_id AS VARCHAR(20)), '\"') ELSE '' END, '>', CASE WHEN event_id % 2 = 0 THEN concat('<e>', CAST(event_id + 1 AS VARCHAR(20)), '</e>') ELSE '' END, '</d>')"
    if d.spark:
        a, c = "nullif(xpath_string(x, 'd/@e'), '')", "nullif(xpath_string(x, 'd/e'), '')"
    else:
        a, c = "nullif(regexp_extract(x, ' e=\"([^\"]*)\"', 1), '')", "nullif(regexp_extract(x, '<e>([^<]*)</e>', 1), '')"
    return f"SELECT event_id, coalesce({a}, {c}, '0') AS value FROM (SELECT event_id, {xml} AS x FROM events)"


@catalog.add
def json_props_extract(d: Dialect) -> str:
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)" if d.spark else "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    return f"SELECT event_id, {k} AS k FROM events"


def exif_rows(d: Dialect) -> str:
    """p_partkey and what an outer reader found: names of a lens in four tags, makers, focal length."""
    some = lambda n, x: f"CASE WHEN p_partkey % {n} = 0 THEN {x} WHEN p_partkey % {n} = 1 THEN '  ' END"
    return f"""SELECT p_partkey, {some(5, "concat(p_name, ' 24-70mm f/4')")} AS lens_model, {some(3, "concat('ID ', p_type)")} AS lens_id, {some(4, "'14-24mm f/4'")} AS lens_spec, {some(2, "concat(p_brand, ' 50 mm')")} AS lens,
        {some(6, 'p_brand')} AS lens_make, CASE WHEN p_size % 4 = 0 THEN 'NIKON CORPORATION' ELSE p_brand END AS make, CASE WHEN p_size % 3 = 0 THEN p_size END AS f35_film, CASE WHEN p_size % 5 = 0 THEN p_size + 1 END AS f35_format FROM part"""


@catalog.add
def vendor_lens_mapping(d: Dialect) -> str:
    """The first non-empty of four lens tags, the lens maker or Nikon by the body's maker, the 35 mm focal length, and a range from the names."""
    full = RANGE.replace("[-\\x{2013}]", "-") + r"(?:\s+[fF]\s*/\s*([0-9]+(?:\.[0-9]+)?)(?:\s*-\s*([0-9]+(?:\.[0-9]+)?))?)?"
    said = lambda x: f"CASE WHEN trim({x}) <> '' THEN {x} END"
    one = f"SELECT p_partkey, coalesce({said('lens_model')}, {said('lens_id')}, {said('lens_spec')}, {said('lens')}) AS model, coalesce({said('lens_make')}, CASE WHEN strpos(lower(make), 'nikon') > 0 THEN 'Nikon' END) AS maker, coalesce(f35_film, f35_format) AS f35, {said('lens')} AS lens FROM ({exif_rows(d)})"
    one = one if not d.spark else one.replace("strpos(lower(make), 'nikon') > 0", "contains(lower(make), 'nikon')")
    two = f"SELECT *, coalesce(lens, model) AS named FROM ({one})"
    n = [d.number(f"nullif({d.pick('named', full, k)}, '')") for k in (1, 2, 3, 4)]
    three = f"SELECT *, {n[0]} AS a, {n[1]} AS b, {n[2]} AS c, {n[3]} AS e FROM ({two})"
    ok = "c IS NOT NULL AND a > 0 AND coalesce(b, a) >= a AND c > 0"
    return f"SELECT p_partkey, model, maker, f35, CASE WHEN {ok} THEN a END AS min_focal, CASE WHEN {ok} THEN coalesce(b, a) END AS max_focal, CASE WHEN {ok} THEN c END AS aperture FROM ({three})"


@catalog.add
def fill_missing_merge(d: Dialect) -> str:
    """Tags that are there stay, even empty ones; only absent ones are taken from the second reader, if it has a value."""
    own = "CASE WHEN p_partkey % 7 < 3 THEN p_name WHEN p_partkey % 7 = 3 THEN '' END"
    return f"SELECT p_partkey, coalesce({own}, lens_model, lens_id, lens_spec, lens) AS lens_model, {own} IS NULL AND coalesce(lens_model, lens_id, lens_spec, lens) IS NOT NULL AS filled FROM (SELECT r.*, p_name FROM ({exif_rows(d)}) r JOIN (SELECT p_partkey AS pk, p_name FROM part) n ON n.pk = r.p_partkey)"


@catalog.add
def text_trim(d: Dialect) -> str:
    raw = "concat('  ', p_name, ' ', chr(0), chr(0))"
    trimmed = f"rtrim({raw}, chr(0))" if not d.spark else f"trim(TRAILING chr(0) FROM {raw})"
    return f"SELECT p_partkey, trim({trimmed}) AS name FROM part"


@catalog.add
def subdir_guard(d: Dialect) -> str:
    """Only relative paths without empty, . or .. parts are taken; otherwise the fallback."""
    raw = "CASE event_id % 6 WHEN 0 THEN ' review ' WHEN 1 THEN '/abs/x' WHEN 2 THEN '../up' WHEN 3 THEN '' WHEN 4 THEN 'a/../b' ELSE concat('day/', event_type) END"
    bad = d.hit("trim(raw)", r"^/|(^|/)\.\.?(/|$)|//|^$")
    return f"SELECT event_id, CASE WHEN {bad} THEN 'fallback' ELSE trim(raw) END AS subdir FROM (SELECT event_id, {raw} AS raw FROM events)"


@catalog.add
def param_clamp(d: Dialect) -> str:
    """Clip to 0..1; not a number becomes 0, infinity 1."""
    x = "CASE event_id % 7 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) ELSE value / 100 - 1 END"
    nan = "isnan(x)"
    return f"SELECT event_id, round(CASE WHEN {nan} THEN 0.0 ELSE greatest(0.0, least(1.0, x)) END, 6) AS p FROM (SELECT event_id, CAST({x} AS DOUBLE) AS x FROM events)"


#: The basic controls and their ranges.
BASIC = {
    "exposure": (-5, 5), "contrast": (-100, 100), "highlights": (-100, 100), "shadows": (-100, 100), "whites": (-100, 100), "blacks": (-100, 100), "vibrance": (-100, 100), "saturation": (-100, 100),
}


def basic_requests(d: Dialect) -> str:
    """id, key, value: requests of eight controls each, of which some lack one, name another, or go out of range."""
    key = d.at(d.list(*[f"'{k}'" for k in BASIC], "'sharpness'"), "k")
    value = "CASE WHEN l_orderkey % 13 = 0 AND k = 3 THEN CAST('NaN' AS DOUBLE) WHEN k = 0 THEN l_discount * 60 - 1 ELSE l_extendedprice / 1000 - 5 * k END"
    skip = "NOT (l_orderkey % 7 = 0 AND k = 5) AND NOT (k = 8 AND l_orderkey % 5 <> 0)"
    return f"SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS m, {key} AS key, {value} AS value FROM lineitem {d.series(9, 'k')} WHERE {skip}"


@catalog.add
def basic_params_validation(d: Dialect) -> str:
    """Valid are exactly the eight keys, each finite and in its range."""
    ranges = " UNION ALL ".join(f"SELECT '{k}' AS name, CAST({a} AS DOUBLE) AS low, CAST({b} AS DOUBLE) AS high FROM (SELECT 1 AS one)" for k, (a, b) in BASIC.items())
    good = "name IS NOT NULL AND NOT isnan(value) AND value >= low AND value <= high"
    return f"SELECT id, n, m, count(*) = {len(BASIC)} AND sum(CASE WHEN {good} THEN 1 ELSE 0 END) = {len(BASIC)} AS valid FROM ({basic_requests(d)}) LEFT JOIN ({ranges}) ON name = key GROUP BY id, n, m"


@catalog.add
def list_validation(d: Dialect) -> str:
    """25 finite values of -100..100; 14 values with a range for each place: hue, saturation and lightness of four wheels, blending, balance."""
    v = d.each("embedding", "v", "CAST(v AS DOUBLE) * 300 + 60")
    first = lambda a, n: f"slice({a}, 1, {n})" if d.spark else f"{a}[1:{n}]"
    bad = lambda a, test: f"{d.size(d.keep(a, 'u', test))} > 0"
    each = [(0, 360) if k % 3 == 0 else (0, 100) if k % 3 == 1 else (-100, 100) for k in range(12)] + [(0, 100), (-100, 100)]
    ranges = " AND ".join(f"{d.at('v14', str(k))} BETWEEN {a} AND {b}" for k, (a, b) in enumerate(each))
    one = f"SELECT vec_id, CAST(23 + vec_id % 4 AS INT) AS n25, CAST(13 + vec_id % 3 AS INT) AS n14, {v} AS vs FROM embeddings"
    two = f"SELECT *, {first('vs', 25)} AS v25, {d.each(first('vs', 14), 'w', 'abs(w) / 3')} AS v14 FROM ({one})"
    return f"SELECT vec_id, n25 = 25 AND NOT ({bad('v25', 'abs(u) > 100 OR isnan(u)')}) AS hsl_ok, n14 = 14 AND {ranges} AS grading_ok FROM ({two})"


@catalog.add
def error_classification(d: Dialect) -> str:
    """First matching class of a failure text."""
    raw = "CASE event_id % 6 WHEN 0 THEN 'Unsupported compression' WHEN 1 THEN 'cannot allocate memory' WHEN 2 THEN 'No such file' WHEN 3 THEN 'Permission denied' WHEN 4 THEN 'truncated: unexpected end' ELSE event_type END"
    hit = lambda p: d.hit("lower(raw)", p)
    return f"""SELECT event_id, CASE WHEN {hit("unsupported")} THEN 'unsupported' WHEN {hit("out of memory|insufficient memory|cannot allocate memory")} THEN 'memory' WHEN {hit("no such file|file not found|does not exist")} THEN 'missing'
        WHEN {hit("permission")} THEN 'permission' WHEN {hit("corrupt|truncated|unexpected end|invalid image|failed to decode|decode error")} THEN 'corrupt' ELSE 'failed' END AS kind FROM (SELECT event_id, {raw} AS raw FROM events)"""


#: The versions of the two algorithms that a token names.
VERSIONS = {"version": "linear-v29-native-scene-dense", "auto_exposure_algorithm": "linear-median768-highlight095-ev2-v1"}


@catalog.add
def cache_token(d: Dialect) -> str:
    """First 20 hex digits of the SHA-256 of both versions, mode, automatic exposure and all normalised settings as JSON with sorted keys."""
    names = ("brightness_protection", "color_protection", "color_recovery", "fog_retention", "highlight_protection", "local_contrast", "naturalness", "shadow_protection", "strength")
    value = lambda k: f"CAST(round(greatest(0.0, least(1.0, p_size / CAST(40 AS DOUBLE) - {k} / CAST(10 AS DOUBLE))), 3) AS VARCHAR(9))"
    pairs = {"auto_exposure": "CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END", "nonlocal_relief": "concat('\"', CASE p_partkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'conservative' ELSE 'strong' END, '\"')"}
    pairs |= {k: f"'\"{v}\"'" for k, v in VERSIONS.items()} | {n: value(k) for k, n in enumerate(names)}
    text = "concat('{', " + ", ', ', ".join(f"'\"{k}\": ', {pairs[k]}" for k in sorted(pairs)) + ", '}')"
    return f"SELECT p_partkey, substr({f'sha2({text}, 256)' if d.spark else f'sha256({text})'}, 1, 20) AS token FROM part"


@catalog.add
def model_routing(d: Dialect) -> str:
    """The first model of the fallback chain that is there and large enough; the mode is only a wish."""
    src = "SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'custom' ELSE 'standard' END AS mode, s_acctbal > 5000 AS custom_ready, s_suppkey % 4 <> 0 AS standard_ready, s_suppkey % 5 <> 0 AS light_ready FROM supplier"
    return f"SELECT s_suppkey, coalesce(CASE WHEN mode = 'custom' AND custom_ready THEN 'custom' END, CASE WHEN standard_ready THEN 'standard' END, CASE WHEN light_ready THEN 'light' END, 'none') AS model FROM ({src})"


@catalog.add
def gps_rational(d: Dialect) -> str:
    """Degrees, minutes and hundredths of seconds of a coordinate; null outside the range."""
    x = "abs(CAST(s_acctbal AS DOUBLE) / 60)"
    deg, rest = f"floor({x})", f"({x} - floor({x})) * 60"
    return f"SELECT s_suppkey, CASE WHEN {x} <= 90 THEN CAST({deg} AS INT) END AS degrees, CASE WHEN {x} <= 90 THEN CAST(floor({rest}) AS INT) END AS minutes, CASE WHEN {x} <= 90 THEN round(({rest} - floor({rest})) * 60, 2) END AS seconds FROM supplier"


# ---- best match ---------------------------------------------------------------------------------------------------


def similarity(d: Dialect, a: str, b: str) -> str:
    """1 for equal names, 0.86 if one holds the other, else the share of common tokens."""
    norm = lambda x: d.sub(f"lower({x})", "[^a-z0-9]+", "")
    toks = lambda x: f"{'array_distinct' if d.spark else 'list_distinct'}({d.all(f'lower({x})', '[a-z0-9]+')})"
    na, nb, ta, tb = norm(a), norm(b), toks(a), toks(b)
    both = d.size(f"{'array_intersect' if d.spark else 'list_intersect'}({ta}, {tb})")
    within = f"(strpos({nb}, {na}) > 0 OR strpos({na}, {nb}) > 0)" if not d.spark else f"(contains({nb}, {na}) OR contains({na}, {nb}))"
    return f"CASE WHEN {na} = '' OR {nb} = '' THEN 0.0 WHEN {na} = {nb} THEN 1.0 WHEN {within} THEN 0.86 ELSE CAST({both} AS DOUBLE) / greatest({d.size(ta)}, {d.size(tb)}) END"


@catalog.add
def fuzzy_best_match(d: Dialect) -> str:
    """Each distinct lens name with the best catalog entry of score 0.34 or more; the first of equals.

    Names and entries meet by what can give a score: a common token, or equal or nested names, whose tokens are joined in
    three-letter pieces; only such pairs are scored, so nothing is compared with everything.
    """
    entries = "SELECT DISTINCT p_name AS model, p_type AS maker FROM part"
    names = "SELECT DISTINCT p_name AS name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS make FROM part"
    distinct = "array_distinct" if d.spark else "list_distinct"
    tokens = lambda x: f"{distinct}({d.all(f'lower({x})', '[a-z0-9]+')})"
    flat = lambda x: d.sub(f"lower({x})", "[^a-z0-9]+", "")
    pieces = lambda x: d.each(d.range(f"greatest(1, length({flat(x)}) - 2)"), "k", f"concat('#', substr({flat(x)}, CAST(k + 1 AS INT), 3))")
    keys = lambda x: f"{'array_union' if d.spark else 'list_concat'}({tokens(x)}, {distinct}({pieces(x)}))"
    open_ = lambda sql, x, cols: f"SELECT {cols}, key FROM ({sql}) LATERAL VIEW explode({keys(x)}) AS key" if d.spark else f"SELECT {cols}, unnest({keys(x)}) AS key FROM ({sql})"
    met = f"SELECT DISTINCT name, model FROM ({open_(f'SELECT DISTINCT name FROM ({names})', 'name', 'name')}) a JOIN ({open_(f'SELECT DISTINCT model FROM ({entries})', 'model', 'model')}) b ON a.key = b.key"
    m, k = similarity(d, "name", "model"), similarity(d, "make", "maker")
    scored = f"SELECT name AS sn, model AS sm, {m} AS m FROM ({met})"
    both = f"SELECT n.name, n.make, e.model, e.maker, s.m FROM ({names}) n JOIN ({scored}) s ON s.sn = n.name JOIN ({entries}) e ON e.model = s.sm WHERE s.m > 0"
    makers = f"SELECT make AS mk, maker AS mr, CASE WHEN make = '' THEN 0.5 ELSE {k} END AS k FROM (SELECT DISTINCT make, maker FROM ({both}))"
    two = f"SELECT name, make, model, maker, 0.78 * m + 0.22 * k AS score FROM ({both}) JOIN ({makers}) ON mk = make AND mr = maker"
    best = f"SELECT name AS bn, make AS bm, model, maker, score FROM (SELECT *, row_number() OVER (PARTITION BY name, make ORDER BY score DESC, model, maker) AS n FROM ({two}) WHERE score >= 0.34) WHERE n = 1"
    return f"SELECT name, make, model, maker, round(score, 6) AS score FROM ({names}) LEFT JOIN ({best}) ON bn = name AND bm = make"


@catalog.add
def fixed_profile_case(d: Dialect) -> str:
    """A fixed profile for exactly one body comes before any matching; bodies without one go on to it."""
    return "SELECT p_partkey, CASE WHEN p_brand = 'Brand#3' AND lower(trim(p_name)) = 'small ring' THEN 'fixed' WHEN p_brand = 'Brand#3' THEN 'body_mismatch' ELSE 'match' END AS route FROM part"


@catalog.add
def row_limit_guard(d: Dialect) -> str:
    """Requests by size: none beyond 500 photos, sessions beyond 5000, or 40 groups in a review."""
    one = "SELECT o_custkey, count(*) AS asked, count(*) * 40 AS photos, count(*) * 300 AS session FROM orders GROUP BY o_custkey"
    return f"SELECT o_custkey, asked, CASE WHEN photos > 500 THEN 'too_many' ELSE 'accepted' END AS batch, CASE WHEN session > 5000 THEN 'too_many' ELSE 'accepted' END AS session_verdict, least(asked * 5, 40) AS shown FROM ({one})"


@catalog.add
def blendshape_map(d: Dialect) -> str:
    """Name and score pairs of a face; unnamed ones drop out, and the larger blink of both eyes counts."""
    return "SELECT l_orderkey AS face, count(*) AS named, round(max(CASE WHEN l_returnflag = 'A' THEN l_discount END), 6) AS left_blink, round(max(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS right_blink, round(max(CASE WHEN l_returnflag IN ('A', 'R') THEN l_discount END), 6) AS blink FROM lineitem WHERE l_linestatus <> '' GROUP BY l_orderkey"


@catalog.add
def tone_curve_parse(d: Dialect) -> str:
    """Points "x, y" or "x y" of a curve: clipped to 0..255, in order of x, the last of equal x; a straight line unless two are left."""
    item = d.list("concat(CAST(p_size * 7 AS VARCHAR(9)), ', ', CAST(p_size * 3 AS VARCHAR(9)))", "'nonsense'", "concat(CAST(p_size AS VARCHAR(9)), ' ', CAST(p_partkey % 400 AS VARCHAR(9)))", "CASE WHEN p_partkey % 3 = 0 THEN '255, 250' ELSE '300,-5,2' END", "concat(CAST(p_size AS VARCHAR(9)), ', 77')")
    rows = f"SELECT p_partkey, k, trim({d.at(item, 'k')}) AS t FROM part {d.series(5, 'k')}"
    pat = r"^([-+]?[0-9.]+)(?:\s*,\s*|\s+)([-+]?[0-9.]+)$"
    nums = f"SELECT p_partkey, k, {d.number(f'nullif({d.pick("t", pat, 1)}, {chr(39) * 2})')} AS a, {d.number(f'nullif({d.pick("t", pat, 2)}, {chr(39) * 2})')} AS b FROM ({rows})"
    points = f"SELECT p_partkey, k, greatest(0.0, least(255.0, a)) AS x, greatest(0.0, least(255.0, b)) AS y FROM ({nums}) WHERE a IS NOT NULL AND b IS NOT NULL"
    last = f"SELECT p_partkey AS i, x, y FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, x ORDER BY k DESC) AS n FROM ({points})) WHERE n = 1"
    agg = f"SELECT i, count(*) AS n, {'max_by(y, x)' if d.spark else 'arg_max(y, x)'} AS last_y, {'min_by(y, x)' if d.spark else 'arg_min(y, x)'} AS first_y, min(x) AS first_x FROM ({last}) GROUP BY i"
    return f"SELECT p_partkey, CAST(CASE WHEN n >= 2 THEN n ELSE 2 END AS INT) AS points, CASE WHEN n >= 2 THEN first_x ELSE 0.0 END AS first_x, CASE WHEN n >= 2 THEN first_y ELSE 0.0 END AS first_y, CASE WHEN n >= 2 THEN last_y ELSE 255.0 END AS last_y FROM part LEFT JOIN ({agg}) ON i = p_partkey"


@catalog.add
def preview_fallback_chain(d: Dialect) -> str:
    """The first preview that is there: embedded thumbnail, half-size decode, ordinary decode; and which."""
    src = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS thumb, CASE WHEN p_partkey % 2 = 0 THEN p_size * 2 END AS half, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 4 END AS whole FROM part"
    return f"SELECT p_partkey, coalesce(thumb, half, whole) AS edge, CASE WHEN thumb IS NOT NULL THEN 'thumb' WHEN half IS NOT NULL THEN 'half' WHEN whole IS NOT NULL THEN 'whole' ELSE 'none' END AS origin FROM ({src})"


@catalog.add
def source_identity(d: Dialect) -> str:
    """Path, size and time in microseconds: the key under which anything made from a file is kept."""
    return f"SELECT o_orderkey, concat(o_orderpriority, '/', CAST(o_orderkey AS VARCHAR(20))) AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, {d.micros('o_orderdate')} AS modified_us FROM orders"

"""Settings beside photos: directories of tags, values, presets, merges, file names, batches and their results."""

from __future__ import annotations

from .dialect import Catalog, Dialect
from .metadata import BASIC
from .rasters import EDGE, Picture, Raster, planes

catalog = Catalog()


def gathered(d: Dialect, item: str, order: str, by: str) -> str:
    """Items of a group in order, as one text."""
    if d.spark:
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {item} AS v))), s -> s.v), '{by}')"
    return f"string_agg({item}, '{by}' ORDER BY {order})"


# ---- tags -----------------------------------------------------------------------------------------------------------


def entries(d: Dialect) -> str:
    """file, dir, tag, num, den, kind: entries of tag directories, one file per order; directories may point to each other."""
    return "SELECT l_orderkey AS file, CAST(l_partkey % 4 AS INT) AS dir, CAST(l_suppkey % 12 AS INT) AS tag, CAST(l_quantity AS INT) AS num, CAST(l_linenumber - 1 AS INT) AS den, CAST(l_partkey % 6 AS INT) AS kind FROM lineitem"


@catalog.add
def exif_walk(d: Dialect) -> str:
    """Entries of the directories that can be reached from the first one, each directory once; of equal tags the one met last.

    Tags 0 to 2 of a directory point to directory tag + 1, here at most three steps deep; blobs (kind 5) are left out.
    """
    point = f"SELECT DISTINCT file, dir, tag + 1 AS target FROM ({entries(d)}) WHERE tag < 3 AND tag + 1 <> dir"
    first = f"SELECT DISTINCT file, 0 AS dir, 0 AS depth FROM ({entries(d)})"
    step = lambda before, n: f"SELECT p.file, p.target AS dir, {n} AS depth FROM ({point}) p JOIN ({before}) b ON b.file = p.file AND b.dir = p.dir"
    one = step(first, 1)
    two = step(one, 2)
    reached = f"SELECT file AS f, dir AS r, min(depth) AS depth FROM ({first} UNION ALL {one} UNION ALL {two} UNION ALL {step(two, 3)}) GROUP BY file, dir"
    met = f"SELECT file, dir, tag, num, depth, row_number() OVER (PARTITION BY file, tag ORDER BY depth DESC, dir DESC, num DESC, den DESC, kind DESC) AS n FROM ({entries(d)}) JOIN ({reached}) ON f = file AND r = dir WHERE kind <> 5 AND tag >= 3"
    return f"SELECT file, tag, dir, num FROM ({met}) WHERE n = 1"


@catalog.add
def exif_value_normalise(d: Dialect) -> str:
    """Values as numbers or text: pairs as quotients (null over 0), numbers that are not finite as null, bytes as text without trailing zeros, lists only whole."""
    q = d.quotient("num", "den")
    text = "concat('T', CAST(num AS VARCHAR(9)))"
    raw = f"concat({text}, chr(0), chr(0))"
    plain = f"trim(TRAILING chr(0) FROM {raw})" if d.spark else f"rtrim({raw}, chr(0))"
    number = f"CASE kind WHEN 0 THEN CAST(num AS DOUBLE) WHEN 1 THEN {q} WHEN 2 THEN CASE WHEN den = 0 THEN NULL ELSE num / CAST(8 AS DOUBLE) END WHEN 4 THEN CASE WHEN den > 0 THEN {q} + num END END"
    return f"SELECT file, dir, tag, num, den, kind, round({number}, 6) AS number, CASE WHEN kind = 3 THEN {plain} END AS text FROM ({entries(d)})"


@catalog.add
def datetime_text(d: Dialect) -> str:
    """Capture times as colon-separated text: that form stays, ISO forms with or without zone are turned, others are null."""
    part = (lambda u: f"{u}(ts)") if d.spark else (lambda u: f"date_part('{u}', ts)")
    two = lambda u: f"lpad(CAST(CAST({part(u)} AS INT) AS VARCHAR(9)), 2, '0')"
    date, time = (lambda by: f"CAST(CAST({part('year')} AS INT) AS VARCHAR(9)), '{by}', {two('month')}, '{by}', {two('day')}"), f"{two('hour')}, ':', {two('minute')}, ':', {two('second')}"
    raw = f"CASE event_id % 7 WHEN 0 THEN concat({date(':')}, ' ', {time}) WHEN 1 THEN concat({date('-')}, 'T', {time}) WHEN 2 THEN concat({date('-')}, ' ', {time}, '.25') WHEN 3 THEN concat({date('-')}, 'T', {time}, 'Z') WHEN 4 THEN concat({date('-')}, 'T', {time}, '+02:00') WHEN 5 THEN concat({date('-')}) ELSE '2024-13-45T00:00:00' END"
    one = f"SELECT event_id, {raw} AS raw FROM events"
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?$"
    g = lambda k: d.pick("raw", iso, k)
    day = f"concat({g(1)}, '-', {g(2)}, '-', {g(3)})"
    real = f"{'try_cast' if d.spark else 'TRY_CAST'}({day} AS DATE) IS NOT NULL"
    clock = f"CASE WHEN {g(4)} = '' THEN '00:00:00' ELSE concat({g(4)}, ':', {g(5)}, ':', {g(6)}) END"
    same = d.hit("raw", r"^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
    return f"SELECT event_id, CASE WHEN {same} THEN raw WHEN {d.hit('raw', iso)} AND {real} THEN concat({g(1)}, ':', {g(2)}, ':', {g(3)}, ' ', {clock}) END AS taken FROM ({one})"


@catalog.add
def bits_per_sample(d: Dialect) -> str:
    """The largest whole number of 1 to 16 among the values of a tag, however they are written; a quotient counts by its numerator."""
    n = "CAST(6 + p_size % 12 AS VARCHAR(9))"
    raw = f"CASE p_partkey % 6 WHEN 0 THEN concat('[', {n}, ', ', {n}, ', 8]') WHEN 1 THEN concat({n}, '/1') WHEN 2 THEN concat('(', {n}, '; 12.5 3)') WHEN 3 THEN 'n/a' WHEN 4 THEN concat({n}, '.0') ELSE '64 32' END"
    bare = d.sub("raw", r"[\[\]();,]", " ")
    tokens = d.all(bare, r"[^\s]+")
    value = d.number(d.sub("t", r"/.*$", ""))
    sound = d.keep(d.each(tokens, "t", value), "u", "u IS NOT NULL AND u = floor(u) AND u BETWEEN 1 AND 16")
    return f"SELECT p_partkey, CAST({d.most_of(sound)} AS INT) AS bits FROM (SELECT p_partkey, {raw} AS raw FROM part)"


@catalog.add
def stable_json_key(d: Dialect) -> str:
    """A request as JSON with sorted keys, without generation and client; numbers that are not finite are null."""
    key = d.at(d.list("'strength'", "'mode'", "'generation'", "'client'", "'edge'", "'angle'", "'photo'"), "l_linenumber - 1")
    value = "CASE WHEN l_linenumber = 6 AND l_orderkey % 3 = 0 THEN 'null' WHEN l_linenumber % 2 = 0 THEN concat('\"', l_returnflag, '\"') ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END"
    one = f"SELECT l_orderkey, k, max(v) AS v FROM (SELECT l_orderkey, {key} AS k, {value} AS v FROM lineitem) WHERE k NOT IN ('generation', 'client') GROUP BY l_orderkey, k"
    pair = "concat('\"', k, '\":', v)"
    return f"SELECT l_orderkey, concat('{{', {gathered(d, pair, 'k', ',')}, '}}') AS request FROM ({one}) GROUP BY l_orderkey"


# ---- presets and settings -------------------------------------------------------------------------------------------


def preset_text(d: Dialect) -> str:
    """s_suppkey and a preset's XML: numbers as attributes or child elements, some missing or malformed."""
    return """SELECT s_suppkey, concat('<d', CASE WHEN s_suppkey % 2 = 0 THEN concat(' Exposure="', CAST(s_suppkey % 9 AS VARCHAR(9)), '.5"') ELSE '' END, CASE WHEN s_suppkey % 3 = 0 THEN ' Gray="True"' ELSE '' END, ' Contrast="', CASE WHEN s_suppkey % 5 = 0 THEN 'high' ELSE CAST(s_suppkey % 90 AS VARCHAR(9)) END, '">',
        CASE WHEN s_suppkey % 4 = 1 THEN concat('<Exposure>', CAST(s_suppkey % 7 AS VARCHAR(9)), '</Exposure>') ELSE '' END, '</d>') AS x FROM supplier"""


def setting(d: Dialect, name: str) -> str:
    """A value of the XML in x: the attribute, else the child element, else null."""
    if d.spark:
        return f"coalesce(nullif(xpath_string(x, 'd/@{name}'), ''), nullif(xpath_string(x, 'd/{name}'), ''))"
    return f"coalesce(nullif(regexp_extract(x, ' {name}=\"([^\"]*)\"', 1), ''), nullif(regexp_extract(x, '<{name}>([^<]*)</{name}>', 1), ''))"


@catalog.add
def preset_controls(d: Dialect) -> str:
    """Numbers of a preset, 0 where one is missing or no number, and whether it is gray."""
    return f"SELECT s_suppkey, coalesce({d.number(setting(d, 'Exposure'))}, 0.0) AS exposure, coalesce({d.number(setting(d, 'Contrast'))}, 0.0) AS contrast, coalesce(lower({setting(d, 'Gray')}) = 'true', FALSE) AS gray FROM ({preset_text(d)})"


@catalog.add
def photo_settings_read(d: Dialect) -> str:
    """All settings of a sidecar; absent ones are defaults, and one that is out of range makes all of them defaults."""
    raw = """SELECT s_suppkey, concat('<d', CASE WHEN s_suppkey % 3 <> 0 THEN concat(' Strength="0.', CAST(s_suppkey % 10 AS VARCHAR(9)), '"') ELSE '' END, CASE WHEN s_suppkey % 11 = 0 THEN ' Naturalness="1.5"' WHEN s_suppkey % 4 = 0 THEN ' Naturalness="0.2"' ELSE '' END,
        CASE s_suppkey % 6 WHEN 0 THEN ' Auto="yes"' WHEN 1 THEN ' Auto="0"' WHEN 2 THEN ' Auto="maybe"' ELSE '' END, CASE s_suppkey % 5 WHEN 0 THEN ' Mode="Strong"' WHEN 1 THEN ' Mode="odd"' ELSE '' END, '></d>') AS x FROM supplier"""
    one = f"SELECT s_suppkey, {d.number(setting(d, 'Strength'))} AS st, {d.number(setting(d, 'Naturalness'))} AS na, lower({setting(d, 'Auto')}) AS au, lower({setting(d, 'Mode')}) AS mo FROM ({raw})"
    two = f"SELECT *, coalesce(st < 0 OR st > 1, FALSE) OR coalesce(na < 0 OR na > 1, FALSE) AS bad, coalesce(au NOT IN ('true', '1', 'yes', 'false', '0', 'no'), FALSE) AS odd, st IS NOT NULL OR na IS NOT NULL AS given FROM ({one})"
    params = "given AND NOT bad"
    auto = f"CASE WHEN bad OR odd THEN NOT ({params}) OR odd WHEN au IS NOT NULL THEN au IN ('true', '1', 'yes') ELSE NOT given END"
    return f"SELECT s_suppkey, CASE WHEN {params} THEN coalesce(st, 0.0) END AS strength, CASE WHEN {params} THEN coalesce(na, 0.7) END AS naturalness, {auto} AS auto_mode, CASE WHEN NOT bad AND NOT odd AND mo IN ('off', 'conservative', 'strong') THEN mo ELSE 'off' END AS mode FROM ({two})"


def existing(d: Dialect) -> str:
    """photo, name, value: properties of sidecars that are there."""
    name = d.at(d.list("'Exposure'", "'Contrast'", "'Temperature'", "'Tint'", "'Rating'", "'Label'", "'WhiteBalance'"), "l_linenumber - 1")
    return f"SELECT l_orderkey AS photo, {name} AS name, max(CAST(CAST(l_quantity AS INT) AS VARCHAR(20))) AS value FROM lineitem GROUP BY l_orderkey, {name}"


def preset_rows(d: Dialect) -> str:
    """photo, name, value: the properties of the preset each photo gets."""
    name = d.at(d.list("'Exposure'", "'Contrast'", "'WhiteBalance'", "'Temperature'", "'Saturation'"), "k")
    value = "CASE k WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'As Shot' ELSE 'Custom' END WHEN 0 THEN CAST(o_orderkey % 5 AS VARCHAR(20)) ELSE CAST(k * 10 AS VARCHAR(20)) END"
    return f"SELECT o_orderkey AS photo, {name} AS name, {value} AS value FROM orders {d.series(5, 'k')} WHERE o_orderkey % 3 <> 0"


@catalog.add
def preset_write(d: Dialect) -> str:
    """A preset merged into a sidecar: what any preset owns goes first, its own values come, the rest stays; no temperature or tint where the
    white balance is as shot; exposure is the preset's plus the photo's adjustment, in -5..5."""
    owned = "('Exposure', 'Contrast', 'Temperature', 'Tint', 'Saturation', 'WhiteBalance')"
    asked = f"SELECT DISTINCT photo AS q FROM ({preset_rows(d)})"
    kept = f"SELECT photo, name, value, 0 AS fresh FROM ({existing(d)}) LEFT JOIN ({asked}) ON q = photo WHERE q IS NULL OR name NOT IN {owned}"
    both = f"SELECT * FROM ({kept}) UNION ALL SELECT photo, name, value, 1 AS fresh FROM ({preset_rows(d)})"
    shot = f"SELECT photo AS s FROM ({preset_rows(d)}) WHERE name = 'WhiteBalance' AND value = 'As Shot'"
    up = "CAST(greatest(-5, least(5, CAST(value AS INT) + photo % 4)) AS VARCHAR(20))"
    return f"SELECT photo, name, CASE WHEN fresh = 1 AND name = 'Exposure' THEN {up} ELSE value END AS value FROM ({both}) LEFT JOIN ({shot}) ON s = photo WHERE NOT (s IS NOT NULL AND name IN ('Temperature', 'Tint'))"


@catalog.add
def dehaze_settings_write(d: Dialect) -> str:
    """Nine settings of 0..1 and the modes as properties of a sidecar; other properties stay, an invalid request changes nothing."""
    names = ("Strength", "Naturalness", "FogRetention", "LocalContrast", "ColorRecovery", "ColorProtection", "HighlightProtection", "ShadowProtection", "BrightnessProtection")
    name = d.at(d.list(*[f"'Dehaze{n}'" for n in names], "'DehazeMode'"), "k")
    value = "CASE WHEN k = 9 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'off' ELSE 'strong' END ELSE concat('0.', CAST((o_orderkey + k) % 10 AS VARCHAR(9))) END"
    fresh = f"SELECT o_orderkey AS photo, {name} AS name, {value} AS value FROM orders {d.series(10, 'k')} WHERE o_orderkey % 7 <> 3"
    return f"SELECT coalesce(f.photo, e.photo) AS photo, coalesce(f.name, e.name) AS name, coalesce(f.value, e.value) AS value FROM ({fresh}) f FULL OUTER JOIN ({existing(d)}) e ON e.photo = f.photo AND e.name = f.name"


@catalog.add
def basic_settings_write(d: Dialect) -> str:
    """The eight basic controls: the adjustment as it is, and its sum with the preset's value inside the control's range."""
    low, high = (d.at(d.list(*[str(r[i]) for r in BASIC.values()]), "k") for i in (0, 1))
    name = d.at(d.list(*[f"'{k}'" for k in BASIC]), "k")
    change = "(o_orderkey % 21 - 10) * (CASE WHEN k = 0 THEN 1 ELSE 15 END)"
    base = "CASE WHEN o_orderkey % 2 = 0 THEN (CASE WHEN k = 0 THEN 1 ELSE 20 END) ELSE 0 END"
    one = f"SELECT o_orderkey AS photo, {name} AS name, greatest({low}, least({high}, {change})) AS adjustment, {base} AS base, {low} AS low, {high} AS high FROM orders {d.series(8, 'k')}"
    return f"SELECT photo, name, adjustment, greatest(low, least(high, base + adjustment)) AS absolute FROM ({one})"


@catalog.add
def settings_snapshot_status(d: Dialect) -> str:
    """What saving a photo's settings answers: no session or photo, unknown preset, bad values, a name that is taken, or saved."""
    one = "SELECT event_id, user_id % 9 = 0 AS no_session, event_id % 13 = 0 AS no_photo, event_id % 7 = 2 AS no_preset, value > 400 AS bad, event_id % 17 = 5 AS taken, event_id % 3 = 0 AS there FROM events"
    return f"SELECT event_id, CASE WHEN no_session OR no_photo THEN 404 WHEN no_preset OR bad THEN 400 WHEN taken THEN 409 ELSE 200 END AS code, CASE WHEN no_session OR no_photo OR no_preset OR bad OR taken THEN 'error' WHEN there THEN 'updated' ELSE 'written' END AS status FROM ({one})"


# ---- file names, batches, jobs --------------------------------------------------------------------------------------


@catalog.add
def unique_export_path(d: Dialect) -> str:
    """Where each export goes: the n-th request of a stem gets the n-th number that no file has; 1 is written without a number."""
    taken = f"SELECT p_brand AS b, p_size AS s, {'collect_set' if d.spark else 'list'}(CAST(p_partkey % 4 + 1 AS INT)) AS used FROM part WHERE p_partkey % 5 = 0 GROUP BY p_brand, p_size"
    asked = "SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 5 <> 0"
    inside = "array_contains(used, k + 1)" if d.spark else "list_contains(used, CAST(k + 1 AS INT))"
    free = d.keep(d.range(f"CAST(n + coalesce({d.size('used')}, 0) AS INT)"), "k", f"used IS NULL OR NOT {inside}")
    number = f"{d.at(free, 'n - 1')} + 1"
    stem = "concat(p_brand, '_', CAST(p_size AS VARCHAR(9)), '_dehaze')"
    return f"SELECT p_partkey, concat('out/', {stem}, CASE WHEN number = 1 THEN '' ELSE concat('_', CAST(number AS VARCHAR(9))) END, '.dng') AS path FROM (SELECT *, {number} AS number FROM ({asked}) LEFT JOIN ({taken}) ON b = p_brand AND s = p_size)"


def batch(d: Dialect) -> str:
    """session, photo, stem, preset, there, broken: photos of a request; companions share a stem."""
    return "SELECT l_suppkey AS session, l_orderkey * 10 + l_linenumber AS photo, l_partkey AS m, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'dsc_' ELSE 'DSC_' END, CAST(l_orderkey % 500 AS VARCHAR(9))) AS stem, CASE WHEN l_orderkey % 6 <> 0 THEN l_orderkey % 3 END AS preset, l_orderkey % 4 = 0 AS there, l_orderkey % 23 = 0 AS broken FROM lineitem"


@catalog.add
def preset_session_results(d: Dialect) -> str:
    """One sidecar per case-blind stem of a session: written or updated once, companions and photos without a preset skipped, failures told."""
    first = f"SELECT *, row_number() OVER (PARTITION BY session, CASE WHEN preset IS NULL THEN 0 ELSE 1 END, lower(stem) ORDER BY photo, m) AS n FROM ({batch(d)})"
    return f"SELECT session, photo, m, CASE WHEN preset IS NULL THEN 'skipped' WHEN n > 1 THEN 'skipped' WHEN broken THEN 'failed' WHEN there THEN 'updated' ELSE 'written' END AS status FROM ({first})"


@catalog.add
def preset_batch_summary(d: Dialect) -> str:
    """Counters of a batch: what was written counts new and updated sidecars; more than 500 photos are refused."""
    n = lambda s: f"sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END)"
    return f"SELECT session, count(*) AS total, {n('written')} + {n('updated')} AS written, {n('written')} AS created, {n('updated')} AS updated, {n('skipped')} AS skipped, {n('failed')} AS failed, count(*) > 500 AS refused FROM ({preset_session_results(d)}) GROUP BY session"


@catalog.add
def job_cancel(d: Dialect) -> str:
    """A cancel request ends queued jobs at once and running ones after their photo; finished ones stay as they are."""
    state = "CASE user_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END"
    one = f"SELECT user_id AS job_id, {state} AS state, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS asked FROM events GROUP BY user_id, {state}"
    return f"SELECT job_id, CASE WHEN asked = 1 AND state = 'queued' THEN 'cancelled' ELSE state END AS status, asked = 1 AND state IN ('queued', 'running') AS stops, state IN ('queued', 'running') AND asked = 0 AS goes_on FROM ({one})"


@catalog.add
def render_status(d: Dialect) -> str:
    """The backend each session used last, and whether any was a graphics one."""
    kind = d.at(d.list("'cpp_cpu'", "'metal'", "'python'", "'cuda'"), "event_id % 4")
    one = f"SELECT user_id, event_id, {kind} AS backend FROM events"
    return f"SELECT user_id AS session_id, {'max_by(backend, event_id)' if d.spark else 'arg_max(backend, event_id)'} AS last_used, bool_or(backend IN ('metal', 'cuda')) AS graphics FROM ({one}) GROUP BY user_id"


@catalog.add
def active_mode(d: Dialect) -> str:
    """The mode that was set last, valid ones only; standard if none was."""
    wish = d.at(d.list("'standard'", "'custom'", "'light'", "'wrong'"), "event_id % 4")
    one = f"SELECT user_id, event_id, {wish} AS mode FROM events WHERE event_type = 'signup'"
    ok = "mode <> 'wrong'"
    newest = f"{'max_by(mode, event_id)' if d.spark else 'arg_max(mode, event_id)'}"
    return f"SELECT u.user_id, coalesce(mode, 'standard') AS mode FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id AS i, {newest} AS mode FROM ({one}) WHERE {ok} GROUP BY user_id) m ON m.i = u.user_id"


@catalog.add
def scorer_instances(d: Dialect) -> str:
    """One scorer for each mode, model path, device and folder that requests ask for, and how many share it."""
    key = "mode, path, gpu"
    one = "SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'custom' ELSE 'standard' END AS mode, concat('models/', CAST(s_nationkey % 5 AS VARCHAR(9))) AS path, s_acctbal > 5000 AS gpu FROM supplier"
    return f"SELECT {key}, count(*) AS shared_by, min(s_suppkey) AS first_request FROM ({one}) GROUP BY {key}"


# ---- model input and heads ------------------------------------------------------------------------------------------


#: The channel means and deviations that the image encoder was trained with.
MEANS, DEVIATIONS = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


def _resized(n: int, to: int) -> list[list[float]]:
    """Rows of weights for a linear resize of n places to ``to``, filled up with zeros to n rows."""
    out = [[0.0] * n for _ in range(n)]
    for i in range(to):
        x = min(max((i + 0.5) * n / to - 0.5, 0.0), n - 1.0)
        lo, f = int(x), x - int(x)
        out[i][lo] += 1 - f
        out[i][min(lo + 1, n - 1)] += f
    return out


def model_input(d: Dialect, side: int, crop: int) -> Picture:
    """in_r, in_g, in_b: the photo with its short side at ``side``, the middle ``crop`` places of each row and column, standardised."""
    m, off = _resized(EDGE, side), (side - crop) // 2
    p = planes(d).filtered(m, m, sm_r="r", sm_g="g", sm_b="b")
    inner = Raster(d, crop, crop)
    at = lambda c: d.at(f"sm_{c}", f"{EDGE} * ({inner.y()} + {off}) + {inner.x()} + {off}")
    return p.add(**{f"in_{c}": inner.map(lambda q, c=c, k=k: f"({at(c)} - {MEANS[k]}) / {DEVIATIONS[k]}") for k, c in enumerate("rgb")})


@catalog.add
def encoder_preprocess(d: Dialect) -> str:
    """Photos of edge 8 at 6, the middle 4 x 4: the same steps that take a photo to 224."""
    p = model_input(d, 6, 4)
    slim = Picture(d, f"SELECT shot_id, in_r, in_g, in_b FROM ({p.sql})")
    return slim.pixels("shot_id, x, y, " + ", ".join(f"round({d.at(f'in_{c}', 'p')}, 5) AS {c}" for c in "rgb"), 16, 4)


@catalog.add
def trainer_preprocess(d: Dialect) -> str:
    """The same for training: stretched to the crop at once, nothing is cut off."""
    p = model_input(d, 4, 4)
    return p.select("shot_id, " + ", ".join(f"round({d.mean(f'in_{c}')}, 5) AS mean_{c}, round({d.most_of(f'in_{c}')}, 5) AS most_{c}" for c in "rgb"))


@catalog.add
def head_fusion(d: Dialect) -> str:
    """Two linear layers as one: the product of their matrices, and the second applied to the first's bias."""
    w1 = f"SELECT vec_id AS i, j, CAST({d.at('embedding', 'j')} AS DOUBLE) AS w FROM embeddings {d.series(64, 'j')}"
    w2 = f"SELECT j AS a, k, CAST((j * 5 + k * 3) % 7 - 3 AS DOUBLE) AS w FROM (SELECT 1 AS one) {d.series(64, 'j')} {d.series(3, 'k')}"
    return f"SELECT i, k, round(sum(p.w * q.w), 5) + 0.0 AS w FROM ({w1}) p JOIN ({w2}) q ON p.j = q.a GROUP BY i, k"

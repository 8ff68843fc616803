"""Queries over bytes: image headers and lists of lens corrections, packed from table rows and read back, with SQL that never packs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.frames import optics, tiles
from burstlake.functions import metadata as M
from burstlake.sources import headers, opcodes
from burstlake.sources import packets as xml
from burstlake.sources.tables import RECORDS, dealt, table

from .dialect import Catalog
from .framed import SHEETS, Steps, _rounded, _sheets

catalog = Catalog()


def records(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become records that Python reads, dealt out by number."""
    return dealt(table(spark, sf_dir, name), RECORDS)


def _register(run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    catalog.queries[run.__name__] = run
    if sql:
        catalog.oracles[run.__name__] = sql


# ---- headers --------------------------------------------------------------------------------------------------------


def _hex(value: Column | int, size: int, little: Column | None = None) -> Column:
    """Hexadecimal digits of an unsigned number of so many bytes."""
    digits = F.lpad(F.hex(F.lit(value) if isinstance(value, int) else value.cast("long")), 2 * size, "0")
    if little is None:
        return digits
    turned = F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)])
    return F.when(little, turned).otherwise(digits)


def _tiff(little: Column, image: list[tuple[int, int, Column]], exif: list[tuple[int, int, Column]], back: Column) -> Column:
    """A TIFF head with two directories; a value is a short (kind 3) or a quotient over 8 (kind 5).  Where ``back`` holds the second one points to the first, a cycle."""
    u = lambda v, n: _hex(v, n, little)
    second = 8 + 2 + 12 * (len(image) + 1) + 4
    values = second + 2 + 12 * (len(exif) + 2) + 4
    out = [F.when(little, F.lit("49492A00")).otherwise(F.lit("4D4D002A")), u(8, 4), u(len(image) + 1, 2)]
    short = lambda tag, v: [u(tag, 2), u(3, 2), u(1, 4), u(v, 2), F.lit("0000")]
    for tag, _, v in image:
        out += short(tag, v)
    out += [u(34665, 2), u(4, 2), u(1, 4), u(second, 4), u(0, 4), u(len(exif) + 2, 2)]
    tail: list[Column] = []
    for tag, kind, v in exif:
        if kind == 3:
            out += short(tag, v)
        else:
            out += [u(tag, 2), u(5, 2), u(1, 4), u(values + 4 * len(tail), 4)]
            tail += [u(v, 4), u(8, 4)]
    out += [u(37500, 2), u(7, 2), u(4, 4), F.lit("DEADBEEF"), u(40965, 2), u(4, 2), u(1, 4), F.when(back, u(8, 4)).otherwise(u(0, 4)), u(0, 4)]
    return F.unhex(F.concat(*out, *tail))


def header_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture metadata of one packed header per order, in either byte order, some with cycles and some cut off."""
    orders = records(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    little = k % 2 == 0
    size = [(256, 3, 1000 + k % 5000), (257, 3, 800 + c % 3000), (274, 3, 1 + k % 8)]
    shot = [(33434, 5, 1 + c % 30), (33437, 5, 8 + k % 150), (34855, 3, 100 * (1 + k % 64)), (37386, 5, 8 * (10 + c % 90)), (41989, 3, 15 + c % 200)]
    whole = _tiff(little, size, shot, k % 3 == 0)
    body = F.when(k % 11 == 5, F.substring(whole, 1, 60)).otherwise(whole)
    made = orders.select(k.alias("photo"), body.alias("body"))
    got = headers.tag_rows(made, "photo", "body").select("*", F.col("photo").cast("string").alias("path"), F.lit(0).cast("long").alias("size_bytes"))
    got = got.withColumn("n_tags", F.size("tags")).withColumn("damaged", F.col("error").isNotNull())
    shown = ("width", "height", "iso", "aperture", "exposure_time", "focal_length", "focal_length_35mm")
    return headers.photo_metadata(got, ["photo", "n_tags", "damaged"]).select("photo", *shown, "n_tags", "damaged")


_register(header_metadata, """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 11 = 5 AS cut FROM orders)
    SELECT k AS photo, CAST(CASE WHEN k % 8 >= 4 THEN 800 + c % 3000 ELSE 1000 + k % 5000 END AS INTEGER) AS width, CAST(CASE WHEN k % 8 >= 4 THEN 1000 + k % 5000 ELSE 800 + c % 3000 END AS INTEGER) AS height,
        CASE WHEN NOT cut THEN CAST(100 * (1 + k % 64) AS DOUBLE) END AS iso, CASE WHEN NOT cut THEN (8 + k % 150) / CAST(8 AS DOUBLE) END AS aperture, CASE WHEN NOT cut THEN (1 + c % 30) / CAST(8 AS DOUBLE) END AS exposure_time,
        CASE WHEN NOT cut THEN CAST(10 + c % 90 AS DOUBLE) END AS focal_length, CASE WHEN NOT cut THEN CAST(15 + c % 200 AS DOUBLE) END AS focal_length_35mm, CAST(CASE WHEN cut THEN 3 ELSE 8 END AS INTEGER) AS n_tags, cut AS damaged FROM o""")  # fmt: skip


def header_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag of one packed header per supplier, with the directory it stands in; positions and maker notes are not among them."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    body = _tiff(k % 2 == 1, [(256, 3, 10 + k % 60000), (274, 3, 1 + n % 8)], [(37386, 5, 1 + n), (41989, 3, n)], F.lit(True))
    got = headers.tag_rows(records(spark, sf_dir, "supplier").select(k.alias("photo"), body.alias("body")), "photo", "body")
    return got.select("photo", F.explode("tags").alias("t")).select("photo", "t.directory", "t.tag", "t.name", F.col("t.numbers")[0].alias("number"))


_register(header_tags, """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, unnest([{'d': 'image', 't': 256, 'm': 'ImageWidth'}, {'d': 'image', 't': 274, 'm': 'Orientation'}, {'d': 'exif', 't': 37386, 'm': 'FocalLength'}, {'d': 'exif', 't': 41989, 'm': 'FocalLengthIn35mmFilm'}]) AS x FROM supplier)
    SELECT k AS photo, x.d AS directory, CAST(x.t AS INTEGER) AS tag, x.m AS name, CASE x.t WHEN 256 THEN CAST(10 + k % 60000 AS DOUBLE) WHEN 274 THEN CAST(1 + n % 8 AS DOUBLE) WHEN 37386 THEN (1 + n) / CAST(8 AS DOUBLE) ELSE CAST(n AS DOUBLE) END AS number FROM s""")  # fmt: skip


# ---- lens corrections -----------------------------------------------------------------------------------------------

#: Doubles as bytes: powers of two and a half.
DOUBLES = {0.0: "0" * 16, 0.5: "3FE" + "0" * 13, 1.0: "3FF" + "0" * 13, 0.25: "3FD" + "0" * 13, 2**-4: "3FB" + "0" * 13, 2**-5: "3FA" + "0" * 13, -(2**-6): "BF9" + "0" * 13, 2**-8: "3F7" + "0" * 13, 2**-9: "3F6" + "0" * 13}


def _eighths(k: Column) -> Column:
    """1 + k / 8 as four bytes."""
    return F.lpad(F.hex(F.lit(0x3F800000) + k.cast("long") * (1 << 20)), 8, "0")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image and payload: a gain map of 3 x 5 points and three planes, then a warp; labels 3 and 8 have a list with bytes missing, labels 4 and 9 two gain maps."""
    label = (F.col("label")).cast("long")
    image = label * 1_000_000 + F.floor(F.col("vec_id") / 400)
    keys = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(image.alias("image"), label.alias("l")).distinct()
    u = lambda v: _hex(v, 4)
    head = "".join(f"{v:08X}" for v in (0, 0, 64, 64, 0, 3, 1, 1, 3, 5))
    gains = F.concat(*[_eighths((F.col("l") + 3 * v + 2 * h + 5 * p) % 8) for v in range(3) for h in range(5) for p in range(3)])
    gain = F.concat(F.lit("0000000901030000"), u(1), u(76 + 4 * 45), F.lit(head + DOUBLES[0.5] + DOUBLES[0.25] + DOUBLES[0.0] * 2 + f"{3:08X}"), gains)
    k1 = F.when(F.col("l") % 2 == 0, F.lit(DOUBLES[2**-4])).otherwise(F.lit(DOUBLES[2**-5]))
    plane = F.concat(F.lit(DOUBLES[1.0]), k1, F.lit(DOUBLES[-(2**-6)] + DOUBLES[2**-8] + DOUBLES[2**-8] + DOUBLES[2**-9]))
    warp = F.concat(F.lit("0000000101030000"), u(0), u(4 + 8 * 8), u(1), plane, F.lit(DOUBLES[0.5] * 2))
    twice = F.col("l") % 5 == 4
    whole = F.concat(F.when(twice, u(3)).otherwise(u(2)), gain, F.when(twice, gain).otherwise(F.lit("")), warp)
    return keys.select("image", F.unhex(F.when(F.col("l") % 5 == 3, F.substring(whole, 1, 600)).otherwise(whole)).alias("payload"))


def opcode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each list, or what is wrong with it."""
    got = opcodes.opcode_rows(_lists(spark, sf_dir), "image", "payload")
    return got.select("image", "seq", "opcode", "optional", "known", F.coalesce(F.size("values"), F.lit(0)).alias("n_values"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.col("error").isNotNull().alias("damaged"))


_IMAGES = "i AS (SELECT DISTINCT CAST(label AS BIGINT) * 1000000 + vec_id // 400 AS image, CAST(label AS INTEGER) AS l FROM embeddings WHERE label IS NOT NULL)"
_GAIN = "list_transform(range(45), lambda k: 1 + ((l + 3 * (k // 15) + 2 * (k // 3 % 5) + 5 * (k % 3)) % 8) / CAST(8 AS DOUBLE))"
_register(opcode_records, f"""WITH {_IMAGES}, r AS (SELECT image, l, unnest(CASE WHEN l % 5 = 3 THEN [0] WHEN l % 5 = 4 THEN [9, 9, 1] ELSE [9, 1] END) AS op, unnest(CASE WHEN l % 5 = 3 THEN [0] WHEN l % 5 = 4 THEN [0, 1, 2] ELSE [0, 1] END) AS n FROM i)
    SELECT image, CASE WHEN op > 0 THEN CAST(n AS INTEGER) END AS seq, CASE WHEN op > 0 THEN CAST(op AS BIGINT) END AS opcode, CASE WHEN op > 0 THEN op = 9 END AS optional, CASE WHEN op > 0 THEN TRUE END AS known,
        CAST(CASE op WHEN 9 THEN 45 WHEN 1 THEN 20 ELSE 0 END AS INTEGER) AS n_values,
        round(CASE op WHEN 9 THEN list_sum({_GAIN}) WHEN 1 THEN 3 * (1 + CASE WHEN l % 2 = 0 THEN 0.0625 ELSE 0.03125 END - 0.015625 + 0.00390625 + 0.00390625 + 0.001953125) + 1 END, 6) AS total, op = 0 AS damaged FROM r""")  # fmt: skip


def gain_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of every gain map."""
    return opcodes.gain_points(opcodes.opcode_rows(_lists(spark, sf_dir), "image", "payload"), "image")


_register(gain_map_points, f"""WITH {_IMAGES}, r AS (SELECT image, l, unnest(CASE WHEN l % 5 = 4 THEN [0, 1] ELSE [0] END) AS seq FROM i WHERE l % 5 <> 3), p AS (SELECT *, unnest(range(45)) AS k FROM r)
    SELECT image, CAST(seq AS INTEGER) AS seq, CAST(k // 15 AS BIGINT) AS v, CAST(k // 3 % 5 AS BIGINT) AS h, CAST(k % 3 AS BIGINT) AS plane, 1 + ((l + 3 * (k // 15) + 2 * (k // 3 % 5) + 5 * (k % 3)) % 8) / CAST(8 AS DOUBLE) AS gain FROM p""")  # fmt: skip


def tiled_gain_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets under their own gain maps, read from bytes, with highlights spared."""
    maps = opcodes.gain_maps(opcodes.opcode_rows(_lists(spark, sf_dir), "image", "payload"), "image")
    return _rounded(optics.with_gains(_sheets(spark, sf_dir).select(*tiles.PLACE, "r", "g", "b"), maps, ["r", "g", "b"], spare_highlights=True), "r", "g", "b")


def _gain_sql() -> str:
    q = Steps(SHEETS, "(SELECT *, CAST(image // 1000000 AS INTEGER) AS l FROM rgb)")
    at = lambda n, points, spacing: f"greatest(0.0, least({points - 1}.0, (({n} + CAST(0.5 AS DOUBLE)) / {'h' if points == 3 else 'w'}) / CAST({spacing} AS DOUBLE)))"
    q.add(gy=f"list_transform(range(h), lambda y: {at('y', 3, 0.5)})", gx=f"list_transform(range(w), lambda x: {at('x', 5, 0.25)})", top=q.each("greatest(r[p + 1], g[p + 1], b[p + 1])"))
    grid = lambda v, u, k: f"(1 + ((l + 3 * CAST(least(2, floor({v})) AS INTEGER) + 2 * CAST(least(4, floor({u})) AS INTEGER) + {5 * k}) % 8) / CAST(8 AS DOUBLE))"
    y, x = "gy[1 + p // w]", "gx[1 + p % w]"
    fy, fx = f"({y} - floor({y}))", f"({x} - floor({x}))"
    for k, c in enumerate("rgb"):
        gain = f"(({grid(y, x, k)} * (1 - {fy}) + {grid(f'{y} + 1', x, k)} * {fy}) * (1 - {fx}) + ({grid(y, f'{x} + 1', k)} * (1 - {fy}) + {grid(f'{y} + 1', f'{x} + 1', k)} * {fy}) * {fx})"
        q.add(**{f"gain_{c}": q.each(gain)})
    spare = "(1 - pow(1 - greatest(0.0, least(1.0, top[p + 1] / CAST(0.55 AS DOUBLE))), 2))"
    out = {f"{c}_": q.each(f"CASE WHEN l % 5 >= 3 THEN {c}[p + 1] ELSE greatest(0.0, least(1.0, {c}[p + 1] * gain_{c}[p + 1] / (1 + (gain_{c}[p + 1] - 1) * {spare}))) END") for c in "rgb"}
    return f"SELECT image, y, x, r_ AS r, g_ AS g, b_ AS b FROM ({q.add(**out).pixels('r_', 'g_', 'b_')})"


_register(tiled_gain_map, _gain_sql())


def tiled_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with the distortion of their own warps taken out; only lists that are sound and have one warp count."""
    found = opcodes.warps(opcodes.opcode_rows(_lists(spark, sf_dir), "image", "payload"), "image")
    return _rounded(optics.warped(_sheets(spark, sf_dir).select(*tiles.PLACE, "r", "g", "b"), found, ["r", "g", "b"]), "r", "g", "b")


def _warp_sql() -> str:
    q = Steps(SHEETS, "(SELECT *, CAST(image // 1000000 AS INTEGER) AS l, h / CAST(2 AS DOUBLE) AS cy, w / CAST(2 AS DOUBLE) AS cx FROM rgb WHERE (image // 1000000) % 5 < 3)")
    q.add(rad="sqrt(cx * cx + cy * cy)", k1="CASE WHEN l % 2 = 0 THEN CAST(0.0625 AS DOUBLE) ELSE CAST(0.03125 AS DOUBLE) END")
    q.add(nx=q.each("(p % w - cx) / rad"), ny=q.each("(p // w - cy) / rad"))
    q.add(r2=q.each("least(1.0, nx[p + 1] * nx[p + 1] + ny[p + 1] * ny[p + 1])"))
    q.add(f=q.each("1 + r2[p + 1] * (k1 + r2[p + 1] * (CAST(-0.015625 AS DOUBLE) + r2[p + 1] * CAST(0.00390625 AS DOUBLE)))"))
    t0, t1, n, m = "CAST(0.00390625 AS DOUBLE)", "CAST(0.001953125 AS DOUBLE)", "nx[p + 1]", "ny[p + 1]"
    q.add(
        sx=q.each(f"greatest(0.0, least(w - 1.0, cx + (p % w - cx) * f[p + 1] + rad * ({t1} * (r2[p + 1] + 2 * {n} * {n}) + 2 * {t0} * {n} * {m})))"),
        sy=q.each(f"greatest(0.0, least(h - 1.0, cy + (p // w - cy) * f[p + 1] + rad * ({t0} * (r2[p + 1] + 2 * {m} * {m}) + 2 * {t1} * {n} * {m})))"),
    )
    q.add(ix=q.each("CAST(floor(sx[p + 1]) AS INTEGER)"), iy=q.each("CAST(floor(sy[p + 1]) AS INTEGER)"))
    x0, y0, x1, y1 = "ix[p + 1]", "iy[p + 1]", "least(ix[p + 1] + 1, w - 1)", "least(iy[p + 1] + 1, h - 1)"
    fx, fy = "(sx[p + 1] - ix[p + 1])", "(sy[p + 1] - iy[p + 1])"
    v = lambda c, y, x: f"{c}[1 + ({y}) * w + {x}]"
    out = {f"{c}_": q.each(f"({v(c, y0, x0)} * (1 - {fx}) + {v(c, y0, x1)} * {fx}) * (1 - {fy}) + ({v(c, y1, x0)} * (1 - {fx}) + {v(c, y1, x1)} * {fx}) * {fy}") for c in "rgb"}
    return f"SELECT image, y, x, r_ AS r, g_ AS g, b_ AS b FROM ({q.add(**out).pixels('r_', 'g_', 'b_')})"


_register(tiled_warp, _warp_sql())


# ---- settings beside photos -----------------------------------------------------------------------------------------

_OPEN = f'<x:xmpmeta xmlns:x="{xml.META}"><rdf:RDF xmlns:rdf="{xml.RDF}"><rdf:Description rdf:about="" xmlns:c="{xml.CRS}" xmlns:v="urn:vendor" c:Exposure2012="'
_CURVE = "</v:Note><c:ToneCurvePV2012><rdf:Seq><rdf:li>0, 0</rdf:li><rdf:li>255, "
_CLOSE = "</rdf:li></rdf:Seq></c:ToneCurvePV2012></rdf:Description></rdf:RDF></x:xmpmeta>"


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo, n and body: a packet per customer with settings, a curve and a vendor's own property; every ninth is cut off, every seventh is missing."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("int")
    whole = F.concat(F.lit(_OPEN), n.cast("string"), F.lit('" v:Secret=\'k'), k.cast("string"), F.lit('\' c:Contrast2012="5"><v:Note>'), F.col("c_name"), F.lit(_CURVE), (k % 256).cast("string"), F.lit(_CLOSE))
    body = F.when(k % 7 == 3, F.lit(None)).when(k % 9 == 4, F.substring(whole, 1, 300)).otherwise(whole)
    return records(spark, sf_dir, "customer").select(k.alias("photo"), n.alias("n"), body.cast("binary").alias("body"))


_BODY = f"""SELECT c_custkey AS k, CAST(c_nationkey AS INTEGER) AS n, '{_OPEN.replace("'", "''")}' || c_nationkey || '" v:Secret=''k' || c_custkey || '''' AS head, '<v:Note>' || c_name || '{_CURVE}' || (c_custkey % 256) || '{_CLOSE}' AS tail FROM customer"""


def sidecar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets after a merge: exposure set, contrast dropped, a setting of one's own added; all else byte for byte as it was."""
    setting = lambda space, name, value: F.struct(F.lit(space).alias("namespace"), F.lit(name).alias("name"), value.alias("value"), F.lit(None).cast("array<string>").alias("items"))
    wanted = F.array(setting(xml.CRS, "Exposure2012", (F.col("n") + 1).cast("string")), setting(xml.CRS, "Contrast2012", F.lit(None).cast("string")), setting("urn:own", "Mode", F.lit("a & b")))
    got = xml.merged_packets(_packets(spark, sf_dir).withColumn("wanted", wanted), "photo", "body", "wanted")
    return got.select("photo", F.col("packet").cast("string").alias("packet"), F.col("error").isNotNull().alias("damaged"))


_register(sidecar_merge, f"""WITH b AS ({_BODY})
    SELECT k AS photo, CASE WHEN k % 7 = 3 THEN '{xml.EMPTY[:xml.EMPTY.index("/></")]}' || ' xmlns:crs="{xml.CRS}" crs:Exposure2012="' || (n + 1) || '" xmlns:ns="urn:own" ns:Mode="a &amp; b"' || '{xml.EMPTY[xml.EMPTY.index("/></"):]}'
        WHEN k % 9 = 4 THEN NULL ELSE replace(head, 'c:Exposure2012="' || n || '"', 'c:Exposure2012="' || (n + 1) || '"') || ' xmlns:ns="urn:own" ns:Mode="a &amp; b">' || tail END AS packet,
        k % 7 <> 3 AND k % 9 = 4 AS damaged FROM b""")  # fmt: skip


def sidecar_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property of the packets; a curve is the list of its points."""
    got = xml.packet_values(_packets(spark, sf_dir), "photo", "body")
    return got.select("photo", "namespace", "name", F.coalesce("value", F.array_join("items", "; ")).alias("value"), F.col("error").isNotNull().alias("damaged"))


_register(sidecar_properties, f"""WITH b AS (SELECT c_custkey AS k, c_nationkey AS n, c_name AS m, c_custkey % 9 = 4 AS bad FROM customer WHERE c_custkey % 7 <> 3),
    p AS (SELECT k, bad, unnest(CASE WHEN bad THEN [{{'s': NULL, 'p': NULL, 'v': NULL}}] ELSE [{{'s': '{xml.CRS}', 'p': 'Exposure2012', 'v': CAST(n AS VARCHAR)}}, {{'s': 'urn:vendor', 'p': 'Secret', 'v': 'k' || k}}, {{'s': '{xml.CRS}', 'p': 'Contrast2012', 'v': '5'}},
        {{'s': 'urn:vendor', 'p': 'Note', 'v': m}}, {{'s': '{xml.CRS}', 'p': 'ToneCurvePV2012', 'v': '0, 0; 255, ' || (k % 256)}}] END) AS x FROM b)
    SELECT k AS photo, x.s AS namespace, x.p AS name, x.v AS value, bad AS damaged FROM p""")  # fmt: skip


def tone_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of the curves in packets, one per part; some points are no points, out of range or at the place of another."""
    k, z = F.col("p_partkey"), F.col("p_size")
    items = [F.concat((z * 7).cast("string"), F.lit(", "), (z * 3).cast("string")), F.lit("nonsense"), F.concat(z.cast("string"), F.lit(" "), (k % 400).cast("string")), F.when(k % 3 == 0, "255, 250").otherwise("300,-5,2"), F.concat(F.lit(" "), z.cast("string"), F.lit(" ,77 "))]
    some = F.when(k % 10 == 0, F.array(F.lit("9, 9"))).otherwise(F.array(*items))
    setting = F.struct(F.lit(xml.CRS).alias("namespace"), F.lit("ToneCurvePV2012").alias("name"), F.lit(None).cast("string").alias("value"), some.alias("items"))
    made = records(spark, sf_dir, "part").select(k.alias("part"), F.lit(None).cast("binary").alias("body"), F.array(setting).alias("wanted"))
    read = xml.packet_values(xml.merged_packets(made, "part", "body", "wanted"), "part", "packet").select("part", M.curve_points(F.col("items")).alias("points"))
    return read.select("part", F.posexplode("points").alias("at", "p")).select("part", F.col("at").cast("int").alias("nth"), "p.x", "p.y")


_register(tone_curve_points, """WITH i AS (SELECT p_partkey AS k, p_size AS z, unnest(CASE WHEN p_partkey % 10 = 0 THEN [{'n': 0, 'x': 9.0, 'y': 9.0}] ELSE [{'n': 0, 'x': p_size * 7.0, 'y': p_size * 3.0}, {'n': 2, 'x': p_size * 1.0, 'y': p_partkey % 400 * 1.0},
        {'n': 3, 'x': CASE WHEN p_partkey % 3 = 0 THEN 255.0 END, 'y': 250.0}, {'n': 4, 'x': p_size * 1.0, 'y': 77.0}] END) AS v FROM part),
    c AS (SELECT k, v.n AS n, CAST(greatest(0, least(255, v.x)) AS DOUBLE) AS x, CAST(greatest(0, least(255, v.y)) AS DOUBLE) AS y FROM i WHERE v.x IS NOT NULL),
    l AS (SELECT k, x, y FROM c QUALIFY row_number() OVER (PARTITION BY k, x ORDER BY n DESC) = 1),
    e AS (SELECT k FROM l GROUP BY k HAVING count(*) >= 2), a AS (SELECT l.* FROM l JOIN e ON e.k = l.k UNION ALL SELECT p_partkey, CAST(v AS DOUBLE), CAST(v AS DOUBLE) FROM part, (SELECT unnest([0, 255]) AS v) WHERE p_partkey NOT IN (SELECT k FROM e))
    SELECT k AS part, CAST(row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS INTEGER) AS nth, x, y FROM a""")  # fmt: skip

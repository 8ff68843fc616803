"""Shared view definitions as SQL text: photos, their pixels, files, metadata records, jobs."""

from __future__ import annotations

from burstlake.sources.tables import IMAGE_SUFFIXES, PHOTO_ROWS, RAW_SUFFIXES

from .dialect import Dialect

RAW_LIST = ", ".join(f"'{s}'" for s in RAW_SUFFIXES)
IMAGE_LIST = ", ".join(f"'{s}'" for s in IMAGE_SUFFIXES)


def photos(d: Dialect) -> str:
    """shot_id, folder, captured_at, aesthetic, gray: 64 integers of 0 to 255, row by row."""
    gray = d.each("m.embedding", "v", "CAST(greatest(0, least(255, floor(128.5 + 400 * CAST(v AS DOUBLE)))) AS INT)")
    if d.spark:
        return f"SELECT m.vec_id AS shot_id, m.label AS folder, m.ts AS captured_at, least(1.0, CAST(m.value AS DOUBLE) / 100) AS aesthetic, {gray} AS gray FROM {PHOTO_ROWS} m"
    return f"""SELECT m.vec_id AS shot_id, m.label AS folder, e.ts AS captured_at, least(1.0, CAST(e.value AS DOUBLE) / 100) AS aesthetic, {gray} AS gray
        FROM embeddings m JOIN events e ON e.event_id = m.vec_id"""


def pixels(d: Dialect) -> str:
    """shot_id, x, y, v."""
    return f"""SELECT shot_id, folder, CAST(p % 8 AS INT) AS x, CAST({d.div("p", "8")} AS INT) AS y, {d.at("gray", "p")} AS v
        FROM ({photos(d)}) {d.series(64, "p")}"""


def rgb(d: Dialect) -> str:
    """shot_id, x, y, r, g, b in 0 to 1: three rotations of the gray image as channels."""
    c = lambda k: f"{d.at('gray', f'(p + {k}) % 64')} / CAST(255 AS DOUBLE)"
    return f"""SELECT shot_id, folder, CAST(p % 8 AS INT) AS x, CAST({d.div("p", "8")} AS INT) AS y, {c(0)} AS r, {c(9)} AS g, {c(18)} AS b
        FROM ({photos(d)}) {d.series(64, "p")}"""


def reflected(i: str, n: str) -> str:
    """Mirror an index of -1 to n at the border without repeating the border cell."""
    return f"(({n} - 1) - abs(({n} - 1) - abs({i})))"


def neighbour(d: Dialect, dx: int, dy: int, x0: str = "0", y0: str = "0", w: str = "8", h: str = "8") -> str:
    """The gray value beside (x, y) inside a region, mirrored at the region's border."""
    col, row = f"({x0} + {reflected(f'(x - {x0} + {dx})', w)})", f"({y0} + {reflected(f'(y - {y0} + {dy})', h)})"
    return d.at("gray", f"8 * {row} + {col}")


def files(d: Dialect) -> str:
    """path, dir, stem, ext, length: files of a photo volume made from lineitem."""
    ext = d.at(d.list("'.NEF'", "'.JPG'", "'.jpg'", "'.xmp'", "'.dng'", "'.txt'", "'.heic'"), "l_partkey % 7")
    stem = "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'dsc_' ELSE 'DSC_' END, CAST(l_orderkey AS VARCHAR(20)))"
    return f"""SELECT concat(dir, '/', stem, ext) AS path, dir, stem, ext, length FROM (
        SELECT dir, stem, ext, max(price) AS length FROM (
            SELECT concat('/vol', CAST(l_suppkey % 5 AS VARCHAR(20))) AS dir, {stem} AS stem, {ext} AS ext, CAST(floor(l_extendedprice) AS BIGINT) AS price
            FROM lineitem ) GROUP BY dir, stem, ext)"""


#: The view (Spark) or recursive query (SQL) that holds folder, shot_id, grp: the burst of each photo.
BURSTS = "photo_bursts"


def features(d: Dialect) -> str:
    """One row per shot of a burst: what scoring starts from.

    The sharpness of a shot is its median over the five regions that have most detail in its burst (of sound shots; larger
    region numbers win ties); severe blur is an absolute sharpness below 0.08.
    """
    from .rasters import Picture, exposure_of, with_absolute, with_cells

    p = with_absolute(with_cells(Picture(d, photos(d)))).add(exposure=exposure_of(d))
    shots = f"""SELECT p.shot_id, p.folder, b.grp AS slot, captured_at, aesthetic, exposure, quality, cells, p.shot_id % 17 = 3 AS eye_defect, p.shot_id % 41 = 5 AS failed
        FROM ({p.sql}) p JOIN {BURSTS} b ON b.shot_id = p.shot_id"""
    medians = ", ".join(f"{d.percentile(d.at('cells', str(k)), 0.5)} AS m{k}" for k in range(9))
    groups = f"SELECT folder AS f, slot AS s, {medians} FROM ({shots}) WHERE NOT failed GROUP BY folder, slot"
    each = d.list(*[d.record(m=f"m{k}", c=str(k)) for k in range(9)])
    best = f"slice(reverse(array_sort({each})), 1, 5)" if d.spark else f"list_reverse_sort({each})[1:5]"
    groups = f"SELECT f, s, {best} AS best FROM ({groups})"
    sharp = d.median(d.each("best", "b", d.at("cells", "b.c")))
    chosen = f"SELECT a.*, {sharp} AS sharpness FROM ({shots}) a LEFT JOIN ({groups}) z ON a.folder = z.f AND a.slot = z.s"
    return f"""SELECT shot_id, folder, slot, captured_at, aesthetic, exposure, coalesce(sharpness, 0.0) AS sharpness, quality < 0.08 AS severe_blur, eye_defect, failed
        FROM ({chosen})"""

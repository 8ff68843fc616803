"""Metadata scalars as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = r"(?i)(\d+(?:\.\d+)?)\s*(?:[-–]\s*(\d+(?:\.\d+)?))?\s*mm"


def number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def capture_micros(taken: Column, fraction: Column, stored: Column) -> Column:
    """Microseconds of a capture time text with its fraction, else of the file's own time."""
    seconds = F.unix_micros(F.try_to_timestamp(F.trim(taken), F.lit("yyyy:MM:dd HH:mm:ss")))
    part = F.coalesce(F.rpad(F.substring(F.trim(fraction), 1, 6), 6, "0").try_cast("int"), F.lit(0))
    return F.coalesce(seconds + part, F.unix_micros(stored.cast("timestamp")))


def rational(num: Column, den: Column) -> Column:
    """Positive quotient of a rational pair, else null."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    return F.when(q > 0, q)


def lens_range(specification: Column, name: Column) -> Column:
    """[shortest, longest] focal length from the lens specification, else from the lens name; null if neither is sound."""
    a, b = F.get(specification, F.lit(0)).cast("double"), F.get(specification, F.lit(1)).cast("double")
    lo = number(F.regexp_extract(name, RANGE, 1))
    hi = F.coalesce(number(F.regexp_extract(name, RANGE, 2)), lo)
    ok = lambda x, y: (x > 0) & (x <= y)
    return F.when(ok(a, b), F.array(a, b)).when(ok(lo, hi), F.array(lo, hi))


def range_35mm(focal: Column, focal35: Column, lens: Column) -> Column:
    """The lens range in 35 mm terms if this shot's focal length lies in it; within 5 % of full frame it stays."""
    scale = focal35 / focal
    scale = F.when(F.abs(scale - 1) <= 0.05, F.lit(1.0)).otherwise(scale)
    return F.when(focal.between(F.get(lens, F.lit(0)), F.get(lens, F.lit(1))) & (scale > 0), F.transform(lens, lambda x: x * scale))


def oriented(width: Column, height: Column, orientation: Column) -> Column:
    """(width, height) as seen: orientations 5 to 8 swap them."""
    turned = orientation.between(5, 8)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def clamp(x: Column) -> Column:
    """To 0..1; not a number becomes 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(0.0))))


def flag(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))


def curve_points(items: Column) -> Column:
    """Points (x, y) of a curve from texts "x, y" or "x y": clipped to 0..255, by x, the last of equal x; a straight line unless two are left."""
    line = F.array(*[F.struct(F.lit(v).alias("x"), F.lit(v).alias("y")) for v in (0.0, 255.0)])

    def point(text: Column) -> Column:
        parts = F.when(F.contains(text, F.lit(",")), F.split(text, ",")).otherwise(F.split(F.trim(text), r"\s+"))
        x, y = (F.trim(F.get(parts, F.lit(k))).try_cast("double") for k in (0, 1))
        sound = (F.size(parts) == 2) & x.isNotNull() & y.isNotNull() & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
        inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))
        return F.when(sound, F.struct(inside(x).alias("x"), inside(y).alias("y")))

    points = F.array_compact(F.transform(items, point))
    placed = F.array_sort(F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), (-i).alias("k"), p["y"].alias("y"))))
    last = F.filter(placed, lambda p, i: (i == 0) | (F.get(placed, i - 1)["x"] != p["x"]))
    found = F.transform(last, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return F.when(F.size(found) >= 2, found).otherwise(line)

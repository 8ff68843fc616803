"""The culling steps as one chain over a user's own tables.

    Cull(shots).sessionize().route(keep=1, action="review").summary()

``shots`` has one row per shot: shot_id, folder, captured_at, dhash (text of 0 and 1, null if unknown), aesthetic,
exposure, sharpness, severe_blur, eye_defect, failed.  Each step returns a new Cull; ``rows`` is its DataFrame.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.operators.sessionize import anchored_groups
from burstlake.plans.culling import ranked
from burstlake.plans.dialect import SPARK, _doubles
from burstlake.sources.tables import IMAGE_SUFFIXES, RAW_SUFFIXES

ACTIONS = ("keep", "review", "reject")


def pair_companions(files: DataFrame) -> DataFrame:
    """(dir, stem_key, primary_path, all_paths) from files (path, dir, stem, ext): raw first, then images, then by suffix and path."""
    ext = F.lower("ext")
    order = F.struct((~ext.isin(*RAW_SUFFIXES)).cast("int").alias("a"), (~ext.isin(*IMAGE_SUFFIXES)).cast("int").alias("b"), ext.alias("c"), F.col("path"))
    shots = files.where(ext.isin(*RAW_SUFFIXES, *IMAGE_SUFFIXES)).groupBy("dir", F.lower("stem").alias("stem_key"))
    paths = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["path"])
    return shots.agg(paths.alias("all_paths")).select("dir", "stem_key", F.col("all_paths")[0].alias("primary_path"), "all_paths")


def usable_weights(weights: dict | None) -> tuple[float, float, float] | None:
    """Weights over their sum; None, and with it adaptive weights, unless all three are finite, none is negative and one is positive."""
    try:
        got = [float(weights[k]) for k in ("aesthetic", "sharpness", "exposure")]
    except (KeyError, TypeError, ValueError, OverflowError):
        return None
    total = sum(got)
    return tuple(w / total for w in got) if all(math.isfinite(w) and w >= 0 for w in got) and total > 1e-12 else None


def upsert_decisions(log: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions (photo_id, kept) with the new ones in place of older ones of the same photo."""
    return log.join(new, "photo_id", "left_anti").unionByName(new)


def merge_settings(existing: str, new: str) -> F.Column:
    """A map column with all new keys and those existing ones that the new map does not name."""
    return F.map_concat(F.map_filter(existing, lambda k, v: ~F.map_contains_key(new, k)), F.col(new))


@dataclass(frozen=True)
class Cull:
    rows: DataFrame

    def sessionize(self, gap_seconds: float = 1.5, max_distance: int = 12) -> Cull:
        """Bursts within each folder, as column slot."""
        got = anchored_groups(self.rows.drop("slot"), "folder", "captured_at", "shot_id", "dhash", round(gap_seconds * 1e6), max_distance, bits=True)
        return Cull(self.rows.drop("slot").join(got.withColumnRenamed("grp", "slot"), ["folder", "shot_id"]))

    def route(self, keep: int = 1, action: str = "keep", weights: dict | None = None) -> Cull:
        """Scores, ranks and the category of each shot."""
        if action not in ACTIONS or keep < 1:
            raise ValueError("action must be keep, review or reject, and keep at least 1")
        spark, view = self.rows.sparkSession, f"shots_{uuid.uuid4().hex}"
        self.rows.createOrReplaceTempView(view)
        try:
            return Cull(spark.sql(_doubles(ranked(SPARK, keep, action, view, usable_weights(weights)))))
        finally:
            spark.catalog.dropTempView(view)

    def summary(self) -> DataFrame:
        """One row per burst: shots, kept, defects, margin, whether to look at it."""
        return self.rows.groupBy("folder", "slot").agg(
            F.count("*").alias("shots"), F.count_if("kept").alias("kept"), F.count_if(F.col("category") == "defect").alias("defects"),
            F.max("margin").alias("margin"), F.bool_or("needs_review").alias("needs_review"),
        )

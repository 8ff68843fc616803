"""Anchored sessions: a row joins the group before it if it comes soon after the row before and is near the group's first row.

The gap to the previous row does not depend on where groups start, so it cuts first, with window functions; what
is left of the anchor rule is a fold over each gap session alone: sessions are dealt out and streamed in order.  A table of
more than ``RANGE_ROWS`` rows is also cut into time ranges, and windows run within a key and a range: what a range needs of those
before it (the last time, how many sessions or groups began) is a table of one row per key and range.  So a hot key is
spread over its ranges and sessions; rows are then read twice.  A missing measure on either side cuts, and such a row anchors its
own group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def near_numbers(a: float, b: float, limit: float) -> bool:
    return abs(a - b) <= limit


def near_bits(a: str, b: str, limit: float) -> bool:
    """For hashes written as texts of 0 and 1: the distance is the number of differing places."""
    return sum(x != y for x, y in zip(a, b, strict=True)) <= limit


RANGE_ROWS = 1_000_000


class Fold:
    """Tells for rows in order whether each starts a group; remembers the session and its anchor between calls."""

    def __init__(self, near: Callable, limit: float) -> None:
        self.near, self.limit, self.session, self.anchor = near, limit, None, None

    def starts(self, session: object, value: object) -> int:
        new = session != self.session or value is None or self.anchor is None or not self.near(value, self.anchor, self.limit)
        if new:
            self.session, self.anchor = session, value
        return int(new)


def _running(rows: DataFrame, flag: str, to: str, ranged: bool) -> DataFrame:
    """rows (k, b, u, i) with to: how many flags there are up to each row of its key."""
    inside = F.sum(flag).over(W.partitionBy("k", "b").orderBy("u", "i"))
    if not ranged:
        return rows.withColumn(to, inside)
    before = F.sum("n").over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    ahead = rows.groupBy("k", "b").agg(F.sum(flag).alias("n")).select(F.col("k").alias("k2"), F.col("b").alias("b2"), F.coalesce(before, F.lit(0)).alias("ahead"))
    return rows.join(ahead, F.col("k").eqNullSafe(F.col("k2")) & (F.col("b") == F.col("b2"))).withColumn(to, F.col("ahead") + inside).drop("k2", "b2", "ahead")


def anchored_groups(
    df: DataFrame, key: str, time: str, row_id: str, measure: str, gap_us: int, limit: float, bits: bool = False, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """df's key and row_id with grp, counted from 1 within a key in order of (time, row_id)."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.select(F.col(key).alias("k"), F.col(row_id).alias("i"), F.col(measure).alias("m"), us.alias("u"))
    span = rows.agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    ranges = max(1, -(-span["n"] // range_rows)) if span["lo"] is not None else 1
    ranged = ranges > 1
    width = (span["hi"] - span["lo"]) // ranges + 1 if ranged else 1
    at = F.coalesce(F.floor((F.col("u") - span["lo"]) / width), F.lit(-1)).cast("long") if ranged else F.lit(0).cast("long")
    rows = rows.withColumn("b", at)
    last = F.lag("u").over(W.partitionBy("k", "b").orderBy("u", "i"))
    if ranged:
        ends = rows.groupBy("k", "b").agg(F.max("u").alias("end")).select(F.col("k").alias("k2"), F.col("b").alias("b2"), F.lag("end").over(W.partitionBy("k").orderBy("b")).alias("end"))
        rows = rows.join(ends, F.col("k").eqNullSafe(F.col("k2")) & (F.col("b") == F.col("b2"))).drop("k2", "b2")
        last = F.coalesce(last, F.col("end"))
    cut: Column = F.coalesce((F.col("u") - last) > gap_us, F.lit(True)).cast("int")
    sessions = _running(rows.withColumn("c", cut), "c", "s", ranged)
    kinds = dict(sessions.dtypes)

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = Fold(near_bits if bits else near_numbers, limit)
        for pdf in batches:
            values = (None if pd.isna(v) else v for v in pdf["m"])
            pdf["starts"] = [run.starts((k, s), v) for k, s, v in zip(pdf["k"], pdf["s"], values, strict=True)]
            yield pdf[["k", "b", "i", "u", "starts"]]

    dealt = sessions.repartition("k", "s").sortWithinPartitions("k", "s", "u", "i").select("k", "b", "i", "u", "s", "m")
    marked = dealt.mapInPandas(folded, f"k {kinds['k']}, b long, i {kinds['i']}, u long, starts int")
    return _running(marked, "starts", "grp", ranged).select(F.col("k").alias(key), F.col("i").alias(row_id), "grp")

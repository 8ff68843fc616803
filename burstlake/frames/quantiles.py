"""Exact quantiles of images by radix select: no image's values are ever gathered or sorted as a whole.

A value's key is its 64 bits, turned so that keys sort as values do.  Each round counts, in every tile, the next 16 bits of the
values whose leading bits are still in question (at most 65,536 counts per tile and open prefix), adds the counts up per image and
moves each wanted rank into the one bucket that holds it.  Once few values share a prefix their whole keys are
counted, which ends most searches with the third round; four always do.

Defined results: quantiles are linear between the two neighbouring values, as is usual; images without values have no row;
nulls and NaNs are not values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlake.sources.scratch import written

from .tiles import pieces

DIGIT, FEW = 16, 20_000
#: Most rows of the table of open prefixes (one per image) that is broadcast; a few hundred bytes each.
BROADCAST_ROWS = 200_000
SIGN = np.uint64(1 << 63)


def keys(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort as the values do."""
    bits = np.ascontiguousarray(values[~np.isnan(values)] + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def value_of(key: np.ndarray) -> np.ndarray:
    key = key.astype(np.uint64)
    return np.where(key & SIGN, key ^ SIGN, ~key).view(np.float64)


def image_quantiles(tiles: DataFrame, band: str, shares: Sequence[float | Callable[[Column], Column]]) -> DataFrame:
    """image, n and q (array: the value at each share).  A share may be a function from the number of values to a place from 0 on."""
    image = tiles.schema["image"]
    narrow = tiles.select("image", F.col(band).alias("v"))
    counts = T.StructType([image]).add("prefix", "long").add("digit", "long").add("n", "long")

    def counted(shift: int, width: int):
        """Counts of the ``width`` bits after ``shift`` decided ones, for the open prefixes of an image."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                at, parts = [], []
                for i in range(batch.num_rows):
                    key = keys(batch.column("v")[i].values.to_numpy(zero_copy_only=False).astype(np.float64))
                    lead = key >> np.uint64(64 - shift) if shift else np.zeros(len(key), np.uint64)
                    for prefix in batch.column("open")[i].as_py() if shift else [0]:
                        inside = key[lead == np.uint64(prefix)]
                        digit, n = np.unique((inside << np.uint64(shift)) >> np.uint64(64 - width) if shift else inside >> np.uint64(64 - width), return_counts=True)
                        at += [i] * len(digit)
                        parts.append((np.full(len(digit), prefix, np.int64), digit.view(np.int64), n))
                columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column("image").take(pa.array(at, pa.int32())), *[pa.array(c, pa.int64()) for c in columns]], names=counts.names)

        return run

    found = narrow.mapInArrow(counted(0, DIGIT), counts).groupBy("image", "prefix", "digit").agg(F.sum("n").alias("n"))
    total = found.groupBy("image").agg(F.sum("n").alias("total"))
    place = lambda s: s(F.col("total")) if callable(s) else F.lit(float(s)) * (F.col("total") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), place(s).cast("double").alias("at")) for k, s in enumerate(shares)]))
    at = F.col("w.at")
    ranks = total.select("image", "total", wanted.alias("w")).select(
        "image", "total", F.col("w.k").alias("k"), (at - F.floor(at)).alias("f"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("side"), F.least(F.floor(at) + 1, F.col("total") - 1).alias("rank")))).alias("r"),
    ).select("image", "total", "k", "f", F.col("r.side").alias("side"), F.col("r.rank").alias("rank"), F.lit(0).cast("long").alias("prefix"))
    shift, width = 0, DIGIT
    while True:
        below = F.sum("n").over(W.partitionBy("image", "prefix").orderBy("digit")) - F.col("n")
        ranks = ranks.drop("inside")
        table = found.select(F.col("image").alias("i"), F.col("prefix").alias("p"), "digit", F.col("n").alias("inside"), below.alias("below"))
        on = ranks["image"].eqNullSafe(table["i"]) & (ranks["prefix"] == table["p"]) & (ranks["rank"] >= table["below"]) & (ranks["rank"] < table["below"] + table["inside"])
        moved = ranks.join(table, on).select(
            "image", "total", "k", "f", "side", (F.col("rank") - F.col("below")).alias("rank"), F.shiftleft(F.col("prefix"), width).bitwiseOR(F.col("digit")).alias("prefix"), "inside"
        )
        ranks = written(moved, "ranks")  # small: two rows for each image and share
        shift += width
        if shift == 64:
            break
        width = 64 - shift if (ranks.agg(F.max("inside")).first()[0] or 0) <= FEW else min(DIGIT, 64 - shift)
        open_ = ranks.groupBy(F.col("image").alias("of")).agg(F.collect_set("prefix").alias("open"))
        open_ = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_.hint("merge")
        found = narrow.join(open_, F.col("image").eqNullSafe(F.col("of"))).select("image", "v", "open").mapInArrow(counted(shift, width), counts)
        found = found.groupBy("image", "prefix", "digit").agg(F.sum("n").alias("n"))
    schema = T.StructType([image]).add("n", "long").add("k", "integer").add("f", "double").add("side", "integer").add("value", "double")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = value_of(batch.column("prefix").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("image", "total", "k", "f", "side")], pa.array(value, pa.float64())], names=schema.names)

    got = ranks.select("image", "total", "k", "f", "side", "prefix").mapInArrow(values, schema)
    low, high = (F.max(F.when(F.col("side") == s, F.col("value"))) for s in (0, 1))
    each = got.groupBy("image", "n", "k").agg((low + (high - low) * F.max("f")).alias("q"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"])
    return each.groupBy("image", "n").agg(ordered.alias("q"))

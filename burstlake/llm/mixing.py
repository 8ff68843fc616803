"""Mixing sources to target weights by systematic sampling.

Source targets are filled like connected vessels: every source takes its weight's share of all words, stops
at ``most`` times its own words, and what is left over is shared among the others by weight.  Within a source
each document is expected target / source_size times; its rows are laid in order of size, so that every run of
the cumulated expectation has a fair share of short and long texts, and one random offset decides which
integer boundaries each document crosses.  A document is emitted once for each boundary.

Ranks are made without gathering a source in one task: rows are counted by (source, size, slice of a uniform
hash of the id), the counts are cumulated over the small table of counts, and only the rows of one slice meet.

Defined results: null or empty texts have size 0 and add nothing to any total; null sources are one source and
come last; repeated rows are ranked as separate rows; an empty table gives an empty mix; columns of the input may
have any name, and only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import boxed, materialise, md5_60, unboxed, words_of

WEIGHTS, MOST, SEED, SLICE_ROWS = (5.0, 2.0, 1.0), 3, 17, 50_000
#: Most rows of the table of strata (one per source and size) that is broadcast, some 100 bytes each.
BROADCAST_ROWS = 500_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add target to a table (source, source_size): one row per source, so the windows here are small."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    # In order of cap / weight the sources that stop are the first ones; level is the share per weight left at each.
    by_cap = W.orderBy(most * F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    rest = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    level = left / F.sum("_w").over(rest)
    at = ranked.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_w") >= most * F.col("source_size"))
    free = F.min(F.when(~F.col("_full"), F.struct(most * F.col("source_size") / F.col("_w"), F.col("_level")))).over(W.partitionBy())
    target = F.when(F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise(free["_level"] * F.col("_w"))
    return at.select("source", "source_size", target.alias("target"))


def _offset(source: Column, seed: int) -> Column:
    return md5_60(F.lit(f"offset{seed}"), source) / F.lit(float(1 << 60))


def sampled_copies(
    df: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, copies, and text_key to tell rows of one id apart."""
    key = F.xxhash64(F.col(text))
    narrow = df.select(
        F.col(row_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), key.alias("text_key")
    ).withColumn("_h", md5_60(F.lit("order"), F.col("doc_id")))
    rows, _ = materialise(narrow, "mix-rows")
    strata = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n"))
    sized = targets(strata.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, most)
    cut = F.ceil(F.col("_n") / slice_rows)
    strata = strata.withColumn("_before", F.sum("_n").over(W.partitionBy("source").orderBy("size")) - F.col("_n")).withColumn("_cut", cut)
    strata = strata.join(sized.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    s, _ = materialise(strata.select([F.col(c).alias(f"s_{c}") for c in ("source", "size")] + ["_before", "_cut", "source_size", "target"]), "mix-strata")
    if s.count() <= BROADCAST_ROWS:  # so a common size is never gathered before it is cut into slices
        s = F.broadcast(s)
    joined = rows.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size"))).drop("s_source", "s_size")
    joined = joined.withColumn("_slice", F.floor(F.col("_h") / F.lit(float(1 << 60)) * F.col("_cut")))
    slices = joined.where("_cut > 1").groupBy("source", "size", "_slice").agg(F.count(F.lit(1)).alias("_m"))
    ahead = F.sum("_m").over(W.partitionBy("source", "size").orderBy("_slice")) - F.col("_m")
    slices = slices.select(F.col("source").alias("t_source"), F.col("size").alias("t_size"), F.col("_slice").alias("t_slice"), ahead.alias("_ahead"))
    on = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")) & (F.col("_slice") == F.col("t_slice"))
    joined = joined.join(slices, on, "left")
    inside = F.row_number().over(W.partitionBy("source", "size", "_slice").orderBy("_h", "doc_id", "text_key"))
    place = F.col("_before") + F.coalesce(F.col("_ahead"), F.lit(0)) + inside
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(n * each + _offset(F.col("source"), seed))
    return joined.withColumn("_place", place).select(
        "doc_id", "source", "size", "source_size", "target", (upto(F.col("_place")) - upto(F.col("_place") - 1)).cast("int").alias("copies"), "text_key"
    )


def mix(df: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", **how) -> DataFrame:
    """The mix itself: df's rows, each as often as it was taken.

    Repeated rows (one id and one text) share their copies: as many rows come out as the sample took of them.
    """
    took = sampled_copies(df, text, source, row_id, **how).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("copies"))
    took = took.where("copies > 0").select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("text_key").alias("k"), "copies")
    keyed = boxed(df, df.columns, id=F.col(row_id), src=F.col(source).cast("string"), key=F.xxhash64(F.col(text)))
    nth = F.row_number().over(W.partitionBy("id", "src", "key").orderBy("key"))
    on = F.col("id").eqNullSafe(F.col("i")) & F.col("src").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k"))
    first = keyed.join(took, on).withColumn("nth", nth).where("nth = 1")
    return first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*unboxed(df.columns))

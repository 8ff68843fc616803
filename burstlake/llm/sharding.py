"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until every splitter is close.

Rows are ordered by a 120-bit key: a hash of the text, then a hash of the row's id.  Equal texts are therefore
neighbours.  The first histogram counts the leading bits of the key; then the buckets in which a splitter's goal (j
times total / shards) falls are counted by further bits, round by round, until the goal lies in one group of equal
texts.  If an edge of that group is within ``tolerance`` of the goal the splitter stands at the nearer edge, so the
group stays whole; else the probes go on inside the group, to the nearest row.  Each round is one aggregation
whose result has at most 2^FIRST_MOST + splitters * 2^STEP_BITS rows; rows move only once, at the end.

Defined results: a null text has no bytes and is a group of its own, other than empty texts; an empty table gives no
rows; repeated rows are separate rows that may tie in every sort key, in which case they are interchangeable;
rows without an id are ordered like others; a text larger than a shard fills its shard alone; columns of the input
may have any name, those that clash with the added ones (``size law shard slot grown_shard``) are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, drop_scratch, materialise, md5_60, own_columns, unboxed, utf8_bytes

FIRST_LEAST, FIRST_MOST, STEP_BITS, HALF_BITS = 12, 18, 6, 60
ROW_OVERHEAD, TOLERANCE = 16, 0.002


class Leaf(NamedTuple):
    """Rows whose key begins with the ``depth`` leading bits of (k1, k2)."""

    k1: int
    k2: int
    depth: int
    rows: int
    size: int


def text_key(text: Column) -> Column:
    return F.when(text.isNull(), md5_60(F.lit("null"))).otherwise(md5_60(F.lit("text"), text))


def row_key(row_id: Column) -> Column:
    return md5_60(F.lit("row"), row_id)


class Histograms:
    """Counts of the keys (k1, k2, size), by the bits that follow some leading ones."""

    def __init__(self, keys: DataFrame, first_bits: int) -> None:
        self.keys, self.first = keys, first_bits

    def _digit(self, at: int) -> tuple[str, int, int]:
        """The digit that starts at bit ``at`` of the key: which half, right shift, width."""
        half, inside = divmod(at, HALF_BITS)
        width = min(STEP_BITS if inside else self.first, HALF_BITS - inside)
        return ("k1", "k2")[half], HALF_BITS - inside - width, width

    def below(self, at: int, prefixes: list[Leaf]) -> list[list[Leaf]]:
        """The leaves below each prefix of ``at`` bits; one text's rows are one leaf of HALF_BITS bits, whatever their digit."""
        half, shift, width = self._digit(at)
        digit = F.shiftright(F.col(half), shift).bitwiseAND((1 << width) - 1)
        # As many rows as prefixes, which are the open splitters and crowded leaves.
        s1, s2 = max(0, HALF_BITS - at), max(0, min(HALF_BITS, 2 * HALF_BITS - at))
        table = self.keys.sparkSession.createDataFrame([(i, x.k1 >> s1, x.k2 >> s2) for i, x in enumerate(prefixes)], "p int, a long, b long")
        on = F.shiftright("k1", s1) == F.col("a") if at <= HALF_BITS else (F.col("k1") == F.col("a")) & (F.shiftright("k2", s2) == F.col("b"))
        got = self.keys.join(F.broadcast(table), on) if at else self.keys.withColumn("p", F.lit(0))
        got = got.groupBy("p", digit.alias("d")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("k1").alias("lo"), F.max("k1").alias("hi"))
        out: list[list[Leaf]] = [[] for _ in prefixes]
        for r in sorted(got.collect(), key=lambda r: (r["p"], r["d"])):
            k1, k2, depth = prefixes[r["p"]].k1, prefixes[r["p"]].k2, at + width
            if half == "k1":
                k1 += r["d"] << shift
            else:
                k2 += r["d"] << shift
            if depth <= HALF_BITS and r["lo"] == r["hi"]:  # one text: only the id can split it
                k1, depth = r["lo"], HALF_BITS
            out[r["p"]].append(Leaf(k1, k2, depth, r["rows"], r["bytes"]))
        return out

    def refined(self, leaves: list[Leaf], open_: set[int]) -> dict[int, list[Leaf]]:
        """The leaves below those that are open."""
        out: dict[int, list[Leaf]] = {}
        for depth in sorted({leaves[i].depth for i in open_}):
            mine = sorted(i for i in open_ if leaves[i].depth == depth)
            out |= zip(mine, self.below(depth, [leaves[i] for i in mine]), strict=True)
        return out


def _at_splitters(keys: Histograms, shards: int, tolerance: float) -> list[tuple[Leaf, int]]:
    """Leaves in key order with their shards, refined where a splitter falls."""
    leaves = keys.below(0, [Leaf(0, 0, 0, 0, 0)])[0]
    total = sum(x.size for x in leaves)
    slack = Fraction(str(tolerance)) * total  # as all distances here, times the number of shards
    while True:
        ends, run = [], 0
        for x in leaves:
            run += x.size
            ends.append(run)
        open_ = set()
        for j in range(1, shards):
            i = bisect_left(ends, Fraction(j * total, shards))
            if i < len(leaves):
                x, before, after = leaves[i], j * total - (ends[i] - leaves[i].size) * shards, ends[i] * shards - j * total
                if before > 0 and after > 0 and x.rows > 1 and x.depth < 2 * HALF_BITS and (x.depth != HALF_BITS or min(before, after) > slack):
                    open_.add(i)
        if not open_:
            # The middle of a leaf is in its shard's span.
            return [(x, min(shards - 1, (2 * end - x.size) * shards // (2 * total))) for x, end in zip(leaves, ends, strict=True)]
        below = keys.refined(leaves, open_)
        leaves = [y for i, x in enumerate(leaves) for y in below.get(i, [x])]


def _to_order(keys: Histograms, placed: list[tuple[Leaf, int]], max_rows: int) -> list[tuple[Leaf, int]]:
    """The same, with leaves of too many rows for one task cut further."""
    while open_ := {i for i, (x, _) in enumerate(placed) if x.rows > max_rows and x.depth < 2 * HALF_BITS}:
        below = keys.refined([x for x, _ in placed], open_)
        placed = [(y, shard) for i, (x, shard) in enumerate(placed) for y in below.get(i, [x])]
    return placed


def histogram_shards(
    df: DataFrame, shards: int = 40, text: str = "text", row_id: str = "doc_id", tolerance: float = TOLERANCE, rows_per_leaf: int = 65_536
) -> DataFrame:
    """df with ``size, law, shard, slot, grown_shard``: shards 0.. of near-equal bytes, rows in key order.

    tolerance: how far from its goal, as a share of one shard, a splitter may stand to keep a group of equal texts
    whole.  rows_per_leaf: most rows that one task orders (more in tables of over 10^10 rows).
    """
    spark = df.sparkSession
    rest = own_columns(df, "size", "law", "shard", "slot", "grown_shard")
    keyed = boxed(df, rest, size=utf8_bytes(F.col(text)) + ROW_OVERHEAD, k1=text_key(F.col(text)), k2=row_key(F.col(row_id)))
    table, path = materialise(keyed.select("k1", "k2", "size"), "shard-keys")
    n_rows = table.count()
    first = min(FIRST_MOST, max(FIRST_LEAST, (n_rows // 16_384).bit_length()))
    cap = max(rows_per_leaf, n_rows >> (first - 1))
    keys = Histograms(table, first)
    placed = _to_order(keys, _at_splitters(keys, shards, tolerance), cap) if n_rows else []
    drop_scratch(spark, path)

    # Neighbours of one shard and first digit become one leaf again while one task can order them.
    by_digit: dict[int, list] = {}
    held: dict[int, int] = {}
    before: dict[int, int] = {}  # rows of a shard before the leaf
    for n, (x, shard) in enumerate(placed):
        d = x.k1 >> (HALF_BITS - first)
        mine = by_digit.setdefault(d, [])
        if mine and mine[-1][3] == shard and held[d] + x.rows <= cap:
            held[d] += x.rows
        else:
            mine.append((x.k1, x.k2, n, shard, before.get(shard, 0)))
            held[d] = x.rows
        before[shard] = before.get(shard, 0) + x.rows
    leaf_t = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "leaf", "shard", "before")])
    schema = T.StructType([T.StructField("d", T.LongType()), T.StructField("leaves", T.ArrayType(leaf_t))])
    # At most 2^FIRST_MOST rows and one entry for each leaf (those, and 2^STEP_BITS for each of the few refined ones).
    found = F.broadcast(spark.createDataFrame(sorted(by_digit.items()), schema))
    at_or_below = lambda x: (x["a"] < F.col("k1")) | ((x["a"] == F.col("k1")) & (x["b"] <= F.col("k2")))
    out = keyed.withColumn("d", F.shiftright("k1", HALF_BITS - first)).join(found, "d").withColumn("leaf", F.element_at(F.filter("leaves", at_or_below), -1))
    return out.drop("d", "leaves").select(
        *unboxed(rest),
        "size",
        F.lit("bytes").alias("law"),
        F.col("leaf.shard").cast("int").alias("shard"),
        (F.col("leaf.before") + F.expr("row_number() OVER (PARTITION BY leaf.leaf ORDER BY k1, k2)") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

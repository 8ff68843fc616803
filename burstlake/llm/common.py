"""Helpers shared by the training-data operators: words, scratch tables, stable hashes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split() takes for white space beside these.
ODD_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def md5_60(*parts: Column) -> Column:
    """A uniform integer in [0, 2^60) that any SQL engine with md5 can repeat."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def split_words(text: str) -> list[str]:
    """The words of a text in order, in Python; str.split() is the faster way where it cuts at the same places."""
    return WORD.findall(text) if any(c in text for c in ODD_SPACES) else text.split()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Where it is unset a temporary folder serves a session in one process; on a cluster that would be another
    folder on each machine, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="burstlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Scratch tables and folders that were made and not yet deleted.
_live: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/burstlake/{name}-{uuid.uuid4().hex}"
    _live.add(path)
    return path


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark's own policy for what runs inside: the shuffle files of a job go when the job has ended."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage is cut and nothing depends on one executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(context: SparkContext, path: str) -> None:
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    _live.discard(path)


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, through the file system that holds them."""
    for path in paths:
        _delete(spark.sparkContext, path)


def clear_scratch() -> None:
    """Delete all scratch tables of this process.  Results that are not written yet may read them: call it last.

    It runs by itself when the driver ends with its session still open.
    """
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        for path in sorted(_live):
            _delete(context, path)


atexit.register(clear_scratch)


def own_columns(df: DataFrame, *added: str) -> list[str]:
    """The columns of df but those that the named ones replace; names are compared as Spark compares them."""
    gone = {c.lower() for c in added}
    return [c for c in df.columns if c.lower() not in gone]


def boxed(df: DataFrame, columns: list[str], **keys: Column) -> DataFrame:
    """A struct ``row`` of these columns beside the given ones, so that no name of df can clash with them."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(None).cast("int").alias("none"))
    return df.select(row.alias("row"), *[v.alias(k) for k, v in keys.items()])


def unboxed(columns: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in columns]


def cut_points(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` values of the long column ``key`` that occur in df, rising, that cut it into near-equal runs.

    The list is bounded by ``parts``, whatever the number of rows.
    """
    shares = [i / parts for i in range(1, parts)] or [0.5]
    got = df.agg(F.percentile_approx(key, shares, 20 * max(parts, 500)).alias("p")).first()["p"]
    return sorted(set(got or []))


def _counted(value: Column, points: list[int], strict: bool) -> Column:
    if not points:
        return F.lit(0)
    step = max(1, int(len(points) ** 0.5))
    blocks = [points[i : i + step] for i in range(0, len(points), step)]
    longs = lambda xs: F.expr("array(" + ",".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1)" for x in xs) + ")")
    passed = lambda x: x < value if strict else x <= value
    heads = longs([b[0] for b in blocks])
    block = F.size(F.filter(heads, passed))
    within = F.size(F.filter(F.get(F.array(*map(longs, blocks)), block - 1), passed))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + within)


def count_at_or_below(value: Column, points: list[int]) -> Column:
    """How many of the sorted points are <= value, looked up in two levels so that it takes about sqrt(n) steps."""
    return _counted(value, points, False)


def count_below(value: Column, points: list[int]) -> Column:
    """How many of the sorted points are < value."""
    return _counted(value, points, True)


def parts_for(spark: SparkSession, rows: int, rows_per_part: int = 20_000, most: int = 20_000) -> int:
    """Partitions for a pass over whole texts: the session's number, more for many rows."""
    return min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_part)))

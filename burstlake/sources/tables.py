"""Readers: the parquet tables, and the views over them that stand for photos, files and metadata records.

There are no image files among the test tables, so a photo is an ``embeddings`` row with the ``events`` row of
the same id: its 64 floats are an 8 x 8 gray image, its label a folder, its event time the capture time.
The view definitions are plain SQL that Spark and other engines share (see plans.dialect).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The suffixes of camera raw files and of ordinary images.
RAW_SUFFIXES = (
    ".nef", ".nrw", ".arw", ".srf", ".sr2", ".cr2", ".cr3", ".crw", ".rw2", ".raw", ".dng", ".raf", ".orf", ".ori",
    ".pef", ".ptx", ".3fr", ".fff", ".iiq", ".srw", ".x3f", ".mrw", ".gpr", ".erf", ".mef", ".mos",
)
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".jpe", ".jxl", ".hif", ".heif", ".heic", ".png", ".webp", ".tiff", ".tif", ".bmp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task gets where a row costs much more to work on than to read: records that Python reads.
RECORDS = 10_000
PHOTOS = 1_000


def dealt(df: DataFrame, rows: int, key: str | None = None) -> DataFrame:
    """df dealt out, so that there is work for all cores and a task has some ``rows`` rows, however small the file is.

    With a ``key`` equal keys meet in one task.  The count is read from the file's own figures.
    """
    spark = df.sparkSession
    cores, n = spark.sparkContext.defaultParallelism, -(-df.count() // rows)
    if n <= cores:
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
    # Joins keep this partitioning only if it has as many parts as their own shuffles.
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key) if key else df.repartition(n)


PREFIX = "burstlake_"
#: The view of photos joined with their events.
PHOTO_ROWS = "photo_rows"


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    """Temporary views of the tables that a query names, under names of their own; only those are opened.

    Photos cost much more to work on than to read: a file with fewer splits than there are cores is dealt over all cores.
    """
    for name in names:
        if name == PHOTO_ROWS:
            df = photo_rows(spark, sf_dir)
        else:
            df = table(spark, sf_dir, name)
            if name == "embeddings" and df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
                df = df.repartition(spark.sparkContext.defaultParallelism)
        df.createOrReplaceTempView(PREFIX + name)


def photo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding, label, ts, value: photos with their events, dealt out by number and by key after that join.

    The tasks of the join follow the size of events and may be few; here a task has some ``PHOTOS`` photos, and groups within a
    photo need no other exchange.
    """
    m, e = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events").select("event_id", "ts", "value")
    parts = max(spark.sparkContext.defaultParallelism, -(-m.count() // PHOTOS))
    return m.join(e, e["event_id"] == m["vec_id"]).select("vec_id", "embedding", "label", "ts", "value").repartition(parts, "vec_id")


def prefixed(sql: str) -> str:
    """The query over the views of register()."""
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join((*TABLES, PHOTO_ROWS))})\b", rf"\1 {PREFIX}\2", sql)


def scan_photos(spark: SparkSession, folder: str, exclude: str | None = None, recursive: bool = False) -> DataFrame:
    """Supported photo files of a folder: path, dir, stem, ext, length, modified.  File contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).select("path", F.col("length"), F.col("modificationTime").alias("modified"))
    files = files.withColumns({
        "dir": F.regexp_extract("path", r"^(.*)/[^/]*$", 1),
        "stem": F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1),
        "ext": F.regexp_extract("path", r"(\.[^./]+)$", 1),
    })
    files = files.where(F.lower("ext").isin(*RAW_SUFFIXES, *IMAGE_SUFFIXES))
    if exclude:
        files = files.where(~F.array_contains(F.split("path", "/"), exclude))
    return files.orderBy("path")


def labelled_scan(spark: SparkSession, liked: str, disliked: str) -> DataFrame:
    """Photos of two folders with label 1 and 0."""
    one, zero = (scan_photos(spark, f).select("path", F.lit(n).alias("label")) for f, n in ((liked, 1), (disliked, 0)))
    return one.unionByName(zero)

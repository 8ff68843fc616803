"""A corpus pipeline: every stage works on all that the one before it kept.

Rows are documents; each stage but the last returns the columns of documents, so any two stages can be swapped
or run alone.  After substring dedup n_chars is counted anew.  A stage that has nothing to say about a row (no
text, no id) leaves it as it is, except that quality rules reject texts without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.llm import mixing, nearjoin, packing, quality, sentences

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.divergence_rules(docs.select(*COLUMNS), keep=COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies, once if its row is repeated."""
    return nearjoin.one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentence runs that an earlier document has; texts with nothing left go."""
    cut = sentences.span_dedup(docs.select(*COLUMNS)).where("n_removed = 0 OR rlike(text, '[^\\\\x20\\\\x09-\\\\x0D]')")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs.select(*COLUMNS))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the bins that they are in."""
    return packing.packed(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", keep_sound),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_bins),
]
#: Stages two to five walk signatures, bins and running offsets; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

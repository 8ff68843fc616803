"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, mixing, nearjoin, packing, pagetext, periods, quality, sentences, sharding, spelling, substrings, tokenfiles, toxicity
from .common import documents, utf8_bytes, words_of
from .oracles import ORACLES


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = documents(spark, sf_dir).select("doc_id", "text", crc.alias("text_crc32"))
    return sharding.histogram_shards(docs, 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score_toxicity(documents(spark, sf_dir), labels)


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.divergence_rules(documents(spark, sf_dir))
    return got.select("doc_id", *quality.FEATURES, "base_failed", "kept")


def op4_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.suffix_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return got.select(
        "doc_id", utf8_bytes(F.col("text")).alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op5_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_join(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "copy_of", "n_links", "near_of")


def op6_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.successive_fingerprints(documents(spark, sf_dir))


def op7_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir).select("doc_id", "text", "source"))


def op8_dictionary_token_files(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    return tokenfiles.token_files(documents(spark, sf_dir), tokenizer_file)


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.sampled_copies(documents(spark, sf_dir))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentences.span_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_sentences", "n_removed", "removed_chars", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _with_period(words: Column, a: Column, p: Column) -> Column:
    """The words, with those from place a on replaced by repeats of the first p of them."""
    rest = F.size(words) - a
    repeats = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    return F.array_join(F.concat(F.slice(words, 1, a), F.slice(repeats, 1, rest)), " ")


def op11_factor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words, g = words_of(F.col("text")), F.floor(F.col("h") / 10)
    n = F.size(words)
    a = (g % F.nullif(n, F.lit(0))).cast("int")
    edited = _with_period(words, a, (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    docs = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), edited).otherwise(F.col("text")).alias("text"))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    longest = F.reduce(
        "runs", F.struct(*[F.lit(0).cast("long").alias(c) for c in ("start", "length", "period")]), lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best)
    )
    some = F.size("runs") > 0
    got = periods.periodic_runs(docs).withColumn("longest", F.when(some, longest))
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("longest")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("longest")["length"] / F.col("longest")["period"]).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_edit_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), typo_every=31)


def op13_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
    "op3_divergence_rules": op3_divergence_rules,
    "op4_prefix_doubling": op4_prefix_doubling,
    "op5_lsh_forest_join": op5_lsh_forest_join,
    "op6_paragraph_sketches": op6_paragraph_sketches,
    "op7_conflict_best_fit": op7_conflict_best_fit,
    "op8_dictionary_token_files": op8_dictionary_token_files,
    "op9_systematic_mix": op9_systematic_mix,
    "op10_sentence_spans": op10_sentence_spans,
    "op11_factor_runs": op11_factor_runs,
    "op12_edit_neighbourhoods": op12_edit_neighbourhoods,
    "op13_tree_scoring": op13_tree_scoring,
}

__all__ = ["ORACLES", "QUERIES"]

"""Quality rules by distribution divergence: histograms of a text against those of its language.

Two histograms per document, one over six character classes and one over a language's common function
words plus "any other word", are compared with the pooled histograms of all documents of that language
that pass the base rules.  The measure is the Jensen-Shannon distance (square root of the divergence in
bits, 0 to 1).  Short documents have noisy histograms, so each comparison has a minimum length.

Words are compared with the common ones in lower case.  References can be given (a table as ``references()``
returns it, made from a corpus known to be good); by default they are pooled from the table under judgement, which
then sets its own norm.

Defined results: null text counts as empty (no words, fails the base rules); null or unlisted languages
share the reference of the rows with that very value, without a common-word comparison; a language without a
reference (no sound document) rejects nothing; columns that are kept may have any name, those that clash with the
added ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialise, own_columns, unboxed, words_of

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Lower-case letters and white space, which make up most of a text, are cut out once; the other classes are counted in the rest.
PLAIN = r"[\p{Ll}\x20\x09-\x0D]++"
#: What to cut out to leave one class.  White space and all remaining characters are the last two classes of the histogram.
CLASSES = {"upper": r"[^\p{Lu}]++", "digit": r"[^0-9]++", "symbol": r"[^#*$%&|<>]++", "punct": r"[^.,;:!?'\"()\-]++"}
#: The most common function words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
}
WIDTH = 8
CHAR_GUARD, WORD_GUARD = 200, 60
#: Eight words that hold 13 to 14 % of a language's words put a text with none of them 0.266 to 0.275 from its reference.
CHAR_LIMIT, WORD_LIMIT = 0.32, 0.25
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Most languages whose references are broadcast; more are joined as they are.
BROADCAST_ROWS = 10_000


def _paired(hashes: str, offset: int) -> Column:
    """One hash for each place from the values there and ``offset`` further on: names runs twice as long."""
    later = F.slice(hashes, offset + 1, F.greatest(F.lit(0), F.size(hashes) - offset))
    full = F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))
    return F.slice(full, 1, F.greatest(F.lit(0), F.size(hashes) - offset))


def features(df: DataFrame) -> DataFrame:
    """A table (row, lang, text) without its text but with the five counts of the base rules, base_failed, and the two histograms.

    Arrays are built in separate projections; each is read more than once in the next, which keeps the
    optimiser from folding it into the lambdas that read it.  Runs of 2, 4 and 8 words are named by doubling;
    only a text that repeats a run of 4 goes on to 8, and only one that repeats a run of 8 sorts its windows.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = df.select(
        "row", "lang", words_of(F.col("text")).alias("_w"), lines.alias("_l"), F.length(t).cast("long").alias("_n"),
        F.regexp_replace(t, PLAIN, "").alias("_r"),
    )
    counts = [F.length(F.regexp_replace("_r", rest, "")).cast("long").alias(f"_{name}") for name, rest in CLASSES.items()]
    common = F.coalesce(*[F.when(F.col("lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()], F.array().cast("array<string>"))
    step = step.select(
        *[c for c in step.columns if c not in ("_l", "_r")],
        *counts,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _paired("_w", 1).alias("_h2"),
        common.alias("_c"),
        F.when(F.size(common) > 0, F.transform("_w", F.lower)).alias("_lw"),
    )
    without = [F.size(F.array_remove("_lw", F.coalesce(F.get("_c", F.lit(i)), F.lit("")))) for i in range(WIDTH)]
    step = step.select(
        *[c for c in step.columns if c not in ("_w", "_lw", "_h2")],
        F.when(F.size("_c") > 0, F.transform(F.array(*without), lambda n: F.col("n_words") - n)).alias("_cc"),
        _paired("_h2", 2).alias("_h4"),
        F.size("_h2").alias("_n2"),
    )
    none = F.array().cast("array<bigint>")
    step = step.select(
        *[c for c in step.columns if c not in ("_h4", "_n2")],
        F.when(F.size("_h4") > F.size(F.array_distinct("_h4")), _paired("_h4", 4)).otherwise(none).alias("_h8"),
    )
    step = step.select(
        "*",
        F.when(
            F.size("_h8") > F.size(F.array_distinct("_h8")),
            F.array_sort(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"),
    )
    twin = lambda x, j: F.when((F.get("_s", j - 1)["h"] == x["h"]) | (F.get("_s", j + 1)["h"] == x["h"]), x["i"])
    step = step.select(*[c for c in step.columns if c != "_h8"], F.array_sort(F.array_compact(F.transform("_s", twin))).alias("_p"))
    gaps = F.transform("_p", lambda i, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), i - F.get("_p", j - 1))))
    chars = [F.col(f"_{c}") for c in CLASSES]
    space = F.col("_n") - F.col("word_chars")
    step = step.select(
        "*",
        F.col("_symbol").alias("n_symbols"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.array(*chars, space, F.col("_n") - space - sum(chars[1:], chars[0])).alias("char_counts"),
        F.aggregate("_cc", F.lit(0).cast("long"), lambda a, x: a + x).alias("_nf"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return step.select(
        "row", "lang", *FEATURES, failed.alias("base_failed"), "char_counts", F.concat("_cc", F.array(F.col("n_words") - F.col("_nf"))).alias("word_counts"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.try_divide(x.cast("double"), total))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance in [0, 1] of two arrays of shares; null if either has no mass."""
    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    each = F.zip_with(p, q, lambda x, y: term(x, y) + term(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2))


def references(feats: DataFrame) -> DataFrame:
    """One row per language: pooled shares of both histograms over the documents that pass the base rules, from what features() returns."""
    sound = feats.where(~F.col("base_failed"))
    width = WIDTH + 1
    sums = [F.sum(F.get("char_counts", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 2)]
    sums += [F.sum(F.get("word_counts", F.lit(i))).alias(f"w{i}") for i in range(width)]
    got = sound.groupBy("lang").agg(*sums)
    char = F.array(*[F.col(f"c{i}") for i in range(len(CLASSES) + 2)])
    word = F.array(*[F.col(f"w{i}") for i in range(width)])
    return got.select(F.col("lang").alias("_lang"), _shares(char).alias("_char"), _shares(word).alias("_word"))


def divergence_rules(
    df: DataFrame, text: str = "text", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, keep: tuple[str, ...] = ("doc_id",),
    lang: str = "lang", against: DataFrame | None = None,
) -> DataFrame:
    """``keep`` columns of df with counts, base_failed, char_distance, word_distance and kept; ``against``: given references."""
    added = (*FEATURES, "base_failed", "char_distance", "word_distance", "kept")
    own = [c for c in own_columns(df, *added) if c.lower() in {k.lower() for k in keep}]
    feats, _ = materialise(features(boxed(df, own, lang=F.col(lang), text=F.col(text))), "quality")
    # One row per language: written, counted, and broadcast only if few.
    known, _ = materialise(references(feats) if against is None else against.select("_lang", "_char", "_word"), "references")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    joined = feats.join(known, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    n_chars = F.aggregate("char_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    char = F.when(n_chars >= CHAR_GUARD, js_distance(_shares(F.col("char_counts")), F.col("_char")))
    word = F.when(F.col("n_words") >= WORD_GUARD, js_distance(_shares(F.col("word_counts")), F.col("_word")))
    judged = joined.select("row", *FEATURES, "base_failed", char.alias("char_distance"), word.alias("word_distance"))
    far = F.coalesce(F.col("char_distance") > char_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return judged.select(*unboxed(own), *added[:-1], (~F.col("base_failed") & ~far).alias("kept"))

"""Best catalog entry for each name, by an exact similarity join on rare tokens and rare letter pieces.

The similarity of two names is 1 if they are equal without signs and case, 0.86 if one contains the other, else the number of
tokens they share over the larger of their numbers of tokens.  Nothing is compared that cannot score:

* Shared tokens.  Tokens have one order everywhere, the rarest first.  Two sets of similarity t or more share one among the
  first ``size - ceil(t * size) + 1`` tokens of either, so only those prefixes are joined, and only sets whose sizes fit.  A token that
  nearly all names have stands last and is joined only for sets of so few tokens that it has to be.
* Containment.  A name that contains another one has all its letter pieces, so the rarest piece of the one is looked up among all of the other.

Names and entries are made distinct first; the best entry is kept by an aggregate that combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MINIMUM, NESTED, MODEL_SHARE, MAKE_SHARE, UNKNOWN_MAKE = 0.34, 0.86, 0.78, 0.22, 0.5


def flat(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def pieces(text: Column, size: int) -> Column:
    """The distinct pieces of so many letters."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    fa, fb, ta, tb = flat(a), flat(b), tokens(a), tokens(b)
    shared = F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(ta), F.size(tb))
    return F.when((fa == "") | (fb == ""), 0.0).when(fa == fb, 1.0).when(F.contains(fb, fa) | F.contains(fa, fb), NESTED).otherwise(shared)


def _ordered(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """(text, n, at, token): the tokens of each text, the rarest first."""
    place = F.row_number().over(W.partitionBy("text").orderBy("freq", "token"))  # a text's few tokens
    return sets.join(rarity, "token").select("text", "n", "token", place.alias("at"))


def token_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of texts whose token sets have a similarity of ``threshold`` or more, and some that have less; left and right have a column text."""
    opened = [d.select("text", tokens(F.col("text")).alias("t")).select("text", F.size("t").alias("n"), F.explode("t").alias("token")) for d in (left, right)]
    rarity = opened[0].unionAll(opened[1]).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    kept = F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    a, b = (_ordered(o, rarity).where(kept).select(F.col("text").alias(x), F.col("n").alias(f"n{x}"), "token") for o, x in zip(opened, "ab", strict=True))
    fits = (F.col("nb") >= threshold * F.col("na") - 1e-9) & (F.col("na") >= threshold * F.col("nb") - 1e-9)
    return a.join(b, "token").where(fits).select("a", "b").distinct()


def nested_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of texts of which one may contain the other."""

    def opened(d: DataFrame) -> DataFrame:
        f = flat(F.col("text"))
        every = F.concat(*[pieces(F.col("f"), k) for k in (1, 2, 3)])
        return d.select("text", f.alias("f")).where("f <> ''").select("text", F.length("f").alias("n"), F.explode(every).alias("piece"))

    a, b = opened(left), opened(right)

    def one_way(short: DataFrame, long: DataFrame, names: tuple[str, str]) -> DataFrame:
        rarity = long.groupBy("piece").agg(F.count(F.lit(1)).alias("freq"))
        own = short.where(F.length("piece") == F.least(F.col("n"), F.lit(3))).join(rarity, "piece", "left")
        # A piece that the other side does not have at all is the rarest: then there is nothing to find.
        rarest = own.groupBy("text", "n").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), F.col("piece"))).alias("r")).where("r.freq > 0")
        met = rarest.select(F.col("text").alias(names[0]), F.col("n").alias("m"), F.col("r.piece").alias("piece")).join(long.select(F.col("text").alias(names[1]), "n", "piece"), "piece")
        return met.where("n >= m").select("a", "b")

    return one_way(a, b, ("a", "b")).unionAll(one_way(b, a, ("b", "a"))).distinct()


def best_matches(names: DataFrame, entries: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """(name, make, model, maker, score) for each distinct (name, make): its best entry (model, maker) of score ``minimum`` or more, nulls if none.

    Of equal scores the smallest model, then maker, wins.  A make that is missing or empty counts half.
    """
    names = names.select("name", F.coalesce("make", F.lit("")).alias("make")).distinct()
    entries = entries.select("model", "maker").distinct()
    left, right = names.select(F.col("name").alias("text")).distinct(), entries.select(F.col("model").alias("text")).distinct()
    # The maker adds at most its share, so a model's own similarity has to reach the rest.
    least = max(1e-6, (minimum - MAKE_SHARE) / MODEL_SHARE)
    pairs = token_pairs(left, right, least).unionAll(nested_pairs(left, right)).distinct()
    scored = pairs.select("a", "b", similarity(F.col("a"), F.col("b")).alias("m")).where(F.col("m") >= least - 1e-9)
    both = names.join(scored, F.col("name") == F.col("a")).join(entries, F.col("model") == F.col("b"))
    makers = both.select(F.col("make").alias("k"), F.col("maker").alias("r")).distinct()
    makers = makers.select("k", "r", F.when(F.col("k") == "", UNKNOWN_MAKE).otherwise(similarity(F.col("k"), F.col("r"))).alias("s"))
    full = both.join(makers, (F.col("make") == F.col("k")) & F.col("maker").eqNullSafe(F.col("r")))
    score = F.col("m") * MODEL_SHARE + F.coalesce("s", F.lit(0.0)) * MAKE_SHARE
    best = full.select("name", "make", score.alias("score"), "model", "maker").where(F.col("score") >= minimum)
    best = best.groupBy(F.col("name").alias("n"), F.col("make").alias("mk")).agg(F.min(F.struct((-F.col("score")).alias("s"), "model", "maker")).alias("x"))
    found = names.join(best, (F.col("name") == F.col("n")) & (F.col("make") == F.col("mk")), "left")
    return found.select("name", "make", F.col("x.model").alias("model"), F.col("x.maker").alias("maker"), (-F.col("x.s")).alias("score"))

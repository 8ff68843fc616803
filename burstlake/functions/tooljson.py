"""Lens data from the JSON that a metadata tool prints: a list with one object of tags, of any types, or anything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tags that may name a lens, the first that says something wins.
MODELS, SPECIFICATIONS, FOCAL_35 = ("LensModel", "LensID", "LensSpec", "Lens"), ("LensSpecification", "LensInfo"), ("FocalLengthIn35mmFilm", "FocalLengthIn35mmFormat")
NUMBER = r"(\d+(?:\.\d+)?)"
NAMED = rf"(?i){NUMBER}\s*(?:-\s*{NUMBER})?\s*mm\s+f\s*/\s*{NUMBER}(?:\s*-\s*{NUMBER})?"


def _positive(x: Column) -> Column:
    return F.when((x > 0) & (x < float("inf")), x)


def _parsed(text: Column) -> Column:
    """[shortest, longest focal length, aperture at both] of a name that has focal length and aperture."""
    part = lambda k: F.nullif(F.regexp_extract(text, NAMED, k), F.lit("")).try_cast("double")
    lo, ap = part(1), part(3)
    hi, most = F.coalesce(part(2), lo), F.coalesce(part(4), ap)
    return F.when((lo > 0) & (hi >= lo) & (ap > 0) & (most > 0), F.array(lo, hi, ap, most))


TAGS = (*MODELS, "LensMake", "Make", "LensSerialNumber", *SPECIFICATIONS, *FOCAL_35)


def with_lens(df: DataFrame, text: str, to: str = "lens") -> DataFrame:
    """df with a struct model, make, serial, focal_35mm, specification; all null for text that is no such JSON.

    The text is parsed once and each tag is read once: the steps are levels of the plan that each read the one before.
    """
    first = lambda name: F.try_variant_get("_json", "$[0]" + name, "variant")
    parsed = df.withColumn("_json", F.try_parse_json(F.col(f"`{text}`")))
    opened = parsed.select(*df.columns, F.struct(first("").alias("_all"), *[first(f".{t}").alias(t) for t in TAGS]).alias("_tags"))
    kinds = F.struct(*[F.schema_of_variant(F.col("_tags")[t]).alias(t) for t in ("_all", *TAGS)])
    typed = opened.withColumn("_kinds", kinds)

    def plain(t: str) -> Column:
        """A tag as text if it is text that is not blank or a number."""
        value = F.try_variant_get(F.col("_tags")[t], "$", "string")
        return F.when(~F.coalesce(F.col("_kinds")[t].rlike("^(OBJECT|ARRAY)"), F.lit(False)) & (F.trim(value) != ""), value)

    def listed(t: str) -> Column:
        value = F.try_variant_get(F.col("_tags")[t], "$", "array<string>")
        return F.when(F.size(value) > 0, value)

    texts = F.struct(*[plain(t).alias(t) for t in TAGS])
    read = typed.select(*df.columns, F.startswith(F.col("_kinds._all"), F.lit("OBJECT")).alias("_sound"), texts.alias("_texts"), F.array(*map(listed, SPECIFICATIONS)).alias("_lists"))
    said = lambda t: F.col("_texts")[t]
    which = F.coalesce(*[F.when(F.col("_lists")[k].isNotNull() | said(t).isNotNull(), F.lit(k)) for k, t in enumerate(SPECIFICATIONS)])
    named = read.withColumn("_model", F.coalesce(*map(said, MODELS))).withColumn("_which", which)
    worded = F.when(F.col("_which").isNull(), F.coalesce(said("Lens"), F.col("_model"))).otherwise(F.element_at(F.array(*map(said, SPECIFICATIONS)), F.col("_which") + 1))
    numbers = F.transform(F.get("_lists", F.col("_which")), lambda x: x.try_cast("double"))
    worked = named.withColumn("_worded", worded).withColumn("_numbers", numbers)
    whole = F.when((F.size("_numbers") == 4) & F.forall("_numbers", lambda x: x.isNotNull()), F.col("_numbers"))
    make = F.coalesce(said("LensMake"), F.when(F.contains(F.lower(F.coalesce(said("Make"), F.lit(""))), F.lit("nikon")), F.lit("Nikon")))
    out = {
        "model": F.col("_model"), "make": make, "serial": said("LensSerialNumber"), "focal_35mm": F.coalesce(*[_positive(said(t).try_cast("double")) for t in FOCAL_35]),
        "specification": F.coalesce(whole, _parsed(F.col("_worded"))),
    }
    return worked.select(*df.columns, F.struct(*[F.when(F.col("_sound"), c).alias(n) for n, c in out.items()]).alias(to))

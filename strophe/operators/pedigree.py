"""Look-ups over subjects, colour bands, parents, SNPs and expression tables.

``animals (uuid, sex, hatch_date, notes, band_color_id, band_color2_id, band_number, band_number2)``,
``colors (id, abbrv)``, ``parents (parent_id, child_id)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.scalars import literal_map

# fixed values: band letters of the subject register, and spellings of yellow
REGISTER_LETTERS = {"b": "bk", "w": "wh", "g": "gr", "y": "ye", "r": "rd", "o": "or"}
YELLOW = ("yw", "yl")
UNKNOWN = "?"
UNLABELLED = "unlabelled in db"


def _colored(animals: DataFrame, colors: DataFrame, how: str = "left") -> DataFrame:
    first = colors.select(F.col("id").alias("band_color_id"), F.col("abbrv").alias("color1"))
    second = colors.select(F.col("id").alias("band_color2_id"), F.col("abbrv").alias("color2"))
    return animals.join(first, "band_color_id", how).join(second, "band_color2_id", how)


def subjects_with_bands(animals: DataFrame, colors: DataFrame) -> DataFrame:
    """Subjects with both bands coloured."""
    return _colored(animals, colors, "inner").select(
        "uuid", "color1", "band_number", "color2", "band_number2"
    )


def band_parts(band: Column) -> dict[str, Column]:
    """Colours and numbers of a band text such as ``g34or18``."""
    text = band
    for spelling in YELLOW:
        text = F.replace(text, F.lit(spelling), F.lit("ye"))
    tokens = F.regexp_extract_all(text, F.lit(r"([\d.]+|[^\d.]+)"), F.lit(1))
    codes = literal_map(REGISTER_LETTERS)

    def colour(i: int) -> Column:
        raw = F.get(tokens, F.lit(i))
        return F.coalesce(codes[raw], raw)

    return {
        "color1": colour(0),
        "number1": F.get(tokens, F.lit(1)).cast("int"),
        "color2": colour(2),
        "number2": F.get(tokens, F.lit(3)).cast("int"),
    }


def subject_uuid(bands: DataFrame, animals: DataFrame, colors: DataFrame) -> DataFrame:
    """Subject of every band text, ``nouuid`` if unknown, and how many matched.

    A missing second band matches a missing second band.
    """
    asked = bands.withColumns(band_parts(F.col("band")))
    known = _colored(animals, colors).select(
        "uuid",
        F.col("color1").alias("_c1"), F.col("band_number").alias("_n1"),
        F.col("color2").alias("_c2"),
        F.when(F.col("color2").isNotNull(), F.col("band_number2")).alias("_n2"),
    )
    match = (
        (F.col("color1") == F.col("_c1")) & (F.col("number1") == F.col("_n1"))
        & F.col("color2").eqNullSafe(F.col("_c2")) & F.col("number2").eqNullSafe(F.col("_n2"))
    )
    return asked.join(known, match, "left").groupBy("band").agg(
        F.coalesce(F.min("uuid"), F.lit("nouuid")).alias("uuid"),
        F.count("uuid").alias("matches"),
    )


def band_of(animals: DataFrame, colors: DataFrame) -> DataFrame:
    """Band text of every subject."""
    text = F.concat(
        F.coalesce("color1", F.lit("")), F.coalesce(F.col("band_number").cast("string"), F.lit("")),
        F.coalesce("color2", F.lit("")), F.coalesce(F.col("band_number2").cast("string"), F.lit("")),
    )
    return _colored(animals, colors).select("uuid", text.alias("band"))


def parents(children: DataFrame, links: DataFrame, animals: DataFrame,
            names: DataFrame | None = None) -> DataFrame:
    """Father (male parent), mother (female parent) and ``father_mother`` of every child.

    The same function serves nest and genetic links. A missing parent is ``?``; a child without
    uuid is unlabelled. ``names (uuid, band)`` puts band texts for the parents.
    """
    sexed = links.join(
        animals.select(F.col("uuid").alias("parent_id"), "sex"), "parent_id"
    )
    if names is not None:
        sexed = sexed.join(
            names.select(F.col("uuid").alias("parent_id"), "band"), "parent_id", "left"
        ).withColumn("shown", F.coalesce("band", "parent_id"))
    else:
        sexed = sexed.withColumn("shown", F.col("parent_id"))

    def of(sex: str, column: str) -> Column:
        return F.max(F.when(F.col("sex") == sex, F.col(column)))

    both = sexed.groupBy(F.col("child_id").alias("uuid")).agg(
        of("M", "parent_id").alias("father"), of("F", "parent_id").alias("mother"),
        of("M", "shown").alias("_f"), of("F", "shown").alias("_m"),
    )
    pair = F.concat_ws("_", F.coalesce("_f", F.lit(UNKNOWN)), F.coalesce("_m", F.lit(UNKNOWN)))
    known = F.col("uuid").isNotNull() & (F.col("uuid") != "nouuid")
    return children.join(both, "uuid", "left").withColumn(
        "father_mother", F.when(known, pair).otherwise(UNLABELLED)
    ).drop("_f", "_m")


def offspring(links: DataFrame) -> DataFrame:
    return links.select(F.col("parent_id").alias("uuid"), "child_id")


def common_offspring(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Children that both members of every pair ``(a, b)`` have."""
    left = links.select(F.col("parent_id").alias("a"), "child_id")
    right = links.select(F.col("parent_id").alias("b"), "child_id")
    return pairs.join(left, "a").join(right, ["b", "child_id"]).select("a", "b", "child_id")


def is_parent(animals: DataFrame, links: DataFrame) -> DataFrame:
    """Subjects that have offspring."""
    return animals.join(
        links.select(F.col("parent_id").alias("uuid")).distinct(), "uuid", "left_semi"
    )


def attributes(animals: DataFrame, wanted: Sequence[str] = ("sex", "hatch_date", "notes")
               ) -> DataFrame:
    return animals.select("uuid", *wanted)


def append_note(animals: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes with new text added: old, ``_from_<source>_``, new."""
    new = notes.select("uuid", F.col("note").alias("_new"), F.col("source").alias("_source"))
    text = F.concat(
        F.coalesce("notes", F.lit("")), F.lit("_from_"), F.col("_source"), F.lit("_"), F.col("_new")
    )
    return animals.join(new, "uuid", "left").withColumn(
        "notes", F.when(F.col("_new").isNotNull(), text).otherwise(F.col("notes"))
    ).drop("_new", "_source")


def snps(genetics: DataFrame) -> DataFrame:
    """All loci of every subject, one row each, numbered from 0."""
    return genetics.select("uuid", F.posexplode(F.split("snp", ",")).alias("locus", "allele"))


def snp_at(genetics: DataFrame, locus: int) -> DataFrame:
    """One locus of every subject; null beyond the last."""
    return genetics.select("uuid", F.get(F.split("snp", ","), F.lit(locus)).alias("allele"))


def expression(wide: DataFrame, gene: str | None = None, subject: str | None = None,
               gene_column: str = "gene") -> DataFrame:
    """(gene, subject, value) of a gene x subject table; filters reach the scan."""
    rows = wide if gene is None else wide.where(F.col(gene_column) == gene)
    columns = [c for c in wide.columns if c != gene_column and subject in (None, c)]
    return rows.unpivot([gene_column], columns, "subject", "value")

"""Parsing of recording names and subject names with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.scalars import literal_map

# fixed values: colour abbreviations and their two-letter codes
COLOUR_CODES = {"g": "gr", "o": "or", "r": "rd", "w": "wh", "wt": "wh", "y": "ye"}
BAND_LETTERS = {"b": "bk", "w": "wh", "g": "gr", "y": "ye", "r": "rd", "o": "or"}
BAND_NAMES = {
    "black": "bk", "white": "wh", "green": "gr", "yellow": "ye", "red": "rd", "pink": "pk",
    "orange": "or", "purple": "pu", "brown": "br", "blue": "bl", "noband": "nb",
}
# fixed values: the formats of recording names
STAMPED = r"^([a-zA-Z]+\d+[a-zA-Z]*\d*)_(\d{6})_(\d{6})\.wav$"
NUMBERED = r"^([a-zA-Z]+\d+[a-zA-Z]*\d*)\.(\d{8})-(\d+)\.wav$"
DATED = r"^([a-zA-Z]+\d+[a-zA-Z]*\d*)\.(\d{8})\.wav$"
# fixed values: pattern, then the groups that hold date and time
TIMESTAMPS = (
    (r"(\w+)_(\d{8})_(\d{6})", 2, 3),
    (r"(\w+)_(\d{6})_(\d{6})", 2, 3),
    (r"(\d{8})_(\d{6})_(\w+)", 1, 2),
    (r"(\d{6})_(\d{6})_(\w+)", 1, 2),
    (r"(\w+)_(\d{8})-(\d{6})", 2, 3),
    (r"(\w+)_(\d{6})-(\d{6})", 2, 3),
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def base_name(path: Column) -> Column:
    """File name up to its first dot; a name with only a leading dot is kept."""
    name = file_name(path)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.substring_index(name, ".", 1))


def normalize_subject(name: Column) -> Column:
    """Colour codes written out if the whole name is made of (letters)(digits) tokens."""
    lower = F.lower(name)
    colours = F.regexp_extract_all(lower, F.lit(r"([a-z]+)(\d+)"), F.lit(1))
    numbers = F.regexp_extract_all(lower, F.lit(r"([a-z]+)(\d+)"), F.lit(2))
    codes = literal_map(COLOUR_CODES)
    whole = F.array_join(
        F.zip_with(colours, numbers, lambda c, n: F.concat(F.coalesce(codes[c], c), n)), ""
    )
    return F.when(lower.rlike(r"^([a-z]+\d+)+$"), whole).otherwise(lower)


def _band_colour(text: Column) -> Column:
    """Two-letter code of a colour word, abbreviation or beginning; the text if none fits."""
    known = sorted({*BAND_LETTERS.values(), *BAND_NAMES.values()})
    out = text
    for name, code in reversed(BAND_NAMES.items()):
        out = F.when(F.lit(name).startswith(text), code).otherwise(out)
    exact = literal_map({**BAND_NAMES, **BAND_LETTERS, **{c: c for c in known}})[text]
    return F.coalesce(exact, out)


def standardize_band(band: Column) -> Column:
    """Band text as colour-number pairs; null unless it has 1-2 colours and 1-2 numbers."""
    lower = F.lower(F.trim(band))
    colours = F.transform(
        F.regexp_extract_all(lower, F.lit(r"([a-z]+)"), F.lit(1)), _band_colour
    )
    numbers = F.regexp_extract_all(lower, F.lit(r"(\d+)"), F.lit(1))
    n_colours, n_numbers = F.size(colours), F.size(numbers)
    valid = n_colours.between(1, 2) & n_numbers.between(1, 2)
    text = F.concat(
        F.get(colours, F.lit(0)),
        F.get(numbers, F.lit(0)),
        F.coalesce(F.get(colours, F.lit(1)), F.lit("")),
        F.coalesce(F.get(numbers, F.lit(1)), F.lit("")),
    )
    return F.when(valid, text)


def parse_recording_name(df: DataFrame, column: str) -> DataFrame:
    """Subject, day and time out of a recording's file name, and whether that worked."""
    name = file_name(F.col(column))
    clean = F.replace(name, F.lit(".not.mat"), F.lit(""))
    parts = F.split(name, "_")
    size = F.size(parts)
    stem = F.substring_index(F.element_at(parts, -1), ".", 1)

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(clean, pattern, i)

    stamped, numbered, dated = (clean.rlike(p) for p in (STAMPED, NUMBERED, DATED))
    split = size.isin(2, 3, 4)
    subject = (
        F.when(stamped, group(STAMPED, 1))
        .when(numbered, group(NUMBERED, 1))
        .when(dated, group(DATED, 1))
        .when(split, F.element_at(parts, 1))
    )
    day = (
        F.when(stamped, F.concat(F.lit("20"), group(STAMPED, 2)))
        .when(numbered, group(NUMBERED, 2))
        .when(dated, group(DATED, 2))
        .when(size == 2, F.substring(stem, 1, 8))
        .when(split, F.get(parts, size - 2))
    )
    count = F.regexp_replace(group(NUMBERED, 3), "^0+(?=.)", "")
    padded = F.when(F.length(count) < 6, F.lpad(count, 6, "0")).otherwise(count)
    time = (
        F.when(stamped, group(STAMPED, 3))
        .when(numbered, padded)
        .when(dated, "000000")
        .when(size == 2, F.substring(stem, 9, 1000))
        .when(split, stem)
    )
    return df.withColumns(
        {
            "subject": normalize_subject(subject),
            "day": day,
            "time": time,
            "success": subject.isNotNull(),
        }
    )


def parse_timestamp(df: DataFrame, column: str, date_format: str = "ddMMyy") -> DataFrame:
    """Recording time from six name patterns, tried in order.

    Six-digit dates are read by ``date_format`` (``ddMMyy`` or ``yyMMdd``), eight-digit ones as
    yyyyMMdd. Hours, minutes and seconds beyond their range wrap around.
    """
    if date_format not in ("ddMMyy", "yyMMdd"):
        raise ValueError("date_format is 'ddMMyy' or 'yyMMdd'")
    name = F.col(column)
    found = [
        F.struct(
            F.regexp_extract(name, pattern, date_group).alias("date"),
            F.regexp_extract(name, pattern, time_group).alias("clock"),
        )
        for pattern, date_group, time_group in TIMESTAMPS
    ]

    def day_of(date: Column) -> Column:
        first, middle, last = (F.substring(date, i, 2) for i in (1, 3, 5))
        year = last if date_format == "ddMMyy" else first
        century = F.when(year < "69", "20").otherwise("19")
        ends = [F.concat(century, last), middle, first]
        if date_format == "yyMMdd":
            ends = [F.concat(century, first), middle, last]
        long = F.concat_ws(
            "-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2)
        )
        text = F.when(F.length(date) == 8, long).otherwise(F.concat_ws("-", *ends))
        return F.try_to_date(text, "yyyy-MM-dd")

    # each pattern is matched once; the dates are only worked out for the matches
    matched = F.filter(F.array(*found), lambda m: m["date"] != "")
    dated = F.transform(
        matched,
        lambda m: F.struct(
            day_of(m["date"]).alias("day"), (F.length(m["date"]) == 8).alias("long"), m["clock"]
            .alias("clock"),
        ),
    )
    known = F.filter(
        dated,
        lambda m: m["day"].isNotNull()
        & (~m["long"] | F.year(m["day"]).between(1900, F.year(F.current_date()))),
    )
    df = df.withColumn("_m", F.get(known, F.lit(0)))
    hour, minute, second = (F.substring("_m.clock", i, 2).cast("int") for i in (1, 3, 5))
    day = F.col("_m.day")
    moment = F.make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), F.pmod(hour, F.lit(24)),
        F.pmod(minute, F.lit(60)), F.pmod(second, F.lit(60)).cast("decimal(8,6)"),
    )
    return df.withColumn("recorded_at", F.when(day.isNotNull(), moment)).drop("_m")

"""Labels, gender codes and clip paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
CLIP_SUFFIX = ".wav"

# Spellings accepted for each gender.
GENDER_CODES = {"male": ("m", "male"), "female": ("f", "female")}


def strip(raw: Column) -> Column:
    """Cut white space of any kind, not only blanks as ``trim`` does."""
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def clean_id(raw: Column) -> Column:
    return strip(raw)


def clean_nationality(raw: Column) -> Column:
    return F.coalesce(strip(raw), F.lit(UNKNOWN))


def clean_gender(raw: Column) -> Column:
    code = F.lower(strip(raw))
    column = F.when(F.lit(False), F.lit(UNKNOWN))
    for gender, spellings in GENDER_CODES.items():
        column = column.when(code.isin(*spellings), gender)
    return column.otherwise(UNKNOWN)


def known(value: Column) -> Column:
    return value.isNotNull() & (value != UNKNOWN)


def pair_label(gender: Column, nationality: Column) -> Column:
    return F.concat_ws(":", gender, nationality)


def nationality_of(label: Column) -> Column:
    """The part after the first colon; null when there is none."""
    return F.get(F.split(label, ":", 2), F.lit(1))


def gender_of(label: Column) -> Column:
    return F.substring_index(label, ":", 1)


def speaker_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -3)


def video_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def is_clip(path: Column) -> Column:
    return path.endswith(CLIP_SUFFIX)


def fixed_decimals(value: Column, places: int = 2) -> Column:
    """A double as text with one or two decimals, rounded by its exact binary value, ties to even.

    A double is a whole number of at most 54 bits over a power of two.  Times a hundred it still fits
    a long, so quotient and remainder are exact, which no product of doubles is.
    """
    if places not in (1, 2):
        raise ValueError("1 or 2 decimals")
    size, scale = F.abs(value), 10**places
    # A power of two that makes a whole number of any value it does not leave below half a unit.
    bits = F.least(F.greatest(F.lit(53) - F.floor(F.log2(size)), F.lit(1)), F.lit(62)).cast("int")
    whole = (size * F.pow(F.lit(2.0), bits)).cast("long") * F.lit(scale)
    one = F.expr("1L")
    unit = F.call_function("shiftleft", one, bits)
    units, rest = F.call_function("shiftright", whole, bits), whole.bitwiseAND(unit - 1)
    half = F.call_function("shiftright", unit, F.lit(1))
    up = (rest > half) | ((rest == half) & (units % 2 == 1))
    units = F.when(size < 0.4 / scale, F.lit(0).cast("long")).otherwise(units + F.when(up, 1).otherwise(0))
    digits = F.concat(F.floor(units / scale).cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), places, "0"))
    plain = F.concat(F.when(value < 0, "-").otherwise(""), digits)
    return F.when(size < float(1 << 40), plain).when(value.isNotNull(), F.format_string(f"%.{places}f", value))

"""Numbers in free text: markers, fill values, spellings.

Every function maps Columns to Columns and stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mark a missing value, compared in lower case without outer blanks.
MISSING_MARKERS = ("", "-", "--", "---", "...", "?", "??", "n/a", "na", "n.a.", "nan", "null", "none", "nil", "unknown", "inf", "-inf", "+inf")

#: Fill numbers that no measured value has.
FILL_NUMBERS = (-9999.0, -999.99, -99999.0, -9999.99, -999.9, -999.0)
#: From here on a number is a fill: no quantity of a star reaches it in any unit (ages in seconds end near 1e18, luminosities in erg/s near 1e41).
FILL_MAGNITUDE = 1e60

NUMBER = r"[+\-−]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?|[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+\-−]?[0-9]+)?(?:\s*[x×]\s*10\^?[+\-−]?[0-9]+)?"
SIGN = r"(?:[<>~≈≤≥=]+|(?:ca|about|approx|circa)\b\.?)"
ERROR = r"(?:\s*(?:±|\+/-|\+-)\s*[0-9][0-9.,]*(?:[eE][+\-−]?[0-9]+)?(?:\s*[x×]\s*10\^?[+\-−]?[0-9]+)?)?"
STATED = rf"(?si)^\s*(?:{SIGN}\s*)*({NUMBER})((?:{ERROR}))(.*)$"


def is_missing_text(c: Column) -> Column:
    """True for null, blank text and the usual markers."""
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING_MARKERS)


def real_value(c: Column) -> Column:
    """A double, null where it is NaN, infinite or a fill number."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < FILL_MAGNITUDE) & ~d.isin(*FILL_NUMBERS), d)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    A later filter on them would otherwise be pushed below the projection and
    evaluate costly expressions again; a generator of one row is a barrier that
    stays inside code generation.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def number_value(text: Column) -> Column:
    """The double that a number text of ``STATED`` means, null where it means none."""
    text = F.regexp_replace(F.translate(text, "−,", "-"), r"\s*[x×]\s*10\^?", "e")
    return text.try_cast("double")


def with_stated(df: DataFrame, text: str, number: str = "number", rest: str = "rest") -> DataFrame:
    """Adds the number a text begins with (double) and what follows it (text).

    Limit and approximation signs before the number and an uncertainty after it
    do not matter; thousands commas, a Unicode minus and powers of ten written as
    ``x 10^3`` are understood. A text that states no number, or a fill number,
    gives a null number; ``rest`` is '' then and never null for a non-null text.
    """
    df = once(df, **{number: stated_text(F.col(text)), rest: stated_rest(F.col(text))})
    df = once(df.withColumnRenamed(number, "_stated"), **{number: number_value(F.col("_stated"))}).drop("_stated")
    return df.withColumn(number, real_value(F.col(number)))


def stated_text(c: Column) -> Column:
    """The number as it is written, without signs around it ('' if there is none)."""
    return F.regexp_extract(c, STATED, 1)


def stated_rest(c: Column) -> Column:
    """What follows the number and its uncertainty, without outer blanks ('' if nothing)."""
    return F.trim(F.regexp_extract(c, STATED, 3))

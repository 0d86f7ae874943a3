"""Text normalisation as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters whose canonical decomposition begins with a plain letter, and that letter.
FOLDS = {chr(i): first for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
         if (first := unicodedata.normalize("NFD", chr(i))[0]).isascii()}
ACCENTED, PLAIN = "".join(FOLDS), "".join(FOLDS.values())

# Spellings of "no value" found in the text columns.
TEXT_SENTINELS = ("", "nan", "None", "NULL", "-1")
NUMERIC_SENTINEL = -1

# Blanks, the no-break space and the letter a wrong charset leaves.
STRAY = " \t\n\r\f\v\u00a0Â"


def fold(text: str) -> str:
    """Driver-side twin of :func:`normalised`, for column names."""
    table = str.maketrans(ACCENTED, PLAIN)
    lowered = text.strip().lower().translate(table)
    return "".join(ch for ch in lowered if ch.isascii() and ch.isalnum())


def normalised(col: Column) -> Column:
    """Trim, lower, drop accents, keep only letters a-z and digits."""
    plain = F.translate(F.lower(F.trim(col)), ACCENTED, PLAIN)
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def snake(col: Column) -> Column:
    """Trim, lower, blanks to underscores."""
    return F.replace(F.lower(F.trim(col)), F.lit(" "), F.lit("_"))


def first_year(col: Column) -> Column:
    """First 20xx year in a text, NULL when there is none."""
    year = F.regexp_extract(col, r"(20\d{2})", 1)
    return F.when(year != "", year.cast("int"))


def zero_padded(col: Column, width: int) -> Column:
    """Whole number as text, left-filled with zeros, never cut."""
    text = col.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def without_blanks(col: Column) -> Column:
    """Drop blanks, no-break spaces and the stray letter left by a wrong charset."""
    return F.translate(col, STRAY, "")


def without_decimal_tail(col: Column) -> Column:
    """'123.0' to '123' after trimming."""
    text = F.trim(col)
    return F.when(text.endswith(".0"), text.substr(F.lit(1), F.length(text) - 2)).otherwise(text)


def decimal_comma(col: Column) -> Column:
    """'48,85' to 48.85; what is not a number becomes NULL."""
    return lenient(F.replace(col, F.lit(","), F.lit(".")), "double")


def lenient(col: Column, kind: str) -> Column:
    """Cast where bad input gives NULL instead of an error."""
    return col.try_cast(kind)


def leading_integer(col: Column) -> Column:
    """Whole-number prefix of a text as text, '0' when there is none."""
    prefix = F.regexp_extract(col, r"^\s*\+?(-?\d+)", 1)
    # In text throughout: a number of any length keeps its digits.
    digits = F.regexp_replace(prefix, r"^(-?)0+(?=\d)", "$1")
    return F.when(col.isNotNull(), F.when(digits.isin("", "-0"), "0").otherwise(digits))


def joined_key(*parts: Column, sep: str = "_") -> Column:
    """Composite text key; NULL as soon as one part is NULL."""
    complete = parts[0].isNotNull()
    for part in parts[1:]:
        complete = complete & part.isNotNull()
    return F.when(complete, F.concat_ws(sep, *parts))


def sentinel_to_null(col: Column, kind: str) -> Column:
    """Map the known "no value" spellings of a column to NULL."""
    if kind == "string":
        trimmed = F.trim(col)
        return F.when(~trimmed.isin(*TEXT_SENTINELS), trimmed)
    return F.nullif(col, F.lit(NUMERIC_SENTINEL).cast(kind))

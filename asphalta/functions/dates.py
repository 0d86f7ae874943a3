"""Dates, times and the public-holiday calendar as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import lenient, zero_padded

# Holidays that fall on the same day every year, with names.
FIXED_HOLIDAYS = {
    "01-01": "Jour de l'an",
    "05-01": "Fête du Travail",
    "05-08": "Fête de la Victoire",
    "07-14": "Fête nationale",
    "08-15": "Assomption",
    "11-01": "Toussaint",
    "11-11": "Armistice",
    "12-25": "Noël",
}
# Holidays counted in days from Easter Sunday.
MOVABLE_HOLIDAYS = {"Lundi de Pâques": 1, "Ascension": 39, "Lundi de Pentecôte": 50}


def compact_date(col: Column) -> Column:
    """Strict yyyyMMdd text to a date, anything else (year 0000 too) to NULL."""
    text = F.trim(col.cast("string"))
    shaped = F.when(text.rlike(r"^(?!0000)\d{8}$"), text)
    return F.try_to_timestamp(shaped, F.lit("yyyyMMdd")).cast("date")


def compact_key(col: Column) -> Column:
    """Date or timestamp to yyyyMMdd text."""
    return F.date_format(col, "yyyyMMdd")


def full_year(col: Column) -> Column:
    """Two-digit years belong to the 2000s."""
    number = lenient(col, "int")
    return F.when(number < 100, number + 2000).otherwise(number)


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date from three columns, NULL when no such day exists."""
    text = F.concat(
        zero_padded(full_year(year), 4), F.lit("-"),
        zero_padded(lenient(month, "int"), 2), F.lit("-"),
        zero_padded(lenient(day, "int"), 2),
    )
    shaped = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd")).cast("date")


def time_digits(col: Column) -> Column:
    """'930', '09:30' and '9:30' to 'HH:mm'; NULL outside 00:00..23:59."""
    digits = F.replace(F.trim(col.cast("string")), F.lit(":"), F.lit(""))
    padded = zero_padded(digits, 4)
    return F.when(
        padded.rlike(r"^([01]\d|2[0-3])[0-5]\d$"),
        F.concat(F.substring(padded, 1, 2), F.lit(":"), F.substring(padded, 3, 2)),
    )


def timestamp_from(day: Column, clock: Column) -> Column:
    """Day plus a time text to a zone-free timestamp; NULL when either is bad."""
    text = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), time_digits(clock))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def clock_hour(col: Column) -> Column:
    """Hour of a strict 'HH:mm' text, NULL otherwise."""
    text = F.trim(col)
    good = text.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$")
    return F.when(good, F.split(text, ":")[0].cast("int"))


def stamp_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def iso_week_key(col: Column) -> Column:
    """ISO year and week as 'YYYY-WW'."""
    year = F.extract(F.lit("YEAROFWEEK"), col).cast("string")
    return F.concat(year, F.lit("-"), F.lpad(F.weekofyear(col).cast("string"), 2, "0"))


def is_weekend(col: Column) -> Column:
    return F.weekday(col) >= 5


def day_name(col: Column) -> Column:
    """English day name, whatever the session locale."""
    names = [F.lit(n) for n in (
        "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")]
    return F.element_at(F.array(*names), F.weekday(col) + 1)


def is_fixed_holiday(col: Column) -> Column:
    return F.date_format(col, "MM-dd").isin(*FIXED_HOLIDAYS)


def span_days(first: Column, last: Column) -> Column:
    """Calendar days from first to last, both included."""
    return F.date_diff(last, first) + 1


def easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian rule, in whole-number arithmetic."""
    def div(x: Column, n: int) -> Column:
        return F.floor(x / F.lit(n)).cast("int")

    golden = year % 19
    century, of_century = div(year, 100), year % 100
    correction = div(century - div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - div(century, 4) - correction + 15) % 30
    to_sunday = (
        (century % 4) * 2 + div(of_century, 4) * 2 - epact - (of_century % 4) + 32) % 7
    late = div(golden + epact * 11 + to_sunday * 22, 451)
    code = epact + to_sunday - late * 7 + 114
    return F.make_date(year, div(code, 31), code % 31 + 1)


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per public holiday (date, name) from first to last year."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    sunday = easter(F.col("y"))
    days = [
        F.struct(
            F.to_date(F.concat(F.col("y").cast("string"), F.lit(f"-{md}"))).alias("date_jour"),
            F.lit(name).alias("nom_jour_ferie"))
        for md, name in FIXED_HOLIDAYS.items()
    ] + [
        F.struct(F.date_add(sunday, shift).alias("date_jour"), F.lit(name).alias("nom_jour_ferie"))
        for name, shift in MOVABLE_HOLIDAYS.items()
    ]
    # A movable feast can meet a fixed one (Ascension on 8 May, 2024 not, 2008 yes):
    # one row per day, names joined.
    return (
        years.select(F.explode(F.array(*days)).alias("d")).select("d.*")
        .groupBy("date_jour")
        .agg(F.array_join(F.array_sort(F.collect_set("nom_jour_ferie")), "; ")
             .alias("nom_jour_ferie"))
    )


def holidays_of(df: DataFrame, day: str) -> DataFrame:
    """Holiday calendar of the years from a table's first day to its last.

    About a dozen rows a year, so it may be broadcast whatever the table's size.
    """
    first, last = df.agg(F.year(F.min(day)), F.year(F.max(day))).head()
    return holiday_calendar(df.sparkSession, first or 2000, last or 2000)


def day_range(spark: SparkSession, first, last) -> DataFrame:
    """One row per calendar day, both ends included."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
        .alias("date_jour"))

"""Accidents over time: hours, weekdays, months, seasons, holidays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import labels as lb


def measures(n_name: str = "nb_accidents") -> list[Column]:
    return [F.count(F.lit(1)).alias(n_name),
            (F.avg(F.col("est_grave").cast("int")) * 100).alias("taux_grave_pct")]


def dated_accidents(accidents: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach registry date and hour; the fact's own date is the fallback."""
    one = registry.groupBy("num_acc").agg(F.min("date").alias("date"), F.min("heure").alias("heure"))
    joined = accidents.join(one, "num_acc", "left")
    own = dt.compact_date(F.col("aaaammjj"))
    return joined.withColumn("date_jour", F.coalesce("date", own)).drop("date")


def with_calendar_labels(accidents: DataFrame, day: str = "date_jour",
                         month: str = "mois") -> DataFrame:
    return accidents.withColumns({
        "jour_semaine": lb.coded(F.weekday(day), lb.WEEKDAYS),
        "is_weekend": F.coalesce(dt.is_weekend(F.col(day)), F.lit(False)),
        "mois_nom": lb.coded(F.col(month), lb.MONTHS),
        "saison": lb.season(F.col(month))})


def level_table(spark: SparkSession, column: str, levels: Sequence) -> DataFrame:
    """Fixed ordered levels as a table (position, level)."""
    kind = "int" if isinstance(levels[0], int) else "string"
    return spark.range(len(levels)).select(
        F.col("id").cast("int").alias("position"),
        F.element_at(F.array(*[F.lit(v) for v in levels]), F.col("id").cast("int") + 1)
        .cast(kind).alias(column))


def by_levels(accidents: DataFrame, column: str, levels: Sequence, fill: bool) -> DataFrame:
    """Counts and severe rate for every level, absent ones as 0 or NULL."""
    agg = accidents.where(F.col(column).isNotNull()).groupBy(column).agg(*measures())
    out = level_table(accidents.sparkSession, column, levels).join(agg, column, "left")
    if fill:
        out = out.na.fill({"nb_accidents": 0, "taux_grave_pct": 0.0})
    return out.select("position", column, "nb_accidents", "taux_grave_pct")


def by_hour(accidents: DataFrame) -> DataFrame:
    return by_levels(accidents, "heure", list(range(24)), fill=True)


def by_weekday(accidents: DataFrame) -> DataFrame:
    return by_levels(accidents, "jour_semaine", list(lb.WEEKDAYS.values()), fill=False)


def by_season(accidents: DataFrame) -> DataFrame:
    return by_levels(accidents, "saison", list(lb.SEASONS), fill=False)


def by_weekend(accidents: DataFrame) -> DataFrame:
    return (accidents.groupBy("is_weekend").agg(*measures())
            .withColumn("periode", F.when(F.col("is_weekend"), "Week-end").otherwise("Semaine"))
            .drop("is_weekend"))


def by_month(accidents: DataFrame) -> DataFrame:
    kept = accidents.na.drop(subset=["mois", "mois_nom"])
    return kept.groupBy("mois", "mois_nom").agg(*measures()).orderBy("mois")


def with_holidays(accidents: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holiday flag and name by calendar membership (about 11 rows per year)."""
    joined = accidents.join(F.broadcast(holidays), "date_jour", "left")
    return joined.withColumn("jour_ferie", F.col("nom_jour_ferie").isNotNull())


def holiday_effect(accidents: DataFrame, holidays: DataFrame) -> DataFrame:
    """Accidents per calendar day on holidays and on ordinary days."""
    spark = accidents.sparkSession
    ends = accidents.agg(F.min("date_jour").alias("a"), F.max("date_jour").alias("b"))
    calendar = ends.select(F.explode(F.sequence("a", "b")).alias("date_jour"))
    days = (with_holidays(calendar, holidays).groupBy("jour_ferie")
            .agg(F.count(F.lit(1)).alias("nombre_jours")))
    seen = with_holidays(accidents, holidays).groupBy("jour_ferie").agg(*measures())
    kinds = spark.range(2).select((F.col("id") == 1).alias("jour_ferie"))
    out = kinds.join(seen, "jour_ferie", "left").join(days, "jour_ferie", "left")
    out = out.na.fill({"nb_accidents": 0, "taux_grave_pct": 0.0, "nombre_jours": 0})
    return out.select(
        F.when(F.col("jour_ferie"), "Jour férié").otherwise("Jour ordinaire").alias("type_jour"),
        "nb_accidents", F.round("taux_grave_pct", 2).alias("taux_grave_pct"), "nombre_jours",
        F.round(F.try_divide(F.col("nb_accidents").cast("double"), F.col("nombre_jours")), 2)
        .alias("accidents_par_jour"))

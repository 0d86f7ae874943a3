"""Accident-grain severity and the analyses built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from .ordered import first_per_key


def weight(grav: Column, weights: Mapping[int, int]) -> Column:
    return lb.coded(grav, weights)


def worst_severity(persons: DataFrame, keys: Sequence[str], weights: Mapping[int, int],
                   grav: str = "grav") -> DataFrame:
    """Worst severity per key, NULL when none is known.

    Weights identify severities, so the arg-max is a max of a small number and
    stays a plain hash aggregate with partial results per task.
    """
    back = {w: g for g, w in weights.items()}
    worst = persons.groupBy(*keys).agg(F.max(weight(F.col(grav), weights)).alias("poids"))
    return worst.withColumn(grav, lb.coded(F.col("poids"), back).cast("int"))


def worst_rows(persons: DataFrame, keys: Sequence[str], weights: Mapping[int, int],
               tie: Sequence[str], grav: str = "grav") -> DataFrame:
    """Whole row of the worst-hit person per key, first under `tie` on equal weights."""
    weighed = persons.withColumn("poids", weight(F.col(grav), weights))
    return first_per_key(weighed, keys, [F.col("poids").desc_nulls_last(), *tie])


def any_severe(persons: DataFrame, keys: Sequence[str], firsts: Sequence[str] = ()) -> DataFrame:
    """Accident grain: one severe person makes the accident severe."""
    return persons.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in firsts],
        F.bool_or(lb.is_severe(F.col("grav"))).alias("est_grave"))


def yearly_evolution(accidents: DataFrame, year: str = "annee") -> DataFrame:
    """Accidents by worst severity and the severe percentage, per year."""
    n = F.count(F.lit(1))
    killed, hosp = F.count_if(F.col("grav") == 2), F.count_if(F.col("grav") == 3)
    return accidents.where(F.col(year).isNotNull()).groupBy(year).agg(
        n.alias("nb_accidents"), killed.alias("nb_tues"),
        hosp.alias("nb_blesses_hospitalises"),
        F.count_if(F.col("grav") == 4).alias("nb_blesses_legers"),
        F.round((killed + hosp) * 100.0 / n, 2).alias("taux_gravite_pct"))


def rates_per_100k(accidents: DataFrame, population: DataFrame, area: str = "com") -> DataFrame:
    """Counts and rates per 100 000 inhabitants by area, populated areas only.

    Accidents are counted per area first; the population table (area, population)
    then meets one row per area, so a busy area is never joined row by row.
    """
    per_area = accidents.where(F.col(area).isNotNull()).groupBy(area).agg(
        F.count(F.lit(1)).alias("nb_accidents"),
        F.count_if(F.col("grav") == 2).alias("nb_tues"),
        F.count_if(F.col("grav") == 3).alias("nb_blesses_hospitalises"))

    def rate(n: Column) -> Column:
        return F.round(n * 100000.0 / F.col("population"), 2)

    killed, hosp = F.col("nb_tues"), F.col("nb_blesses_hospitalises")
    return per_area.join(population, area).where(F.col("population") > 0).select(
        area, "nb_accidents", "nb_tues", "nb_blesses_hospitalises", "population",
        rate(F.col("nb_accidents")).alias("taux_accidents_pour_100k"),
        rate(killed).alias("taux_tues_pour_100k"),
        rate(killed + hosp).alias("taux_graves_pour_100k"))


def key_figures(persons: DataFrame) -> DataFrame:
    """Distinct accidents, killed, hospitalised and severe share of person rows."""
    n = F.count(F.lit(1))
    killed, hosp = F.count_if(F.col("grav") == 2), F.count_if(F.col("grav") == 3)
    return persons.agg(
        F.count_distinct("num_acc").alias("nb_accidents"), killed.alias("nb_tues"),
        hosp.alias("nb_hospitalises"),
        F.coalesce(F.round(F.try_divide((killed + hosp) * 100.0, n), 2), F.lit(0.0))
        .alias("taux_gravite_pct"))


def distinct_accidents_by(persons: DataFrame, period: str) -> DataFrame:
    return (persons.where(F.col(period).isNotNull()).groupBy(period)
            .agg(F.count_distinct("num_acc").alias("nb_accidents")))


def accidents_on_map(persons: DataFrame) -> DataFrame:
    """Accident grain for the zone analysis: place and heaviest weight."""
    placed = persons.na.drop(subset=["lat", "lon"])
    heavy = F.coalesce(weight(F.col("grav"), lb.WEIGHTS_ZONES), F.lit(0))
    return placed.groupBy("num_acc").agg(
        F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.max(heavy).alias("poids_gravite"))


def risk_zones(accidents: DataFrame, killed_weight: int = 3, hosp_weight: int = 1) -> DataFrame:
    """Counts and risk score per 0.01 degree cell, from one row per accident."""
    from ..functions import geo

    cells = accidents.select(
        "num_acc", geo.grid_cell(F.col("lat")).alias("lat_e2"),
        geo.grid_cell(F.col("lon")).alias("lon_e2"), "poids_gravite")
    zones = cells.groupBy("lat_e2", "lon_e2").agg(
        F.count("num_acc").alias("nb_accidents"),
        F.count_if(F.col("poids_gravite") == 4).alias("nb_tues"),
        F.count_if(F.col("poids_gravite") == 2).alias("nb_blesses_hospitalises"),
        F.count_if(F.col("poids_gravite") == 1).alias("nb_blesses_legers"))
    return zones.withColumn(
        "score_risque", F.col("nb_accidents") + F.col("nb_tues") * killed_weight
        + F.col("nb_blesses_hospitalises") * hosp_weight)


def top_zones(zones: DataFrame, k: int = 20) -> DataFrame:
    """The k riskiest zones with rank, share of the top score and colour band."""
    from pyspark.sql import Window

    top = zones.orderBy(F.col("score_risque").desc(), "lat_e2", "lon_e2").limit(k)
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("score_risque").desc(), "lat_e2", "lon_e2")
    share = F.col("score_risque") / F.max("score_risque").over(everything)
    return (top.withColumn("rang_risque", F.row_number().over(order))
            .withColumn("intensite", share)
            .withColumn("couleur", F.when(F.col("intensite") > 0.66, "red")
                        .when(F.col("intensite") > 0.33, "orange").otherwise("green")))

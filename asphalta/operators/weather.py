"""Daily weather: station completeness and the reference series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from .linking import left_with_marker
from .ordered import first_per_key

SHARED = ("nom_usuel", "lat", "lon", "alti", "aaaammjj")


def one_row_per_day(obs: DataFrame, order: Sequence) -> DataFrame:
    """Keep one row per (station, day)."""
    return first_per_key(obs, ["num_poste", "date_obs"], order)


def station_completeness(obs: DataFrame, measures: Sequence[str] = ("rr", "tn", "tx")) -> DataFrame:
    """Days, span, share of missing measures and completeness per station."""
    stats = obs.where(F.col("num_poste").isNotNull()).groupBy("num_poste").agg(
        F.count("date_obs").alias("nb_jours"),
        F.min("date_obs").alias("date_min"), F.max("date_obs").alias("date_max"),
        *[(F.avg(F.col(m).isNull().cast("int")) * 100).alias(f"pct_manquant_{m}")
          for m in measures if m in obs.columns])
    span = dt.span_days(F.col("date_min"), F.col("date_max"))
    return (stats.withColumn("duree_couverture_jours", span)
            .withColumn("taux_completude",
                        F.try_divide(F.col("nb_jours"), F.col("duree_couverture_jours"))))


def best_station(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.col("taux_completude").desc(), F.col("nb_jours").desc(),
                         F.col("num_poste").asc()).limit(1)


def best_station_rows(obs: DataFrame) -> DataFrame:
    """Rows of the best-covered station, repeated days included.

    Coverage needs distinct days only, so the ranking pass aggregates (station, day)
    and the rows are filtered by one broadcast station id.
    """
    days = obs.na.drop(subset=["num_poste", "date_obs"]).select("num_poste", "date_obs").distinct()
    best = best_station(station_completeness(days, ())).select("num_poste")
    return obs.join(F.broadcast(best), "num_poste", "left_semi")


def reference_series(obs: DataFrame, order: Sequence) -> DataFrame:
    """Daily rows of the best-covered station, one per day."""
    return one_row_per_day(best_station_rows(obs), order)


def merge_reference(main: DataFrame, other: DataFrame, station: str,
                    order: Sequence | None = None) -> DataFrame:
    """Second weather file joined to the first for one station, with a match flag."""
    keys = ["num_poste", "date_obs"]
    here = F.col("num_poste") == station
    return left_with_marker(main.where(here), other.where(here), keys, SHARED, order=order)

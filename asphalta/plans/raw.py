"""Raw source files as the views a star schema is built on.

`RawDomain` offers what `Domain` offers to `Star`, read from the registry's yearly files,
weekly sensor files, daily weather files, the census table and the sensor referential:
`Star(RawDomain(...)).enriched()` leads from raw files to the enriched fact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates as dt
from ..functions import text as tx
from ..session import materialize
from . import curate


@dataclass(frozen=True)
class RawFolders:
    """Where the raw files lie; population and its labels are delimited files with headers."""

    registry: str
    traffic: str
    weather: str
    population: str
    population_labels: str
    sensors: str


class RawDomain:
    """The views of a star schema over raw files.

    department: of the accidents kept, None for all. Numbers that are none become NULL,
    accidents without a readable day have no day, and a vehicle described twice counts
    once, with its smallest category.
    """

    #: Labels among which the preferred population measure is looked for.
    population_measure = "popref_measure_lib"

    def __init__(self, spark: SparkSession, folders: RawFolders, department: str | None = "75"):
        self.spark, self.folders, self.department = spark, folders, department

    @cached_property
    def _registry(self) -> dict[str, DataFrame]:
        return curate.curate_registry(self.spark, self.folders.registry, self.department)

    @cached_property
    def caract(self) -> DataFrame:
        raw = self._registry["caracteristiques"]
        whole = {c: tx.lenient(F.col(c), "int") for c in ("lum", "atm", "col")}
        day = dt.date_from_parts(F.col("an"), F.col("mois"), F.col("jour"))
        return materialize(raw.select(
            F.col("Num_Acc").alias("num_acc"), day.alias("date_acc"), F.col("hrmn"), "dep", "com",
            tx.decimal_comma(F.col("lat")).alias("lat"), tx.decimal_comma(F.col("long")).alias("lon"),
            *[v.alias(c) for c, v in whole.items()]), "accidents")

    @cached_property
    def usagers(self) -> DataFrame:
        raw = self._registry["usagers"]
        optional = [c for c in ("secu1", "secu2", "secu3") if c in raw.columns]
        return raw.select(F.col("Num_Acc").alias("num_acc"), "num_veh", "place",
                          *[tx.lenient(F.col(c), "int").alias(c) for c in ("grav", "catu", *optional)])

    @cached_property
    def vehicules(self) -> DataFrame:
        raw = self._registry["vehicules"]
        return raw.groupBy(F.col("Num_Acc").alias("num_acc"), tx.without_blanks(F.col("num_veh")).alias("num_veh")).agg(
            F.min(tx.lenient(F.col("catv"), "int")).alias("catv"))

    @cached_property
    def weekly(self) -> DataFrame:
        return curate.curate_traffic(self.spark, self.folders.traffic)

    @cached_property
    def meteo(self) -> DataFrame:
        """Written once: the best station is found in one pass and its rows are read in another."""
        return materialize(curate.curate_weather(self.spark, self.folders.weather), "weather")

    @cached_property
    def population(self) -> DataFrame:
        data, labels = (curate.read_text_table(self.spark, p) for p in (self.folders.population, self.folders.population_labels))
        return curate.curate_population(data, labels).where("geo_object = 'ARM'").withColumn("com", F.col("geo"))

    @cached_property
    def ref_geo(self) -> DataFrame:
        return curate.curate_sensors(self.spark, self.folders.sensors).select(
            F.col("iu_ac").cast("string").alias("iu_ac"), "libelle",
            F.col("lat_wgs84").alias("lat"), F.col("lon_wgs84").alias("lon"))

"""Road-safety views projected from the general-purpose tables.

Each view is a narrow projection: column pruning reaches the Parquet scan, and
filters on the view become filters on the scan where the expression allows it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Domain:
    """Lazy access to raw tables and road-safety views of one data folder."""

    #: Column of the population's measure, where it holds several.
    population_measure = None

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def caract(self) -> DataFrame:
        """Accidents: date, time, place, light, weather and collision codes."""
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        placed = key % 50 != 0

        def two_digits(c):
            return F.lpad(c.cast("string"), 2, "0")

        return self.table("orders").select(
            key.cast("string").alias("num_acc"),
            F.date_add(F.lit("2024-01-01").cast("date"), (key % 366).cast("int")).alias("date_acc"),
            F.year("o_orderdate").alias("annee_hist"),
            F.concat(two_digits(cust % 24), F.lit(":"), two_digits(key % 60)).alias("hrmn"),
            F.when(key % 10 == 0, "93").otherwise("75").alias("dep"),
            (cust % 20 + 75101).cast("string").alias("com"),
            F.when(placed, ((cust * 37) % 1300 + 488000).cast("double") / 10000).alias("lat"),
            F.when(placed, ((cust * 53) % 3100 + 22000).cast("double") / 10000).alias("lon"),
            (key % 5 + 1).cast("int").alias("lum"), (cust % 9 + 1).cast("int").alias("atm"),
            (key % 7 + 1).cast("int").alias("col"))

    @cached_property
    def usagers(self) -> DataFrame:
        """Persons involved: vehicle, seat, severity and category."""
        q = F.col("l_quantity")
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("num_acc"),
            F.col("l_linenumber").cast("string").alias("num_veh"),
            (F.col("l_partkey") % 9 + 1).cast("string").alias("place"),
            F.when(F.col("l_suppkey") % 97 == 0, None).when(q == 1, 2).when(q <= 3, 3)
            .when(q <= 25, 1).otherwise(4).alias("grav"),
            (F.col("l_partkey") % 3 + 1).cast("int").alias("catu"))

    @cached_property
    def vehicules(self) -> DataFrame:
        """Vehicles, one row per (accident, vehicle), grouped by the keys they are joined on."""
        return (self.table("lineitem").select(
                    F.col("l_orderkey").cast("string").alias("num_acc"),
                    F.col("l_linenumber").cast("string").alias("num_veh"), "l_partkey")
                .groupBy("num_acc", "num_veh").agg(F.min("l_partkey").alias("p"))
                .select("num_acc", "num_veh", (F.col("p") % 40).cast("int").alias("catv")))

    @cached_property
    def lieux(self) -> DataFrame:
        """Roads of an accident, several rows at intersections."""
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("num_acc"),
            F.col("l_suppkey").cast("string").alias("voie"),
            (F.col("l_partkey") % 5).cast("int").alias("surf"))

    @cached_property
    def trafic(self) -> DataFrame:
        """Hourly sensor readings with the weekly file they came in."""
        from ..functions.dates import iso_week_key

        return self.table("events").select(
            F.col("user_id").cast("string").alias("iu_ac"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t_1h"),
            F.when(F.col("event_type") != "error", F.col("value")).alias("q"),
            F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("k"),
            F.concat(F.lit("trafic_"), iso_week_key(F.col("ts")), F.lit(".txt"))
            .alias("fichier_source"))

    @cached_property
    def weekly(self) -> DataFrame:
        """One row per sensor and weekly file."""
        from ..operators.traffic import weekly_aggregate

        return weekly_aggregate(self.trafic)

    @cached_property
    def ref_geo(self) -> DataFrame:
        """Sensors and their positions."""
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.cast("string").alias("iu_ac"), F.col("s_name").alias("libelle"),
            (((key * 37) % 1300 + 488000).cast("double") / 10000).alias("lat"),
            (((key * 53) % 3100 + 22000).cast("double") / 10000).alias("lon"))

    @cached_property
    def meteo(self) -> DataFrame:
        """Daily weather per station, with repeated days."""
        size, key = F.col("p_size").cast("double"), F.col("p_partkey")
        return self.table("part").select(
            (key % 3).cast("string").alias("num_poste"),
            F.date_add(F.lit("2024-01-01").cast("date"), (key % 366).cast("int")).alias("date_obs"),
            F.when(F.col("p_size") <= 25, F.lit(0.0)).otherwise((size - 25) / 2).alias("rr"),
            (size / 4).alias("tn"), (size / 4 + 7).alias("tx"),
            F.when(key % 11 != 0, size / 4 + 3).alias("tm"))

    @cached_property
    def population(self) -> DataFrame:
        """Inhabitants per commune."""
        key = F.col("n_nationkey")
        return self.table("nation").where(key < 20).select(
            (key + 75101).cast("string").alias("com"),
            (key * 10000 + 15000).cast("double").alias("obs_value"),
            F.lit(2023).alias("time_period"))

"""Star schema: dimensions, person-by-accident fact and its enrichment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as dt
from ..functions import geo
from ..functions import text as tx
from ..operators import traffic, weather
from ..operators.linking import fill_from, left_scattered
from ..operators.ordered import first_per_key, with_row_ids
from ..operators.shape import align
from ..session import materialize, small_table

FACT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("num_acc", T.StringType()), ("id_usager", T.StringType()), ("aaaammjj", T.StringType()),
    ("geo_key", T.StringType()), ("com", T.StringType()), ("iu_ac", T.StringType()),
    ("lum", T.IntegerType()), ("atm", T.IntegerType()), ("col", T.IntegerType()),
    ("catu", T.IntegerType()), ("grav", T.IntegerType()), ("secu1", T.IntegerType()),
    ("secu2", T.IntegerType()), ("secu3", T.IntegerType()), ("catv", T.IntegerType()))])


def keyed_accidents(caract: DataFrame) -> DataFrame:
    """Accident rows with date, commune and place keys."""
    return caract.select(
        tx.without_decimal_tail(F.col("num_acc")).alias("num_acc"),
        dt.compact_key(F.col("date_acc")).alias("aaaammjj"),
        tx.zero_padded(F.col("com").try_cast("int"), 5).alias("com"),
        geo.geo_key(F.col("lat"), F.col("lon")).alias("geo_key"),
        "lat", "lon", "lum", "atm", "col", "dep")


def calendar(d: Column) -> list[Column]:
    """The calendar columns of a date."""
    return [
        F.date_format(d, "yyyy-MM-dd").alias("date"),
        F.year(d).alias("annee"), F.month(d).alias("mois"), F.day(d).alias("jour"),
        dt.day_name(d).alias("jour_semaine"), dt.is_weekend(d).alias("is_weekend"),
        dt.iso_week_key(d).alias("annee_semaine")]


def dim_date(days: DataFrame, day: str) -> DataFrame:
    d = F.col(day)
    return days.where(d.isNotNull()).select(d).distinct().select(dt.compact_key(d).alias("aaaammjj"), *calendar(d))


def dim_geo(accidents: DataFrame) -> DataFrame:
    """One row per place key; the key fixes the coordinates to four decimals."""
    placed = accidents.na.drop(subset=["geo_key"])
    return placed.groupBy("geo_key").agg(
        F.min("lat").alias("lat"), F.min("lon").alias("lon")).withColumn(
        "arrondissement", F.lit(None).cast("string"))


def dim_population(pop: DataFrame, measure: str | None = None,
                   preferred: str = "Population totale") -> DataFrame:
    """Latest period of the preferred measure, one row per commune."""
    if measure:
        # Keep the preferred measure when it occurs at all, every measure otherwise.
        has = not pop.where(F.col(measure) == preferred).isEmpty()
        pop = pop.where(F.col(measure) == preferred) if has else pop
    newest = pop.agg(F.max("time_period")).head()[0]
    keyed = pop.where(F.col("time_period") == F.lit(newest)).select(
        tx.zero_padded(F.col("com").try_cast("int"), 5).alias("com"), "obs_value", "time_period")
    return first_per_key(keyed, ["com"], [F.col("obs_value")])


def dim_meteo(reference: DataFrame) -> DataFrame:
    keyed = reference.select(dt.compact_key(F.col("date_obs")).alias("aaaammjj"),
                             "rr", "tn", "tx", "tm")
    return first_per_key(keyed, ["aaaammjj"], [F.col(c) for c in ("rr", "tn", "tx", "tm")])


def dim_sensor(ref_geo: DataFrame) -> DataFrame:
    return ref_geo.select(
        tx.leading_integer(F.col("iu_ac")).alias("iu_ac"),
        geo.geo_key(F.col("lat"), F.col("lon")).alias("geo_key"), "libelle").distinct()


def assign_sensor(accidents: DataFrame, sensors: DataFrame) -> DataFrame:
    """Sensor of each accident: same place key first, then same ~1 km cell.

    Done at accident grain, before persons multiply the rows.  Each lookup side is
    one row per key or cell, so neither join can fan out.
    """
    start = accidents.withColumn("iu_ac", F.lit(None).cast("string")) \
        if "iu_ac" not in accidents.columns else accidents
    exact = fill_from(start, sensors.select("geo_key", "iu_ac"), ["geo_key"], "iu_ac")
    lat, lon = geo.split_geo_key(F.col("geo_key"))
    cell = {"lat_e2": geo.grid_cell(lat), "lon_e2": geo.grid_cell(lon)}
    near = fill_from(exact.withColumns(cell),
                     sensors.withColumns(cell).select(*cell, "iu_ac"), list(cell), "iu_ac")
    return near.drop(*cell)


def fact(persons: DataFrame, accidents: DataFrame, vehicles: DataFrame | None,
         unique_vehicles: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Person-by-accident fact: inner join to accidents, left join to vehicles.

    Vehicles are reduced to one row per (accident, vehicle) unless the caller
    knows they are, and meet the persons first: both are narrow, so that the wide rows
    of accidents and persons are not sent once more.  `extra` accident columns are kept.
    Without vehicles the result has no category of vehicle.
    """
    clean = {c: tx.without_blanks(F.col(c)) for c in ("num_veh", "place")}
    people = persons.withColumns(clean).withColumn(
        "id_usager", tx.joined_key(F.col("num_acc"), F.col("num_veh"), F.col("place")))
    more = [f for f in accidents.schema if f.name in extra]
    if vehicles is None:
        kept = [f for f in FACT_SCHEMA.fields if f.name != "catv"]
        return align(people.join(accidents, "num_acc"), T.StructType([*kept, *more]))
    if not unique_vehicles:
        vehicles = vehicles.groupBy("num_acc", "num_veh").agg(F.min("catv").alias("catv"))
    joined = people.join(vehicles, ["num_acc", "num_veh"], "left").join(accidents, "num_acc")
    return align(joined, T.StructType([*FACT_SCHEMA.fields, *more]))


def numbered_fact(rows: DataFrame) -> DataFrame:
    """Fact with `id_fait` = 1..n in (accident, person) order."""
    return with_row_ids(rows, ["num_acc", "id_usager", "grav", "catu"], "id_fait")


CONTEXT = ("date", "annee", "mois", "jour", "jour_semaine", "is_weekend", "annee_semaine",
           "q_total", "q_moyen", "k_moyen", "meteo_precipitations", "meteo_temp_min",
           "meteo_temp_max", "meteo_temp_moy", "population", "population_annee")


def enrich(rows: DataFrame, traffic_weeks: DataFrame, weather_days: DataFrame,
           population: DataFrame) -> DataFrame:
    """Calendar columns of the day and three left joins; every right side has one row per key.

    All keys belong to the accident, so the joins run best at accident grain,
    before persons multiply the rows; any grain gives the same values.  Callers pass
    weather and communes for broadcast once their size is known; the sensor-week table
    is large, and rows without a sensor are scattered over its tasks.
    """
    days = weather_days.select(
        "aaaammjj", F.col("rr").alias("meteo_precipitations"), F.col("tn").alias("meteo_temp_min"),
        F.col("tx").alias("meteo_temp_max"), F.col("tm").alias("meteo_temp_moy"))
    people = population.select("com", F.col("obs_value").alias("population"),
                               F.col("time_period").alias("population_annee"))
    weeks = traffic_weeks.select("iu_ac", "annee_semaine", "q_total", "q_moyen", "k_moyen")
    dated = rows.select("*", *calendar(dt.compact_date(F.col("aaaammjj"))))
    joined = left_scattered(dated, weeks, ["iu_ac", "annee_semaine"]).join(
        days, "aaaammjj", "left").join(people, "com", "left")
    return joined.select(*rows.columns, *CONTEXT)


class Star:
    """The star schema of a :class:`~asphalta.plans.views.Domain` or :class:`~asphalta.plans.raw.RawDomain`, built as needed."""

    def __init__(self, domain):
        self.domain = domain

    @cached_property
    def accidents(self) -> DataFrame:
        return keyed_accidents(self.domain.caract)

    @cached_property
    def dim_date(self) -> DataFrame:
        return dim_date(self.domain.caract, "date_acc")

    @cached_property
    def dim_geo(self) -> DataFrame:
        return dim_geo(self.accidents)

    @cached_property
    def dim_population(self) -> DataFrame:
        return dim_population(self.domain.population, self.domain.population_measure)

    @cached_property
    def dim_meteo(self) -> DataFrame:
        return dim_meteo(weather.best_station_rows(self.domain.meteo))

    @cached_property
    def dim_sensor(self) -> DataFrame:
        return dim_sensor(self.domain.ref_geo)

    @cached_property
    def dim_traffic(self) -> DataFrame:
        """A dimension is a table at rest; writing it also ends a long plan."""
        return materialize(traffic.traffic_dimension(self.domain.weekly), "dim-traffic")

    @cached_property
    def located(self) -> DataFrame:
        return assign_sensor(self.accidents, self.dim_sensor)

    @cached_property
    def fact(self) -> DataFrame:
        return fact(self.domain.usagers, self.located, self.domain.vehicules, unique_vehicles=True)

    @cached_property
    def persons(self) -> DataFrame:
        """The fact without the category of vehicle, for work that does not ask for it."""
        return fact(self.domain.usagers, self.located, None)

    @cached_property
    def context(self) -> tuple[DataFrame, DataFrame]:
        """Weather by day and population by commune: at most a row per day and per commune."""
        return small_table(self.dim_meteo, "dim-meteo"), small_table(self.dim_population, "dim-population")

    def with_context(self, rows: DataFrame) -> DataFrame:
        """Date, traffic, weather and population of any rows with the four keys."""
        return enrich(rows, self.dim_traffic, *self.context)

    def enriched(self, vehicles: bool = True) -> DataFrame:
        """Enriched fact: context at accident grain, then one join to persons; without vehicles no category of them."""
        return fact(self.domain.usagers, self.with_context(self.located), self.domain.vehicules if vehicles else None,
                    unique_vehicles=True, extra=CONTEXT)

    def enriched_table(self, columns: Sequence[str] = ()) -> DataFrame:
        """Chosen columns of the enriched fact as a written table, for several passes.

        Names without the category of vehicle spare the join to vehicles, which adds no rows.
        """
        wide = self.enriched(vehicles=not columns or any(not isinstance(c, str) or c == "catv" for c in columns))
        return materialize(wide.select(*columns) if columns else wide, "enriched")


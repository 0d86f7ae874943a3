"""Sensor readings: quality filter, imputation, weekly aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions.text import leading_integer
from ..session import materialize
from .ordered import Balance, grouped_medians, median_of_ranked, running_totals

MAX_MISSING = 0.30
#: Different values of a sensor in a file up to which they are put in order in one task.
SMALL_GROUP = 100_000


def value_counts(readings: DataFrame, source: str = "fichier_source") -> DataFrame:
    """Readings counted per (file, sensor, measure, value).

    `n` counts known values, `m` all readings including the NULL value. Missing rates,
    medians, sums and periods all come out of these counts, and those of different files
    stand side by side.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
        for c in ("q", "k")])).alias("p")
    known = readings.where(F.col("iu_ac").isNotNull())
    return (known.select(source, "iu_ac", "t_1h", pairs).select(source, "iu_ac", "t_1h", "p.*")
            .groupBy(source, "iu_ac", "variable", "value")
            .agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("m"),
                 F.min("t_1h").alias("t_min"), F.max("t_1h").alias("t_max")))


def count_balance(counts: DataFrame) -> Balance:
    """Bounds from the counted values, which are what the ordered work is about."""
    wide = counts.select(*[F.when(F.col("variable") == v, F.col("value")).alias(v) for v in ("q", "k")])
    return Balance.of(wide, ["q", "k"])


def running_counts(counts: DataFrame, source: str = "fichier_source", balance: Balance | None = None) -> DataFrame:
    """Written value counts with running counts within each sensor of a file.

    Where no sensor of a file has over SMALL_GROUP values of a measure, which is counted
    first, one shuffle brings each sensor's values together; else they lie in buckets.
    """
    keys = [source, "iu_ac", "variable"]
    largest = counts.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    if largest <= SMALL_GROUP:
        together = counts.where(F.col(source).isNotNull()).repartition(source, "iu_ac")
        return running_totals(together, keys, "value", ["n"], None)
    balance = balance or count_balance(counts)
    return running_totals(counts, keys, "value", ["n"],
                          balance.bucket_in(F.col("variable"), F.col("value")))


def reading_counts(readings: DataFrame, source: str = "fichier_source",
                   balance: Balance | None = None) -> DataFrame:
    """Value counts of readings, written once, with running counts."""
    return running_counts(materialize(value_counts(readings, source), "reading-counts"), source, balance)


def per_sensor(counts: DataFrame, source: str = "fichier_source") -> DataFrame:
    """Counts, sums, period and median of each measure per (file, sensor)."""
    missing = F.sum(F.when(F.col("value").isNull(), F.col("m")).otherwise(0))
    measured = counts.groupBy(source, "iu_ac", "variable").agg(
        median_of_ranked().alias("median"), F.sum("m").alias("rows"), missing.alias("missing"),
        F.coalesce(F.sum(F.col("value") * F.col("n")), F.lit(0.0)).alias("known_sum"),
        F.min("t_min").alias("t_debut"), F.max("t_max").alias("t_fin"))

    def of(variable: str, name: str):
        return F.max(F.when(F.col("variable") == variable, F.col(name)))

    return measured.groupBy(source, "iu_ac").agg(
        F.max("rows").alias("rows"), F.min("t_debut").alias("t_debut"), F.max("t_fin").alias("t_fin"),
        *[of(v, n).alias(f"{v}_{n}") for v in ("q", "k") for n in ("median", "missing", "known_sum")]
    ).withColumns({
        f"{v}_missing_rate": F.col(f"{v}_missing") / F.col("rows") for v in ("q", "k")})


def sensor_statistics(readings: DataFrame, source: str = "fichier_source",
                      balance: Balance | None = None) -> DataFrame:
    """Missing rate and exact medians of q and k per (source file, sensor)."""
    return per_sensor(reading_counts(readings, source, balance), source).select(
        source, "iu_ac", "q_missing_rate", "q_median", "k_median")


def reliable_sensors(readings: DataFrame, source: str = "fichier_source",
                     limit: float = MAX_MISSING) -> DataFrame:
    """Readings of sensors whose missing rate within the file is at most the limit."""
    keys = [source, "iu_ac"]
    good = (readings.where(F.col("iu_ac").isNotNull()).groupBy(*keys)
            .agg(F.avg(F.col("q").isNull().cast("int")).alias("_r"))
            .where(F.col("_r") <= limit).select(*keys))
    return readings.join(good, keys, "left_semi")


def impute_readings(readings: DataFrame, stats: DataFrame, source: str = "fichier_source",
                    balance: Balance | None = None) -> DataFrame:
    """Fill q and k by the sensor's median, then by the file's median over kept rows."""
    keys = [source, "iu_ac"]
    good = stats.where(F.col("q_missing_rate") <= MAX_MISSING).select(
        *keys, "q_median", "k_median")
    kept = readings.join(good, keys)
    per_file = grouped_medians(kept, [source], {"q": "_qf", "k": "_kf"}, balance)
    return kept.join(per_file, source, "left").select(
        *keys, "t_1h",
        F.coalesce("q", "q_median", "_qf").alias("q"),
        F.coalesce("k", "k_median", "_kf").alias("k"),
        F.col("q").isNull().cast("int").alias("q_missing"),
        F.col("k").isNull().cast("int").alias("k_missing"))


def weekly_aggregate(readings: DataFrame, source: str = "fichier_source") -> DataFrame:
    """One row per sensor and weekly file, after filtering and imputation."""
    return weekly_of_counts(materialize(value_counts(readings, source), "reading-counts"), source)


def weekly_of_counts(values: DataFrame, source: str = "fichier_source") -> DataFrame:
    """The same from written value counts: a missing reading adds the sensor's median, or the
    median of the file's kept readings where the sensor has none.
    """
    balance = count_balance(values)
    counts = running_counts(values, source, balance)
    # Written, as it is read for the files' medians and for the result.
    kept = materialize(per_sensor(counts, source).where(F.col("q_missing_rate") <= MAX_MISSING), "kept-sensors")
    pooled = (values.select(source, "iu_ac", "variable", "value", "n")
              .where(F.col("value").isNotNull())
              .join(kept.select(source, "iu_ac"), [source, "iu_ac"])
              .groupBy(source, "variable", "value").agg(F.sum("n").alias("n")))
    pooled = materialize(pooled, "pooled-counts")
    ranked = running_totals(pooled, [source, "variable"], "value", ["n"],
                            balance.bucket_in(F.col("variable"), F.col("value")))
    file_level = ranked.groupBy(source, "variable").agg(median_of_ranked().alias("_m"))
    file_level = file_level.groupBy(source).agg(*[
        F.max(F.when(F.col("variable") == v, F.col("_m"))).alias(f"_{v}f") for v in ("q", "k")])

    def filled(v: str):
        """Sum of a measure and number of readings once gaps are filled."""
        fill = F.coalesce(F.col(f"{v}_median"), F.col(f"_{v}f"))
        gaps = F.col(f"{v}_missing")
        total = F.col(f"{v}_known_sum") + F.when(gaps > 0, F.coalesce(fill, F.lit(0.0)) * gaps).otherwise(0.0)
        size = F.col("rows") - F.when(fill.isNull(), gaps).otherwise(0)
        return total, size

    q_sum, q_n = filled("q")
    k_sum, k_n = filled("k")
    return kept.join(file_level, source, "left").select(
        source, "iu_ac", q_sum.alias("q_total"), F.try_divide(q_sum, q_n).alias("q_moyen"),
        F.try_divide(k_sum, k_n).alias("k_moyen"), q_n.alias("nb_heures"),
        "q_missing_rate", "k_missing_rate", "t_debut", "t_fin")


def traffic_dimension(weekly: DataFrame, when: str = "t_debut") -> DataFrame:
    """Mean measures per (sensor, ISO week); NULL keys play no part."""
    keyed = weekly.select(
        leading_integer(F.col("iu_ac")).alias("iu_ac"),
        dt.iso_week_key(F.col(when)).alias("annee_semaine"), "q_total", "q_moyen", "k_moyen")
    return (keyed.na.drop(subset=["iu_ac", "annee_semaine"])
            .groupBy("iu_ac", "annee_semaine")
            .agg(*[F.avg(c).alias(c) for c in ("q_total", "q_moyen", "k_moyen")])
            .withColumn("grain_trafic", F.lit("hebdomadaire")))

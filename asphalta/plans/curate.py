"""Raw files to curated tables: registry, traffic, weather, population, sensors.

File names and headers are metadata and are looked at on the driver; every row
stays on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import geo
from ..functions import text as tx
from ..operators import linking, shape, traffic, weather
from ..operators.ordered import first_per_key
from ..sources import files

ACCIDENT_ALIASES = ("Num_Acc", "NumAcc", "Accident_Id")
DEPARTMENT_ALIASES = ("dep", "departement")


@dataclass(frozen=True)
class RawFile:
    path: str
    name: str
    kind: str
    year: int | None


def registry_files(spark: SparkSession, folder: str) -> list[RawFile]:
    """Files (or folders of parts) of a registry folder with kind and year."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
              .select("path", files.logical_name(F.col("path")).alias("nom")))
    kinds = listed.select(
        "path", "nom", files.file_kind(F.col("nom")).alias("kind"),
        tx.first_year(F.col("nom")).alias("year")).where(F.col("kind").isNotNull())
    return sorted((RawFile(r["path"], r["nom"], r["kind"], r["year"]) for r in kinds.collect()),
                  key=lambda f: f.path)


def read_text_table(spark: SparkSession, path: str | Sequence[str], sep: str = ";",
                    encoding: str = "UTF-8") -> DataFrame:
    """Delimited file with its own header, every column as text."""
    return (spark.read.option("header", True).option("sep", sep)
            .option("encoding", encoding).csv(path))


def clean_registry_file(raw: DataFrame, department: str | None) -> DataFrame:
    """Headers, empty rows, sentinels, accident key, department (None: all), repeated rows."""
    df = shape.clean_headers(raw, blanks=None, lower=False)
    df = shape.sentinels_to_null(shape.drop_all_null_rows(df))
    df = shape.normalise_key(df, "Num_Acc", ACCIDENT_ALIASES)
    dep = shape.resolve_column(df.columns, DEPARTMENT_ALIASES)
    if dep is not None and department is not None:
        df = df.where(shape.in_department(F.col(dep), department))
    return df.distinct()


def lanes_per_accident(roads: DataFrame, order: Sequence[str]) -> DataFrame:
    """One road row per accident, with the number of roads and an intersection flag."""
    lanes = roads.groupBy("Num_Acc").agg(F.count(F.lit(1)).alias("nb_voies_intersection"))
    first = first_per_key(roads, ["Num_Acc"], list(order))
    return first.join(lanes, "Num_Acc").withColumn(
        "intersection", F.col("nb_voies_intersection") > 1)


def curate_registry(spark: SparkSession, folder: str, department: str | None = "75",
                    encoding: str = "ISO-8859-1") -> dict[str, DataFrame]:
    """Yearly registry files to one frame per table, plus a cleaning report."""
    stacked: dict[str, list[DataFrame]] = {}
    reports = []
    for f in registry_files(spark, folder):
        raw = read_text_table(spark, f.path, ";", encoding)
        cleaned = clean_registry_file(raw, department)
        reports.append(
            raw.agg(F.count(F.lit(1)).alias("lignes_avant")).withColumn("_j", F.lit(1))
            .join(cleaned.agg(F.count(F.lit(1)).alias("lignes_apres")).withColumn("_j", F.lit(1)), "_j")
            .select(F.lit(f.name).alias("fichier"), F.lit(f.kind).alias("type"),
                    F.lit(f.year).cast("int").alias("annee"), "lignes_avant", "lignes_apres"))
        stacked.setdefault(f.kind, []).append(
            cleaned.withColumn("annee_source", F.lit(f.year).cast("int")))
    out = {kind: shape.union_by_name(frames) for kind, frames in stacked.items()}
    if "caracteristiques" in out:
        for kind in out.keys() - {"caracteristiques"}:
            if shape.resolve_column(out[kind].columns, DEPARTMENT_ALIASES) is None:
                out[kind] = linking.semi(out[kind], out["caracteristiques"], ["Num_Acc"])
    if "lieux" in out:
        others = [c for c in out["lieux"].columns if c != "Num_Acc"]
        out["lieux"] = lanes_per_accident(out["lieux"], others)
    if reports:
        out["rapport"] = shape.union_by_name(reports)
    return out


def curate_traffic(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly sensor text files, each by its own header, to one row per sensor and file."""
    raw, _ = files.read_by_header(spark, folder, ("iu_ac", "t_1h"))
    text = {c: F.col(c) if c in raw.columns else F.lit(None).cast("string") for c in ("q", "k")}
    typed = raw.select(
        "fichier_source", "iu_ac", F.col("t_1h").try_cast("timestamp_ntz").alias("t_1h"),
        *[tx.lenient(v, "double").alias(c) for c, v in text.items()])
    return traffic.weekly_aggregate(typed)


def curate_weather(spark: SparkSession, path: str, first_day: str = "2020-01-01",
                   last_day: str = "2024-12-31") -> DataFrame:
    """Daily weather files, gzipped or not, each by its own header, to typed rows: one per station and day."""
    raw = files.read_by_header(spark, path, ("NUM_POSTE", "AAAAMMJJ"))[0].drop("fichier_source")
    dated = raw.withColumn("date_obs", dt.compact_date(F.col("AAAAMMJJ")))
    period = dated.where(F.col("date_obs").between(first_day, last_day))
    slim = shape.type_by_prefix(shape.drop_near_empty(period), "Q", "tinyint")
    measures = [c for c in ("RR", "TN", "TX", "TM", "LAT", "LON", "ALTI") if c in slim.columns]
    typed = slim.withColumns({c: tx.lenient(F.col(c), "double") for c in measures})
    rest = [c for c in typed.columns if c not in ("NUM_POSTE", "date_obs")]
    lower = first_per_key(typed, ["NUM_POSTE", "date_obs"], rest)
    return lower.toDF(*[c.lower() for c in lower.columns])


def curate_reference_weather(spark: SparkSession, main: str, other: str) -> DataFrame:
    """Daily rows of the best-covered station, with the columns of the second weather file beside them."""
    first, second = curate_weather(spark, main), curate_weather(spark, other)
    station = weather.best_station(weather.station_completeness(first, ())).head()["num_poste"]
    return weather.merge_reference(first, second, station)


def curate_population(data: DataFrame, metadata: DataFrame) -> DataFrame:
    """Census values of the city, typed, decoded and without negative counts."""
    df = shape.clean_headers(shape.trim_texts(data))
    meta = shape.clean_headers(shape.trim_texts(metadata)).withColumn(
        "rang", F.monotonically_increasing_id())
    df = df.withColumns({"time_period": tx.lenient(F.col("time_period"), "int"),
                         "obs_value": tx.lenient(F.col("obs_value"), "double")}).distinct()
    df = shape.negatives_to_null(df, "obs_value")
    for variable in ("GEO", "POPREF_MEASURE", "FREQ"):
        code = variable.lower()
        df = linking.decode(df, meta, variable, code, f"{code}_lib", "rang")
    return df.where(shape.any_of_pairs(F.col("geo_object"), F.col("geo"), shape.paris_codes()))


def curate_sensors(spark: SparkSession, path: str) -> DataFrame:
    """Sensor referential from JSON arrays, with its point split in two columns."""
    raw = shape.clean_headers(shape.nested_to_json(files.read_json_arrays(spark, path)))
    lat, lon = geo.parse_point(F.col("geo_point_2d"))
    kept = shape.drop_all_null_rows(raw).distinct()
    return kept.withColumns({"lat_wgs84": lat, "lon_wgs84": lon})

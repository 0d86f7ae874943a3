"""Scans and sinks.  Each query writes files derived from its tables, then reads them."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import profile, shape
from ..operators.ordered import with_row_ids
from ..plans.star import numbered_fact
from ..session import fresh_path
from ..sources import files, tables
from ..sources.snapshots import SnapshotTable
from .registry import query


@query("s01_delimited_scan", """
 SELECT num_acc, hrmn, com, 'Échangeur n°' || com AS libelle, lat FROM caract""")
def s01(c):
    """Semicolon, Latin-1 text with decimal commas, read under an all-text schema."""
    path = fresh_path(c.spark, "s01")
    out = c.d.caract.select(
        "num_acc", "hrmn", "com", F.concat(F.lit("Échangeur n°"), "com").alias("libelle"),
        F.replace(F.col("lat").cast("string"), F.lit("."), F.lit(",")).alias("lat"))
    tables.write_delimited(out, path, ";", "ISO-8859-1")
    back = files.read_delimited(c.spark, path, files.all_text(out.columns), ";", "ISO-8859-1")
    return back.withColumn("lat", tx.decimal_comma(F.col("lat")))


@query("s02_classified_scan", """
 WITH f AS (
  SELECT 'caracteristiques' AS type_fichier, year(o_orderdate) AS y FROM orders
  UNION ALL SELECT 'lieux', year(l_shipdate) FROM lineitem
  UNION ALL SELECT 'usagers', year(l_shipdate) FROM lineitem WHERE l_linenumber > 1)
 SELECT type_fichier, CAST(y AS INT) + 10 AS annee_source, count(*) AS lignes FROM f GROUP BY 1, 2""")
def s02(c):
    """Kind and year from file names; the vehicle-registration file is rejected."""
    path = fresh_path(c.spark, "s02")
    orders, lines = c.table("orders"), c.table("lineitem")

    def named(df, stem, day, key):
        year = (F.year(day) + 10).cast("string")
        return df.select(F.col(key).cast("string").alias("value"),
                         F.concat(F.lit(stem), F.lit("-"), year, F.lit(".csv")).alias("fichier"))

    lot = (named(orders, "Caractéristiques", "o_orderdate", "o_orderkey")
           .unionAll(named(lines, "LIEUX", "l_shipdate", "l_orderkey"))
           .unionAll(named(lines.where("l_linenumber > 1"), "usagers", "l_shipdate", "l_orderkey"))
           .unionAll(named(lines.where("l_linenumber = 1"), "vehicules-immatricules", "l_shipdate",
                           "l_orderkey")))
    lot.write.partitionBy("fichier").text(path)
    return (files.classified_lines(c.spark, path).groupBy("type_fichier", "annee_source")
            .agg(F.count(F.lit(1)).alias("lignes")))


@query("s03_latest_snapshot", """
 SELECT CAST('2024-' || lpad(CAST(m AS STRING), 2, '0') || '-01' AS DATE) AS snapshot_date, o_orderstatus, count(*) AS n
 FROM (SELECT month(o_orderdate) AS m, o_orderstatus FROM orders) WHERE m = (SELECT max(month(o_orderdate)) FROM orders)
 GROUP BY 1, 2""")
def s03(c):
    path = fresh_path(c.spark, "s03")
    dated = c.table("orders").select(
        "o_orderkey", "o_orderstatus",
        F.make_date(F.lit(2024), F.month("o_orderdate"), F.lit(1)).alias("snapshot_date"))
    dated.write.partitionBy("snapshot_date").parquet(path)
    return (files.latest_snapshot(c.spark, path).groupBy("snapshot_date", "o_orderstatus")
            .agg(F.count(F.lit(1)).alias("n")))


@query("s04_tolerant_scan", """
 SELECT fichier_source, count(*) AS lignes, count(q) AS q_lus, count(k) AS k_lus, round(sum(q), 3) AS q_somme
 FROM (SELECT t.fichier_source, CASE WHEN e.event_id % 89 = 0 OR e.event_type = 'error' THEN NULL ELSE e.value END AS q,
   CASE WHEN e.event_id % 89 = 0 THEN NULL ELSE CAST(regexp_extract(e.props,'([0-9]+)',1) AS DOUBLE) END AS k
  FROM events e JOIN (SELECT event_id, 'trafic_' || CAST(isoyear(ts) AS STRING) || '-'
   || lpad(CAST(weekofyear(ts) AS STRING),2,'0') || '.txt' AS fichier_source FROM events) t ON e.event_id = t.event_id
  WHERE e.event_id % 97 <> 0 OR e.event_id % 89 = 0) GROUP BY fichier_source""")
def s04(c):
    """Weekly sensor files with headers of two kinds: over-long lines are skipped, short or non-numeric ones and quoted separators kept."""
    from ..functions.dates import iso_week_key

    path = fresh_path(c.spark, "s04")
    event, week = F.col("event_id"), iso_week_key(F.col("ts"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    q = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    k = F.regexp_extract("props", "([0-9]+)", 1)
    lines = {}
    for header, parts in (("iu_ac;t_1h;q;k;dessin", (F.col("user_id"), stamp, q, k)),
                          ("t_1h;iu_ac;k;q;etat_trafic;etat_barre;dessin", (stamp, F.col("user_id"), k, q, F.lit("1"), F.lit("2")))):
        lines[header] = (
            F.when(event % 89 == 0, F.concat_ws(";", *parts[:2]))
            .when(event % 97 == 0, F.concat_ws(";", *parts, F.lit("d"), F.lit("x")))
            .when(event % 83 == 0, F.concat_ws(";", *parts, F.lit('"Rue; nord ""A"""')))
            .otherwise(F.concat_ws(";", *parts, F.lit("dessin"))))
    first, second = lines
    even = F.right(week, F.lit(2)).cast("int") % 2 == 0
    weekly = c.table("events").select(
        F.concat(F.lit("trafic_"), week, F.lit(".txt")).alias("fichier"), even.alias("even"),
        F.lit(1).alias("ordre"), F.when(even, lines[first]).otherwise(lines[second]).alias("value"))
    heads = weekly.select("fichier", "even").distinct().select(
        "fichier", "even", F.lit(0).alias("ordre"), F.when(F.col("even"), first).otherwise(second).alias("value"))
    # One file a week, its header first.
    (weekly.unionByName(heads).repartition("fichier").sortWithinPartitions("fichier", "ordre").select("fichier", "value")
     .write.partitionBy("fichier").text(path))
    raw, _ = files.read_by_header(c.spark, path, ("iu_ac", "t_1h"))
    typed = raw.withColumns({m: tx.lenient(F.col(m), "double") for m in ("q", "k")})
    return typed.groupBy("fichier_source").agg(
        F.count(F.lit(1)).alias("lignes"), F.count("q").alias("q_lus"), F.count("k").alias("k_lus"),
        F.round(F.sum("q"), 3).alias("q_somme"))


@query("s05_sniffed_gzip_scan", """
 SELECT num_poste, count(*) AS lignes, round(sum(rr), 4) AS pluie FROM meteo GROUP BY num_poste""")
def s05(c):
    """Gzip recognised by its first bytes, whatever the extension."""
    path = fresh_path(c.spark, "s05")
    lines = c.d.meteo.select(F.concat_ws(
        ";", "num_poste", F.date_format("date_obs", "yyyyMMdd"), F.col("rr").cast("string")).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    row = F.from_csv("value", "num_poste string, aaaammjj string, rr string", {"sep": ";"})
    parsed = files.read_sniffed(c.spark, path).select(row.alias("r")).select("r.*")
    return parsed.groupBy("num_poste").agg(
        F.count(F.lit(1)).alias("lignes"),
        F.round(F.sum(tx.lenient(F.col("rr"), "double")), 4).alias("pluie"))


def _write_sensor_arrays(c, path):
    """One JSON array per file, exactly 1000 sensors each but for the last."""
    numbered = with_row_ids(c.d.ref_geo, ["iu_ac"], "rang")
    docs = numbered.select(
        F.floor((F.col("rang") - 1) / 1000).alias("lot"),
        F.struct("iu_ac", "libelle", F.struct("lon", "lat").alias("geo_point_2d")).alias("r"))
    arrays = docs.groupBy("lot").agg(F.to_json(F.collect_list("r")).alias("value"))
    arrays.repartition("lot").write.partitionBy("lot").text(path)


@query("s06_json_array_scan", "SELECT iu_ac, libelle, lat, lon FROM ref_geo")
def s06(c):
    path = fresh_path(c.spark, "s06")
    _write_sensor_arrays(c, path)
    schema = "iu_ac string, libelle string, geo_point_2d struct<lon: double, lat: double>"
    records = files.read_json_arrays(c.spark, path, schema)
    return records.select("iu_ac", "libelle", "geo_point_2d.lat", "geo_point_2d.lon")


@query("s07_json_flatten", """
 SELECT iu_ac, libelle, lat AS geo_point_2d_lat, lon AS geo_point_2d_lon FROM ref_geo""")
def s07(c):
    path = fresh_path(c.spark, "s07")
    _write_sensor_arrays(c, path)
    schema = "iu_ac string, libelle string, geo_point_2d struct<lon: double, lat: double>"
    return shape.flatten(files.read_json_arrays(c.spark, path, schema), sep="_")


@query("s08_adaptive_scan", """
 SELECT CAST(c_custkey AS STRING) AS c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer""")
def s08(c):
    """First candidate that exists, separator taken from its header line."""
    path = fresh_path(c.spark, "s08")
    out = c.table("customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_acctbal")
    tables.write_delimited(out, path, ",")
    return files.read_first_available(c.spark, [path + "-absent", path], out.schema)


@query("s09_sql_scan", """
 SELECT u.num_acc, u.grav, c.com, c.dep FROM usagers u JOIN caract c ON u.num_acc = c.num_acc
 WHERE c.lum = 3 AND u.grav IN (2, 3)""")
def s09(c):
    return tables.query(c.spark, """
        SELECT u.num_acc, u.grav, c.com, c.dep
        FROM {usagers} u JOIN {caract} c ON u.num_acc = c.num_acc
        WHERE c.lum = 3 AND u.grav IN (2, 3)""", usagers=c.d.usagers, caract=c.d.caract)


@query("s10_table_fallback", """
 SELECT u.num_acc, strftime(c.date_acc, '%Y%m%d') AS aaaammjj, CAST(year(c.date_acc) AS INT) AS annee,
  CAST(month(c.date_acc) AS INT) AS mois, u.grav FROM usagers u JOIN caract c ON u.num_acc = c.num_acc""")
def s10(c):
    """The enriched table is used when complete, otherwise rebuilt from sources."""
    def rebuild():
        dated = c.d.caract.select(
            "num_acc", F.date_format("date_acc", "yyyyMMdd").alias("aaaammjj"),
            F.year("date_acc").alias("annee"), F.month("date_acc").alias("mois"))
        return (c.d.usagers.select("num_acc", "grav").join(dated, "num_acc")
                .select("num_acc", "aaaammjj", "annee", "mois", "grav"))

    return tables.table_or_rebuild(
        c.spark, "asphalta_absent_enriched", ["num_acc", "aaaammjj", "annee", "mois", "grav"], rebuild)


@query("s11_delimited_sink", "SELECT num_acc, com, lat, lon, lum FROM caract")
def s11(c):
    path = fresh_path(c.spark, "s11")
    out = c.d.caract.select("num_acc", "com", "lat", "lon", "lum")
    tables.write_delimited(out, path)
    return files.read_delimited(c.spark, path, out.schema)


@query("s12_replace_table_sink", """
 SELECT com, count(*) AS n FROM caract WHERE dep = '75' GROUP BY com""")
def s12(c):
    """Replace a table by part of itself; an empty frame must not wipe it."""
    table = SnapshotTable(c.spark, fresh_path(c.spark, "s12"))
    tables.replace_table(c.d.caract.select("num_acc", "com", "dep"), table.path)
    tables.replace_table(table.read().where(F.col("dep") == "75").select("num_acc", "com"), table.path)
    tables.replace_table(table.read().where("com IS NULL"), table.path)
    return table.read().groupBy("com").agg(F.count(F.lit(1)).alias("n"))


@query("s13_create_table_as", """
 SELECT annee_semaine, count(*) AS n, count(q_moyen) AS n_trafic, count(meteo_temp_moy) AS n_meteo,
  sum(population)::DOUBLE AS population FROM enrichi GROUP BY annee_semaine""")
def s13(c):
    name = f"asphalta_enriched_{uuid.uuid4().hex}"
    made = tables.create_table_as(c.spark, name, c.star.enriched(), fresh_path(c.spark, "s13"))
    return made.groupBy("annee_semaine").agg(
        F.count(F.lit(1)).alias("n"), F.count("q_moyen").alias("n_trafic"),
        F.count("meteo_temp_moy").alias("n_meteo"), F.sum("population").alias("population"))


@query("s14_export", "SELECT count(*) AS lignes, 32 AS colonnes FROM fait")
def s14(c):
    """Enriched fact with its row ids, exported and counted back."""
    return tables.export_delimited(numbered_fact(c.star.enriched()), fresh_path(c.spark, "s14"))


@query("s15_first_rows", "SELECT num_acc, hrmn, com FROM caract ORDER BY num_acc LIMIT 50")
def s15(c):
    return files.sample_rows(c.d.caract.select("num_acc", "hrmn", "com"), ["num_acc"], 50)


@query("s16_row_counts", """
 SELECT 'FAIT_ACCIDENT' AS table_name, count(*) AS lignes FROM fait
 UNION ALL SELECT 'DIM_DATE', count(*) FROM dim_date
 UNION ALL SELECT 'DIM_GEO', count(DISTINCT geo_key) FROM accidents
 UNION ALL SELECT 'DIM_METEO', count(*) FROM dim_meteo
 UNION ALL SELECT 'DIM_TRAFIC', count(*) FROM dim_trafic
 UNION ALL SELECT 'DIM_POPULATION', count(*) FROM population
 UNION ALL SELECT 'DIM_REFERENTIELGEO', count(*) FROM capteurs""")
def s16(c):
    s = c.star
    return profile.row_counts({
        "FAIT_ACCIDENT": s.fact, "DIM_DATE": s.dim_date, "DIM_GEO": s.dim_geo,
        "DIM_METEO": s.dim_meteo, "DIM_TRAFIC": s.dim_traffic,
        "DIM_POPULATION": s.dim_population, "DIM_REFERENTIELGEO": s.dim_sensor})


def _zip_lots(batches):
    for batch in batches:
        contents = []
        for lot, text in zip(batch["lot"], batch["text"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"releve_{lot}.txt", text)
            data = buffer.getvalue()
            contents.append(data[:len(data) // 2] if lot % 5 == 0 else data)
        yield pd.DataFrame({"path": [f"lot_{n}.zip" for n in batch["lot"]], "content": contents})


@query("s17_archive_expansion", """
 SELECT 'lot_' || CAST(lot AS STRING) || '.zip' AS archive,
  CASE WHEN lot % 5 = 0 THEN 'CORROMPU' ELSE 'OK' END AS statut,
  CASE WHEN lot % 5 = 0 THEN 0 ELSE count(*) END AS lignes
 FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS lot FROM orders) GROUP BY lot""")
def s17(c):
    """ZIP archives of 500 orders each, every fifth cut in half."""
    numbered = with_row_ids(c.table("orders").select("o_orderkey"), ["o_orderkey"], "rang")
    lots = (numbered.select(F.floor((F.col("rang") - 1) / 500).alias("lot"),
                            F.col("o_orderkey").cast("string").alias("v"))
            .groupBy("lot").agg(F.array_join(F.collect_list("v"), "\n").alias("text")))
    archives = lots.mapInPandas(_zip_lots, "path string, content binary")
    return (files.expand_archives(archives).groupBy(F.col("path").alias("archive"), "statut")
            .agg(F.count("value").alias("lignes")))

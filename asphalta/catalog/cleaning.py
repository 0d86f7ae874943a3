"""Projections, filters and schema shaping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions import labels as lb
from ..functions import text as tx
from ..ml import prep
from ..operators import severity, shape
from ..operators.ordered import exact_quantiles
from .registry import query


@query("p01_header_cleanup", "SELECT c_custkey, c_name AS nom_client, c_mktsegment AS segment FROM customer")
def p01(c):
    messy = c.table("customer").select("c_custkey", "c_name", "c_mktsegment").toDF(
        "﻿C_CustKey ", " Nom Client", "Segment ")
    return shape.clean_headers(messy)


@query("p02_alias_columns", """
 SELECT CAST(o_orderkey AS STRING) AS num_acc, o_orderstatus AS dep FROM orders""")
def p02(c):
    raw = c.table("orders").select(F.col("o_orderkey").cast("string"), "o_orderstatus").toDF(
        "Accident_Id", "Département")
    return shape.rename_aliases(raw, {
        "num_acc": ["NumAcc", "num acc", "accident id"], "dep": ["dep", "departement"]})


@query("p03_key_normalisation", """
 SELECT CAST(o_orderkey AS STRING) AS num_acc, o_custkey FROM orders""")
def p03(c):
    raw = c.table("orders").select(
        F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit(".0 ")).alias("Accident_Id"),
        "o_custkey")
    return shape.normalise_key(raw, "num_acc", ["NumAcc", "Accident_Id"])


DIRTY = """CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' nan ' WHEN 2 THEN 'None' WHEN 3 THEN 'NULL'
  WHEN 4 THEN '-1' WHEN 5 THEN ' ' || o_orderstatus || ' ' ELSE o_orderpriority END"""


@query("p04_sentinels_to_null", f"""
 SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 5 THEN o_orderstatus WHEN o_orderkey % 7 = 6 THEN o_orderpriority END AS txt,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS num FROM orders""")
def p04(c):
    raw = c.table("orders").select(
        "o_orderkey", F.expr(DIRTY).alias("txt"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("o_custkey")).alias("num"))
    return shape.sentinels_to_null(raw)


@query("p05_trim_texts", "SELECT s_suppkey, s_name FROM supplier")
def p05(c):
    return shape.trim_texts(c.table("supplier").select(
        "s_suppkey", F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("s_name")))


@query("p06_drop_empty_rows", """
 SELECT * FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS a,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders) WHERE a IS NOT NULL OR b IS NOT NULL""")
def p06(c):
    key = F.col("o_orderkey")
    return shape.drop_all_null_rows(c.table("orders").select(
        F.when(key % 4 != 0, key).alias("a"), F.when(key % 6 != 0, F.col("o_orderstatus")).alias("b")))


@query("p07_drop_null_keys", "SELECT num_acc, lat, lon FROM caract WHERE lat IS NOT NULL AND lon IS NOT NULL")
def p07(c):
    return c.d.caract.select("num_acc", "lat", "lon").na.drop(subset=["lat", "lon"])


@query("p08_department_filter", "SELECT num_acc, com FROM caract WHERE dep = '75'")
def p08(c):
    padded = c.d.caract.withColumn(
        "dep", F.when(F.col("lum") == 2, F.concat(F.lit(" 0"), "dep")).otherwise(F.col("dep")))
    return padded.where(shape.in_department(F.col("dep"), "75")).select("num_acc", "com")


@query("p09_geography_predicate", """
 SELECT o_orderkey, geo_object, geo FROM (SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN 'DEP' WHEN 1 THEN 'ARR' WHEN 2 THEN 'COM' ELSE 'ARM' END AS geo_object,
  CASE o_custkey % 5 WHEN 0 THEN '75' WHEN 1 THEN '751' WHEN 2 THEN '75056' ELSE CAST(75101 + o_custkey % 30 AS STRING) END AS geo
  FROM orders) WHERE (geo_object = 'DEP' AND geo = '75') OR (geo_object = 'ARR' AND geo = '751')
  OR (geo_object = 'COM' AND geo = '75056') OR (geo_object = 'ARM' AND geo BETWEEN '75101' AND '75120')""")
def p09(c):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    zones = c.table("orders").select(
        "o_orderkey",
        F.when(key % 4 == 0, "DEP").when(key % 4 == 1, "ARR").when(key % 4 == 2, "COM")
        .otherwise("ARM").alias("geo_object"),
        F.when(cust % 5 == 0, "75").when(cust % 5 == 1, "751").when(cust % 5 == 2, "75056")
        .otherwise((cust % 30 + 75101).cast("string")).alias("geo"))
    return zones.where(shape.any_of_pairs(F.col("geo_object"), F.col("geo"), shape.paris_codes()))


@query("p10_date_range", """
 SELECT num_poste, date_obs, rr FROM meteo WHERE date_obs BETWEEN DATE '2024-03-01' AND DATE '2024-09-30'""")
def p10(c):
    return c.d.meteo.where(F.col("date_obs").between("2024-03-01", "2024-09-30")).select(
        "num_poste", "date_obs", "rr")


@query("p11_drop_near_empty_columns", "SELECT p_partkey, p_size FROM part")
def p11(c):
    sparse = c.table("part").select(
        "p_partkey", "p_size", F.when(F.col("p_partkey") < 0, F.col("p_name")).alias("presque_vide"))
    return shape.drop_near_empty(sparse)


@query("p12_drop_constant_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def p12(c):
    wide = c.table("orders").select(
        "o_orderkey", "o_totalprice", F.lit(2024).alias("annee"), F.lit(None).cast("double").alias("vide"))
    return wide.select(*shape.informative_columns(wide, wide.columns))


@query("p13_negative_to_null", """
 SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer""")
def p13(c):
    return shape.negatives_to_null(c.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("p14_lenient_cast", """
 SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events""")
def p14(c):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return c.table("events").select("event_id", tx.lenient(text, "double").alias("v"))


@query("p15_typed_quality_columns", """
 SELECT p_partkey, CAST(p_size AS TINYINT) AS QRR, CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 100 END AS TINYINT) AS QTN,
  CAST(p_size AS STRING) AS RR FROM part""")
def p15(c):
    key = F.col("p_partkey")
    text = c.table("part").select(
        "p_partkey", F.col("p_size").cast("string").alias("QRR"),
        F.when(key % 3 == 0, "?").otherwise((key % 100).cast("string")).alias("QTN"),
        F.col("p_size").cast("string").alias("RR"))
    return shape.type_by_prefix(text, "Q", "tinyint")


@query("p16_required_columns", """
 SELECT 'trafic' AS source, 'debit' AS absente, count(*) AS lignes FROM events
 UNION ALL SELECT 'meteo', NULL, count(*) FROM part""")
def p16(c):
    """Which required columns a source lacks, next to its row count."""
    def report(df, name, wanted):
        absent = ", ".join(shape.require_columns(df, wanted)) or None
        return df.agg(F.count(F.lit(1)).alias("lignes")).select(
            F.lit(name).alias("source"), F.lit(absent).cast("string").alias("absente"), "lignes")

    return report(c.d.trafic, "trafic", ["iu_ac", "t_1h", "debit"]).unionAll(
        report(c.d.meteo, "meteo", ["num_poste", "date_obs"]))


@query("p17_bounding_box", """
 SELECT count(*) AS lignes_totales, count(*) FILTER (lat IS NULL OR lon IS NULL) AS coord_manquantes,
  count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat BETWEEN 48.80 AND 48.92 AND lon BETWEEN 2.20 AND 2.50)) AS coord_hors_plage,
  count(*) FILTER (lat BETWEEN 48.80 AND 48.92 AND lon BETWEEN 2.20 AND 2.50) AS coord_valides FROM caract""")
def p17(c):
    inside = geo.in_box(F.col("lat"), F.col("lon"))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return c.d.caract.agg(
        F.count(F.lit(1)).alias("lignes_totales"), F.count_if(~known).alias("coord_manquantes"),
        F.count_if(known & ~inside).alias("coord_hors_plage"), F.count_if(inside).alias("coord_valides"))


@query("p17_out_of_box_examples", """
 SELECT num_acc, lat, lon FROM caract WHERE NOT (lat BETWEEN 48.80 AND 48.92 AND lon BETWEEN 2.20 AND 2.50)
 ORDER BY num_acc LIMIT 5""")
def p17_examples(c):
    outside = ~geo.in_box(F.col("lat"), F.col("lon"))
    return c.d.caract.where(outside).select("num_acc", "lat", "lon").orderBy("num_acc").limit(5)


@query("p18_schema_alignment", """
 SELECT num_acc, CAST(NULL AS INT) AS secu1, CAST(lum AS BIGINT) AS lum, CAST(NULL AS STRING) AS arrondissement FROM caract""")
def p18(c):
    return shape.align(c.d.caract, T.StructType([
        T.StructField("num_acc", T.StringType()), T.StructField("secu1", T.IntegerType()),
        T.StructField("lum", T.LongType()), T.StructField("arrondissement", T.StringType())]))


@query("p19_rain_bands", """
 SELECT condition_pluie, count(*) AS n FROM (SELECT CASE WHEN rr = 0 THEN 'Temps Sec (0 mm)'
  WHEN rr > 0 AND rr <= 5 THEN 'Pluie Léger (0-5 mm)' WHEN rr > 5 THEN 'Pluie Forte (>5 mm)' ELSE 'Inconnu' END AS condition_pluie
  FROM (SELECT CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE rr END AS rr FROM (SELECT p_partkey,
   CASE WHEN p_size <= 25 THEN 0 ELSE CAST(p_size - 25 AS DOUBLE)/2 END AS rr FROM part))) GROUP BY 1""")
def p19(c):
    size = F.col("p_size").cast("double")
    rr = F.when(F.col("p_size") <= 25, F.lit(0.0)).otherwise((size - 25) / 2)
    return (c.table("part").select(lb.rain_band(F.when(F.col("p_partkey") % 13 != 0, rr)).alias("condition_pluie"))
            .groupBy("condition_pluie").agg(F.count(F.lit(1)).alias("n")))


@query("p20_traffic_bands", """
 SELECT niveau_trafic, count(*) AS n FROM (SELECT CASE WHEN q < 500 THEN 'Trafic Fluide (Faible)'
  WHEN q >= 500 AND q <= 1500 THEN 'Trafic Modéré' WHEN q > 1500 THEN 'Trafic Dense / Saturé' ELSE 'Inconnu' END AS niveau_trafic
  FROM (SELECT q * 20 AS q FROM trafic)) GROUP BY 1""")
def p20(c):
    return (c.d.trafic.select(lb.traffic_band(F.col("q") * 20).alias("niveau_trafic"))
            .groupBy("niveau_trafic").agg(F.count(F.lit(1)).alias("n")))


@query("p21_tercile_bands", """
 SELECT niveau_trafic, count(*) AS n FROM (SELECT CASE WHEN q IS NULL THEN 'Inconnu' WHEN q <= b.lo THEN 'Trafic Fluide (Faible)'
  WHEN q <= b.hi THEN 'Trafic Modéré' ELSE 'Trafic Dense / Saturé' END AS niveau_trafic
  FROM trafic, (SELECT quantile_cont(q, 0.33) AS lo, quantile_cont(q, 0.66) AS hi FROM trafic) b) GROUP BY 1""")
def p21(c):
    """Bands at the exact 33 % and 66 % quantiles; two numbers reach the driver."""
    low, high = exact_quantiles(c.d.trafic, [], "q", {"lo": 0.33, "hi": 0.66}).head()
    band = lb.banded(F.col("q"), low, high, lb.TRAFFIC_LABELS, low_closed=True)
    return (c.d.trafic.select(band.alias("niveau_trafic")).groupBy("niveau_trafic")
            .agg(F.count(F.lit(1)).alias("n")))


@query("p22_severity_labels", """
 SELECT libel_gravite, classe_gravite, count(*) AS n FROM (SELECT CASE grav WHEN 1 THEN 'Indemne' WHEN 2 THEN 'Tué'
  WHEN 3 THEN 'Blessé Hospitalisé' WHEN 4 THEN 'Blessé Léger' ELSE 'Inconnu' END AS libel_gravite,
  CASE WHEN grav IN (2,3) THEN 'Grave / Décès' WHEN grav IN (1,4) THEN 'Léger / Indemne' ELSE 'Autre' END AS classe_gravite
  FROM usagers) GROUP BY 1, 2""")
def p22(c):
    g = F.col("grav")
    return (c.d.usagers.select(lb.severity_label(g).alias("libel_gravite"), lb.severity_class(g).alias("classe_gravite"))
            .groupBy("libel_gravite", "classe_gravite").agg(F.count(F.lit(1)).alias("n")))


@query("p23_darkness_flag", """
 SELECT condition_lum, count(*) AS n FROM (SELECT CASE WHEN l IN (2,3,4,5) THEN 1 ELSE 0 END AS condition_lum
  FROM (SELECT CASE WHEN atm = 9 THEN NULL ELSE lum END AS l FROM caract)) GROUP BY 1""")
def p23(c):
    lum = F.when(F.col("atm") != 9, F.col("lum"))
    return (c.d.caract.select(lb.dark(lum).alias("condition_lum")).groupBy("condition_lum")
            .agg(F.count(F.lit(1)).alias("n")))


@query("p24_season", """
 SELECT saison, count(*) AS n FROM (SELECT CASE WHEN month(date_acc) IN (12,1,2) THEN 'Hiver' WHEN month(date_acc) IN (3,4,5) THEN 'Printemps'
  WHEN month(date_acc) IN (6,7,8) THEN 'Été' ELSE 'Automne' END AS saison FROM caract) GROUP BY 1""")
def p24(c):
    return (c.d.caract.select(lb.season(F.month("date_acc")).alias("saison")).groupBy("saison")
            .agg(F.count(F.lit(1)).alias("n")))


@query("p25_code_labels", """
 SELECT jour_semaine, mois_nom, count(*) AS n FROM (SELECT
  (['Lundi','Mardi','Mercredi','Jeudi','Vendredi','Samedi','Dimanche'])[isodow(date_acc)] AS jour_semaine,
  (['Janvier','Février','Mars','Avril','Mai','Juin','Juillet','Août','Septembre','Octobre','Novembre','Décembre'])[month(date_acc)] AS mois_nom
  FROM caract) GROUP BY 1, 2""")
def p25(c):
    day = F.col("date_acc")
    return (c.d.caract.select(lb.coded(F.weekday(day), lb.WEEKDAYS).alias("jour_semaine"),
                              lb.coded(F.month(day), lb.MONTHS).alias("mois_nom"))
            .groupBy("jour_semaine", "mois_nom").agg(F.count(F.lit(1)).alias("n")))


@query("p26_severity_weights", """
 SELECT grav, CAST(CASE grav WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS INT) AS poids_annuel,
  CAST(CASE grav WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS INT) AS poids_zone, count(*) AS n FROM usagers GROUP BY 1, 2, 3""")
def p26(c):
    g = F.col("grav")
    return (c.d.usagers.select(
        "grav", severity.weight(g, lb.WEIGHTS_YEARLY).alias("poids_annuel"),
        F.coalesce(severity.weight(g, lb.WEIGHTS_ZONES), F.lit(0)).alias("poids_zone"))
        .groupBy("grav", "poids_annuel", "poids_zone").agg(F.count(F.lit(1)).alias("n")))


@query("p27_multi_select_filter", """
 SELECT num_acc, annee_hist, lum FROM caract WHERE annee_hist IN (1996, 1998) AND lum IN (1, 3)""")
def p27(c):
    return shape.keep_selected(c.d.caract.select("num_acc", "annee_hist", "lum"),
                               {"annee_hist": [1996, 1998], "lum": [1, 3], "num_acc": []})


@query("p28_feature_selection", """
 SELECT mois, jour_semaine, is_weekend, annee, jour, k_moyen, q_moyen, meteo_precipitations, meteo_temp_max,
  meteo_temp_min, meteo_temp_moy, population FROM enrichi""")
def p28(c):
    enriched = c.star.enriched()
    return enriched.select(*prep.select_features(enriched.columns))


@query("p29_date_reorder", """
 SELECT num_acc, strftime(date_acc, '%Y-%m-%d') || ' ' || hrmn || ':00' AS date, dep FROM caract""")
def p29(c):
    parts = c.d.caract.select(
        "num_acc", F.lit("24").alias("an"), F.month("date_acc").alias("mois"),
        F.day("date_acc").alias("jour"), "hrmn", "dep")
    once = shape.unified_date(parts)
    return shape.unified_date(once)


@query("p30_positive_denominator", """
 SELECT com, n / pop AS taux FROM (SELECT com, count(*)::DOUBLE AS n, max(CASE WHEN com = '75103' THEN 0 ELSE 1000 END) AS pop
  FROM caract GROUP BY com) WHERE pop > 0""")
def p30(c):
    per = c.d.caract.groupBy("com").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("com") == "75103", 0).otherwise(1000)).alias("pop"))
    return per.where(F.col("pop") > 0).select("com", (F.col("n") / F.col("pop")).alias("taux"))


@query("p31_constant_columns", """
 SELECT iu_ac, 2024 AS annee_source, 'hebdomadaire' AS grain_trafic FROM ref_geo""")
def p31(c):
    return c.d.ref_geo.select("iu_ac", F.lit(2024).alias("annee_source"), F.lit("hebdomadaire").alias("grain_trafic"))


@query("p32_drop_columns", "SELECT num_acc, lum FROM caract")
def p32(c):
    return c.d.caract.select("num_acc", "lum", "lat", "lon", F.lit("d").alias("dessin")).drop("lat", "lon", "dessin", "absent")


@query("p33_ordinal_labels", """
 SELECT o_orderkey, CASE WHEN v >= 0.7 THEN 'très forte' WHEN v >= 0.5 THEN 'forte' WHEN v >= 0.3 THEN 'modérée'
  WHEN v >= 0.15 THEN 'faible' ELSE 'très faible' END AS force, CASE WHEN v*20 >= 10 THEN 'PROBLEME' WHEN v*20 >= 5 THEN 'ATTENTION' ELSE 'OK' END AS vif,
  CASE WHEN v < 0.2 THEN 'important' WHEN v < 0.4 THEN 'modéré' ELSE 'équilibré' END AS desequilibre
 FROM (SELECT o_orderkey, (o_orderkey % 100)::DOUBLE / 100 AS v FROM orders)""")
def p33(c):
    v = (F.col("o_orderkey") % 100).cast("double") / 100
    return c.table("orders").select(
        "o_orderkey", lb.threshold_label(v, lb.CORRELATION_STEPS, "très faible").alias("force"),
        lb.threshold_label(v * 20, lb.VIF_STEPS, "OK").alias("vif"), lb.imbalance_label(v).alias("desequilibre"))


ZONES_SQL = """
 WITH points AS (SELECT f.num_acc, min(f.lat) AS lat, min(f.lon) AS lon,
   max(CASE f.grav WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END) AS w FROM fait f
   WHERE f.lat IS NOT NULL AND f.lon IS NOT NULL GROUP BY f.num_acc),
 zones AS (SELECT (CAST(round(lat*10000) AS BIGINT)+50)//100 AS lat_e2, (CAST(round(lon*10000) AS BIGINT)+50)//100 AS lon_e2,
   count(*) AS nb_accidents, count(*) FILTER (w = 4) AS nb_tues, count(*) FILTER (w = 2) AS nb_blesses_hospitalises,
   count(*) FILTER (w = 1) AS nb_blesses_legers, count(*) + 3 * count(*) FILTER (w = 4) + count(*) FILTER (w = 2) AS score_risque
  FROM points GROUP BY 1, 2)"""


def zones(c):
    """Risk zones from persons with the coordinates of their accident."""
    persons = c.d.usagers.select("num_acc", "grav").join(
        c.d.caract.select("num_acc", "lat", "lon"), "num_acc")
    return severity.risk_zones(severity.accidents_on_map(persons))


@query("p34_relative_intensity", ZONES_SQL + """
 SELECT lat_e2, lon_e2, score_risque, CAST(row_number() OVER (ORDER BY score_risque DESC, lat_e2, lon_e2) AS INT) AS rang_risque,
  round(score_risque::DOUBLE / max(score_risque) OVER (), 6) AS intensite,
  CASE WHEN score_risque::DOUBLE / max(score_risque) OVER () > 0.66 THEN 'red'
   WHEN score_risque::DOUBLE / max(score_risque) OVER () > 0.33 THEN 'orange' ELSE 'green' END AS couleur
 FROM (SELECT * FROM zones ORDER BY score_risque DESC, lat_e2, lon_e2 LIMIT 20)""")
def p34(c):
    return severity.top_zones(zones(c)).select(
        "lat_e2", "lon_e2", "score_risque", "rang_risque", F.round("intensite", 6).alias("intensite"), "couleur")


@query("p35_train_order_and_narrowing", """
 SELECT CAST(o_custkey AS INT) AS o_custkey, o_totalprice, CAST(o_orderkey AS INT) AS o_orderkey FROM orders WHERE o_orderkey % 5 = 0""")
def p35(c):
    orders = c.table("orders")
    train = orders.where("o_orderkey % 5 <> 0").select("o_custkey", "o_totalprice", "o_orderkey")
    test = orders.where("o_orderkey % 5 = 0").select("o_orderkey", "o_custkey", "o_totalprice")
    return shape.narrow_longs(test.select(*train.columns))



"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..operators import linking, profile, temporal, traffic, weather
from ..operators.ordered import grouped_medians
from ..plans import star as st
from ..plans.raw import RawDomain
from ..plans.star import Star
from .raw_files import written_raw
from .registry import query


@query("j01_semi_join_keys", """
 SELECT num_acc, voie, surf FROM lieux WHERE num_acc IN (SELECT num_acc FROM caract WHERE dep = '75')""")
def j01(c):
    return linking.semi(c.d.lieux, c.d.caract.where(F.col("dep") == "75"), ["num_acc"])


@query("j02_semi_join_reliable_sensors", """
 SELECT t.fichier_source, t.iu_ac, t.t_1h, t.q, t.k FROM trafic_garde t""")
def j02(c):
    return traffic.reliable_sensors(c.d.trafic).select("fichier_source", "iu_ac", "t_1h", "q", "k")


@query("j03_decode_labels", """
 SELECT n_nationkey, n_regionkey, lib FROM nation LEFT JOIN (
  SELECT r_regionkey, r_name || ' (bis)' AS lib FROM region WHERE r_regionkey <> 3) ON n_regionkey = r_regionkey""")
def j03(c):
    """Code to label; duplicated codes take the later entry, unknown codes give NULL."""
    region = c.table("region").where("r_regionkey <> 3")
    entry = [F.lit("GEO").alias("cod_var"), F.col("r_regionkey").cast("string").alias("cod_mod")]
    meta = (region.select(*entry, F.col("r_name").alias("lib_mod"), F.lit(1).alias("rang"))
            .unionAll(region.select(*entry, F.concat("r_name", F.lit(" (bis)")), F.lit(2)))
            .unionAll(region.select(F.lit("FREQ"), F.col("r_regionkey").cast("string"), F.lit("autre"), F.lit(3))))
    nation = c.table("nation").select(
        "n_nationkey", "n_regionkey", F.col("n_regionkey").cast("string").alias("code"))
    return linking.decode(nation, meta, "GEO", "code", "lib", "rang").select("n_nationkey", "n_regionkey", "lib")


@query("j03_undecoded_count", """
 SELECT count(*) AS total, count(*) FILTER (n_regionkey = 3) AS non_decodes FROM nation""")
def j03_count(c):
    return j03(c).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lib").isNull()).alias("non_decodes"))


def _two_weather_files(c):
    base = c.d.meteo
    other = base.where("rr > 0").select(
        "num_poste", "date_obs", F.lit("Paris").alias("nom_usuel"), (F.col("tx") + 1).alias("tx"),
        F.col("rr").alias("vent"))
    return base, other


@query("j04_marked_left_join", """
 SELECT m.num_poste, m.date_obs, m.rr, m.tx, o.tx_autres, o.vent, o.tx_autres IS NOT NULL AS matched FROM meteo m
 LEFT JOIN (SELECT * FROM (SELECT num_poste, date_obs, tx + 1 AS tx_autres, rr AS vent,
   row_number() OVER (PARTITION BY num_poste, date_obs ORDER BY tx, rr) AS rn FROM meteo WHERE rr > 0) WHERE rn = 1) o
  ON m.num_poste = o.num_poste AND m.date_obs = o.date_obs WHERE m.num_poste = '0'""")
def j04(c):
    main, other = _two_weather_files(c)
    merged = weather.merge_reference(main, other, "0", order=[F.col("tx_autres"), F.col("vent")])
    return merged.select("num_poste", "date_obs", "rr", "tx", "tx_autres", "vent", "matched")


@query("j04_match_summary", """
 SELECT count(*) AS lignes_avant, count(*) FILTER (hit) AS lignes_matchees, count(*) FILTER (hit) * 100.0::DOUBLE / count(*) AS taux_match
 FROM (SELECT (num_poste, date_obs) IN (SELECT (num_poste, date_obs) FROM meteo WHERE rr > 0) AS hit FROM meteo WHERE num_poste = '0')""")
def j04_summary(c):
    return linking.match_summary(j04(c))


@query("j05_person_accident_join", """
 SELECT u.num_acc, u.num_veh, u.place, u.grav, c.com, c.lum FROM usagers u JOIN caract c ON u.num_acc = c.num_acc""")
def j05(c):
    return c.d.usagers.join(c.d.caract, "num_acc").select("num_acc", "num_veh", "place", "grav", "com", "lum")


@query("j06_vehicle_left_join", """
 SELECT u.num_acc, u.num_veh, u.place, v.catv FROM usagers u LEFT JOIN vehicules v ON u.num_acc = v.num_acc AND u.num_veh = v.num_veh
  AND v.catv < 30""")
def j06(c):
    vehicles = c.d.vehicules.where("catv < 30")
    return linking.left_lookup(c.d.usagers, vehicles, ["num_acc", "num_veh"], ["catv"]).select(
        "num_acc", "num_veh", "place", "catv")


ENRICHED_SQL = """
 SELECT num_acc, id_usager, aaaammjj, com, iu_ac, grav, date, annee, mois, jour, jour_semaine, is_weekend, annee_semaine,
  round(q_total, 4) AS q_total, round(q_moyen, 6) AS q_moyen, round(k_moyen, 6) AS k_moyen, meteo_precipitations,
  meteo_temp_min, meteo_temp_max, meteo_temp_moy, population, population_annee, catv FROM enrichi"""


def enriched_columns(star):
    return star.enriched().select(
        "num_acc", "id_usager", "aaaammjj", "com", "iu_ac", "grav", "date", "annee", "mois", "jour",
        "jour_semaine", "is_weekend", "annee_semaine", F.round("q_total", 4).alias("q_total"),
        F.round("q_moyen", 6).alias("q_moyen"), F.round("k_moyen", 6).alias("k_moyen"),
        "meteo_precipitations", "meteo_temp_min", "meteo_temp_max", "meteo_temp_moy",
        "population", "population_annee", "catv")


@query("j07_star_enrichment", ENRICHED_SQL)
def j07(c):
    return enriched_columns(c.star)


# Rows that a raw file repeats count once; such rows agree in every column of the fact.
@query("j07_from_raw_files", ENRICHED_SQL.replace("FROM enrichi", "FROM (SELECT DISTINCT * FROM enrichi)"))
def j07_raw(c):
    """The same from raw files: registry, sensors, weather and census are written as they come and read back."""
    return enriched_columns(Star(RawDomain(c.spark, written_raw(c), department=None)))


@query("j08_exact_place_lookup", """
 SELECT a.num_acc, e.iu_ac FROM accidents a LEFT JOIN (SELECT geo_key, min(iu_ac) AS iu_ac FROM capteurs GROUP BY geo_key) e
  ON a.geo_key = e.geo_key""")
def j08(c):
    start = c.star.accidents.select("num_acc", "geo_key", F.lit(None).cast("string").alias("iu_ac"))
    sensors = c.star.dim_sensor.select("geo_key", "iu_ac")
    return linking.fill_from(start, sensors, ["geo_key"], "iu_ac").select("num_acc", "iu_ac")


@query("j09_grid_place_lookup", "SELECT num_acc, iu_ac FROM localises")
def j09(c):
    """Exact place first, then the ~1 km cell, each an equality join."""
    return st.assign_sensor(c.star.accidents, c.star.dim_sensor).select("num_acc", "iu_ac")


@query("j10_fact_weather_inner", """
 SELECT f.num_acc, f.id_usager, f.aaaammjj, f.grav, m.rr, m.tm FROM fait f JOIN dim_meteo m ON f.aaaammjj = m.aaaammjj""")
def j10(c):
    return (c.star.fact.join(c.star.dim_meteo, "aaaammjj")
            .select("num_acc", "id_usager", "aaaammjj", "grav", "rr", "tm"))


@query("j11_text_key_left_join", """
 SELECT f.num_acc, f.aaaammjj, m.tm, m.rr FROM accidents f LEFT JOIN dim_meteo m ON f.aaaammjj = m.aaaammjj""")
def j11(c):
    """Keys of different types meet as text, cast once on the small side."""
    numeric = c.star.dim_meteo.withColumn("aaaammjj", F.col("aaaammjj").cast("int"))
    as_text = numeric.withColumn("aaaammjj", F.col("aaaammjj").cast("string"))
    return c.star.accidents.join(as_text, "aaaammjj", "left").select("num_acc", "aaaammjj", "tm", "rr")


@query("j12_coordinates_left_join", """
 SELECT f.num_acc, f.geo_key, f.grav, g.lat, g.lon FROM fait f LEFT JOIN
  (SELECT geo_key, min(lat) AS lat, min(lon) AS lon FROM accidents GROUP BY geo_key) g ON f.geo_key = g.geo_key
 WHERE f.geo_key IS NOT NULL""")
def j12(c):
    placed = c.star.persons.where(F.col("geo_key").isNotNull()).select("num_acc", "geo_key", "grav")
    return placed.join(c.star.dim_geo.select("geo_key", "lat", "lon"), "geo_key", "left")


@query("j13_date_fallback_join", """
 SELECT a.num_acc, CASE WHEN c.lum = 2 THEN NULL ELSE CAST(split_part(c.hrmn, ':', 1) AS INT) END AS heure,
  CASE WHEN c.lum = 2 THEN a.date_acc ELSE CAST(c.date_acc + 1 AS DATE) END AS date_jour
 FROM accidents a JOIN caract c ON a.num_acc = c.num_acc""")
def j13(c):
    """Registry date and hour, the fact's own date where the registry has none."""
    registry = c.d.caract.where("lum <> 2").select(
        "num_acc", F.date_add("date_acc", 1).alias("date"), dt.clock_hour(F.col("hrmn")).alias("heure"))
    accidents = c.star.accidents.select("num_acc", "aaaammjj")
    return temporal.dated_accidents(accidents, registry).select("num_acc", "heure", "date_jour")


@query("j14_key_match_rates", """
 WITH p AS (
  SELECT 'caract' AS source_a, 'lieux' AS source_b, 'num_acc' AS cle, num_acc AS k, 1 AS side FROM caract
  UNION ALL SELECT 'caract', 'lieux', 'num_acc', num_acc, 2 FROM lieux
  UNION ALL SELECT 'caract', 'meteo', 'aaaammjj', CAST(date_acc AS STRING), 1 FROM caract
  UNION ALL SELECT 'caract', 'meteo', 'aaaammjj', CAST(date_obs AS STRING), 2 FROM meteo WHERE rr > 0
  UNION ALL SELECT 'trafic', 'ref_geo', 'iu_ac', iu_ac, 1 FROM trafic
  UNION ALL SELECT 'trafic', 'ref_geo', 'iu_ac', iu_ac, 2 FROM ref_geo
  UNION ALL SELECT 'caract', 'ref_geo', 'geo_key', geo_key, 1 FROM accidents WHERE geo_key IS NOT NULL
  UNION ALL SELECT 'caract', 'ref_geo', 'geo_key', geo_key, 2 FROM capteurs),
 h AS (SELECT *, bool_or(side = 1) OVER (PARTITION BY source_a, source_b, cle, k) AS in_a,
   bool_or(side = 2) OVER (PARTITION BY source_a, source_b, cle, k) AS in_b FROM p)
 SELECT source_a, source_b, cle, round(avg(CASE WHEN side = 1 THEN CASE WHEN in_b THEN 100.0::DOUBLE ELSE 0 END END), 6) AS taux_match_a_vers_b,
  round(avg(CASE WHEN side = 2 THEN CASE WHEN in_a THEN 100.0::DOUBLE ELSE 0 END END), 6) AS taux_match_b_vers_a FROM h GROUP BY 1, 2, 3""")
def j14(c):
    d, s = c.d, c.star
    day = F.col("date_obs").cast("string")
    rates = [
        linking.key_match_rate(d.caract, d.lieux, F.col("num_acc"), F.col("num_acc"), "caract", "lieux", "num_acc"),
        linking.key_match_rate(d.caract, d.meteo.where("rr > 0"), F.col("date_acc"), day, "caract", "meteo", "aaaammjj"),
        linking.key_match_rate(d.trafic, d.ref_geo, F.col("iu_ac"), F.col("iu_ac"), "trafic", "ref_geo", "iu_ac"),
        linking.key_match_rate(s.accidents, s.dim_sensor, F.col("geo_key"), F.col("geo_key"), "caract", "ref_geo", "geo_key")]
    out = rates[0]
    for r in rates[1:]:
        out = out.unionAll(r)
    return out.select("source_a", "source_b", "cle", F.round("taux_match_a_vers_b", 6).alias("taux_match_a_vers_b"),
                      F.round("taux_match_b_vers_a", 6).alias("taux_match_b_vers_a"))


@query("j15_group_median_back", """
 SELECT t.fichier_source, t.iu_ac, t.t_1h, round(coalesce(t.q, s.q_median), 6) AS q FROM trafic t
 JOIN capteur_stats s ON t.fichier_source = s.fichier_source AND t.iu_ac = s.iu_ac""")
def j15(c):
    keys = ["fichier_source", "iu_ac"]
    readings = c.d.trafic
    medians = grouped_medians(readings, keys, {"q": "q_median"})
    return readings.join(medians, keys, "left").select(
        *keys, "t_1h", F.round(F.coalesce("q", "q_median"), 6).alias("q"))


@query("j16_holiday_membership", """
 SELECT c.num_acc, c.date_acc AS date_jour, f.nom IS NOT NULL AS jour_ferie, f.nom AS nom_jour_ferie FROM caract c LEFT JOIN
  (SELECT date_jour, string_agg(nom, '; ' ORDER BY nom) AS nom FROM feries GROUP BY date_jour) f ON c.date_acc = f.date_jour""")
def j16(c):
    days = c.d.caract.select("num_acc", F.col("date_acc").alias("date_jour"))
    return temporal.with_holidays(days, dt.holidays_of(days, "date_jour")).select(
        "num_acc", "date_jour", "jour_ferie", "nom_jour_ferie")


@query("j17_dictionary_enrichment", """
 SELECT variable, nb_valeurs, CASE variable WHEN 'iu_ac' THEN 'OUI - identifiant tronçon / arc' ELSE '' END AS cle_jointure,
  CASE variable WHEN 'q' THEN 'véhicules/heure' WHEN 'k' THEN '%' ELSE '' END AS unite,
  CASE variable WHEN 'iu_ac' THEN 'Identifiant de l''arc ou du tronçon routier' WHEN 'q' THEN 'Débit de circulation'
   WHEN 'k' THEN 'Taux d''occupation du trafic' WHEN 't_1h' THEN 'Horodatage de la mesure de trafic' ELSE '' END AS description
 FROM (SELECT unnest(['iu_ac','t_1h','q','k','fichier_source']) AS variable), (SELECT count(*) AS nb_valeurs FROM trafic)""")
def j17(c):
    dictionary = profile.data_dictionary(c.d.trafic, "trafic", "trafic.txt")
    return profile.enrich_dictionary(dictionary).select(
        "variable", "nb_valeurs", "cle_jointure", "unite", "description")


@query("j18_split_overlap", """
 SELECT count(*) AS communs FROM (SELECT num_acc FROM lieux WHERE surf < 3 INTERSECT SELECT num_acc FROM lieux WHERE surf >= 3)""")
def j18(c):
    """Accidents present on both sides of a row split."""
    low, high = c.d.lieux.where("surf < 3"), c.d.lieux.where("surf >= 3")
    return linking.common_keys(low, high, "num_acc").agg(F.count(F.lit(1)).alias("communs"))



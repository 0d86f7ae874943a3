"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import labels as lb
from ..operators import profile, severity, temporal, traffic, weather
from .cleaning import ZONES_SQL, zones
from .registry import query


def rounded(df, n, *names):
    return df.withColumns({c: F.round(c, n) for c in names})


@query("a01_sensor_statistics", """
 SELECT fichier_source, iu_ac, round(q_missing_rate, 6) AS q_missing_rate, round(q_median, 6) AS q_median,
  round(k_median, 6) AS k_median FROM capteur_stats""")
def a01(c):
    return rounded(traffic.sensor_statistics(c.d.trafic), 6, "q_missing_rate", "q_median", "k_median")


@query("a02_sensor_week_aggregate", """
 SELECT fichier_source, iu_ac, round(q_total, 4) AS q_total, round(q_moyen, 6) AS q_moyen, round(k_moyen, 6) AS k_moyen,
  nb_heures, round(q_missing_rate, 6) AS q_missing_rate, round(k_missing_rate, 6) AS k_missing_rate, t_debut, t_fin FROM trafic_hebdo""")
def a02(c):
    weekly = rounded(traffic.weekly_aggregate(c.d.trafic), 6, "q_moyen", "k_moyen", "q_missing_rate", "k_missing_rate")
    return weekly.withColumn("q_total", F.round("q_total", 4))


@query("a03_iso_week_means", """
 SELECT iu_ac, annee_semaine, round(q_total, 4) AS q_total, round(q_moyen, 6) AS q_moyen, round(k_moyen, 6) AS k_moyen,
  'hebdomadaire' AS grain_trafic FROM dim_trafic""")
def a03(c):
    dim = traffic.traffic_dimension(traffic.weekly_aggregate(c.d.trafic))
    return rounded(dim, 6, "q_moyen", "k_moyen").withColumn("q_total", F.round("q_total", 4))


@query("a04_station_completeness", """
 SELECT num_poste, nb_jours, date_min, date_max, round(p_rr, 6) AS pct_manquant_rr, round(p_tm, 6) AS pct_manquant_tm,
  CAST(date_diff('day', date_min, date_max) + 1 AS INT) AS duree_couverture_jours,
  round(nb_jours::DOUBLE / (date_diff('day', date_min, date_max) + 1), 6) AS taux_completude FROM (
  SELECT num_poste, count(date_obs) AS nb_jours, min(date_obs) AS date_min, max(date_obs) AS date_max,
   avg(CASE WHEN rr IS NULL THEN 100.0::DOUBLE ELSE 0 END) AS p_rr, avg(CASE WHEN tm IS NULL THEN 100.0::DOUBLE ELSE 0 END) AS p_tm
  FROM meteo_jour GROUP BY num_poste)""")
def a04(c):
    daily = weather.one_row_per_day(c.d.meteo, [F.col(x) for x in ("rr", "tn", "tx", "tm")])
    return rounded(weather.station_completeness(daily, ["rr", "tm"]), 6,
                   "pct_manquant_rr", "pct_manquant_tm", "taux_completude")


@query("a05_lanes_per_accident", """
 SELECT num_acc, count(*) AS nb_voies_intersection, count(*) > 1 AS intersection FROM lieux GROUP BY num_acc""")
def a05(c):
    lanes = c.d.lieux.groupBy("num_acc").agg(F.count(F.lit(1)).alias("nb_voies_intersection"))
    return lanes.withColumn("intersection", F.col("nb_voies_intersection") > 1)


@query("a06_worst_person", """
 SELECT num_acc, num_veh, place, grav, poids FROM (SELECT *, row_number() OVER (PARTITION BY num_acc
   ORDER BY poids DESC NULLS LAST, num_veh, place, catu) AS rn FROM (SELECT *, CAST(CASE grav WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS INT) AS poids
   FROM usagers)) WHERE rn = 1""")
def a06(c):
    worst = severity.worst_rows(c.d.usagers, ["num_acc"], lb.WEIGHTS_YEARLY, ["num_veh", "place", "catu"])
    return worst.select("num_acc", "num_veh", "place", "grav", "poids")


@query("a07_any_severe", """
 SELECT num_acc, min(aaaammjj) AS aaaammjj, bool_or(coalesce(grav IN (2,3), false)) AS est_grave FROM fait GROUP BY num_acc""")
def a07(c):
    return severity.any_severe(c.star.persons, ["num_acc"], ["aaaammjj"])


@query("a08_heaviest_and_place", """
 SELECT num_acc, min(lat) AS lat, min(lon) AS lon, CAST(max(CASE grav WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END) AS INT) AS poids_gravite
 FROM fait WHERE lat IS NOT NULL GROUP BY num_acc""")
def a08(c):
    persons = c.d.usagers.join(c.d.caract.select("num_acc", "lat", "lon"), "num_acc")
    return severity.accidents_on_map(persons)


@query("a09_yearly_evolution", """
 SELECT c.annee_hist AS annee, count(*) AS nb_accidents, count(*) FILTER (p.grav = 2) AS nb_tues,
  count(*) FILTER (p.grav = 3) AS nb_blesses_hospitalises, count(*) FILTER (p.grav = 4) AS nb_blesses_legers,
  round(count(*) FILTER (p.grav IN (2,3)) * 100.0::DOUBLE / count(*), 2) AS taux_gravite_pct
 FROM caract c JOIN pire p ON c.num_acc = p.num_acc WHERE c.dep = '75' AND p.grav IS NOT NULL GROUP BY 1""")
def a09(c):
    known = c.d.usagers.where(F.col("grav").isin(1, 2, 3, 4))
    worst = severity.worst_severity(known, ["num_acc"], lb.WEIGHTS_YEARLY)
    paris = c.d.caract.where(F.col("dep").try_cast("int") == 75).select("num_acc", F.col("annee_hist").alias("annee"))
    return severity.yearly_evolution(paris.join(worst, "num_acc"))


@query("a10_risk_zones", ZONES_SQL + " SELECT * FROM zones")
def a10(c):
    return zones(c)


HOURLY = """SELECT {k}, count(*) AS nb_accidents, avg(CASE WHEN est_grave THEN 100.0::DOUBLE ELSE 0 END) AS taux FROM acc_temps {w} GROUP BY 1"""


def accident_times(c):
    """Accident grain with day, hour and labels."""
    acc = severity.any_severe(c.d.usagers, ["num_acc"])
    day = c.d.caract.select("num_acc", F.col("date_acc").alias("date_jour"),
                            dt.clock_hour(F.col("hrmn")).alias("heure"), F.month("date_acc").alias("mois"))
    return temporal.with_calendar_labels(acc.join(day, "num_acc"))


@query("a11_by_hour", f"""
 SELECT CAST(h AS INT) AS heure, coalesce(nb_accidents, 0) AS nb_accidents, round(coalesce(taux, 0), 6) AS taux_grave_pct
 FROM (SELECT unnest(range(24)) AS h) LEFT JOIN ({HOURLY.format(k='heure', w='')}) a ON h = a.heure""")
def a11(c):
    """All 24 hours; an hour without accidents counts 0."""
    return rounded(temporal.by_hour(accident_times(c)), 6, "taux_grave_pct").drop("position")


@query("a12_by_weekday", f"""
 SELECT CAST(d - 1 AS INT) AS position, (['Lundi','Mardi','Mercredi','Jeudi','Vendredi','Samedi','Dimanche'])[d] AS jour_semaine,
  nb_accidents, round(taux, 6) AS taux_grave_pct FROM (SELECT unnest(range(1, 8)) AS d) LEFT JOIN ({HOURLY.format(k='dow', w='')}) a ON d = a.dow""")
def a12(c):
    """Seven weekdays in order; a day without accidents stays NULL."""
    return rounded(temporal.by_weekday(accident_times(c)), 6, "taux_grave_pct")


@query("a13_week_and_weekend", f"""
 SELECT CASE WHEN w THEN 'Week-end' ELSE 'Semaine' END AS periode, nb_accidents, round(taux, 6) AS taux_grave_pct FROM ({HOURLY.format(k='dow >= 6 AS w', w='')})""")
def a13(c):
    return rounded(temporal.by_weekend(accident_times(c)), 6, "taux_grave_pct")


@query("a14_by_month", f"""
 SELECT mois, (['Janvier','Février','Mars','Avril','Mai','Juin','Juillet','Août','Septembre','Octobre','Novembre','Décembre'])[mois] AS mois_nom,
  nb_accidents, round(taux, 6) AS taux_grave_pct FROM ({HOURLY.format(k='mois', w='')})""")
def a14(c):
    return rounded(temporal.by_month(accident_times(c)), 6, "taux_grave_pct")


@query("a15_by_season", f"""
 SELECT CAST(s AS INT) AS position, (['Hiver','Printemps','Été','Automne'])[s + 1] AS saison, nb_accidents, round(taux, 6) AS taux_grave_pct
 FROM (SELECT unnest(range(4)) AS s) LEFT JOIN ({HOURLY.format(k='(mois % 12) // 3 AS k', w='')}) a ON s = a.k""")
def a15(c):
    return rounded(temporal.by_season(accident_times(c)), 6, "taux_grave_pct")


@query("a16_holiday_effect", """
 SELECT CASE WHEN a.f THEN 'Jour férié' ELSE 'Jour ordinaire' END AS type_jour, a.n AS nb_accidents, round(a.t, 2) AS taux_grave_pct,
  b.n AS nombre_jours, round(a.n::DOUBLE / b.n, 2) AS accidents_par_jour
 FROM (SELECT date_jour IN (SELECT date_jour FROM feries) AS f, count(*) AS n, avg(CASE WHEN est_grave THEN 100.0::DOUBLE ELSE 0 END) AS t
  FROM acc_temps GROUP BY 1) a
 JOIN (SELECT j IN (SELECT date_jour FROM feries) AS f, count(*) AS n FROM (
   SELECT CAST(unnest(range(min(date_jour), max(date_jour) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS j FROM acc_temps) GROUP BY 1) b ON a.f = b.f""")
def a16(c):
    return temporal.holiday_effect(accident_times(c), dt.holidays_of(c.d.caract, "date_acc"))


RATES_SQL = """SELECT c.com, count(*) AS nb_accidents, count(*) FILTER (p.grav = 2) AS nb_tues,
  count(*) FILTER (p.grav = 3) AS nb_blesses_hospitalises, max(pop.obs_value) AS population,
  round(count(*) * 100000.0::DOUBLE / max(pop.obs_value), 2) AS taux_accidents_pour_100k,
  round(count(*) FILTER (p.grav = 2) * 100000.0::DOUBLE / max(pop.obs_value), 2) AS taux_tues_pour_100k,
  round(count(*) FILTER (p.grav IN (2,3)) * 100000.0::DOUBLE / max(pop.obs_value), 2) AS taux_graves_pour_100k
 FROM caract c JOIN pire p ON c.num_acc = p.num_acc LEFT JOIN population pop ON c.com = pop.com
 WHERE c.dep = '75' GROUP BY c.com HAVING max(pop.obs_value) > 0"""


def commune_rates(c):
    """Persons are reduced to one row per accident before anything is joined."""
    worst = severity.worst_severity(c.d.usagers, ["num_acc"], lb.WEIGHTS_YEARLY)
    paris = c.d.caract.where(F.col("dep") == "75").select("num_acc", "com")
    people = c.star.dim_population.select("com", F.col("obs_value").alias("population"))
    return severity.rates_per_100k(paris.join(worst, "num_acc"), people)


@query("a17_rates_per_100k", RATES_SQL)
def a17(c):
    return commune_rates(c)


@query("a18_key_figures", """
 SELECT count(DISTINCT num_acc) AS nb_accidents, count(*) FILTER (grav = 2) AS nb_tues, count(*) FILTER (grav = 3) AS nb_hospitalises,
  round(count(*) FILTER (grav IN (2,3)) * 100.0::DOUBLE / count(*), 2) AS taux_gravite_pct FROM fait""")
def a18(c):
    return severity.key_figures(c.star.persons)


@query("a19_accidents_by_year", """
 SELECT c.annee_hist, count(DISTINCT u.num_acc) AS nb_accidents FROM usagers u JOIN caract c ON u.num_acc = c.num_acc GROUP BY 1""")
def a19(c):
    persons = c.d.usagers.select("num_acc").join(c.d.caract.select("num_acc", "annee_hist"), "num_acc")
    return severity.distinct_accidents_by(persons, "annee_hist")


@query("a19_accidents_by_month", """
 SELECT CAST(month(c.date_acc) AS INT) AS mois, count(DISTINCT u.num_acc) AS nb_accidents FROM usagers u JOIN caract c ON u.num_acc = c.num_acc GROUP BY 1""")
def a19_month(c):
    months = c.d.caract.select("num_acc", F.month("date_acc").alias("mois"))
    return severity.distinct_accidents_by(c.d.usagers.select("num_acc").join(months, "num_acc"), "mois")


@query("a31_column_profile", """
 WITH s AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer),
 top AS (SELECT string_agg(v || ' (' || CAST(n AS STRING) || ')', '; ' ORDER BY n DESC, v) AS t FROM
  (SELECT c_mktsegment AS v, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, v LIMIT 3)),
 p AS (SELECT 'c_custkey' AS colonne, 'bigint' AS type, count(c_custkey) AS nb_valeurs, count(*) AS n, count(DISTINCT c_custkey) AS nb_uniques,
   min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max, avg(c_custkey) AS m, median(c_custkey) AS d, stddev_samp(c_custkey) AS e, NULL AS t FROM s
  UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey), count(*), count(DISTINCT c_nationkey), min(c_nationkey), max(c_nationkey),
   avg(c_nationkey), median(c_nationkey), stddev_samp(c_nationkey), NULL FROM s
  UNION ALL SELECT 'c_acctbal', 'double', count(c_acctbal), count(*), count(DISTINCT c_acctbal), min(c_acctbal), max(c_acctbal),
   avg(c_acctbal), median(c_acctbal), stddev_samp(c_acctbal), NULL FROM s
  UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment), count(*), count(DISTINCT c_mktsegment), NULL, NULL, NULL, NULL, NULL, (SELECT t FROM top) FROM s)
 SELECT colonne, type, nb_valeurs, n - nb_valeurs AS nb_manquants, round((n - nb_valeurs) * 100.0::DOUBLE / n, 2) AS pct_manquants, nb_uniques,
  min, max, round(m, 3) AS moyenne, round(d, 6) AS mediane, round(e, 3) AS ecart_type, t AS top_3_valeurs FROM p""")
def a31(c):
    frame = _profiled(c)
    return rounded(profile.column_profile(frame), 6, "mediane").drop("nb_lignes")


def _profiled(c):
    return c.table("customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")


@query("a32_dataset_summary", """
 SELECT 'customer' AS dataset, count(*) AS nb_lignes, 4::BIGINT AS nb_colonnes,
  (count(*) FILTER (c_acctbal < 0) > 0)::BIGINT AS colonnes_avec_manquants,
  (count(DISTINCT c_custkey) = count(*))::BIGINT AS colonnes_100pct_uniques FROM customer""")
def a32(c):
    return profile.dataset_summary(profile.column_profile(_profiled(c)), "customer")


@query("a33_data_dictionary", """
 WITH t AS (SELECT iu_ac, t_1h, q FROM trafic)
 SELECT 'trafic' AS source, 'releve.txt' AS fichier, 'iu_ac' AS variable, 'texte' AS type, count(*) AS nb_valeurs, count(*) - count(iu_ac) AS nb_manquantes,
  round((count(*) - count(iu_ac)) * 100.0::DOUBLE / count(*), 2) AS pct_manquantes, min(iu_ac) AS exemple FROM t
 UNION ALL SELECT 'trafic', 'releve.txt', 't_1h', 'date', count(*), count(*) - count(t_1h), round((count(*) - count(t_1h)) * 100.0::DOUBLE / count(*), 2),
  strftime(min(t_1h), '%Y-%m-%d %H:%M:%S') FROM t
 UNION ALL SELECT 'trafic', 'releve.txt', 'q', 'numerique', count(*), count(*) - count(q), round((count(*) - count(q)) * 100.0::DOUBLE / count(*), 2),
  CAST(min(q) AS STRING) FROM t""")
def a33(c):
    return profile.data_dictionary(c.d.trafic.select("iu_ac", "t_1h", "q"), "trafic", "releve.txt")


@query("a34_duplicate_counts", """
 SELECT 'lieux' AS source, (SELECT count(*) FROM lieux) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lieux)) AS doublons_totaux,
  (SELECT count(*) - count(DISTINCT num_acc) FROM lieux) AS doublons_cle
 UNION ALL SELECT 'meteo', (SELECT count(*) FROM meteo) - (SELECT count(*) FROM (SELECT DISTINCT * FROM meteo)),
  (SELECT count(*) FROM meteo) - (SELECT count(*) FROM (SELECT DISTINCT num_poste, date_obs FROM meteo))""")
def a34(c):
    return profile.duplicate_counts(c.d.lieux, ["num_acc"], "lieux").unionAll(
        profile.duplicate_counts(c.d.meteo, ["num_poste", "date_obs"], "meteo"))


@query("a35_before_after", """
 SELECT 'caract' AS source, count(*) AS lignes_raw, 11 AS colonnes_raw, count(*) FILTER (dep = '75') AS lignes_curated, 10 AS colonnes_curated,
  round(count(*) FILTER (dep = '75') * 100.0::DOUBLE / count(*), 1) AS pct_lignes_conservees FROM caract
 UNION ALL SELECT 'meteo', count(*), 6, (SELECT count(*) FROM meteo_jour), 6, round((SELECT count(*) FROM meteo_jour) * 100.0::DOUBLE / count(*), 1) FROM meteo""")
def a35(c):
    paris = c.d.caract.where("dep = '75'").drop("dep")
    daily = weather.one_row_per_day(c.d.meteo, [F.col(x) for x in ("rr", "tn", "tx", "tm")])
    return profile.before_after(c.d.caract, paris, "caract").unionAll(
        profile.before_after(c.d.meteo, daily, "meteo"))


@query("a36_grain_check", """
 SELECT (SELECT count(*) FROM fait) AS n_fait, (SELECT count(*) FROM enrichi) AS n_enrichi, (SELECT count(*) FROM enrichi) AS n_distinct_id,
  (SELECT count(*) FROM fait) = (SELECT count(*) FROM enrichi) AS grain_ok""")
def a36(c):
    from ..plans.star import numbered_fact

    numbered = numbered_fact(c.star.fact)
    return profile.grain_check(numbered, c.star.with_context(numbered), "id_fait")


@query("a36_duplicated_ids", "SELECT num_acc, count(*) AS n FROM lieux GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, num_acc LIMIT 5")
def a36_ids(c):
    return profile.duplicated_ids(c.d.lieux, "num_acc")


@query("a37_key_cardinality", """
 SELECT 'DIM_METEO' AS dimension, 'aaaammjj' AS cle, count(*) AS lignes, 0::BIGINT AS cles_dupliquees, 'unique' AS statut FROM dim_meteo
 UNION ALL SELECT 'DIM_TRAFIC', 'iu_ac, annee_semaine', count(*), 0, 'unique' FROM dim_trafic
 UNION ALL SELECT 'meteo', 'num_poste, date_obs', sum(n)::BIGINT, count(*) FILTER (n > 1), CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'unique' ELSE 'dupliquée' END
  FROM (SELECT count(*) AS n FROM meteo GROUP BY num_poste, date_obs)""")
def a37(c):
    s = c.star
    return (profile.key_cardinality(s.dim_meteo, ["aaaammjj"], "DIM_METEO")
            .unionAll(profile.key_cardinality(s.dim_traffic, ["iu_ac", "annee_semaine"], "DIM_TRAFIC"))
            .unionAll(profile.key_cardinality(c.d.meteo, ["num_poste", "date_obs"], "meteo")))


FILLED = ("annee_semaine", "q_total", "q_moyen", "k_moyen", "meteo_precipitations", "meteo_temp_moy", "com", "population")


@query("a38_fill_rates", " UNION ALL ".join(
    f"SELECT '{x}' AS colonne, count({x}) AS renseignees, count(*) AS total, round(count({x}) * 100.0::DOUBLE / count(*), 6) AS pct FROM enrichi"
    for x in FILLED))
def a38(c):
    return rounded(profile.fill_rates(c.star.enriched(), FILLED), 6, "pct")


ANOMALY_SQL = """
 WITH src AS (SELECT num_acc, dep, lat, CASE WHEN lum = 5 THEN NULL ELSE col END AS col,
   CASE WHEN atm = 9 THEN 13 ELSE CAST(month(date_acc) AS INT) END AS mois FROM caract
  UNION ALL SELECT num_acc, dep, lat, col, 1 FROM caract WHERE lum = 1),
 journal AS (
  SELECT 'COLONNE_MANQUANTE' AS categorie, 'ERROR' AS niveau, 'long' AS detail, 1::BIGINT AS nb, NULL::DOUBLE AS pct
  UNION ALL SELECT 'DOUBLONS', 'WARNING', 'clé num_acc', count(*) - count(DISTINCT num_acc), NULL FROM src
  UNION ALL SELECT 'VALEURS_MANQUANTES', 'WARNING', 'colonne lat', count(*) FILTER (lat IS NULL), count(*) FILTER (lat IS NULL) * 100.0::DOUBLE / count(*)
   FROM src HAVING count(*) FILTER (lat IS NULL) * 100.0::DOUBLE / count(*) >= 5
  UNION ALL SELECT 'VALEURS_MANQUANTES', 'WARNING', 'colonne col', count(*) FILTER (col IS NULL), count(*) FILTER (col IS NULL) * 100.0::DOUBLE / count(*)
   FROM src HAVING count(*) FILTER (col IS NULL) * 100.0::DOUBLE / count(*) >= 5
  UNION ALL SELECT 'DATE', 'WARNING', 'dates invalides', count(*) FILTER (mois = 13), NULL FROM src)"""


def _anomalies(c):
    parts = [F.lit("24").alias("an"), F.lit(15).alias("jour")]
    base = c.d.caract.select(
        "num_acc", "dep", "lat", F.when(F.col("lum") != 5, F.col("col")).alias("col"),
        F.when(F.col("atm") == 9, 13).otherwise(F.month("date_acc")).alias("mois"), *parts)
    again = c.d.caract.where("lum = 1").select("num_acc", "dep", "lat", "col", F.lit(1).alias("mois"), *parts)
    return profile.anomaly_log(base.unionAll(again), "caracteristiques.csv", "num_acc",
                               ["num_acc", "dep", "lat", "long"], ("an", "mois", "jour"))


@query("a39_anomaly_log", ANOMALY_SQL + """
 SELECT 'caracteristiques.csv' AS fichier, categorie, niveau, detail, nb, round(pct, 6) AS pct FROM journal WHERE nb > 0""")
def a39(c):
    return rounded(_anomalies(c), 6, "pct")


@query("a40_anomaly_totals", ANOMALY_SQL + " SELECT niveau, count(*) AS nb_anomalies FROM journal WHERE nb > 0 GROUP BY niveau")
def a40(c):
    return profile.anomaly_totals(_anomalies(c))


@query("a41_latest_period", """
 SELECT com, obs_value, CAST(2023 AS INT) AS time_period FROM population""")
def a41(c):
    """Latest period of the preferred measure, from several periods and measures."""
    from ..plans.star import dim_population

    pop = c.d.population
    both = (pop.withColumn("popref_measure_lib", F.lit("Population totale"))
            .unionAll(pop.select("com", F.col("obs_value") - 5, "time_period", F.lit("Population municipale"))))
    older = both.select("com", F.col("obs_value") * 2, F.col("time_period") - 3, "popref_measure_lib")
    return dim_population(both.unionAll(older), "popref_measure_lib")


@query("a42_multi_date_accidents", """
 SELECT num_acc, min(d) AS premiere, max(d) AS derniere FROM (SELECT num_acc, date_acc AS d FROM caract
  UNION ALL SELECT num_acc, CAST(date_acc + 1 AS DATE) FROM caract WHERE lum = 4 AND atm = 4) GROUP BY 1 HAVING count(DISTINCT d) > 1""")
def a42(c):
    days = c.d.caract.select("num_acc", F.col("date_acc").alias("d"))
    moved = c.d.caract.where("lum = 4 AND atm = 4").select("num_acc", F.date_add("date_acc", 1))
    return profile.multi_date_accidents(days.unionAll(moved), "num_acc", "d")


@query("a43_class_distribution", """
 WITH y AS (SELECT CASE WHEN grav IN (2,3) THEN 1 ELSE 0 END AS grave FROM usagers)
 SELECT grave, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM y), 6) AS pct, round((SELECT sum(grave)::DOUBLE / sum(1 - grave) FROM y), 6) AS ratio,
  (SELECT CASE WHEN sum(grave)::DOUBLE / sum(1 - grave) < 0.2 THEN 'important' WHEN sum(grave)::DOUBLE / sum(1 - grave) < 0.4 THEN 'modéré' ELSE 'équilibré' END FROM y) AS desequilibre
 FROM y GROUP BY grave""")
def a43(c):
    y = c.d.usagers.select(lb.is_severe(F.col("grav")).cast("int").alias("grave"))
    return rounded(profile.class_distribution(y, "grave"), 6, "pct", "ratio")


@query("a45_value_counts", "SELECT com AS valeur, count(*) AS n FROM caract GROUP BY com")
def a45(c):
    return profile.value_counts(c.d.caract, ["com"]).select("valeur", "n").orderBy(F.col("n").desc(), "valeur")


@query("a46_landing_completeness", """
 SELECT 'baac' AS source, attendu, CASE WHEN v > 0 THEN 'NOM_FICHIER' ELSE 'FICHIER_MANQUANT' END AS categorie, CASE WHEN v > 0 THEN 'WARNING' ELSE 'ERROR' END AS niveau,
  CAST(v AS BIGINT) AS nb_variantes, exemple AS exemple_variante FROM (
  SELECT 'usagers.csv' AS attendu, (SELECT count(DISTINCT year(l_shipdate)) FROM lineitem) AS v,
   (SELECT 'usagers-' || CAST(min(year(l_shipdate)) AS STRING) || '.csv' FROM lineitem) AS exemple
  UNION ALL SELECT 'vehicules.csv', 0, NULL)""")
def a46(c):
    """Expected files against what landed: one exact, one misnamed, one missing."""
    from ..session import fresh_path
    from ..sources.files import logical_name

    path = fresh_path(c.spark, "a46")
    exact = c.d.caract.select(F.col("num_acc").alias("value"), F.lit("caracteristiques.csv").alias("fichier"))
    yearly = c.table("lineitem").select(
        F.col("l_orderkey").cast("string"), F.concat(F.lit("usagers-"), F.year("l_shipdate").cast("string"), F.lit(".csv")))
    exact.unionAll(yearly).write.partitionBy("fichier").text(path)
    landed = (c.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
              .select(logical_name(F.col("path")).alias("nom")).distinct())
    return profile.landing_gaps(landed, [
        ("baac", "caracteristiques.csv", "caract"), ("baac", "usagers.csv", "usager"),
        ("baac", "vehicules.csv", "vehicule")])

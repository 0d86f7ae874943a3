"""Order-dependent operators and top-k reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..ml import metrics, prep
from ..operators import association as assoc
from ..operators import ordered, profile, weather
from .aggregates import RATES_SQL, commune_rates
from .cleaning import ZONES_SQL, zones
from .modelling import SCORED_SQL, scored_rows
from .registry import query


@query("w01_keep_first", """
 SELECT num_acc, voie, surf FROM (SELECT *, row_number() OVER (PARTITION BY num_acc ORDER BY voie, surf) AS rn FROM lieux) WHERE rn = 1""")
def w01(c):
    return ordered.first_per_key(c.d.lieux, ["num_acc"], ["voie", "surf"])


@query("w02_surrogate_ids", """
 SELECT row_number() OVER (ORDER BY num_acc, num_veh, place, grav NULLS FIRST, catu) AS id_fait, num_acc, num_veh, place, grav, catu FROM usagers""")
def w02(c):
    return ordered.with_row_ids(c.d.usagers, ["num_acc", "num_veh", "place", "grav", "catu"], "id_fait")


@query("w03_rank_after_sort", ZONES_SQL + """
 SELECT row_number() OVER (ORDER BY score_risque DESC, lat_e2, lon_e2) AS rang_risque, lat_e2, lon_e2, score_risque FROM zones""")
def w03(c):
    """Rank of every zone, by the distributed numbering (no single-task sort)."""
    scored = zones(c).select("lat_e2", "lon_e2", "score_risque", (-F.col("score_risque")).alias("neg"))
    return ordered.with_row_ids(scored, ["neg", "lat_e2", "lon_e2"], "rang_risque").select(
        "rang_risque", "lat_e2", "lon_e2", "score_risque")


@query("w04_day_pivot", """
 WITH j AS (SELECT date_acc, row_number() OVER (ORDER BY date_acc) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT date_acc FROM caract)),
 pv AS (SELECT date_acc AS bascule FROM j WHERE rn = floor(n * 0.80) + 1)
 SELECT date_acc < bascule AS train, min(date_acc) AS debut, max(date_acc) AS fin, count(*) AS n FROM caract, pv GROUP BY 1""")
def w04(c):
    pivot = prep.pivot_day(c.d.caract, "date_acc")
    return c.d.caract.groupBy((F.col("date_acc") < F.lit(pivot)).alias("train")).agg(
        F.min("date_acc").alias("debut"), F.max("date_acc").alias("fin"), F.count(F.lit(1)).alias("n"))


@query("w05_share_of_group", """
 SELECT lum, grav, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY lum), 6) AS pct
 FROM fait WHERE grav IS NOT NULL GROUP BY lum, grav""")
def w05(c):
    return assoc.row_shares(c.star.persons, "lum", "grav").withColumn("pct", F.round("pct", 6))


@query("o01_best_station", """
 SELECT num_poste, nb_jours, round(taux, 6) AS taux_completude FROM stations ORDER BY taux DESC, nb_jours DESC, num_poste LIMIT 1""")
def o01(c):
    daily = weather.one_row_per_day(c.d.meteo, [F.col(x) for x in ("rr", "tn", "tx", "tm")])
    best = weather.best_station(weather.station_completeness(daily))
    return best.select("num_poste", "nb_jours", F.round("taux_completude", 6).alias("taux_completude"))


@query("o02_top_zones", ZONES_SQL + " SELECT * FROM zones ORDER BY score_risque DESC, lat_e2, lon_e2 LIMIT 10")
def o02(c):
    return zones(c).orderBy(F.col("score_risque").desc(), "lat_e2", "lon_e2").limit(10)


@query("o02_top_communes", f"""
 SELECT com, nb_accidents, taux_accidents_pour_100k FROM ({RATES_SQL}) ORDER BY taux_accidents_pour_100k DESC, com LIMIT 15""")
def o02_communes(c):
    return (commune_rates(c).select("com", "nb_accidents", "taux_accidents_pour_100k")
            .orderBy(F.col("taux_accidents_pour_100k").desc(), "com").limit(15))


@query("o03_ranking_differences", f"""
 WITH r AS ({RATES_SQL}), brut AS (SELECT com FROM r ORDER BY nb_accidents DESC, com LIMIT 5),
 norm AS (SELECT com FROM r ORDER BY taux_accidents_pour_100k DESC, com LIMIT 5)
 SELECT 'brut seulement' AS classement, com FROM (SELECT * FROM brut EXCEPT SELECT * FROM norm)
 UNION ALL SELECT 'normalise seulement', com FROM (SELECT * FROM norm EXCEPT SELECT * FROM brut)""")
def o03(c):
    """Communes in the top five of one ranking only."""
    rates = commune_rates(c)
    raw = rates.orderBy(F.col("nb_accidents").desc(), "com").limit(5).select("com")
    per = rates.orderBy(F.col("taux_accidents_pour_100k").desc(), "com").limit(5).select("com")
    return (raw.exceptAll(per).select(F.lit("brut seulement").alias("classement"), "com")
            .unionAll(per.exceptAll(raw).select(F.lit("normalise seulement"), "com")))


@query("o04_top_values_per_column", """
 WITH v AS (SELECT 'com' AS colonne, com AS valeur, count(*) AS n FROM caract GROUP BY com
  UNION ALL SELECT 'dep', dep, count(*) FROM caract GROUP BY dep UNION ALL SELECT 'atm', CAST(atm AS STRING), count(*) FROM caract GROUP BY atm)
 SELECT colonne, valeur, n, CAST(rn AS INT) AS rang FROM (SELECT *, row_number() OVER (PARTITION BY colonne ORDER BY n DESC, valeur) AS rn FROM v) WHERE rn <= 3""")
def o04(c):
    return profile.top_values(c.d.caract, ["com", "dep", "atm"])


@query("o05_rare_levels_lumped", """
 WITH k AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 20)
 SELECT CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'AUTRE' END AS p_brand, count(*) AS n FROM part GROUP BY 1""")
def o05(c):
    return prep.lump_rare(c.table("part"), "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("o06_sort_by_absolute_value", """
 SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey""")
def o06(c):
    return (c.table("customer").select("c_custkey", "c_acctbal")
            .orderBy(F.abs("c_acctbal").desc(), "c_custkey"))


@query("o07_best_row_by_metric", SCORED_SQL + """
 , m AS (SELECT t AS seuil, count(*) FILTER (s >= t AND y = 1) AS tp, count(*) FILTER (s >= t AND y = 0) AS fp, count(*) FILTER (s < t AND y = 1) AS fn
  FROM sc, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS t) GROUP BY t)
 SELECT 'seuil ' || CAST(seuil AS STRING) AS strategie, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_grave FROM m ORDER BY f1_grave DESC, 1 LIMIT 1""")
def o07(c):
    rows = None
    scored = scored_rows(c)
    for t in (0.25, 0.5, 0.75):
        row = metrics.threshold_metrics(scored, "s", "y", t).withColumn("strategie", F.lit(f"seuil {t}"))
        rows = row if rows is None else rows.unionAll(row)
    return metrics.best_by(rows).withColumn("f1_grave", F.round("f1_grave", 6))


@query("o08_lowest_scores", SCORED_SQL + " SELECT id_usager, s FROM sc WHERE y = 1 ORDER BY s, id_usager LIMIT 10")
def o08(c):
    return scored_rows(c).where("y = 1").orderBy("s", "id_usager").limit(10).select("id_usager", "s")


@query("o09_chronological_sort", "SELECT num_acc, aaaammjj, lum FROM accidents")
def o09(c):
    return c.star.accidents.select("num_acc", "aaaammjj", "lum").orderBy("aaaammjj", "num_acc")


@query("o10_any_row_per_key", """
 SELECT (CAST(round(lat*10000) AS BIGINT)+50)//100 AS lat_e2, (CAST(round(lon*10000) AS BIGINT)+50)//100 AS lon_e2, min(iu_ac) AS iu_ac FROM capteurs GROUP BY 1, 2""")
def o10(c):
    """"Any one" per key made repeatable: the smallest."""
    return c.d.ref_geo.groupBy(
        geo.grid_cell(F.col("lat")).alias("lat_e2"), geo.grid_cell(F.col("lon")).alias("lon_e2")
    ).agg(F.min("iu_ac").alias("iu_ac"))


@query("o11_dictionary_sort", """
 SELECT source, fichier, variable FROM (SELECT 'trafic' AS source, 'releve.txt' AS fichier, unnest(['iu_ac','t_1h','q','k','fichier_source']) AS variable
  UNION ALL SELECT 'meteo', 'quotidien.csv', unnest(['num_poste','date_obs','rr','tn','tx','tm']))""")
def o11(c):
    return (profile.data_dictionary(c.d.trafic, "trafic", "releve.txt")
            .unionAll(profile.data_dictionary(c.d.meteo, "meteo", "quotidien.csv"))
            .orderBy("source", "fichier", "variable").select("source", "fichier", "variable"))


@query("o12_first_map_points", """
 SELECT num_acc, id_usager, lat, lon, CASE WHEN grav IN (2,3) THEN 'red' ELSE 'blue' END AS couleur FROM fait WHERE lat IS NOT NULL
 ORDER BY num_acc, id_usager, grav NULLS FIRST, catu LIMIT 1000""")
def o12(c):
    lat, lon = geo.split_geo_key(F.col("geo_key"))
    points = c.star.persons.withColumns({"lat": lat, "lon": lon}).na.drop(subset=["lat", "lon"])
    first = points.orderBy("num_acc", "id_usager", "grav", "catu").limit(1000)
    return first.select("num_acc", "id_usager", "lat", "lon",
                        F.when(F.col("grav").isin(2, 3), "red").otherwise("blue").alias("couleur"))



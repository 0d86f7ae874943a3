"""Query registry and the named SQL fragments the check queries share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.star import Star
from ..plans.views import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Context:
    """What a registered query gets: the session, the views and the star schema."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.d = Domain(spark, folder)
        self._star: Star | None = None
        self._made: dict = {}

    def table(self, name: str) -> DataFrame:
        return self.d.table(name)

    @property
    def star(self) -> Star:
        if self._star is None:
            self._star = Star(self.d)
        return self._star

    def once(self, name, make: Callable):
        """What make gives, made once for this query."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def fitted(self, name, fit: Callable):
        """A model, fitted once for a session and folder; it lives in memory and reads no table."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _FITTED:
            _FITTED[key] = fit()
        return _FITTED[key]


_FITTED: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (Context) -> DataFrame under a survey id."""
    def register(build: Callable[[Context], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: build(Context(spark, folder))
        if sql is not None:
            ORACLE[name] = with_fragments(sql)
        return build

    return register


FRAGMENTS: dict[str, str] = {
    "caract": """
 SELECT CAST(o_orderkey AS STRING) AS num_acc,
  CAST(DATE '2024-01-01' + CAST(o_orderkey % 366 AS INT) AS DATE) AS date_acc,
  CAST(YEAR(o_orderdate) AS INT) AS annee_hist,
  lpad(CAST(o_custkey % 24 AS STRING),2,'0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING),2,'0') AS hrmn,
  CASE WHEN o_orderkey % 10 = 0 THEN '93' ELSE '75' END AS dep,
  CAST(75101 + o_custkey % 20 AS STRING) AS com,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(488000 + (o_custkey*37) % 1300 AS DOUBLE)/10000 END AS lat,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(22000 + (o_custkey*53) % 3100 AS DOUBLE)/10000 END AS lon,
  CAST(1 + o_orderkey % 5 AS INT) AS lum, CAST(1 + o_custkey % 9 AS INT) AS atm,
  CAST(1 + o_orderkey % 7 AS INT) AS col FROM orders""",
    "usagers": """
 SELECT CAST(l_orderkey AS STRING) AS num_acc, CAST(l_linenumber AS STRING) AS num_veh,
  CAST(1 + l_partkey % 9 AS STRING) AS place,
  CAST(CASE WHEN l_suppkey % 97 = 0 THEN NULL WHEN l_quantity = 1 THEN 2 WHEN l_quantity <= 3 THEN 3
   WHEN l_quantity <= 25 THEN 1 ELSE 4 END AS INT) AS grav,
  CAST(1 + l_partkey % 3 AS INT) AS catu FROM lineitem""",
    "vehicules": """
 SELECT CAST(l_orderkey AS STRING) AS num_acc, CAST(l_linenumber AS STRING) AS num_veh,
  CAST(min(l_partkey) % 40 AS INT) AS catv FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "lieux": """
 SELECT CAST(l_orderkey AS STRING) AS num_acc, CAST(l_suppkey AS STRING) AS voie,
  CAST(l_partkey % 5 AS INT) AS surf FROM lineitem""",
    "trafic": """
 SELECT CAST(user_id AS STRING) AS iu_ac, date_trunc('hour', ts) AS t_1h,
  CASE WHEN event_type='error' THEN NULL ELSE value END AS q,
  CAST(regexp_extract(props,'([0-9]+)',1) AS DOUBLE) AS k,
  'trafic_' || CAST(isoyear(ts) AS STRING) || '-' || lpad(CAST(weekofyear(ts) AS STRING),2,'0') || '.txt'
   AS fichier_source FROM events""",
    "ref_geo": """
 SELECT CAST(s_suppkey AS STRING) AS iu_ac, s_name AS libelle,
  CAST(488000 + (s_suppkey*37) % 1300 AS DOUBLE)/10000 AS lat,
  CAST(22000 + (s_suppkey*53) % 3100 AS DOUBLE)/10000 AS lon FROM supplier""",
    "meteo": """
 SELECT CAST(p_partkey % 3 AS STRING) AS num_poste,
  CAST(DATE '2024-01-01' + CAST(p_partkey % 366 AS INT) AS DATE) AS date_obs,
  CASE WHEN p_size <= 25 THEN CAST(0 AS DOUBLE) ELSE CAST(p_size-25 AS DOUBLE)/2 END AS rr,
  CAST(p_size AS DOUBLE)/4 AS tn, CAST(p_size AS DOUBLE)/4+7 AS tx,
  CASE WHEN p_partkey % 11=0 THEN NULL ELSE CAST(p_size AS DOUBLE)/4+3 END AS tm FROM part""",
    "population": """
 SELECT CAST(75101 + n_nationkey AS STRING) AS com,
  CAST(15000 + n_nationkey*10000 AS DOUBLE) AS obs_value, 2023 AS time_period
 FROM nation WHERE n_nationkey < 20""",
    # Derived stages of the star schema, written independently of the Spark plans.
    "accidents": """
 SELECT num_acc, strftime(date_acc, '%Y%m%d') AS aaaammjj, com,
  CASE WHEN lat IS NULL THEN NULL ELSE CAST(lat AS STRING) || '_' || CAST(lon AS STRING) END AS geo_key,
  lat, lon, lum, atm, col, dep, date_acc FROM caract""",
    "meteo_jour": """
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY num_poste, date_obs
   ORDER BY rr NULLS FIRST, tn NULLS FIRST, tx NULLS FIRST, tm NULLS FIRST) AS rn FROM meteo) WHERE rn = 1""",
    "stations": """
 SELECT num_poste, count(date_obs) AS nb_jours, min(date_obs) AS date_min, max(date_obs) AS date_max,
  count(date_obs)::DOUBLE / (date_diff('day', min(date_obs), max(date_obs)) + 1) AS taux
 FROM meteo_jour GROUP BY num_poste""",
    "dim_meteo": """
 SELECT strftime(date_obs, '%Y%m%d') AS aaaammjj, rr, tn, tx, tm FROM meteo_jour
 WHERE num_poste = (SELECT num_poste FROM stations ORDER BY taux DESC, nb_jours DESC, num_poste LIMIT 1)""",
    "dim_date": """
 SELECT DISTINCT strftime(date_acc, '%Y%m%d') AS aaaammjj, strftime(date_acc, '%Y-%m-%d') AS date,
  CAST(year(date_acc) AS INT) AS annee, CAST(month(date_acc) AS INT) AS mois,
  CAST(day(date_acc) AS INT) AS jour, dayname(date_acc) AS jour_semaine,
  isodow(date_acc) >= 6 AS is_weekend,
  CAST(isoyear(date_acc) AS STRING) || '-' || lpad(CAST(weekofyear(date_acc) AS STRING),2,'0') AS annee_semaine
 FROM caract""",
    "capteurs": """
 SELECT DISTINCT iu_ac, CAST(lat AS STRING) || '_' || CAST(lon AS STRING) AS geo_key, libelle, lat, lon FROM ref_geo""",
    "localises": """
 SELECT a.*, coalesce(e.iu_ac, g.iu_ac) AS iu_ac FROM accidents a
 LEFT JOIN (SELECT geo_key, min(iu_ac) AS iu_ac FROM capteurs GROUP BY geo_key) e ON a.geo_key = e.geo_key
 LEFT JOIN (SELECT (CAST(round(lat*10000) AS BIGINT)+50)//100 AS y, (CAST(round(lon*10000) AS BIGINT)+50)//100 AS x,
   min(iu_ac) AS iu_ac FROM capteurs GROUP BY 1, 2) g
  ON (CAST(round(a.lat*10000) AS BIGINT)+50)//100 = g.y AND (CAST(round(a.lon*10000) AS BIGINT)+50)//100 = g.x""",
    "fait": """
 SELECT u.num_acc, u.num_acc || '_' || u.num_veh || '_' || u.place AS id_usager, a.aaaammjj, a.geo_key, a.com,
  a.iu_ac, a.lum, a.atm, a.col, u.catu, u.grav, CAST(NULL AS INT) AS secu1, CAST(NULL AS INT) AS secu2,
  CAST(NULL AS INT) AS secu3, v.catv, a.lat, a.lon, a.date_acc
 FROM usagers u JOIN localises a ON u.num_acc = a.num_acc
 LEFT JOIN vehicules v ON u.num_acc = v.num_acc AND u.num_veh = v.num_veh""",
    "capteur_stats": """
 SELECT fichier_source, iu_ac, avg(CASE WHEN q IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS q_missing_rate,
  quantile_cont(q, 0.5) AS q_median, quantile_cont(k, 0.5) AS k_median
 FROM trafic GROUP BY fichier_source, iu_ac""",
    "trafic_garde": """
 SELECT t.*, s.q_median, s.k_median FROM trafic t JOIN capteur_stats s
  ON t.fichier_source = s.fichier_source AND t.iu_ac = s.iu_ac WHERE s.q_missing_rate <= 0.30""",
    "trafic_rempli": """
 SELECT g.fichier_source, g.iu_ac, g.t_1h, coalesce(g.q, g.q_median, f.qf) AS q, coalesce(g.k, g.k_median, f.kf) AS k,
  CASE WHEN g.q IS NULL THEN 1 ELSE 0 END AS q_missing, CASE WHEN g.k IS NULL THEN 1 ELSE 0 END AS k_missing
 FROM trafic_garde g LEFT JOIN (SELECT fichier_source, quantile_cont(q, 0.5) AS qf, quantile_cont(k, 0.5) AS kf
  FROM trafic_garde GROUP BY fichier_source) f ON g.fichier_source = f.fichier_source""",
    "trafic_hebdo": """
 SELECT fichier_source, iu_ac, coalesce(sum(q), 0) AS q_total, avg(q) AS q_moyen, avg(k) AS k_moyen,
  count(q) AS nb_heures, avg(q_missing) AS q_missing_rate, avg(k_missing) AS k_missing_rate,
  min(t_1h) AS t_debut, max(t_1h) AS t_fin FROM trafic_rempli GROUP BY fichier_source, iu_ac""",
    "dim_trafic": """
 SELECT iu_ac, CAST(isoyear(t_debut) AS STRING) || '-' || lpad(CAST(weekofyear(t_debut) AS STRING),2,'0') AS annee_semaine,
  avg(q_total) AS q_total, avg(q_moyen) AS q_moyen, avg(k_moyen) AS k_moyen
 FROM trafic_hebdo GROUP BY 1, 2""",
    "enrichi": """
 SELECT f.* EXCLUDE (lat, lon, date_acc), d.date, d.annee, d.mois, d.jour, d.jour_semaine, d.is_weekend,
  d.annee_semaine, t.q_total, t.q_moyen, t.k_moyen, m.rr AS meteo_precipitations, m.tn AS meteo_temp_min,
  m.tx AS meteo_temp_max, m.tm AS meteo_temp_moy, p.obs_value AS population, p.time_period AS population_annee
 FROM fait f LEFT JOIN dim_date d ON f.aaaammjj = d.aaaammjj
 LEFT JOIN dim_trafic t ON f.iu_ac = t.iu_ac AND d.annee_semaine = t.annee_semaine
 LEFT JOIN dim_meteo m ON f.aaaammjj = m.aaaammjj LEFT JOIN population p ON f.com = p.com""",
    # Features of the severity model before gaps are filled; measures rounded so that both engines count alike.
    "variables": """
 SELECT id_usager, aaaammjj, meteo_precipitations, meteo_temp_min, meteo_temp_max, meteo_temp_moy, round(q_moyen, 6) AS q_moyen, round(k_moyen, 6) AS k_moyen,
  population, annee, mois, jour, CAST(isodow(d) - 1 AS INT) AS jour_semaine_num, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CAST(weekofyear(d) AS INT) AS semaine_annee, CAST(quarter(d) AS INT) AS trimestre,
  CASE WHEN strftime(d, '%m-%d') IN ('01-01','05-01','05-08','07-14','08-15','11-01','11-11','12-25') THEN 1 ELSE 0 END AS is_ferie,
  CASE WHEN meteo_precipitations > 1 THEN 1 ELSE 0 END AS is_pluie, round(k_moyen / (q_moyen + 1), 6) AS ratio_saturation,
  CASE WHEN q_moyen > (SELECT median(q_moyen) FROM enrichi) + 1e-9 THEN 1 ELSE 0 END AS trafic_eleve, jour_semaine,
  CASE WHEN mois IN (12,1,2) THEN 'hiver' WHEN mois < 6 THEN 'printemps' WHEN mois < 9 THEN 'ete' ELSE 'automne' END AS saison
 FROM (SELECT *, CAST(date AS DATE) AS d FROM enrichi)""",
    # First day of the test period: that at 80 % of the distinct days.
    "jour_pivot": """
 SELECT aaaammjj AS jour FROM (SELECT aaaammjj, row_number() OVER (ORDER BY aaaammjj) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT aaaammjj FROM fait)) WHERE i = CAST(floor(n * 0.8) AS BIGINT)""",
    # Worst severity of each accident, killed > hospitalised > slight > unhurt.
    "pire": """
 SELECT num_acc, max(CASE grav WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 END) AS poids,
  CAST(CASE max(CASE grav WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 END)
   WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 2 THEN 3 WHEN 1 THEN 4 END AS INT) AS grav
 FROM usagers GROUP BY num_acc""",
    # Accident grain of the temporal analyses.
    "acc_temps": """
 SELECT u.num_acc, u.est_grave, c.date_acc AS date_jour, CAST(split_part(c.hrmn, ':', 1) AS INT) AS heure,
  CAST(month(c.date_acc) AS INT) AS mois, isodow(c.date_acc) AS dow
 FROM (SELECT num_acc, bool_or(coalesce(grav IN (2, 3), false)) AS est_grave FROM usagers GROUP BY num_acc) u
 JOIN caract c ON u.num_acc = c.num_acc""",
    "feries": """
 SELECT make_date(y, m, d) AS date_jour, nom FROM
  (SELECT CAST(unnest(range(1990, 2031)) AS INT) AS y),
  (VALUES (1,1,'Jour de l''an'),(5,1,'Fête du Travail'),(5,8,'Fête de la Victoire'),(7,14,'Fête nationale'),
   (8,15,'Assomption'),(11,1,'Toussaint'),(11,11,'Armistice'),(12,25,'Noël')) AS f(m, d, nom)
 UNION ALL SELECT CAST(paques + n AS DATE), nom FROM (
  SELECT make_date(y, x // 31, x % 31 + 1) AS paques FROM (
   SELECT y, h + l - 7*((a + 11*h + 22*l) // 451) + 114 AS x FROM (
    SELECT *, (32 + 2*e + 2*i - h - k) % 7 AS l FROM (
     SELECT *, (19*a + b - d - g + 15) % 30 AS h FROM (
      SELECT *, b // 4 AS d, b % 4 AS e, (b - ((b + 8) // 25) + 1) // 3 AS g, c // 4 AS i, c % 4 AS k FROM (
       SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c
       FROM (SELECT CAST(unnest(range(1990, 2031)) AS INT) AS y))))))),
  (VALUES (1,'Lundi de Pâques'),(39,'Ascension'),(50,'Lundi de Pentecôte')) AS mv(n, nom)""",
}


def with_fragments(sql: str) -> str:
    """Prefix a query with the fragments it names, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_]+", text):
            if word in FRAGMENTS and word not in needed:
                needed.add(word)
                visit(FRAGMENTS[word])

    visit(re.sub(r"'[^']*'", "", sql))
    body = sql.strip()
    if not needed:
        return body
    # Fragments are declared in dependency order.
    prefix = ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in FRAGMENTS if n in needed)
    if body[:5].upper() == "WITH ":
        return f"WITH {prefix},\n{body[5:]}"
    return f"WITH {prefix}\n{body}"

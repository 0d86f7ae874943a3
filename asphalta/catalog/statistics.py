"""Association and correlation statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import association as assoc, neighbours
from .aggregates import rounded
from .registry import query

RAIN_CASE = """CASE WHEN m.rr = 0 THEN 'Temps Sec (0 mm)' WHEN m.rr > 0 AND m.rr <= 5 THEN 'Pluie Léger (0-5 mm)'
  WHEN m.rr > 5 THEN 'Pluie Forte (>5 mm)' ELSE 'Inconnu' END"""
SEVERITY_CASE = """CASE f.grav WHEN 1 THEN 'Indemne' WHEN 2 THEN 'Tué' WHEN 3 THEN 'Blessé Hospitalisé' WHEN 4 THEN 'Blessé Léger' ELSE 'Inconnu' END"""
CROSSED = f"""
 WITH x AS (SELECT {RAIN_CASE} AS condition_pluie, {SEVERITY_CASE} AS libel_gravite FROM fait f LEFT JOIN dim_meteo m ON f.aaaammjj = m.aaaammjj)"""


def rain_by_severity(c):
    """Rain band and severity label per person."""
    joined = c.star.persons.select("aaaammjj", "grav").join(c.star.dim_meteo.select("aaaammjj", "rr"), "aaaammjj", "left")
    return joined.select(lb.rain_band(F.col("rr")).alias("condition_pluie"),
                         lb.severity_label(F.col("grav")).alias("libel_gravite"))


def traffic_by_severity(c):
    return c.star.enriched().select(lb.traffic_band(F.col("q_moyen") * 10).alias("niveau_trafic"),
                                    lb.severity_label(F.col("grav")).alias("libel_gravite"))


@query("a20_contingency_margins", CROSSED + """
 SELECT coalesce(condition_pluie, 'Total') AS condition_pluie, coalesce(libel_gravite, 'Total') AS libel_gravite, count(*) AS n
 FROM x GROUP BY CUBE (condition_pluie, libel_gravite)""")
def a20(c):
    return assoc.contingency(rain_by_severity(c), "condition_pluie", "libel_gravite")


@query("a20_contingency_wide", CROSSED + """
 SELECT condition_pluie, count(*) FILTER (libel_gravite = 'Indemne') AS indemne, count(*) FILTER (libel_gravite = 'Tué') AS tue,
  count(*) FILTER (libel_gravite = 'Blessé Hospitalisé') AS hospitalise, count(*) FILTER (libel_gravite = 'Blessé Léger') AS leger,
  count(*) FILTER (libel_gravite = 'Inconnu') AS inconnu FROM x GROUP BY 1""")
def a20_wide(c):
    labels = [*lb.SEVERITY_LABELS.values(), lb.UNKNOWN]
    wide = assoc.contingency_wide(rain_by_severity(c), "condition_pluie", "libel_gravite", labels)
    return wide.toDF("condition_pluie", "indemne", "tue", "hospitalise", "leger", "inconnu")


@query("a20_row_percentages", CROSSED + """
 SELECT condition_pluie, libel_gravite, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY condition_pluie), 6) AS pct
 FROM x GROUP BY 1, 2""")
def a20_pct(c):
    return rounded(assoc.row_shares(rain_by_severity(c), "condition_pluie", "libel_gravite"), 6, "pct")


def chi_sql(a, b, yates=False):
    """Chi-square, p-value (series for the lower tail) and V over all cells of the grid."""
    dev = "abs(coalesce(o.n, 0) - e.e)"
    dev = f"(CASE WHEN d.dof = 1 THEN greatest({dev} - 0.5, 0) ELSE {dev} END)" if yates else dev
    return f"""
 , o AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM o GROUP BY 1), k AS (SELECT b, sum(n) AS n FROM o GROUP BY 1),
 t AS (SELECT sum(n) AS n FROM o), d AS (SELECT ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS dof, least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) AS m),
 e AS (SELECT r.a, k.b, r.n * k.n / t.n AS e FROM r, k, t),
 c2 AS (SELECT sum({dev} * {dev} / e.e) AS chi2 FROM d, e LEFT JOIN o ON e.a = o.a AND e.b = o.b)
 SELECT round(chi2, 6) AS chi2, dof, n::BIGINT AS n, round(CASE WHEN chi2 > 1400 THEN 0 ELSE
   1 - (SELECT sum(exp((dof / 2.0::DOUBLE + g) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2.0::DOUBLE + g + 1))) FROM range(5000) AS s(g)) END, 8) AS p_value,
  round(sqrt(chi2 / (n * (m - 1))), 8) AS v_cramer FROM c2, d, t"""


def tested(df, a, b):
    return assoc.independence_test(df, a, b).select(
        F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("p_value", 8).alias("p_value"),
        F.round("v_cramer", 8).alias("v_cramer"))


@query("a21_rain_severity_test", CROSSED + chi_sql("condition_pluie", "libel_gravite"))
def a21(c):
    return tested(rain_by_severity(c), "condition_pluie", "libel_gravite")


@query("a21_traffic_severity_test", f"""
 WITH x AS (SELECT CASE WHEN q_moyen*10 < 500 THEN 'Trafic Fluide (Faible)' WHEN q_moyen*10 <= 1500 THEN 'Trafic Modéré' WHEN q_moyen*10 > 1500 THEN 'Trafic Dense / Saturé'
   ELSE 'Inconnu' END AS niveau_trafic, {SEVERITY_CASE} AS libel_gravite FROM enrichi f)""" + chi_sql("niveau_trafic", "libel_gravite"))
def a21_traffic(c):
    return tested(traffic_by_severity(c), "niveau_trafic", "libel_gravite")


@query("a21_two_by_two_test", """
 WITH x AS (SELECT dep, CASE WHEN lum > 3 THEN 'nuit' ELSE 'jour' END AS lumiere FROM caract)""" + chi_sql("dep", "lumiere", yates=True))
def a21_yates(c):
    """2 x 2 table: continuity correction applies."""
    x = c.d.caract.select("dep", F.when(F.col("lum") > 3, "nuit").otherwise("jour").alias("lumiere"))
    return tested(x, "dep", "lumiere")


#: All columns of the enriched fact with at most 50 values.
CATEGORIES = ("jour_semaine", "mois", "jour", "is_weekend", "com", "lum", "atm", "col", "catu", "catv", "grav")


def cramer_sql(columns):
    parts = []
    for x, y in combinations(columns, 2):
        parts.append(f"""SELECT '{x}' AS var1, '{y}' AS var2, CAST({x} AS STRING) AS a, CAST({y} AS STRING) AS b, count(*)::DOUBLE AS n
  FROM enrichi WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL""")
    return f"""
 WITH o AS ({' UNION ALL '.join(parts)}), r AS (SELECT var1, var2, a, sum(n) AS n FROM o GROUP BY ALL), k AS (SELECT var1, var2, b, sum(n) AS n FROM o GROUP BY ALL),
 t AS (SELECT var1, var2, sum(n) AS n FROM o GROUP BY ALL),
 e AS (SELECT r.var1, r.var2, r.a, k.b, r.n * k.n / t.n AS e FROM r JOIN k USING (var1, var2) JOIN t USING (var1, var2)),
 c2 AS (SELECT e.var1, e.var2, sum((coalesce(o.n, 0) - e.e) ** 2 / e.e) AS chi2, count(DISTINCT e.a)::DOUBLE AS r, count(DISTINCT e.b)::DOUBLE AS k FROM e
  LEFT JOIN o ON e.var1 = o.var1 AND e.var2 = o.var2 AND e.a = o.a AND e.b = o.b GROUP BY ALL),
 f AS (SELECT var1, var2, t.n, greatest(0, chi2 / t.n - (k-1)*(r-1)/(t.n-1)) AS phi, r - (r-1)**2/(t.n-1) AS rc, k - (k-1)**2/(t.n-1) AS kc FROM c2 JOIN t USING (var1, var2))
 SELECT var1, var2, n::BIGINT AS n, round(sqrt(phi / least(kc - 1, rc - 1)), 6) AS v FROM f"""


@query("a22_cramer_matrix", cramer_sql(CATEGORIES))
def a22(c):
    return rounded(assoc.cramer_matrix(c.star.enriched_table(CATEGORIES), CATEGORIES), 6, "v")


#: All numeric columns of the enriched fact that vary, but the target.
MEASURES = ("atm", "catu", "catv", "col", "is_weekend", "jour", "k_moyen", "lum", "meteo_precipitations", "meteo_temp_max",
            "meteo_temp_min", "meteo_temp_moy", "mois", "population", "q_moyen", "q_total")
WITH_TARGET = (*MEASURES, "grav")


def numeric_frame(c):
    """Numeric columns of the enriched fact, written once: several passes follow."""
    return c.star.enriched_table([F.col(m).cast("double").alias(m) for m in WITH_TARGET])


#: The same in SQL.
NUMERIC = f"SELECT {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in WITH_TARGET)} FROM enrichi"


def pearson_sql(columns):
    """One pass for all pairs, then a row for each."""
    pairs = list(combinations(sorted(columns), 2))
    wide = ", ".join(f"corr({x}, {y}) AS r{i}, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n{i}" for i, (x, y) in enumerate(pairs))
    rows = ", ".join(f"{{'var1': '{x}', 'var2': '{y}', 'r': CASE WHEN isnan(r{i}) THEN NULL ELSE r{i} END, 'n': n{i}}}" for i, (x, y) in enumerate(pairs))
    return f"SELECT unnest([{rows}], max_depth := 2) FROM (SELECT {wide} FROM ({NUMERIC}))"


def spearman_sql(columns):
    parts = []
    for x, y in combinations(sorted(columns), 2):
        parts.append(f"""SELECT '{x}' AS var1, '{y}' AS var2, CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE corr(rx, ry) END AS rho, count(*) AS n FROM (SELECT
   rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0::DOUBLE AS ry
   FROM numeriques WHERE {x} IS NOT NULL AND {y} IS NOT NULL)""")
    return f"WITH numeriques AS MATERIALIZED ({NUMERIC}) " + " UNION ALL ".join(parts)


def tail_sql(r, n):
    """Two-sided p-value of a correlation by the series of the incomplete beta function."""
    y, b = f"({r}*{r})", f"(({n} - 2) / 2.0::DOUBLE)"
    return f"""CASE WHEN {r} IS NULL THEN NULL WHEN {y} * {b} > 60 THEN 0 ELSE greatest(0, 1 - (SELECT sum(exp((0.5::DOUBLE + g) * ln({y}) + {b} * ln(1 - {y}) + lgamma(0.5::DOUBLE + {b} + g)
   - lgamma(1.5::DOUBLE + g) - lgamma({b}))) FROM range(3000) AS s(g))) END"""


@query("a23_pearson_matrix", f"SELECT var1, var2, round(r, 8) AS r, n FROM ({pearson_sql(MEASURES)})")
def a23(c):
    return rounded(assoc.pearson_pairs(numeric_frame(c), MEASURES), 8, "r")


@query("a24_spearman_matrix", f"SELECT var1, var2, round(rho, 8) AS rho, n FROM ({spearman_sql(MEASURES)})")
def a24(c):
    return rounded(assoc.spearman_pairs(numeric_frame(c), MEASURES), 8, "rho")


@query("a25_pearson_pvalues", f"""
 SELECT var1, var2, round(r, 8) AS r, n, round({tail_sql('r', 'n')}, 7) AS p_value FROM ({pearson_sql(MEASURES)})""")
def a25(c):
    p = assoc.pearson_pvalues(numeric_frame(c), MEASURES)
    return rounded(rounded(p, 8, "r"), 7, "p_value")


@query("a26_top_pairs", f"""
 SELECT var1, var2, round(r, 8) AS r, n, round(abs(r), 8) AS abs_corr, CASE WHEN abs(r) >= 0.5 THEN 'FORTE' WHEN abs(r) >= 0.3 THEN 'MOYENNE' ELSE 'FAIBLE' END AS force,
  CASE WHEN r > 0 THEN 'positive (+)' ELSE 'negative (-)' END AS sens FROM ({pearson_sql(MEASURES)}) WHERE r IS NOT NULL ORDER BY abs(r) DESC LIMIT 25""")
def a26(c):
    return rounded(assoc.top_pairs(assoc.pearson_pairs(numeric_frame(c), MEASURES), 25), 8, "r", "abs_corr")


@query("a27_significance_table", f"""
 WITH p AS (SELECT var1, var2, r, {tail_sql('r', 'n')} AS pp FROM ({pearson_sql(MEASURES)})),
 s AS (SELECT var1, var2, rho, {tail_sql('rho', 'n')} AS ps FROM ({spearman_sql(MEASURES)}))
 SELECT var1, var2, round(r, 8) AS pearson_r, round(pp, 7) AS pearson_p, round(rho, 8) AS spearman_r, round(ps, 7) AS spearman_p,
  CASE WHEN pp < 0.05 THEN 'OUI' ELSE 'NON' END AS significatif, CASE WHEN pp < 0.001 THEN '***' WHEN pp < 0.01 THEN '**' WHEN pp < 0.05 THEN '*' ELSE 'ns' END AS etoiles
 FROM p JOIN s USING (var1, var2) ORDER BY abs(r) DESC NULLS LAST LIMIT 15""")
def a27(c):
    t = assoc.significance_table(numeric_frame(c), MEASURES, 15)
    return rounded(rounded(t, 8, "pearson_r", "spearman_r"), 7, "pearson_p", "spearman_p")


@query("a28_target_ranking", f"""
 SELECT CASE WHEN var1 = 'grav' THEN var2 ELSE var1 END AS variable, round(rho, 8) AS correlation, CASE WHEN abs(rho) >= 0.7 THEN 'très forte' WHEN abs(rho) >= 0.5 THEN 'forte'
  WHEN abs(rho) >= 0.3 THEN 'modérée' WHEN abs(rho) >= 0.15 THEN 'faible' ELSE 'très faible' END AS force
 FROM ({spearman_sql(WITH_TARGET)}) WHERE var1 = 'grav' OR var2 = 'grav' ORDER BY abs(rho) DESC NULLS LAST LIMIT 10""")
def a28(c):
    pairs = assoc.spearman_pairs(numeric_frame(c), WITH_TARGET)
    return rounded(assoc.against_target(pairs, "grav", 10), 8, "correlation")


@query("a28_retained_variables", f"""
 SELECT CASE WHEN var1 = 'q_moyen' THEN var2 ELSE var1 END AS variable FROM ({spearman_sql(MEASURES)}) WHERE (var1 = 'q_moyen' OR var2 = 'q_moyen') AND abs(rho) >= 0.15""")
def a28_kept(c):
    ranked = assoc.against_target(assoc.spearman_pairs(numeric_frame(c), MEASURES), "q_moyen")
    return assoc.retained_variables(ranked)


#: Numeric columns that are there in every row; a constant is left out.
VIF_COLUMNS = ("atm", "catu", "catv", "col", "jour", "lum", "mois", "population", "annee")


def vif_sql():
    """VIF without intercept: 1 / (1 - R2) of each column on the others, by elimination on the Gram matrix.

    Sweeping all other columns out of the scaled Gram matrix leaves 1 / VIF on the diagonal.
    """
    names = [v for v in VIF_COLUMNS if v != "annee"]
    k = len(names)
    sums = ", ".join(f"sum(CAST({a} AS DOUBLE) * {b}) / sqrt(sum(CAST({a} AS DOUBLE) * {a}) * sum(CAST({b} AS DOUBLE) * {b})) AS g{i}_{j}"
                     for i, a in enumerate(names) for j, b in enumerate(names))
    parts = []
    for last in range(k):
        order = [i for i in range(k) if i != last] + [last]
        steps = f"SELECT {', '.join(f'g{i}_{j} AS s{p}_{q}' for p, i in enumerate(order) for q, j in enumerate(order))} FROM g"
        for s in range(k - 1):
            steps = "SELECT " + ", ".join(
                f"s{p}_{q} - s{p}_{s} * s{s}_{q} / s{s}_{s} AS s{p}_{q}" for p in range(s + 1, k) for q in range(s + 1, k)) + f" FROM ({steps})"
        parts.append(f"SELECT '{names[last]}' AS variable, 1 / s{k - 1}_{k - 1} AS vif FROM ({steps})")
    return f"""WITH g AS MATERIALIZED (SELECT {sums} FROM enrichi WHERE {" AND ".join(f"{v} IS NOT NULL" for v in VIF_COLUMNS)})
 SELECT variable, round(vif, 6) AS vif, CASE WHEN vif >= 10 THEN 'PROBLEME' WHEN vif >= 5 THEN 'ATTENTION' ELSE 'OK' END AS niveau FROM ({' UNION ALL '.join(parts)})"""


@query("a29_variance_inflation", vif_sql())
def a29(c):
    return rounded(assoc.variance_inflation(c.star.enriched_table(VIF_COLUMNS), VIF_COLUMNS), 6, "vif")


MI_COLUMNS = ("lum", "atm", "catu")


@query("a30_mutual_information", """
 WITH y AS (SELECT CASE WHEN grav IN (2,3) THEN 1 ELSE 0 END AS b, lum, atm, catu FROM fait),
 o AS (SELECT 'lum' AS variable, lum AS a, b, count(*)::DOUBLE AS n FROM y GROUP BY ALL UNION ALL SELECT 'atm', atm, b, count(*) FROM y GROUP BY ALL
  UNION ALL SELECT 'catu', catu, b, count(*) FROM y GROUP BY ALL)
 SELECT variable, round(sum(n / t * ln(n * t / (na * nb))), 9) AS mutual_info FROM (SELECT *, sum(n) OVER (PARTITION BY variable, a) AS na,
  sum(n) OVER (PARTITION BY variable, b) AS nb, sum(n) OVER (PARTITION BY variable) AS t FROM o) GROUP BY variable""")
def a30(c):
    """Few-valued columns keep their values, so plain counts check the estimate."""
    y = c.star.persons.withColumn("y", lb.is_severe(F.col("grav")).cast("int"))
    return rounded(assoc.mutual_information(y, MI_COLUMNS, "y", bins=64), 9, "mutual_info")


def mi_measures_sql(columns, bins=16):
    """Mutual information with cuts at the exact quantiles of each column."""
    steps = "[" + ", ".join(f"{i / bins!r}::DOUBLE" for i in range(1, bins)) + "]"
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, len(list_filter(list_distinct(q), lambda t: t < coalesce({c}::DOUBLE, 0))) AS a, b, count(*)::DOUBLE AS n"
        f" FROM y, (SELECT quantile_cont({c}::DOUBLE, {steps}) AS q FROM y) GROUP BY ALL" for c in columns)
    return f"""
 WITH y AS (SELECT *, CASE WHEN grav IN (2,3) THEN 1 ELSE 0 END AS b FROM enrichi), o AS ({parts})
 SELECT variable, round(sum(n / t * ln(n * t / (na * nb))), 9) AS mutual_info FROM (SELECT *, sum(n) OVER (PARTITION BY variable, a) AS na,
  sum(n) OVER (PARTITION BY variable, b) AS nb, sum(n) OVER (PARTITION BY variable) AS t FROM o) GROUP BY variable"""


MI_MEASURES = ("k_moyen", "meteo_precipitations", "meteo_temp_max", "meteo_temp_min", "meteo_temp_moy", "population", "q_moyen", "q_total")


@query("a30_mutual_information_measures", mi_measures_sql(MI_MEASURES))
def a30_measures(c):
    """Continuous columns are cut at exact quantiles."""
    y = numeric_frame(c).withColumn("y", lb.is_severe(F.col("grav")).cast("int"))
    return rounded(assoc.mutual_information(y, MI_MEASURES, "y"), 9, "mutual_info")


def psi_sql(x):
    """Digamma of a number of one or more, by recurrence and its asymptotic series."""
    z = f"({x} + 6.0::DOUBLE)"
    steps = " + ".join(f"1.0::DOUBLE / ({x} + {i})" for i in range(6))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) + 1 / (240 * {z} ** 8) - ({steps}))"


def neighbours_sql(columns, k=3):
    """Nearest neighbours by comparing all values of a class with each other."""
    rows = " UNION ALL ".join(f"SELECT '{c}' AS variable, y, coalesce(CAST({c} AS DOUBLE), 0) AS v FROM p" for c in columns)
    return f"""
 WITH p AS (SELECT *, CASE WHEN grav IN (2,3) THEN 1 ELSE 0 END AS y FROM enrichi),
 w AS MATERIALIZED (SELECT variable, y, v, count(*)::DOUBLE AS n FROM ({rows}) GROUP BY ALL),
 c AS (SELECT variable, y, sum(n) AS nc FROM w GROUP BY ALL HAVING sum(n) >= 2),
 x AS MATERIALIZED (SELECT w.*, nc, sum(n) OVER (PARTITION BY w.variable) AS nn, sum(n) OVER (PARTITION BY w.variable, v) AS equal FROM w JOIN c USING (variable, y)),
 d AS (SELECT a.variable, a.y, a.v, a.n, a.nc, a.nn, a.equal, b.v AS u, abs(b.v - a.v) AS dist,
   sum(CASE WHEN b.v = a.v THEN b.n - 1 ELSE b.n END) OVER (PARTITION BY a.variable, a.y, a.v ORDER BY abs(b.v - a.v), b.v) AS upto
  FROM x a JOIN x b ON a.variable = b.variable AND a.y = b.y),
 f AS (SELECT variable, y, v, max(n) AS n, max(nc) AS nc, max(nn) AS nn, max(equal) AS equal, arg_min(u, (dist, u)) AS u, min(dist) AS dist
  FROM d WHERE upto >= least({k}, nc - 1) GROUP BY variable, y, v),
 m AS (SELECT f.variable, f.y, f.v, max(f.n) AS n, max(f.nc) AS nc, max(f.nn) AS nn, max(dist) AS dist, max(f.equal) AS equal,
   sum(x.n) FILTER (x.v > CASE WHEN f.u < f.v THEN f.u ELSE f.v - dist END AND x.v < CASE WHEN f.u > f.v THEN f.u ELSE f.v + dist END) AS inside
  FROM f JOIN x ON f.variable = x.variable GROUP BY f.variable, f.y, f.v),
 t AS (SELECT *, CASE WHEN dist = 0 THEN n - 1 ELSE least({k}, nc - 1) END AS ki, CASE WHEN dist = 0 THEN equal - 1 ELSE inside END AS mi FROM m)
 SELECT variable, round(greatest(0, {psi_sql('max(nn)')} + sum(n * ({psi_sql('ki')} - {psi_sql('nc')} - {psi_sql('mi')})) / max(nn)), 8) AS mutual_info
 FROM t GROUP BY variable"""


@query("a30_mutual_information_neighbours", neighbours_sql(MEASURES))
def a30_neighbours(c):
    """Every measure, NULLs as 0, by distances to nearest neighbours of the same class."""
    y = numeric_frame(c).withColumn("y", lb.is_severe(F.col("grav")).cast("int")).na.fill(0.0, list(MEASURES))
    return rounded(neighbours.mutual_information(y, MEASURES, "y"), 8, "mutual_info")

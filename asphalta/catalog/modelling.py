"""Severity model: preparation, metrics on a fixed score, trained models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window, functions as F

from ..functions import dates as dt
from ..functions import labels as lb
from ..ml import boosting, explain, metrics, models, prep, shapley
from ..operators import profile
from ..operators.ordered import exact_medians
from ..session import materialize, spread
from .aggregates import rounded
from .registry import query

Y = "CASE WHEN grav IN (2,3) THEN 1 ELSE 0 END"
# A fixed score both engines compute alike: whole-number arithmetic over 100.
SCORED_SQL = f"""
 WITH sc AS (SELECT num_acc, id_usager, aaaammjj, lum, atm, col, catu, {Y} AS y,
  ((lum*7 + atm*3 + col*5 + catu*11 + {Y}*13 + CAST(substr(aaaammjj, 7, 2) AS INT)*17) % 100)::DOUBLE / 100 AS s FROM fait)"""


def scored_rows(c):
    y = lb.is_severe(F.col("grav")).cast("int")
    day = F.substring("aaaammjj", 7, 2).cast("int")
    points = F.col("lum") * 7 + F.col("atm") * 3 + F.col("col") * 5 + F.col("catu") * 11 + y * 13 + day * 17
    return c.star.persons.select("num_acc", "id_usager", "aaaammjj", "lum", "atm", "col", "catu", y.alias("y"),
                              ((points % 100).cast("double") / 100).alias("s"))


@query("m01_target", f"SELECT num_acc, id_usager, grav, {Y} AS grave FROM fait")
def m01(c):
    return prep.define_target(c.star.persons).select("num_acc", "id_usager", "grav", "grave")


@query("m01_suspect_columns", """
 SELECT unnest(['catu','grav','secu1','secu2','secu3']) AS colonne, count(*) AS lignes FROM fait""")
def m01_suspects(c):
    names = prep.suspect_columns(c.star.fact.columns)
    return c.star.fact.agg(F.count(F.lit(1)).alias("lignes")).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("colonne"), "lignes")


@query("m02_engineered_features", """
 SELECT id_usager, annee, mois, jour, CAST(isodow(d) - 1 AS INT) AS jour_semaine_num, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CAST(weekofyear(d) AS INT) AS semaine_annee, CAST(quarter(d) AS INT) AS trimestre,
  CASE WHEN mois IN (12,1,2) THEN 'hiver' WHEN mois < 6 THEN 'printemps' WHEN mois < 9 THEN 'ete' ELSE 'automne' END AS saison,
  CASE WHEN strftime(d, '%m-%d') IN ('01-01','05-01','05-08','07-14','08-15','11-01','11-11','12-25') THEN 1 ELSE 0 END AS is_ferie,
  CASE WHEN meteo_precipitations > 1 THEN 1 ELSE 0 END AS is_pluie, round(k_moyen / (q_moyen + 1), 6) AS ratio_saturation,
  CASE WHEN q_moyen > (SELECT median(q_moyen) FROM enrichi) + 1e-9 THEN 1 ELSE 0 END AS trafic_eleve
 FROM (SELECT *, CAST(date AS DATE) AS d FROM enrichi)""")
def m02(c):
    enriched = c.star.enriched_table(["id_usager", "aaaammjj", "meteo_precipitations", "q_moyen", "k_moyen"])
    # The shared 1e-9 margin keeps last-digit differences of means from flipping the flag.
    median = exact_medians(enriched, ["q_moyen"])["q_moyen"]
    wide = prep.engineer_features(enriched, None if median is None else median + 1e-9)
    return wide.select("id_usager", "annee", "mois", "jour", "jour_semaine_num", "is_weekend", "semaine_annee", "trimestre",
                       "saison", "is_ferie", "is_pluie", F.round("ratio_saturation", 6).alias("ratio_saturation"), "trafic_eleve")


GAPPY_SQL = """SELECT num_acc, date_acc, lat, CASE WHEN lum = 5 THEN NULL ELSE atm END AS atm, CASE WHEN col = 3 THEN NULL ELSE com END AS com FROM caract"""


def gappy(c):
    return c.d.caract.select("num_acc", "date_acc", "lat", F.when(F.col("lum") != 5, F.col("atm")).alias("atm"),
                             F.when(F.col("col") != 3, F.col("com")).alias("com"))


@query("m03_impute_all_rows", f"""
 WITH x AS ({GAPPY_SQL}) SELECT num_acc, round(coalesce(lat, (SELECT median(lat) FROM x)), 6) AS lat, coalesce(atm, (SELECT median(atm) FROM x))::DOUBLE AS atm,
  coalesce(com, (SELECT com FROM x WHERE com IS NOT NULL GROUP BY com ORDER BY count(*) DESC, com LIMIT 1)) AS com FROM x""")
def m03(c):
    x = gappy(c)
    filled = prep.impute(x, prep.fit_imputation(x, ["lat", "atm"], ["com"]))
    return filled.select("num_acc", F.round("lat", 6).alias("lat"), "atm", "com")


@query("m04_impute_train_only", f"""
 WITH x AS ({GAPPY_SQL}) SELECT num_acc, round(coalesce(lat, (SELECT median(lat) FROM x WHERE date_acc < DATE '2024-10-19')), 6) AS lat,
  coalesce(atm, (SELECT median(atm) FROM x WHERE date_acc < DATE '2024-10-19'))::DOUBLE AS atm FROM x""")
def m04(c):
    x = gappy(c)
    train, _ = prep.temporal_split(x, "date_acc")
    return prep.impute(x, prep.fit_imputation(train, ["lat", "atm"])).select("num_acc", F.round("lat", 6).alias("lat"), "atm")


@query("m05_one_hot", """
 WITH k AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 20),
 b AS (SELECT p_partkey, p_size, CASE WHEN p_brand IN (SELECT * FROM k) THEN p_brand ELSE 'AUTRE' END AS v FROM part),
 l AS (SELECT v, row_number() OVER (ORDER BY v) AS pos FROM (SELECT DISTINCT v FROM b))
 SELECT p_partkey, p_size, CASE WHEN pos = 2 THEN 1 ELSE 0 END AS deuxieme, CASE WHEN pos > 1 THEN 1 ELSE 0 END AS somme FROM b JOIN l ON b.v = l.v""")
def m05(c):
    """Top 20 levels, the rest lumped; the first sorted level is the reference."""
    lumped = prep.lump_rare(c.table("part").select("p_partkey", "p_size", "p_brand"), "p_brand")
    levels = prep.observed_levels(lumped, "p_brand")
    coded = prep.one_hot(lumped, "p_brand", levels)
    flags = [f"`p_brand_{v}`" for v in levels[1:]]
    return coded.select("p_partkey", "p_size", F.col(flags[0]).alias("deuxieme"), F.expr(" + ".join(flags)).alias("somme"))


@query("m05_season_levels", """
 SELECT num_acc, CASE WHEN month(date_acc) IN (6,7,8) THEN 1 ELSE 0 END AS saison_Ete, CASE WHEN month(date_acc) IN (12,1,2) THEN 1 ELSE 0 END AS saison_Hiver,
  CASE WHEN month(date_acc) IN (3,4,5) THEN 1 ELSE 0 END AS saison_Printemps FROM caract""")
def m05_season(c):
    named = c.d.caract.select("num_acc", lb.season(F.month("date_acc"), ("Hiver", "Printemps", "Ete", "Automne")).alias("saison"))
    return prep.one_hot(named, "saison", ["Automne", "Ete", "Hiver", "Printemps"])


@query("m06_temporal_split", """
 SELECT num_acc, CASE WHEN date_acc < DATE '2024-10-19' THEN 'train' ELSE 'test' END AS partie FROM caract""")
def m06(c):
    train, test = prep.temporal_split(c.d.caract.select("num_acc", "date_acc"), "date_acc")
    return (train.select("num_acc", F.lit("train").alias("partie"))
            .unionAll(test.select("num_acc", F.lit("test"))))


@query("m07_split_summary", f"""
 SELECT CASE WHEN aaaammjj < '20241019' THEN 'train' ELSE 'test' END AS partie, count(*) AS lignes, min(CAST(strptime(aaaammjj, '%Y%m%d') AS DATE)) AS debut,
  max(CAST(strptime(aaaammjj, '%Y%m%d') AS DATE)) AS fin, round(avg({Y} * 100.0::DOUBLE), 6) AS taux_grave_pct FROM fait GROUP BY 1""")
def m07(c):
    rows = prep.define_target(c.star.persons).select(dt.compact_date(F.col("aaaammjj")).alias("jour"), "grave")
    pivot = prep.pivot_day(c.star.dim_date.select(F.col("date").cast("date").alias("jour")), "jour")
    return rounded(prep.split_summary(rows, "jour", pivot), 6, "taux_grave_pct")


#: Features of the severity model: doubles, whole numbers, texts.
MEASURED = ("meteo_precipitations", "meteo_temp_min", "meteo_temp_max", "meteo_temp_moy", "q_moyen", "k_moyen", "population", "ratio_saturation")
COUNTED = ("annee", "mois", "jour", "jour_semaine_num", "is_weekend", "semaine_annee", "trimestre", "is_ferie", "is_pluie", "trafic_eleve")
NAMED = ("jour_semaine", "saison")


def wide_features(c):
    """All features before gaps are filled with their day, written once, and the first day of the test period."""
    enriched = c.star.enriched_table([
        "id_usager", "aaaammjj", "jour_semaine", *[m for m in MEASURED if m != "ratio_saturation"]])
    # The shared 1e-9 margin keeps last-digit differences of means from flipping the flag.
    median = exact_medians(enriched, ["q_moyen"])["q_moyen"]
    wide = prep.engineer_features(enriched, None if median is None else median + 1e-9)
    wide = rounded(wide, 6, "q_moyen", "k_moyen", "ratio_saturation").withColumn("jour_date", dt.compact_date(F.col("aaaammjj")))
    table = materialize(wide.select("id_usager", "jour_date", *MEASURED, *COUNTED, *NAMED), "wide-features")
    return table, F.lit(prep.pivot_day(table, "jour_date"))


@query("m08_standard_scaling", "WITH s AS (SELECT " + ", ".join(
    f"avg({f}) AS m{i}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s{i}" for i, f in enumerate((*MEASURED, *COUNTED)))
    + " FROM variables WHERE aaaammjj < (SELECT jour FROM jour_pivot)) SELECT id_usager, " + ", ".join(
    f"round(({f} - m{i}) / s{i}, 5) AS {f}" for i, f in enumerate((*MEASURED, *COUNTED))) + " FROM variables, s")
def m08(c):
    """Every numeric feature scaled by mean and deviation of the training days."""
    rows, pivot = wide_features(c)
    columns = [*MEASURED, *COUNTED]
    fitted = prep.fit_scaling(rows.where(F.col("jour_date") < pivot), columns)
    return rounded(prep.scale(rows.select("id_usager", *columns), fitted), 5, *columns)


def _side_sql(side, f, kind):
    moments = f"avg({f}) AS m, stddev_samp({f}) AS s" if kind != "texte" else "CAST(NULL AS DOUBLE) AS m, CAST(NULL AS DOUBLE) AS s"
    return f"(SELECT count(DISTINCT {f}) AS u, {moments}, avg(CASE WHEN {f} IS NULL THEN 100.0::DOUBLE ELSE 0 END) AS p FROM variables WHERE aaaammjj {side} (SELECT jour FROM jour_pivot))"


@query("a44_split_feature_report", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{kind}' AS dtype, a.u AS n_unique_train, b.u AS n_unique_test, round(a.m, 6) AS mean_train, round(a.s, 6) AS std_train,"
    f" round(a.p, 6) AS pct_na_train, round(b.p, 6) AS pct_na_test FROM {_side_sql('<', f, kind)} a, {_side_sql('>=', f, kind)} b"
    for kind, names in (("numerique", MEASURED), ("entier", COUNTED), ("texte", NAMED)) for f in names))
def a44(c):
    """Types, distinct values, moments and gaps of every feature on both sides of the data's own pivot day."""
    rows, pivot = wide_features(c)
    train, test = (rows.where(side).drop("id_usager", "jour_date") for side in (F.col("jour_date") < pivot, F.col("jour_date") >= pivot))
    return rounded(profile.split_report(train, test), 6, "mean_train", "std_train", "pct_na_train", "pct_na_test")


@query("m12_balanced_weights", f"""
 WITH y AS (SELECT {Y} AS grave FROM usagers) SELECT grave, round((SELECT count(*) FROM y)::DOUBLE / (2 * count(*)), 8) AS poids FROM y GROUP BY grave""")
def m12(c):
    return rounded(prep.class_weights(prep.define_target(c.d.usagers)), 8, "poids")


@query("m13_roc_auc", SCORED_SQL + """
 , r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM sc)
 SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 8) AS roc_auc FROM r""")
def m13(c):
    return metrics.ranking_metrics(scored_rows(c), "s", "y").select(F.round("roc_auc", 8).alias("roc_auc"))


CURVE = """
 , g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM sc GROUP BY s),
 cu AS (SELECT s, p, sum(p) OVER (ORDER BY s DESC)::DOUBLE AS tp, sum(n) OVER (ORDER BY s DESC)::DOUBLE AS fp, sum(p) OVER ()::DOUBLE AS tot_p, sum(n) OVER ()::DOUBLE AS tot_n FROM g)"""


@query("m14_average_precision", SCORED_SQL + CURVE + " SELECT round(sum(p / tot_p * tp / (tp + fp)), 8) AS pr_auc FROM cu")
def m14(c):
    return metrics.ranking_metrics(scored_rows(c), "s", "y").select(F.round("pr_auc", 8).alias("pr_auc"))


@query("m15_threshold_metrics", SCORED_SQL + """
 , k AS (SELECT count(*) FILTER (y = 0 AND s < 0.5) AS tn, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, count(*) FILTER (y = 1 AND s < 0.5) AS fn,
  count(*) FILTER (y = 1 AND s >= 0.5) AS tp FROM sc)
 SELECT 0.5::DOUBLE AS seuil, round(tp::DOUBLE / (tp + fp), 8) AS precision_grave, round(tp::DOUBLE / (tp + fn), 8) AS recall_grave,
  round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 8) AS f1_grave, tn AS "TN", fp AS "FP", fn AS "FN", tp AS "TP" FROM k""")
def m15(c):
    return rounded(metrics.threshold_metrics(scored_rows(c), "s", "y", 0.5), 8, "precision_grave", "recall_grave", "f1_grave")


@query("m16_best_f1_threshold", SCORED_SQL + CURVE + """
 SELECT s AS seuil, round(f, 8) AS f1 FROM (SELECT s, 2 * tp / (tp + fp) * (tp / tot_p) / nullif(tp / (tp + fp) + tp / tot_p, 0) AS f FROM cu) ORDER BY f DESC NULLS LAST, s LIMIT 1""")
def m16(c):
    return rounded(metrics.best_f1_threshold(scored_rows(c), "s", "y"), 8, "f1")


@query("m17_roc_points", SCORED_SQL + CURVE + """
 SELECT s AS seuil, round(fp / tot_n, 8) AS fpr, round(tp / tot_p, 8) AS tpr FROM cu UNION ALL SELECT NULL, 0, 0""")
def m17(c):
    return rounded(metrics.roc_points(scored_rows(c), "s", "y"), 8, "fpr", "tpr")


@query("m17_precision_recall_points", SCORED_SQL + CURVE + """
 SELECT s AS seuil, round(tp / (tp + fp), 8) AS precision, round(tp / tot_p, 8) AS recall FROM cu UNION ALL SELECT NULL, 1, 0""")
def m17_pr(c):
    return rounded(metrics.pr_points(scored_rows(c), "s", "y"), 8, "precision", "recall")


def categorised(c, threshold=0.5):
    return metrics.categorised(scored_rows(c), "s", "y", threshold)


CATEGORISED = SCORED_SQL + """
 , ca AS (SELECT *, CASE WHEN y = 1 AND s >= 0.5 THEN 'TP (grave détecté)' WHEN y = 0 AND s < 0.5 THEN 'TN (léger détecté)'
  WHEN y = 1 THEN 'FN (grave RATÉ)' ELSE 'FP (fausse alerte)' END AS categorie FROM sc)"""


@query("m21_outcome_categories", CATEGORISED + " SELECT categorie, count(*) AS n FROM ca GROUP BY 1")
def m21(c):
    return categorised(c).groupBy("categorie").agg(F.count(F.lit(1)).alias("n"))


@query("m22_missed_profile", CATEGORISED + " , p AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg({f}) FILTER (categorie LIKE 'FN%') AS a, avg({f}) FILTER (categorie LIKE 'TP%') AS b FROM ca"
    for f in ("lum", "atm", "col", "catu")) + ") SELECT feature, round(a, 6) AS moyenne_fn, round(b, 6) AS moyenne_tp, round(a - b, 6) AS ecart FROM p")
def m22(c):
    return rounded(metrics.missed_profile(categorised(c), ["lum", "atm", "col", "catu"]), 6, "moyenne_fn", "moyenne_tp", "ecart")


@query("m23_score_histogram", CATEGORISED + """
 , w AS (SELECT categorie, min(s) AS lo, max(s) AS hi FROM ca GROUP BY 1)
 SELECT ca.categorie, CAST(least(floor((s - lo) / ((hi - lo) / 20)), 19) AS INT) AS classe, count(*) AS n FROM ca JOIN w ON ca.categorie = w.categorie GROUP BY 1, 2""")
def m23(c):
    return metrics.score_histogram(categorised(c), "s", 20)


@query("m24_worst_missed", CATEGORISED + """
 SELECT id_usager, s, lum, atm, col, catu FROM ca WHERE categorie LIKE 'FN%' ORDER BY s, id_usager, catu LIMIT 10""")
def m24(c):
    return metrics.worst_missed(categorised(c), "s", ["id_usager", "catu"]).select("id_usager", "s", "lum", "atm", "col", "catu")


# Scores in the place of three models, and the thresholds they are read at.
RIVALS = (("A. Brut", "s", 0.5), ("B. Inverse", "1 - s", 0.25), ("C. Decalage", "(s * 100 * 37 % 100) / 100", 0.75))


@query("m25_strategy_comparison", SCORED_SQL + ", a AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS strategie, y, round({score}, 4) AS s, {t}::DOUBLE AS seuil FROM sc" for name, score, t in RIVALS) + """),
 g AS (SELECT strategie, s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM a GROUP BY ALL),
 cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY strategie) AS tot_p, sum(n) OVER (PARTITION BY strategie) AS tot_n
  FROM g WINDOW w AS (PARTITION BY strategie ORDER BY s DESC)),
 r AS (SELECT strategie, sum(p * (tot_n - fp + n / 2)) / max(tot_p * tot_n) AS auc, sum(p / tot_p * tp / (tp + fp)) AS ap FROM cu GROUP BY strategie),
 k AS (SELECT strategie, max(seuil) AS seuil, count(*) FILTER (s >= seuil AND y = 1) AS tp, count(*) FILTER (s >= seuil AND y = 0) AS fp,
  count(*) FILTER (s < seuil AND y = 1) AS fn, count(*) FILTER (s < seuil AND y = 0) AS tn FROM a GROUP BY strategie),
 f AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k)
 SELECT strategie, round(auc, 8) AS roc_auc, round(ap, 8) AS pr_auc, seuil, round(tp::DOUBLE / (tp + fp), 8) AS precision_grave,
  round(tp::DOUBLE / (tp + fn), 8) AS recall_grave, round(f1, 8) AS f1_grave, tn AS "TN", fp AS "FP", fn AS "FN", tp AS "TP",
  row_number() OVER (ORDER BY f1 DESC, strategie) = 1 AS gagnant FROM f JOIN r USING (strategie)""")
def m25(c):
    """Every strategy's ranking and threshold measures, and the winner by F1."""
    rows = scored_rows(c)
    parts = [(name, rows.select("y", F.round(F.expr(score), 4).alias("s")), t) for name, score, t in RIVALS]
    return compared(parts, "s", "y")


def compared(parts, score, label):
    """One row of full metrics for each (name, scored rows, threshold), with the winner by F1."""
    rows = None
    for name, scored, threshold in parts:
        row = metrics.full_metrics(scored, score, label, threshold, name)
        rows = row if rows is None else rows.unionAll(row)
    first = Window.orderBy(F.col("f1_grave").desc(), "strategie")  # one row a strategy
    return rounded(rows.withColumn("gagnant", F.row_number().over(first) == 1), 8,
                   "roc_auc", "pr_auc", "precision_grave", "recall_grave", "f1_grave")


@query("m26_error_summary", CATEGORISED + """
 SELECT count(*) AS n_total, count(*) FILTER (categorie LIKE 'TP%') AS n_tp, count(*) FILTER (categorie LIKE 'TN%') AS n_tn, count(*) FILTER (categorie LIKE 'FN%') AS n_fn,
  count(*) FILTER (categorie LIKE 'FP%') AS n_fp, sum(y)::BIGINT AS n_graves, round(count(*) FILTER (categorie LIKE 'FN%') * 100.0::DOUBLE / sum(y), 6) AS pct_rates FROM ca""")
def m26(c):
    return rounded(metrics.error_summary(categorised(c)), 6, "pct_rates")


@query("m27_scored_export", CATEGORISED + " SELECT id_usager, y AS y_true, s AS y_probs, categorie FROM ca")
def m27(c):
    """Scored rows written out and read back."""
    rows = categorised(c).select("id_usager", F.col("y").alias("y_true"), F.col("s").alias("y_probs"), "categorie")
    return materialize(rows, "scored")


# Trained models. Trees and solver are Spark's own, so no SQL gives their figures: the queries
# return them whole, and tests hold them against invariants and plain computations.

def model_data(c):
    return c.once("data", lambda: split_features(c))


def boosted(c, weighted=False):
    train, _, features = model_data(c)
    return c.fitted(("boosted", weighted), lambda: models.fit_boosted(train, features, weighted=weighted))


def split_features(c):
    """Feature table written once, split at the pivot day."""
    table, features = prep.feature_table(c.star.enriched())
    table = materialize(table, "features")
    train, test = prep.temporal_split(table, "jour_date")
    return train, test, features


def ranked(table, value):
    """The table with the rank of each feature by a value."""
    order = Window.orderBy(F.col(value).desc(), "feature")  # one row a feature
    return table.withColumn("rang", F.row_number().over(order))


def logistic_measures(c, train, test, features, name):
    """Measures on the test days, with the fit's rounds and the mean weighted residual on the training rows.

    At the optimum of balanced logistic loss the weighted residuals sum to zero, the
    intercept being free.
    """
    fitted = prep.fit_scaling(train, features)
    ready = materialize(models.assembled(prep.scale(train, fitted), features).select("features", "grave"), "scaled")
    model = models.fit_assembled_logistic(ready)
    residual = prep.with_class_weights(models.scored(model, ready)).agg(
        F.count(F.lit(1)).alias("n_train"), F.avg(F.col("poids") * (F.col("grave") - F.col("y_probs"))).alias("r")).head()
    scored = materialize(models.scored(model, models.assembled(prep.scale(test, fitted), features)).select("grave", "y_probs"), "scores")
    return metrics.full_metrics(scored, "y_probs", "grave", 0.5, name).select(
        "*", F.lit(residual["n_train"]).alias("n_train"), F.lit(model.summary.totalIterations).alias("tours"),
        F.lit(float(residual["r"])).alias("residu_moyen"))


@query("m09_logistic_regression")
def m09(c):
    """Balanced logistic regression on scaled features, measured on the test days."""
    train, test, features = model_data(c)
    return logistic_measures(c, train, test, features, "Regression Logistique")


BASELINE_FEATURES = ("tm", "rr", "condition_lum", "saison_Ete", "saison_Hiver", "saison_Printemps")


@query("m09_baseline_features", f"""
 WITH x AS (SELECT f.id_usager, f.aaaammjj, {Y} AS grave, m.tm, m.rr, CASE WHEN f.lum IN (2,3,4,5) THEN 1 ELSE 0 END AS condition_lum,
  CAST(substr(f.aaaammjj, 5, 2) AS INT) AS mm FROM fait f LEFT JOIN dim_meteo m ON f.aaaammjj = m.aaaammjj),
 md AS (SELECT median(tm) AS tm, median(rr) AS rr FROM x WHERE aaaammjj < '20241019')
 SELECT id_usager, grave, round(coalesce(x.tm, md.tm), 6) AS tm, round(coalesce(x.rr, md.rr), 6) AS rr, condition_lum, CASE WHEN mm IN (6,7,8) THEN 1 ELSE 0 END AS saison_Ete,
  CASE WHEN mm IN (12,1,2) THEN 1 ELSE 0 END AS saison_Hiver, CASE WHEN mm IN (3,4,5) THEN 1 ELSE 0 END AS saison_Printemps FROM x, md""")
def m09_features(c):
    """Six baseline features; medians from the training days only."""
    return rounded(baseline_table(c).drop("jour_date"), 6, "tm", "rr")


def baseline_table(c, empty=None):
    """empty: what stands for a measure that no training day has."""
    rows = c.star.persons.select("id_usager", "aaaammjj", "lum", "grav").join(
        c.star.dim_meteo.select("aaaammjj", "tm", "rr"), "aaaammjj", "left")
    month = F.substring("aaaammjj", 5, 2).cast("int")
    named = prep.define_target(rows).select(
        "id_usager", "grave", dt.compact_date(F.col("aaaammjj")).alias("jour_date"), "tm", "rr",
        lb.dark(F.col("lum")).alias("condition_lum"),
        lb.season(month, ("Hiver", "Printemps", "Ete", "Automne")).alias("saison"))
    table = materialize(prep.one_hot(named, "saison", ["Automne", "Ete", "Hiver", "Printemps"]), "baseline")
    train, _ = prep.temporal_split(table, "jour_date")
    return prep.impute(table, prep.fit_imputation(train, ["tm", "rr"], empty=empty))


@query("m09_baseline_model")
def m09_baseline(c):
    """Weather, light and season only: the reference point of the other models."""
    train, test = prep.temporal_split(baseline_table(c, empty=0.0), "jour_date")
    return logistic_measures(c, train, test, BASELINE_FEATURES, "Baseline")


# The strategies that are compared.
STRATEGIES = ("A. Brut", "B. Class_weight", "C. Seuil optimal")


def model_scores(c, part, weighted=False):
    """Keys, day, label, features and the boosted model's probability for the rows of one side."""
    train, test, features = model_data(c)
    rows = train if part == "train" else test
    return c.once((part, weighted), lambda: materialize(models.scored(
        boosted(c, weighted), models.assembled(spread(rows), features)).drop("features"), "scores"))


@query("m10_gradient_boosting")
def m10(c):
    """Boosted trees, plain, weighted, and plain at the threshold of the best F1 in training; the winner by F1."""
    model_data(c)
    both(lambda weighted: boosted(c, weighted))
    on_test = model_scores(c, "test")
    best = metrics.best_f1_threshold(model_scores(c, "train"), "y_probs", "grave").head()["seuil"]
    parts = ((on_test, 0.5), (model_scores(c, "test", True), 0.5), (on_test, best))
    return compared([(n, rows, t) for n, (rows, t) in zip(STRATEGIES, parts)], "y_probs", "grave")


# Columns of which one Newton tree with one test is compared, and its rate and ridge.
STUMP_FEATURES = ("lum", "atm", "col", "catu")
STUMP = boosting.Settings(trees=1, depth=1, rate=0.05, rows=1.0, columns=1.0, ridge=1.0)


@query("m10_newton_stumps", SCORED_SQL + ", l AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS x, count(*) AS n, sum(y) AS k FROM sc GROUP BY 2" for f in STUMP_FEATURES) + """),
 t AS (SELECT count(*)::DOUBLE AS tn, sum(y)::DOUBLE / count(*) AS p FROM sc),
 c AS (SELECT feature, x, sum(n) OVER w AS n, sum(k) OVER w AS k FROM l WINDOW w AS (PARTITION BY feature ORDER BY x)),
 v AS (SELECT feature, x, n * p - k AS g, n * p * (1 - p) AS hl, (tn - n) * p * (1 - p) AS hr FROM c, t WHERE n < tn),
 b AS (SELECT *, g * g / (hl + 1) + g * g / (hr + 1) AS gain FROM v WHERE hl >= 1 AND hr >= 1)
 SELECT feature, x::DOUBLE AS seuil, round(gain, 5) AS gain, round(-0.05::DOUBLE * g / (hl + 1), 7) AS feuille_basse,
  round(0.05::DOUBLE * g / (hr + 1), 7) AS feuille_haute FROM b QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, x) = 1""")
def m10_stumps(c):
    """Best test of each column, its gain and Newton leaves, by a boosted model of one tree over all persons."""
    rows = c.once("stumps", lambda: materialize(scored_rows(c).select("id_usager", "y", *STUMP_FEATURES), "stumps"))
    found = []
    for f in STUMP_FEATURES:
        model = boosting.fit(rows, [f], "y", ["id_usager"], None, STUMP)
        tree = model.trees[0]
        found.append((f, float(model.edges[0][tree.cut[0]]), float(tree.gain[0]), float(tree.leaf[0]), float(tree.leaf[1])))
    table = c.spark.createDataFrame(found, "feature string, seuil double, gain double, feuille_basse double, feuille_haute double")
    return rounded(rounded(table, 5, "gain"), 7, "feuille_basse", "feuille_haute")


def newton(c, weighted=False):
    """A model with all trees of `boosting.Settings`."""
    train, _, features = model_data(c)

    def fit():
        rows = prep.with_class_weights(train) if weighted else train.withColumn("poids", F.lit(1.0))
        # Both models are fitted to the same rows, so the edges of their bins are found once.
        edges = c.once("edges", lambda: boosting.bin_edges(train, features))
        return boosting.fit(rows, features, "grave", train.columns, F.col("poids"), boosting.Settings(), edges)

    return c.fitted(("newton", weighted), fit)


def both(make):
    """The plain and the weighted model, fitted side by side: neither keeps all cores busy."""
    with ThreadPoolExecutor(2) as pool:
        return list(pool.map(make, (False, True)))


def newton_scores(c, part, weighted=False):
    train, test, _ = model_data(c)
    rows = train if part == "train" else test
    return c.once(("newton", part, weighted), lambda: materialize(
        boosting.scored(newton(c, weighted), rows).select("grave", "y_probs"), "scores"))


@query("m10_newton_boosting")
def m10_newton(c):
    """The comparison of m10 for Newton trees with a sample of columns for each tree."""
    train, _, features = model_data(c)
    c.once("edges", lambda: boosting.bin_edges(train, features))
    both(lambda weighted: newton(c, weighted))
    on_test = newton_scores(c, "test")
    best = metrics.best_f1_threshold(newton_scores(c, "train"), "y_probs", "grave").head()["seuil"]
    parts = ((on_test, 0.5), (newton_scores(c, "test", True), 0.5), (on_test, best))
    return compared([(n, rows, t) for n, (rows, t) in zip(STRATEGIES, parts)], "y_probs", "grave")


@query("m10_newton_rounds")
def m10_rounds(c):
    """Columns, leaves and log-loss of every round."""
    return boosting.rounds(newton(c), c.spark)


@query("m19_newton_importance")
def m19_newton(c):
    return ranked(boosting.importances(newton(c), c.spark), "importance")


@query("m11_forest_importance")
def m11(c):
    train, _, features = model_data(c)
    return ranked(models.importances(models.fit_forest(train, features), features, c.spark), "importance")


# Three small trees over the tests lum <= 2, atm <= 4 and col <= 3, as the
# score of each of the eight patterns of tests met (bit 0, 1, 2).
FIXED_TREES = (
    (1.0, ((({"lum": (None, 2), "atm": (None, 4)}), 0.2), ({"lum": (None, 2), "atm": (4, None)}, -0.1), ({"lum": (2, None)}, 0.4))),
    (0.5, (({"col": (None, 3)}, -0.6), ({"col": (3, None), "lum": (None, 2)}, 0.8), ({"col": (3, None), "lum": (2, None)}, 0.1))),
    (0.25, (({"atm": (None, 4), "col": (None, 3), "lum": (None, 2)}, 1.0), ({"atm": (None, 4), "col": (None, 3), "lum": (2, None)}, -1.0),
            ({"atm": (None, 4), "col": (3, None)}, 0.3), ({"atm": (4, None)}, 0.0))))
FIXED_FEATURES = ("lum", "atm", "col")
FIXED_TESTS = {"lum": 2, "atm": 4, "col": 3}


def fixed_boxes():
    inf = float("inf")
    number = {f: j for j, f in enumerate(FIXED_FEATURES)}
    return shapley.boxes_of([(w, [({
        number[f]: (-inf if a is None else a, inf if b is None else b) for f, (a, b) in box.items()}, v) for box, v in tree])
        for w, tree in FIXED_TREES])


def fixed_score(met):
    """Score of the trees for a set of tests met."""
    return sum(w * v for w, tree in FIXED_TREES for box, v in tree if all((b is not None) == (f in met) for f, (_, b) in box.items()))


@query("m18_shapley_fixed_trees", "WITH pt AS (SELECT " + " + ".join(
    f"CASE WHEN {f} <= {t} THEN {1 << i} ELSE 0 END" for i, (f, t) in enumerate(FIXED_TESTS.items())) + """ AS m, count(*)::DOUBLE AS n
  FROM caract WHERE lum IS NOT NULL AND atm IS NOT NULL AND col IS NOT NULL GROUP BY 1),
 fx AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({m}, {fixed_score({f for i, f in enumerate(FIXED_TESTS) if m >> i & 1})!r}::DOUBLE)" for m in range(8)) + """) AS v(m, y)),
 v AS (SELECT x.m, s, max(x.n) AS n, sum(z.n * y) / sum(z.n) AS v FROM pt x, (SELECT unnest(range(8)) AS s), pt z
  JOIN fx ON true WHERE fx.m = (s & x.m) | ((7 - s) & z.m) GROUP BY 1, 2),
 phi AS (SELECT a.m, j, max(a.n) AS n, sum((b.v - a.v) * CASE bit_count(CAST(a.s AS INT)) WHEN 1 THEN 1 ELSE 2 END / 6.0::DOUBLE) AS phi
  FROM (SELECT unnest(range(3)) AS j) k JOIN v a ON (a.s >> j) & 1 = 0 JOIN v b ON b.m = a.m AND b.s = a.s + (1 << j) GROUP BY a.m, j)
 SELECT list_extract(['lum', 'atm', 'col'], CAST(j + 1 AS INT)) AS feature, round(sum(n * abs(phi)) / sum(n), 8) AS shap_abs_moyen,
  abs(round(sum(n * phi) / sum(n), 8)) AS shap_moyen FROM phi GROUP BY j""")
def m18_fixed(c):
    """Exact Shapley values of three fixed trees over all accidents, which SQL finds from all coalitions."""
    rows = c.d.caract.select(*FIXED_FEATURES).na.drop()
    table = rounded(shapley.shapley_importance(fixed_boxes(), rows, FIXED_FEATURES), 8, "shap_abs_moyen", "shap_moyen")
    return table.withColumn("shap_moyen", F.abs("shap_moyen"))


def shapley_table(c):
    _, test, features = model_data(c)
    return shapley.shapley_importance(shapley.boosted_boxes(boosted(c)), test, features)


@query("m18_shapley_importance")
def m18(c):
    """Mean absolute exact Shapley value of every feature over all test rows, on the log-odds."""
    return ranked(shapley_table(c), "shap_abs_moyen")


@query("m19_native_importance")
def m19(c):
    _, _, features = model_data(c)
    return ranked(models.importances(boosted(c), features, c.spark), "importance")


def permutation_table(c):
    _, test, features = model_data(c)
    return explain.permutation_importance(boosted(c), test.select("grave", *features), features, "grave")


@query("m20_permutation_importance")
def m20(c):
    """Mean loss of ROC-AUC over 20 permutations of each feature, and its deviation."""
    return ranked(permutation_table(c), "importance_mean")


@query("m22_model_missed_profile")
def m22_model(c):
    """All features over the severe cases that the weighted model misses and finds."""
    _, _, features = model_data(c)
    return metrics.missed_profile(metrics.categorised(model_scores(c, "test", True), "y_probs", "grave", 0.5), features)


@query("m26_model_error_summary")
def m26_model(c):
    return metrics.error_summary(metrics.categorised(model_scores(c, "test", True), "y_probs", "grave", 0.5))


@query("m28_importance_methods")
def m28(c):
    """Ten strongest features by native, permutation and Shapley importance, side by side."""
    _, _, features = model_data(c)
    return explain.top_by_method({
        "native": models.importances(boosted(c), features, c.spark),
        "permutation": permutation_table(c).select("feature", "importance_mean"),
        "shapley": shapley_table(c).select("feature", "shap_abs_moyen")})

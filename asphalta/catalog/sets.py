"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking, shape
from .registry import query


@query("u01_union_by_name", """
 SELECT num_acc, dep, CAST(NULL AS INT) AS lum, annee_hist FROM caract WHERE annee_hist < 1997
 UNION ALL SELECT num_acc, dep, lum, annee_hist FROM caract WHERE annee_hist >= 1997 AND annee_hist < 1999
 UNION ALL SELECT num_acc, NULL, lum, annee_hist FROM caract WHERE annee_hist >= 1999""")
def u01(c):
    """Yearly files with different columns, stacked by name."""
    d = c.d.caract
    return shape.union_by_name([
        d.where("annee_hist < 1997").select("num_acc", "dep", "annee_hist"),
        d.where("annee_hist >= 1997 AND annee_hist < 1999").select("annee_hist", "lum", "num_acc", "dep"),
        d.where("annee_hist >= 1999").select("lum", "num_acc", "annee_hist")])


@query("u02_union_of_weeks", """
 SELECT fichier_source, iu_ac, count(*) AS n FROM trafic GROUP BY 1, 2""")
def u02(c):
    """Weekly files are one scan keyed by file, not a union of per-file results."""
    return c.d.trafic.groupBy("fichier_source", "iu_ac").agg(F.count(F.lit(1)).alias("n"))


@query("u03_distinct_rows", "SELECT DISTINCT num_poste, date_obs, rr, tn, tx, tm FROM meteo")
def u03(c):
    return c.d.meteo.distinct()


@query("u04_key_intersection", """
 SELECT com FROM caract WHERE lum = 1 AND atm < 4 INTERSECT SELECT com FROM caract WHERE lum = 3 AND atm > 6""")
def u04(c):
    return linking.common_keys(c.d.caract.where("lum = 1 AND atm < 4"), c.d.caract.where("lum = 3 AND atm > 6"), "com")


@query("u05_column_difference", """
 SELECT count(*) AS lignes, 'dep, hrmn, lat, lon' AS retirees FROM caract""")
def u05(c):
    dropped = shape.require_columns(c.d.caract.select("num_acc"), ["dep", "hrmn", "lat", "lon"])
    return c.d.caract.drop(*dropped).agg(F.count(F.lit(1)).alias("lignes")).withColumn(
        "retirees", F.lit(", ".join(dropped)))


@query("u06_distinct_values", "SELECT DISTINCT com, dep FROM caract")
def u06(c):
    return c.d.caract.select("com", "dep").distinct()

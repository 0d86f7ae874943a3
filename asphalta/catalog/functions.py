"""Scalar functions and the row logic behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import geo
from ..functions import labels as lb
from ..functions import text as tx
from ..operators import shape
from ..operators.ordered import exact_medians
from .registry import query


@query("f01_name_normalisation", """
 SELECT doc_id, regexp_replace(translate(lower(trim(t)), 'àâäéèêëîïôöùûüç', 'aaaeeeeiioouuuc'), '[^a-z0-9]', '', 'g') AS nom
 FROM (SELECT doc_id, ' Été_' || source || '-' || lang || ' Çà ' AS t FROM documents)""")
def f01(c):
    name = F.concat(F.lit(" Été_"), "source", F.lit("-"), "lang", F.lit(" Çà "))
    return c.table("documents").select("doc_id", tx.normalised(name).alias("nom"))


@query("f02_year_in_name", """
 SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(2000 + o_orderkey % 30 AS INT) END AS annee FROM orders""")
def f02(c):
    key = F.col("o_orderkey")
    name = F.when(key % 4 == 0, "caract-1999.csv").otherwise(
        F.concat(F.lit("caract-"), (key % 30 + 2000).cast("string"), F.lit(".csv")))
    return c.table("orders").select("o_orderkey", tx.first_year(name).alias("annee"))


@query("f03_snake_names", "SELECT p_partkey, replace(lower(trim(p_name)), ' ', '_') AS nom FROM part")
def f03(c):
    return c.table("part").select("p_partkey", tx.snake(F.col("p_name")).alias("nom"))


@query("f04_zero_padding", """
 SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS STRING)) >= 5 THEN CAST(o_orderkey AS STRING) ELSE lpad(CAST(o_orderkey AS STRING), 5, '0') END AS com FROM orders""")
def f04(c):
    return c.table("orders").select("o_orderkey", tx.zero_padded(F.col("o_orderkey"), 5).alias("com"))


@query("f05_stray_blanks", "SELECT num_acc, num_veh || place AS t FROM usagers")
def f05(c):
    messy = F.concat(F.lit(" "), "num_veh", F.lit("Â  "), "place", F.lit(" "))
    return c.d.usagers.select("num_acc", tx.without_blanks(messy).alias("t"))


@query("f06_decimal_tail", "SELECT CAST(o_orderkey AS STRING) AS k, CAST(o_custkey AS STRING) || '.05' AS v FROM orders")
def f06(c):
    return c.table("orders").select(
        tx.without_decimal_tail(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0"))).alias("k"),
        tx.without_decimal_tail(F.concat(F.col("o_custkey").cast("string"), F.lit(".05"))).alias("v"))


@query("f07_decimal_comma", "SELECT num_acc, lat FROM caract")
def f07(c):
    comma = F.replace(F.coalesce(F.col("lat").cast("string"), F.lit("inconnu")), F.lit("."), F.lit(","))
    return c.d.caract.select("num_acc", tx.decimal_comma(comma).alias("lat"))


@query("f08_composite_keys", """
 SELECT num_acc, CASE WHEN lat IS NULL THEN NULL ELSE CAST(lat AS STRING) || '_' || CAST(lon AS STRING) END AS geo_key, num_acc || '_' || com AS cle FROM caract""")
def f08(c):
    return c.d.caract.select("num_acc", geo.geo_key(F.col("lat"), F.col("lon")).alias("geo_key"),
                             tx.joined_key(F.col("num_acc"), F.col("com")).alias("cle"))


@query("f09_split_place_key", "SELECT num_acc, lat, lon FROM caract")
def f09(c):
    lat, lon = geo.split_geo_key(geo.geo_key(F.col("lat"), F.col("lon")))
    return c.d.caract.select("num_acc", lat.alias("lat"), lon.alias("lon"))


@query("f10_point_parsing", """
 SELECT iu_ac, CASE WHEN CAST(iu_ac AS INT) % 5 < 3 THEN lat END AS lat, CASE WHEN CAST(iu_ac AS INT) % 5 < 3 THEN lon END AS lon FROM ref_geo""")
def f10(c):
    """JSON, single-quoted and 'lat,lon' texts; malformed ones give NULLs."""
    kind = F.col("iu_ac").cast("int") % 5
    lat, lon = F.col("lat").cast("string"), F.col("lon").cast("string")
    text = (F.when(kind == 0, F.concat(F.lit('{"lon": '), lon, F.lit(', "lat": '), lat, F.lit("}")))
            .when(kind == 1, F.concat(F.lit("{'lon': "), lon, F.lit(", 'lat': "), lat, F.lit("}")))
            .when(kind == 2, F.concat(lat, F.lit(", "), lon))
            .when(kind == 3, lat).otherwise(F.concat(F.lit("x,"), lon)))
    py, px = geo.parse_point(text)
    return c.d.ref_geo.select("iu_ac", py.alias("lat"), px.alias("lon"))


@query("f11_nested_to_json", """
 SELECT iu_ac, '{"x":' || CAST(CAST(iu_ac AS INT) % 7 AS STRING) || ',"nom":"' || libelle || '"}' AS point FROM ref_geo""")
def f11(c):
    nested = c.d.ref_geo.select("iu_ac", F.struct(
        (F.col("iu_ac").cast("int") % 7).alias("x"), F.col("libelle").alias("nom")).alias("point"))
    return shape.nested_to_json(nested)


@query("f12_leading_integer", """
 SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) ELSE '0' END AS iu_ac FROM orders WHERE o_orderkey % 7 <> 0
 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0""")
def f12(c):
    key = F.col("o_orderkey")
    text = F.when(key % 7 == 0, None).when(key % 3 == 0, F.concat(F.lit(" 0"), key.cast("string"), F.lit("_5678"))).otherwise(
        F.concat(F.lit("x"), key.cast("string")))
    return c.table("orders").select("o_orderkey", tx.leading_integer(text).alias("iu_ac"))


@query("f13_sql_text_functions", """
 SELECT num_acc, substr(aaaammjj, 5, 2) AS mm, CAST(instr(geo_key, '_') AS INT) AS pos, CAST(substr(aaaammjj, 5, 2) AS INT) AS mois FROM accidents""")
def f13(c):
    from ..sources.tables import query as run

    return run(c.spark, """
        SELECT num_acc, substr(aaaammjj, 5, 2) AS mm, instr(geo_key, '_') AS pos,
               CAST(substr(aaaammjj, 5, 2) AS INT) AS mois FROM {a}""", a=c.star.accidents)


@query("f14_strict_compact_date", """
 SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(o_orderkey % 366 AS INT) AS DATE) END AS d FROM orders""")
def f14(c):
    key = F.col("o_orderkey")
    good = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key % 366).cast("int")), "yyyyMMdd")
    bad = F.when(key % 12 == 0, "20230229").otherwise("2024-1-5")
    text = F.when(key % 6 == 0, bad).otherwise(good)
    return c.table("orders").select("o_orderkey", dt.compact_date(text).alias("d"))


@query("f14_bad_date_count", "SELECT count(*) AS lignes, count(*) FILTER (o_orderkey % 6 = 0) AS dates_invalides FROM orders")
def f14_count(c):
    return f14(c).agg(F.count(F.lit(1)).alias("lignes"), F.count_if(F.col("d").isNull()).alias("dates_invalides"))


@query("f15_date_from_parts", """
 SELECT num_acc, CASE WHEN lum = 5 THEN NULL ELSE date_acc END AS d FROM caract""")
def f15(c):
    day = F.when(F.col("lum") == 5, 32).otherwise(F.day("date_acc"))
    year = F.when(F.col("atm") < 5, "24").otherwise("2024")
    return c.d.caract.select("num_acc", dt.date_from_parts(year, F.month("date_acc"), day).alias("d"))


@query("f16_clock_texts", """
 SELECT num_acc, CASE WHEN lum = 5 THEN NULL ELSE CAST(date_acc AS TIMESTAMP) + CAST(split_part(hrmn, ':', 1) AS INT) * INTERVAL 1 HOUR
   + CAST(split_part(hrmn, ':', 2) AS INT) * INTERVAL 1 MINUTE END AS ts, CAST(split_part(hrmn, ':', 1) AS INT) AS heure FROM caract""")
def f16(c):
    """'0930' and '09:30' both parse; '24:10' does not."""
    clock = (F.when(F.col("lum") == 5, "24:10").when(F.col("lum") == 4, F.replace(F.col("hrmn"), F.lit(":"), F.lit("")))
             .otherwise(F.col("hrmn")))
    return c.d.caract.select("num_acc", dt.timestamp_from(F.col("date_acc"), clock).alias("ts"),
                             dt.clock_hour(F.col("hrmn")).alias("heure"))


@query("f17_date_dispatch", """
 SELECT 'meteo' AS source, strftime(date_obs, '%Y-%m-%d') || ' 00:00:00' AS date, count(*) AS n FROM meteo GROUP BY 2
 UNION ALL SELECT 'trafic', strftime(t_1h, '%Y-%m-%d %H:%M:%S'), count(*) FROM trafic GROUP BY 2
 UNION ALL SELECT 'population', '2023-01-01 00:00:00', count(*) FROM population""")
def f17(c):
    """One `date` column from whichever temporal columns a source has."""
    sources = {
        "meteo": c.d.meteo.select("num_poste", dt.compact_key(F.col("date_obs")).alias("aaaammjj")),
        "trafic": c.d.trafic.select("iu_ac", "t_1h"),
        "population": c.d.population.select("com", "time_period")}
    out = None
    for name, df in sources.items():
        per = shape.unified_date(df).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
        row = per.select(F.lit(name).alias("source"), "date", "n")
        out = row if out is None else out.unionAll(row)
    return out


@query("f18_compact_key", "SELECT event_id, strftime(ts, '%Y%m%d') AS aaaammjj FROM events")
def f18(c):
    return c.table("events").select("event_id", dt.compact_key(F.col("ts")).alias("aaaammjj"))


@query("f19_stamp_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date FROM events")
def f19(c):
    return c.table("events").select("event_id", dt.stamp_text(F.col("ts")).alias("date"))


@query("f20_calendar_fields", """
 SELECT num_acc, CAST(year(date_acc) AS INT) AS annee, CAST(month(date_acc) AS INT) AS mois, CAST(day(date_acc) AS INT) AS jour,
  CAST(isodow(date_acc) - 1 AS INT) AS jour_num, isodow(date_acc) >= 6 AS is_weekend FROM caract""")
def f20(c):
    d = F.col("date_acc")
    return c.d.caract.select("num_acc", F.year(d).alias("annee"), F.month(d).alias("mois"), F.day(d).alias("jour"),
                             F.weekday(d).alias("jour_num"), dt.is_weekend(d).alias("is_weekend"))


@query("f21_day_names", "SELECT date_acc, dayname(date_acc) AS jour_semaine, count(*) AS n FROM caract GROUP BY 1, 2")
def f21(c):
    return (c.d.caract.select("date_acc", dt.day_name(F.col("date_acc")).alias("jour_semaine"))
            .groupBy("date_acc", "jour_semaine").agg(F.count(F.lit(1)).alias("n")))


@query("f22_iso_week_key", """
 SELECT o_orderkey, CAST(isoyear(o_orderdate) AS STRING) || '-' || lpad(CAST(weekofyear(o_orderdate) AS STRING), 2, '0') AS annee_semaine FROM orders""")
def f22(c):
    return c.table("orders").select("o_orderkey", dt.iso_week_key(F.col("o_orderdate")).alias("annee_semaine"))


@query("f23_week_and_quarter", """
 SELECT o_orderkey, CAST(weekofyear(o_orderdate) AS INT) AS semaine, CAST(quarter(o_orderdate) AS INT) AS trimestre FROM orders""")
def f23(c):
    d = F.col("o_orderdate")
    return c.table("orders").select("o_orderkey", F.weekofyear(d).alias("semaine"), F.quarter(d).alias("trimestre"))


@query("f24_fixed_holidays", """
 SELECT o_orderkey, strftime(o_orderdate, '%m-%d') AS jour_mois,
  strftime(o_orderdate, '%m-%d') IN ('01-01','05-01','05-08','07-14','08-15','11-01','11-11','12-25') AS is_ferie FROM orders""")
def f24(c):
    d = F.col("o_orderdate")
    return c.table("orders").select("o_orderkey", F.date_format(d, "MM-dd").alias("jour_mois"),
                                    dt.is_fixed_holiday(d).alias("is_ferie"))


@query("f25_holiday_calendar", """
 SELECT f.date_jour, string_agg(DISTINCT f.nom, '; ' ORDER BY f.nom) AS nom_jour_ferie, max(o.n) AS commandes FROM feries f
 JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) o ON f.date_jour = o.d GROUP BY 1""")
def f25(c):
    """Orders on public holidays, calendar generated for the span of the data."""
    days = c.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date_jour")).agg(
        F.count(F.lit(1)).alias("commandes"))
    return days.join(F.broadcast(dt.holidays_of(days, "date_jour")), "date_jour")


@query("f26_day_range", """
 SELECT j AS date_jour, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(min(date_obs), max(date_obs) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS j FROM meteo)
 LEFT JOIN (SELECT date_obs, count(*) AS n FROM meteo WHERE rr > 10 GROUP BY 1) ON j = date_obs""")
def f26(c):
    first, last = c.d.meteo.agg(F.min("date_obs"), F.max("date_obs")).head()
    wet = c.d.meteo.where("rr > 10").groupBy(F.col("date_obs").alias("date_jour")).agg(F.count(F.lit(1)).alias("n"))
    return dt.day_range(c.spark, first, last).join(wet, "date_jour", "left").na.fill({"n": 0})


@query("f27_span_days", """
 SELECT num_poste, CAST(date_diff('day', min(date_obs), max(date_obs)) + 1 AS INT) AS jours FROM meteo GROUP BY 1""")
def f27(c):
    return c.d.meteo.groupBy("num_poste").agg(dt.span_days(F.min("date_obs"), F.max("date_obs")).alias("jours"))


@query("f28_rounding", """
 SELECT num_acc, CAST(round(lat * 10000) AS BIGINT) AS lat_e4, (CAST(round(lat*10000) AS BIGINT)+50)//100 AS lat_e2, round(lat / 7, 6) AS taux FROM caract""")
def f28(c):
    lat = F.col("lat")
    return c.d.caract.select("num_acc", geo.scaled(lat).alias("lat_e4"), geo.grid_cell(lat).alias("lat_e2"),
                             F.round(lat / 7, 6).alias("taux"))


@query("f29_guarded_ratio", "SELECT iu_ac, t_1h, round(k / (q + 1), 9) AS saturation FROM trafic")
def f29(c):
    return c.d.trafic.select("iu_ac", "t_1h", F.round(F.col("k") / (F.col("q") + 1), 9).alias("saturation"))


@query("f30_threshold_flags", """
 SELECT num_poste, date_obs, CASE WHEN rr > 1 THEN 1 ELSE 0 END AS is_pluie, CASE WHEN tm > (SELECT median(tm) FROM meteo) THEN 1 ELSE 0 END AS chaud FROM meteo""")
def f30(c):
    median = exact_medians(c.d.meteo, ["tm"])["tm"]
    return c.d.meteo.select("num_poste", "date_obs", F.when(F.col("rr") > 1, 1).otherwise(0).alias("is_pluie"),
                            F.when(F.col("tm") > F.lit(median), 1).otherwise(0).alias("chaud"))


@query("f31_numeric_helpers", """
 SELECT c_custkey, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 6) AS r, greatest(c_acctbal, 100) AS g, least(c_acctbal, 100) AS l,
  CASE WHEN c_acctbal > 0 THEN 'positive (+)' ELSE 'negative (-)' END AS sens FROM customer""")
def f31(c):
    v = F.col("c_acctbal")
    return c.table("customer").select(
        "c_custkey", F.abs(v).alias("a"), F.round(F.sqrt(F.abs(v)), 6).alias("r"), F.greatest(v, F.lit(100.0)).alias("g"),
        F.least(v, F.lit(100.0)).alias("l"), F.when(v > 0, "positive (+)").otherwise("negative (-)").alias("sens"))


@query("f32_null_chain", "SELECT iu_ac, t_1h, coalesce(q, k, 0) AS v FROM trafic")
def f32(c):
    return c.d.trafic.select("iu_ac", "t_1h", F.coalesce("q", "k", F.lit(0.0)).alias("v"))


@query("d01_missing_share", """
 SELECT iu_ac, round(avg(CASE WHEN q IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS manquant FROM trafic GROUP BY 1""")
def d01(c):
    return c.d.trafic.groupBy("iu_ac").agg(F.round(F.avg(F.col("q").isNull().cast("int")), 6).alias("manquant"))


@query("d02_count_equal", """
 SELECT num_acc, count(*) FILTER (grav = 2) AS tues, count(*) FILTER (grav = 3) AS hospitalises FROM usagers GROUP BY 1""")
def d02(c):
    return c.d.usagers.groupBy("num_acc").agg(F.count_if(F.col("grav") == 2).alias("tues"),
                                              F.count_if(F.col("grav") == 3).alias("hospitalises"))


@query("d03_point_struct", "SELECT iu_ac, lat, lon FROM ref_geo")
def d03(c):
    text = F.to_json(F.struct("lon", "lat"))
    lat, lon = geo.parse_point(text)
    return c.d.ref_geo.select("iu_ac", lat.alias("lat"), lon.alias("lon"))


@query("d04_commune_format", "SELECT num_acc, com FROM caract")
def d04(c):
    number = F.concat("com", F.lit(".0")).try_cast("double").cast("int")
    return c.d.caract.select("num_acc", tx.zero_padded(number, 5).alias("com"))


@query("d05_array_to_json", """
 SELECT num_acc, '["' || voie || '","' || CAST(surf AS STRING) || '"]' AS cellule FROM lieux""")
def d05(c):
    nested = c.d.lieux.select("num_acc", F.array("voie", F.col("surf").cast("string")).alias("cellule"))
    return shape.nested_to_json(nested)


@query("d06_two_digit_years", """
 SELECT num_acc, CAST(CASE WHEN lum < 3 THEN 2000 + annee_hist % 100 ELSE annee_hist END AS INT) AS annee FROM caract""")
def d06(c):
    year = F.when(F.col("lum") < 3, F.col("annee_hist") % 100).otherwise(F.col("annee_hist"))
    return c.d.caract.select("num_acc", dt.full_year(year.cast("string")).alias("annee"))


@query("d07_banding", """
 SELECT iu_ac, t_1h, CASE WHEN q IS NULL THEN 'Inconnu' WHEN q <= 20 THEN 'bas' WHEN q <= 60 THEN 'moyen' ELSE 'haut' END AS bande FROM trafic""")
def d07(c):
    return c.d.trafic.select("iu_ac", "t_1h", lb.banded(F.col("q"), 20, 60, ("bas", "moyen", "haut"), True).alias("bande"))


@query("d08_unordered_pairs", """
 SELECT DISTINCT least(p_brand, p_type) AS a, greatest(p_brand, p_type) AS b FROM part""")
def d08(c):
    return c.table("part").select(F.least("p_brand", "p_type").alias("a"), F.greatest("p_brand", "p_type").alias("b")).distinct()

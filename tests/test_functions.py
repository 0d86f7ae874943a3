"""Column functions on hand-made frames."""

import datetime as d
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from asphalta.functions import dates as dt
from asphalta.functions import geo, labels as lb, tails, text as tx


def column(spark, values, kind, expr):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expr(F.col("v"))).collect()]


def test_sentinels(spark):
    texts = ["", " ", "nan", "None", "NULL", "-1", " -1 ", "0", " x ", None]
    assert column(spark, texts, "string", lambda c: tx.sentinel_to_null(c, "string")) == (
        [None] * 7 + ["0", "x", None])
    assert column(spark, [-1, 0, None], "int", lambda c: tx.sentinel_to_null(c, "int")) == [None, 0, None]


def test_names_fold_alike_on_both_sides(spark):
    names = [" Département ", "NUM_ACC", "Été-2021", "carcteristiques-2021.csv"]
    assert column(spark, names, "string", tx.normalised) == [tx.fold(n) for n in names]


def test_leading_integer(spark):
    texts = ["1234_5678", " 12", "-7x", "abc", "", None, "007"]
    assert column(spark, texts, "string", tx.leading_integer) == ["1234", "12", "-7", "0", "0", None, "7"]


def test_zero_padding_never_cuts(spark):
    assert column(spark, [5, 75101, 1234567, None], "int", lambda c: tx.zero_padded(c, 5)) == [
        "00005", "75101", "1234567", None]


def test_joined_key_is_null_on_any_gap(spark):
    frame = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in frame.select(tx.joined_key(F.col("x"), F.col("y"))).collect()] == ["a_b", None]


def test_compact_dates(spark):
    texts = ["20240229", "20230229", "20241345", "2024-1-1", " 20240101 ", None]
    assert column(spark, texts, "string", dt.compact_date) == [
        d.date(2024, 2, 29), None, None, None, d.date(2024, 1, 1), None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 99999999).map(lambda n: f"{n:08d}"), min_size=1, max_size=20))
def test_compact_dates_match_python(spark, texts):
    def parse(t):
        try:
            return d.datetime.strptime(t, "%Y%m%d").date()
        except ValueError:
            return None

    assert column(spark, texts, "string", dt.compact_date) == [parse(t) for t in texts]


def test_date_from_parts(spark):
    rows = [("20", "2", "29"), ("2021", "2", "29"), ("24", "13", "1"), (None, "1", "1"), ("x", "1", "1")]
    frame = spark.createDataFrame(rows, "a string, m string, j string")
    got = [r[0] for r in frame.select(dt.date_from_parts(F.col("a"), F.col("m"), F.col("j"))).collect()]
    assert got == [d.date(2020, 2, 29), None, None, None, None]


def test_clock_texts(spark):
    texts = ["930", "09:30", "24:10", "0060", "23:59", None]
    assert column(spark, texts, "string", dt.time_digits) == ["09:30", "09:30", None, None, "23:59", None]
    assert column(spark, ["09:30", "9:30", "0930", "24:10"], "string", dt.clock_hour) == [9, 9, None, None]


def test_iso_weeks(spark):
    days = [d.date(2020, 12, 31), d.date(2021, 1, 1), d.date(2021, 1, 4), d.date(2024, 12, 30)]
    assert column(spark, days, "date", dt.iso_week_key) == ["2020-53", "2020-53", "2021-01", "2025-01"]


def test_easter_dates(spark):
    frame = dt.holiday_calendar(spark, 2020, 2025).where("nom_jour_ferie LIKE '%Lundi de Pâques%'")
    mondays = sorted(r[0] for r in frame.select("date_jour").collect())
    easters = [(2020, 4, 12), (2021, 4, 4), (2022, 4, 17), (2023, 4, 9), (2024, 3, 31), (2025, 4, 20)]
    assert mondays == [d.date(*e) + d.timedelta(1) for e in easters]


def test_two_holidays_on_one_day_give_one_row(spark):
    rows = dt.holiday_calendar(spark, 2008, 2008).where("date_jour = '2008-05-01'").collect()
    assert [r["nom_jour_ferie"] for r in rows] == ["Ascension; Fête du Travail"]


def test_point_texts(spark):
    texts = ['{"lon": 2.37, "lat": 48.85}', "{'lon': 2.37, 'lat': 48.85}", "48.85,2.37", "48.85", "x,y",
             "1,2,3", "{bad", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    lat, lon = geo.parse_point(F.col("v"))
    got = [tuple(r) for r in frame.orderBy("i").select(lat, lon).collect()]
    assert got[:3] == [(48.85, 2.37)] * 3
    assert got[3:] == [(None, None)] * 5


def test_grid_cells_round_half_up(spark):
    assert column(spark, [48.8549, 48.855, 48.8551, None], "double", geo.grid_cell) == [4885, 4886, 4886, None]


def test_season_and_bands(spark):
    assert column(spark, [12, 1, 3, 8, 11, None], "int", lb.season) == [
        "Hiver", "Hiver", "Printemps", "Été", "Automne", None]
    assert column(spark, [0.0, 5.0, 5.1, None], "double", lb.rain_band) == [*lb.RAIN_LABELS, "Inconnu"]
    assert column(spark, [499.0, 500.0, 1500.0, 1501.0, None], "double", lb.traffic_band) == [
        lb.TRAFFIC_LABELS[0], lb.TRAFFIC_LABELS[1], lb.TRAFFIC_LABELS[1], lb.TRAFFIC_LABELS[2], "Inconnu"]


def test_distribution_tails():
    # Textbook points: chi-square .05 critical values and closed forms.
    assert math.isclose(tails.gamma_q(0.5, 3.841458820694124 / 2), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.gamma_q(5, 18.307038053275146 / 2), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.gamma_q(1, 40.0), math.exp(-40), rel_tol=1e-12)
    assert math.isclose(tails.pearson_p(0.5, 4), 0.5, rel_tol=1e-12)
    assert tails.pearson_p(1.0, 10) == 0.0 and math.isnan(tails.pearson_p(0.3, 2))


def test_tails_keep_their_digits_at_any_size():
    import math

    from asphalta.functions.tails import pearson_p

    for t in (0.5, 1.0, 2.5):
        for n in (1e6, 1e10, 1e12, 1e13):
            assert abs(pearson_p(t / math.sqrt(n - 2 + t * t), n) - math.erfc(t / math.sqrt(2))) < 1e-6


def test_long_prefixes_and_rare_accents(spark):
    df = spark.createDataFrame([("  0012345678901234567890x", "Győr Šumava Žižka"), ("-007", "ÇÀ"), ("abc", ""), ("-0", None), ("+5", "x")], "a string, b string")
    got = df.select(tx.leading_integer(F.col("a")).alias("a"), tx.normalised(F.col("b")).alias("b")).collect()
    assert [r["a"] for r in got] == ["12345678901234567890", "-7", "0", "0", "5"]
    assert [r["b"] for r in got] == ["gyorsumavazizka", "ca", "", None, "x"] and tx.fold("Győr Ž") == "gyorz"

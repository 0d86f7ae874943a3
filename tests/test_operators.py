"""Operators on small frames with NULLs, ties, repeated keys and empty inputs."""

import itertools
import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from asphalta.functions import labels as lb
from asphalta.operators import association as assoc
from asphalta.operators import linking, matrices, ordered, profile, severity, shape, temporal, traffic


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


# Ordered work

@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.integers(-1000, 1000)), max_size=60))
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")
    got = ordered.exact_quantiles(df, [], "v", {"a": 0.33, "m": 0.5, "z": 1.0}).collect()
    known = [v for v in values if v is not None]
    if not known:
        assert [tuple(r) for r in got] in ([], [(None, None, None)])
        return
    want = np.quantile(np.array(known, dtype=float), [0.33, 0.5, 1.0])
    assert np.allclose(list(got[0]), want)


def test_many_buckets_give_the_same_running_totals(spark):
    draw = random.Random(3)
    data = [(draw.choice("ab"), float(draw.randrange(400))) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, v double")
    bounds = ordered.value_bounds(df, ["v"], buckets=200)
    assert len(bounds["v"]) > ordered.CHUNK
    spread, plain = ordered.Balance(bounds), ordered.Balance(None)
    for balance in (spread, plain):
        got = {(r["g"], r["v"]): (r["n"], r["n_before"], r["n_total"])
               for r in ordered.ranked_counts(df, ["g"], "v", balance).collect()}
        for g, v in set(data):
            same = [x for k, x in data if k == g]
            assert got[g, v] == (same.count(v), sum(x < v for x in same), len(same))
        long = ordered.ranked_long(df, ["g"], ["v"], balance)
        assert {(r["g"], r["value"]): r["n_before"] for r in long.collect()} == {
            k: n[1] for k, n in got.items()}


def test_balance_follows_the_largest_group(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    assert ordered.Balance.of(df, ["v"]).bounds["v"]


def test_hot_value_quantile(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    want = statistics.median([7.0 if i % 3 == 0 else float(i) for i in range(3000)])
    assert ordered.exact_medians(df, ["v"])["v"] == want


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.lit("same").alias("x"))
    got = [(r["i"], r["k"]) for r in ordered.with_row_ids(df, ["k"], "i").orderBy("i").collect()]
    assert [i for i, _ in got] == list(range(1, 501))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_day_pivot(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-12-31')) AS d")
    twice = df.unionAll(df)
    assert str(ordered.distinct_position(twice, "d", 0.8)) == "2024-10-19"


# Shape

def test_alias_resolution_first_match_wins():
    assert shape.resolve_column(["x", "NUM ACC", "Accident_Id"], ["Accident Id", "num_acc"]) == "Accident_Id"
    assert shape.resolve_column(["x"], ["y"]) is None


def test_near_empty_limit_is_strict(spark):
    df = spark.range(100).select("id", F.when(F.col("id") == 0, 1).alias("one"), F.lit(None).cast("int").alias("none"))
    assert shape.drop_near_empty(df).columns == ["id", "one"]


def test_unified_date_is_idempotent_and_selective(spark):
    df = spark.createDataFrame([("a", "20240229"), ("b", "20230229")], "k string, aaaammjj string")
    once = shape.unified_date(df)
    assert once.columns == ["k", "date"]
    assert rows(once, "k", "date") == [("a", "2024-02-29 00:00:00"), ("b", None)]
    assert shape.unified_date(once) is once
    plain = df.select("k")
    assert shape.unified_date(plain) is plain


def test_flatten_and_json(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', named_struct('z', 3)) AS b")
    assert shape.flatten(df).columns == ["a", "b.x", "b.y.z"]
    assert shape.nested_to_json(df).head()["b"] == '{"x":2,"y":{"z":3}}'


def test_align_adds_and_orders(spark):
    from pyspark.sql import types as T

    df = spark.sql("SELECT 1 AS b, 'x' AS a")
    out = shape.align(df, T.StructType([T.StructField("a", T.StringType()), T.StructField("c", T.IntegerType())]))
    assert out.columns == ["a", "c"] and tuple(out.head()) == ("x", None)


# Joins

def test_lookups_keep_the_left_grain(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n")], "k int, v string")
    assert sorted(linking.left_lookup(left, right, ["k"], ["v"]).collect(), key=str) == sorted(
        [(1, "a"), (2, None), (None, None)], key=str)
    filled = linking.fill_from(left.withColumn("v", F.lit(None).cast("string")), right, ["k"], "v")
    assert filled.count() == 3


def test_match_rates_leave_nulls_out(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "k string")
    r = linking.key_match_rate(a, b, F.col("k"), F.col("k"), "a", "b", "k").head()
    assert (round(r["taux_match_a_vers_b"], 4), r["taux_match_b_vers_a"]) == (66.6667, 50.0)
    empty = linking.key_match_rate(a.limit(0), b, F.col("k"), F.col("k"), "a", "b", "k").head()
    assert (empty["taux_match_a_vers_b"], empty["taux_match_b_vers_a"]) == (0.0, 0.0)


def test_decode_takes_the_last_entry(spark):
    meta = spark.createDataFrame(
        [("GEO", "75", "old", 1), ("GEO", "75", "new", 2), ("FREQ", "75", "no", 3)],
        "cod_var string, cod_mod string, lib_mod string, rang int")
    df = spark.createDataFrame([("75",), ("99",)], "geo string")
    assert rows(linking.decode(df, meta, "GEO", "geo", "lib", "rang"), "geo", "lib") == [("75", "new"), ("99", None)]


# Severity, time

def test_severity_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", 3, 1), ("a", 3, 2), ("b", None, 1), ("c", 1, 1), ("c", 4, 2), ("c", 2, 3)], "k string, grav int, id int")
    assert rows(severity.worst_severity(df, ["k"], lb.WEIGHTS_YEARLY), "k", "grav") == [("a", 3), ("b", None), ("c", 2)]
    assert rows(severity.worst_rows(df, ["k"], lb.WEIGHTS_YEARLY, ["id"]), "k", "id") == [("a", 1), ("b", 1), ("c", 3)]
    assert rows(severity.any_severe(df, ["k"]), "k", "est_grave") == [("a", True), ("b", False), ("c", True)]


def test_levels_filled_or_null(spark):
    df = spark.createDataFrame([(5, True), (5, False), (None, True)], "heure int, est_grave boolean")
    hours = temporal.by_hour(df).orderBy("heure").collect()
    assert len(hours) == 24 and hours[5]["nb_accidents"] == 2 and hours[5]["taux_grave_pct"] == 50.0
    assert hours[0]["nb_accidents"] == 0 and hours[0]["taux_grave_pct"] == 0.0
    named = spark.createDataFrame([("Hiver", True)], "saison string, est_grave boolean")
    seasons = temporal.by_season(named).orderBy("position").collect()
    assert [s["nb_accidents"] for s in seasons] == [1, None, None, None]


# Traffic

def test_sensor_threshold_is_inclusive(spark):
    def sensor(name, missing, total):
        return [("f", name, None if i < missing else float(i), 1.0) for i in range(total)]

    data = sensor("keep", 3, 10) + sensor("drop", 4, 10) + sensor("void", 2, 2) + sensor("one", 0, 1)
    df = spark.createDataFrame(data, "fichier_source string, iu_ac string, q double, k double").withColumn(
        "t_1h", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    out = {r["iu_ac"]: r for r in traffic.weekly_aggregate(df).collect()}
    assert set(out) == {"keep", "one"}
    # 3..9 known, median 6 fills three gaps.
    assert out["keep"]["q_total"] == sum(range(3, 10)) + 18 and out["keep"]["nb_heures"] == 10
    assert out["keep"]["q_missing_rate"] == pytest.approx(0.3)


# Statistics

def chi2_by_hand(table):
    t = np.array(table, dtype=float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    d = np.abs(t - e)
    if t.shape == (2, 2):
        d = d - np.minimum(0.5, d)
    return (d ** 2 / e).sum()


@pytest.mark.parametrize("table", [[[10, 20], [30, 5]], [[5, 1, 9, 3], [2, 8, 4, 4], [0, 3, 6, 1]], [[1, 1], [1, 1]]])
def test_chi_square(spark, table):
    data = [(f"r{i}", f"c{j}") for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]
    got = assoc.independence_test(spark.createDataFrame(data, "a string, b string"), "a", "b").head()
    assert got["chi2"] == pytest.approx(chi2_by_hand(table), abs=1e-9)
    assert 0 <= got["v_cramer"] <= 1 and 0 <= got["p_value"] <= 1


def test_single_column_table_has_no_test(spark):
    got = assoc.independence_test(spark.createDataFrame([("a", "x"), ("b", "x")], "a string, b string"), "a", "b").head()
    assert got["dof"] == 0 and got["p_value"] is None and got["v_cramer"] is None


def ranks(v):
    order = sorted(v)
    return [order.index(x) + (order.count(x) + 1) / 2 for x in v]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.integers(0, 6))] * 3), min_size=4, max_size=40))
def test_correlations_match_numpy(spark, data):
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in data],
                               "a double, b double, c double")
    pearson = {(r[0], r[1]): (r["r"], r["n"]) for r in assoc.pearson_pairs(df, ["a", "b", "c"]).collect()}
    spearman = {(r[0], r[1]): r["rho"] for r in assoc.spearman_pairs(df, ["a", "b", "c"]).collect()}
    for (i, x), (j, y) in itertools.combinations(enumerate("abc"), 2):
        both = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
        assert pearson[x, y][1] == len(both)
        xs, ys = [p[0] for p in both], [p[1] for p in both]
        if len(set(xs)) < 2 or len(set(ys)) < 2:
            assert pearson[x, y][0] is None and spearman.get((x, y)) is None
            continue
        assert pearson[x, y][0] == pytest.approx(np.corrcoef(xs, ys)[0, 1], abs=1e-9)
        assert spearman[x, y] == pytest.approx(np.corrcoef(ranks(xs), ranks(ys))[0, 1], abs=1e-9)


def test_vif_matches_regression_without_intercept(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(3, 1, (200, 3))
    x[:, 2] += 0.7 * x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    df = df.withColumn("const", F.lit(1.0))
    got = {r["variable"]: r["vif"] for r in assoc.variance_inflation(df, ["a", "b", "c", "const"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for i, n in enumerate("abc"):
        rest = np.delete(x, i, 1)
        fit = rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fit) ** 2).sum() / (x[:, i] ** 2).sum()
        assert got[n] == pytest.approx(1 / (1 - r2), rel=1e-8)


# Quality

def test_profile_of_gaps_and_texts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b"), (4, None)], "n int, t string")
    got = {r["colonne"]: r for r in profile.column_profile(df).collect()}
    assert (got["n"]["nb_manquants"], got["n"]["mediane"], got["n"]["nb_uniques"]) == (1, 2.0, 3)
    assert got["t"]["top_3_valeurs"] == "a (2); b (1)" and got["t"]["min"] is None


def test_grain_check_sees_fan_out(spark):
    fact = spark.range(5).toDF("id")
    doubled = fact.unionAll(fact.limit(1))
    assert profile.grain_check(fact, fact, "id").head()["grain_ok"]
    assert not profile.grain_check(fact, doubled, "id").head()["grain_ok"]


def test_anomaly_limits(spark):
    df = spark.range(100).select(
        F.when(F.col("id") > 0, F.col("id")).alias("k"), F.when(F.col("id") >= 5, 1).alias("five"),
        F.when(F.col("id") >= 4, 1).alias("four"))
    log = {r["detail"]: r["nb"] for r in profile.anomaly_log(df, "f", "k", ["k", "absent"]).collect()}
    assert log == {"absent": 1, "clé k": 1, "colonne five": 5}


def test_empty_dataset_is_reported(spark):
    log = profile.anomaly_log(spark.range(0).toDF("k"), "f", "k", ["k"]).collect()
    assert [(r["categorie"], r["detail"]) for r in log] == [("DONNEES", "vide")]


def test_multi_date_guard(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, d int")
    assert profile.assert_single_date(df, "k", "d") is df
    with pytest.raises(ValueError):
        profile.assert_single_date(df.unionAll(df.selectExpr("k", "d + 1")), "k", "d")


def test_mutual_information_extremes(spark):
    df = spark.range(4000).select(
        (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 10 + 0.0).alias("same"),
        F.floor(F.col("id") / 2).cast("double").alias("free"), F.lit(1.0).alias("flat"))
    got = {r["variable"]: r["mutual_info"] for r in assoc.mutual_information(df, ["same", "free", "flat"], "y").collect()}
    assert got["same"] == pytest.approx(np.log(2))
    assert got["flat"] == pytest.approx(0, abs=1e-12) and 0 <= got["free"] < 0.01


@pytest.mark.parametrize("held", [0, 20, 1_000_000])
def test_spearman_ranks_inside_tasks_and_by_join(spark, held):
    """Columns ranked in tasks, by join or both give the ranks of plain counting; rows are never exploded otherwise."""
    rng = np.random.default_rng(7)
    rows = [tuple(None if rng.random() < gap else float(rng.integers(0, top)) for top, gap in (
        (4, 0.0), (9, 0.2), (300, 0.2), (300, 0.0))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["var1"], r["var2"]): (r["rho"], r["n"]) for r in matrices.spearman(df, list("abcd"), held).collect()}
    for i, j in ((i, j) for i in range(4) for j in range(i + 1, 4)):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        x, y = (ranks(list(v)) for v in zip(*both))
        assert got["abcd"[i], "abcd"[j]] == (pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9), len(both))


def test_running_counts_need_one_shuffle_and_equal_the_bucketed_ones(spark, monkeypatch):
    """Few values a sensor: one exchange; the way for many gives the same rows. Files without a name take no part."""
    rng = np.random.default_rng(3)
    known = [(f, s, float(rng.integers(0, 40)) if rng.random() < 0.9 else None, float(rng.integers(0, 9)))
             for f in ("a", "b", None) for s in ("1", "2") for _ in range(60)]
    readings = spark.createDataFrame(known, "fichier_source string, iu_ac string, q double, k double").withColumn(
        "t_1h", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    counts = traffic.materialize(traffic.value_counts(readings), "counts")
    plan = traffic.running_counts(counts)
    names = ("fichier_source", "iu_ac", "variable", "value", "n", "n_before", "n_total")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    few = sorted(map(str, plan.select(*names).collect()))
    monkeypatch.setattr(traffic, "SMALL_GROUP", 0)
    assert few and few == sorted(map(str, traffic.running_counts(counts).select(*names).collect()))

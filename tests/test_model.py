"""Preparation, metrics and models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from asphalta import session
from asphalta.ml import explain, metrics, models, prep
from asphalta.operators.ordered import Balance, value_bounds


def scores(spark, pairs):
    return spark.createDataFrame([(float(s), y) for s, y in pairs], "s double, y int")


def auc_by_pairs(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def ap_by_steps(pairs):
    total, ap, prev = sum(y for _, y in pairs), 0.0, 0.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        hit = [y for s, y in pairs if s >= t]
        recall = sum(hit) / total
        ap, prev = ap + (recall - prev) * sum(hit) / len(hit), recall
    return ap


CASES = {
    "ties": [(0.5, 1), (0.5, 0), (0.5, 1), (0.2, 0), (0.9, 0)],
    "perfect": [(0.9, 1), (0.8, 1), (0.1, 0)],
    "inverted": [(0.1, 1), (0.9, 0), (0.8, 0)],
    "random": [(round(random.Random(i).random(), 2), random.Random(i + 500).randrange(2)) for i in range(300)],
}


@pytest.mark.parametrize("name", CASES)
def test_ranking_metrics(spark, name):
    df = scores(spark, CASES[name])
    for balance in (None, Balance(value_bounds(df, ["s"], buckets=50))):
        got = metrics.ranking_metrics(df, "s", "y", balance=balance).head()
        assert got["roc_auc"] == pytest.approx(auc_by_pairs(CASES[name]))
        assert got["pr_auc"] == pytest.approx(ap_by_steps(CASES[name]))


def test_one_class_has_no_auc(spark):
    got = metrics.ranking_metrics(scores(spark, [(0.3, 0), (0.4, 0)]), "s", "y").head()
    assert got["roc_auc"] is None and got["pr_auc"] is None


def test_threshold_metrics_with_no_positive_prediction(spark):
    got = metrics.threshold_metrics(scores(spark, CASES["ties"]), "s", "y", 2.0).head()
    assert (got["precision_grave"], got["recall_grave"], got["f1_grave"]) == (0.0, 0.0, 0.0)
    assert got["TN"] + got["FP"] + got["FN"] + got["TP"] == len(CASES["ties"])


def test_best_threshold_takes_lowest_on_ties(spark):
    pairs = [(0.9, 1), (0.8, 0), (0.7, 0), (0.6, 1), (0.1, 0)]

    def f1(t):
        tp = sum(y for s, y in pairs if s >= t)
        fp = sum(1 - y for s, y in pairs if s >= t)
        p, r = tp / (tp + fp), tp / 2
        return 2 * p * r / (p + r) if p + r else 0

    best = max(f1(s) for s, _ in pairs)
    want = min(s for s, _ in pairs if f1(s) == best)
    got = metrics.best_f1_threshold(scores(spark, pairs), "s", "y").head()
    assert (got["seuil"], got["f1"]) == (want, pytest.approx(best))


def test_curves_end_where_they_should(spark):
    roc = metrics.roc_points(scores(spark, CASES["random"]), "s", "y").collect()
    assert max(r["tpr"] for r in roc) == 1.0 and max(r["fpr"] for r in roc) == 1.0
    assert any(r["seuil"] is None and r["tpr"] == 0.0 for r in roc)


def test_target_guards(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "grav int")
    assert [r[0] for r in prep.define_target(df).select("grave").collect()] == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        prep.define_target(df, leakage=["grave"])
    with pytest.raises(ValueError):
        prep.define_target(df.select(F.lit(1).alias("x")))


def test_banned_names_never_become_features():
    names = ["mois", "population", "grav", "catu", "secu1", "id_fait", "saison", "unlisted"]
    assert prep.select_features(names) == ["population", "mois", "saison"]


def test_lumping_and_one_hot(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbc"] + [(None,)], "v string")
    lumped = prep.lump_rare(df, "v", k=2)
    assert sorted(r[0] or "NULL" for r in lumped.collect()) == ["AUTRE", "AUTRE", "a", "a", "a", "b", "b"]
    coded = prep.one_hot(df, "v", ["a", "b", "c"])
    assert coded.columns == ["v_b", "v_c"] and coded.agg(F.sum("v_b"), F.sum("v_c")).head()[:] == (2, 1)


def test_split_is_disjoint_and_imputation_sees_train_only(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-10')) AS d").withColumn(
        "v", F.when(F.day("d") != 5, F.day("d").cast("double")))
    train, test = prep.temporal_split(df, "d")
    assert (train.count(), test.count()) == (8, 2)
    assert train.agg(F.max("d")).head()[0] < test.agg(F.min("d")).head()[0]
    assert prep.fit_imputation(train, ["v"]) == {"v": 4.0}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "grave int")
    assert sorted(tuple(r) for r in prep.class_weights(df).collect()) == [(0, pytest.approx(10 / 18)), (1, 5.0)]


@pytest.fixture(scope="module")
def fitted(spark):
    draw = random.Random(0)
    data = []
    for _ in range(800):
        a, b = draw.random(), draw.random()
        data.append((a, b, int(a + 0.1 * draw.random() > 0.6)))
    df = spark.createDataFrame(data, "a double, b double, grave int").cache()
    return df, models.fit_boosted(df, ["a", "b"], trees=5)


def test_boosted_model_finds_the_signal(spark, fitted):
    df, model = fitted
    scored = models.scored(model, models.assembled(df, ["a", "b"]))
    assert metrics.ranking_metrics(scored, "y_probs", "grave").head()["roc_auc"] > 0.95
    assert models.importances(model, ["a", "b"], spark).head()["feature"] == "a"


def test_permutation_importance_ranks_the_signal_first(fitted):
    df, model = fitted
    got = {r["feature"]: r for r in explain.permutation_importance(model, df, ["a", "b"], "grave", repeats=3).collect()}
    assert got["a"]["importance_mean"] > 0.2 > abs(got["b"]["importance_mean"])
    assert got["a"]["importance_std"] >= 0


def test_every_place_goes_to_one_other(spark):
    for n in (1, 2, 3, 5, 16, 17, 50, 997, 5000):
        places = spark.range(n).select(*[explain.permuted(F.col("id"), n, F.lit(k)).alias(f"p{k}") for k in range(3)]).collect()
        for k in range(3):
            assert sorted(r[k] for r in places) == list(range(n))
        if n > 16:
            assert len({tuple(r[k] for r in places) for k in range(3)}) == 3


def test_permutations_are_drawn_alike(spark):
    """All permutations of four and five places come up about as often."""
    for n, draws in ((4, 9600), (5, 24000)):
        moved = spark.range(draws).select(F.array(*[explain.permuted(F.lit(i), n, F.col("id")) for i in range(n)]).alias("p"))
        counts = [r["count"] for r in moved.groupBy("p").count().collect()]
        expected = draws / math.factorial(n)
        assert len(counts) == math.factorial(n)
        # Chi-square over its degrees of freedom is near one for free draws.
        assert sum((x - expected) ** 2 / expected for x in counts) / (len(counts) - 1) < 1.6


def test_every_feature_has_partners_of_its_own(spark):
    base = spark.range(60).select("id", F.array(*[F.col("id").cast("double")] * 3).alias("x"), F.lit(0).alias("y"))
    rows = explain.partners(base, 60, 2, 7).collect()
    assert len(rows) == 120
    for r in (0, 1):
        maps = [tuple(int(x["z"][j]) for x in sorted(rows, key=lambda x: x["id"]) if x["essai"] == r) for j in range(3)]
        assert all(sorted(m) == list(range(60)) for m in maps) and len(set(maps)) == 3


def test_an_unused_feature_has_no_importance(spark):
    draw = random.Random(5)
    df = spark.createDataFrame([(a, 1.0 if i % 2 else 0.0, int(a > 0.5)) for i in range(300) for a in [draw.random()]], "a double, b double, grave int")
    model = models.fit_boosted(df, ["a", "b"], trees=1, depth=1, rows=1.0, columns=1.0)
    got = {r["feature"]: r for r in explain.permutation_importance(model, df, ["a", "b"], "grave", repeats=4).collect()}
    assert (got["b"]["importance_mean"], got["b"]["importance_std"]) == (0.0, 0.0)
    # Shuffling the only feature used leaves an area of one half.
    assert got["a"]["importance_mean"] == pytest.approx(0.5, abs=0.1) and got["a"]["importance_std"] > 0


def test_strategies_and_their_winner(spark):
    from asphalta.catalog.modelling import compared

    one, two = scores(spark, CASES["random"]), scores(spark, [(float(y), y) for _, y in CASES["random"]])
    rows = {r["strategie"]: r for r in compared([("x", one, 0.5), ("y", two, 0.5), ("z", two, 0.5)], "s", "y").collect()}
    assert [n for n, r in rows.items() if r["gagnant"]] == ["y"] and rows["y"]["roc_auc"] == rows["y"]["f1_grave"] == 1.0


def test_a_balanced_fit_leaves_no_residual(spark, fitted):
    from types import SimpleNamespace

    from asphalta.catalog.modelling import logistic_measures

    df, _ = fitted
    row = logistic_measures(SimpleNamespace(spark=spark), df, df, ["a", "b"], "x").head()
    assert abs(row["residu_moyen"]) < 1e-4 and row["n_train"] == 800 and row["roc_auc"] > 0.95 and row["tours"] > 0
    assert row["TP"] + row["FN"] == df.where("grave = 1").count()


def test_logistic_regression_uses_scaled_balanced_data(fitted):
    df, _ = fitted
    scaled = prep.scale(df, prep.fit_scaling(df, ["a", "b"]))
    model = models.fit_logistic(scaled, ["a", "b"])
    assert model.coefficients[0] > 1 > abs(model.coefficients[1])


def test_forest_importances_and_method_table(spark, fitted):
    df, model = fitted
    forest = models.importances(models.fit_forest(df, ["a", "b"], trees=5, depth=3), ["a", "b"], spark)
    values = {r["feature"]: r["importance"] for r in forest.collect()}
    assert sum(values.values()) == pytest.approx(1.0) and values["a"] > values["b"]
    table = explain.top_by_method({"forest": forest, "boosted": models.importances(model, ["a", "b"], spark)}, k=1)
    assert sorted((r["methode"], r["feature"], r["rang"]) for r in table.collect()) == [
        ("boosted", "a", 1), ("forest", "a", 1)]


def test_a_measure_that_is_nowhere_known_does_not_stop_a_model(spark):
    """Medians of a column without values are NULL; its gaps must not reach the models."""
    rows = [(f"{i}", f"{i}_1_1", f"202401{1 + i % 20:02d}", 2 if i % 3 else 1, float(i % 7), 1.0 + i % 5, 0.0, None) for i in range(200)]
    enriched = spark.createDataFrame(rows, "num_acc string, id_usager string, aaaammjj string, grav int, q_moyen double, "
                                           "k_moyen double, meteo_precipitations double, meteo_temp_moy double")
    table, features = prep.feature_table(enriched)
    assert "meteo_temp_moy" in features and prep.fit_imputation(enriched, ["meteo_temp_moy"]) == {}
    assert table.where(" OR ".join(f"{f} IS NULL" for f in features)).count() == 0
    forest = models.importances(models.fit_forest(table, features, trees=2, depth=2), features, spark)
    assert forest.where("feature = 'meteo_temp_moy'").head()["importance"] == 0.0


def test_small_tables_are_dealt_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    one = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("grave")).coalesce(1)
    assert session.spread(one).rdd.getNumPartitions() == 2
    assert sorted(session.spread(one).collect()) == sorted(one.collect())
    assert session.spread(one.where("a < 60")).rdd.getNumPartitions() == 1
    assert session.spread(one.repartition(5)).rdd.getNumPartitions() == 5
    base, n = explain.numbered_base(one, ["a"], "grave", 1)
    assert n == 100 and base.rdd.getNumPartitions() >= 2
    assert sorted(r.id for r in base.collect()) == list(range(100))


def test_boosted_trees_equal_sparks_where_nothing_is_sampled(spark):
    from pyspark.ml.classification import GBTClassifier

    draw = random.Random(11)
    rows = [(i, *(float(draw.randrange(n)) for n in (9, 5, 2, 30)), draw.random()) for i in range(1500)]
    rows = [(*r[:5], int(r[5] < 0.1 + 0.07 * (r[1] > 4) * r[2] + 0.2 * r[3] * (r[4] > 11))) for r in rows]
    df, names = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, grave int"), list("abcd")
    for weighted in (False, True):
        ours = models.fit_boosted(df, names, weighted=weighted, trees=7, depth=3, rate=0.2, rows=1.0, columns=1.0)
        data = prep.with_class_weights(models.assembled(df, names))
        plain = GBTClassifier(labelCol="grave", maxIter=7, stepSize=0.2, maxDepth=3, **{"weightCol": "poids"} if weighted else {}).fit(data)
        got, want = ({r["id"]: r["y_probs"] for r in models.scored(m, data).collect()} for m in (ours, plain))
        assert got == pytest.approx(want, abs=1e-7)
        assert ours.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-5)
        assert ours.treeWeights == plain.treeWeights
    sampled = models.fit_boosted(df, names, trees=20)
    assert len(sampled.trees) == 20 and max(t.depth for t in sampled.trees) == 4
    with pytest.raises(Exception):
        models.fit_boosted(df.limit(0), names, trees=1)


def test_a_fit_starts_no_job_for_each_tree(spark, fitted):
    df, _ = fitted
    started = []
    for trees in (2, 12):
        spark.sparkContext.setJobGroup(f"fit-{trees}", "")
        models.fit_boosted(df, ["a", "b"], trees=trees)
        started.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{trees}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert started[0] == started[1] > 0


def test_a_tree_of_the_forest_equals_sparks_without_samples(spark):
    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier

    draw = random.Random(12)
    rows = [tuple(float(draw.randrange(n)) for n in (9, 5, 2, 30)) for _ in range(1500)]
    df = spark.createDataFrame([(i, *r, int(draw.random() < 0.1 + 0.07 * (r[0] > 4) * r[1] + 0.2 * r[2] * (r[3] > 11))) for i, r in enumerate(rows)],
                               "id int, a double, b double, c double, d double, grave int")
    plain = RandomForestClassifier(labelCol="grave", numTrees=1, maxDepth=5, bootstrap=False).fit(models.assembled(df, list("abcd")))
    ours = models.fit_forest(df, list("abcd"), trees=1, depth=5, bootstrap=False)
    assert ours.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-6)
    want = [r["y_probs"] for r in models.scored(plain, models.assembled(df, list("abcd"))).orderBy("id").collect()]
    assert ours.probability(np.array(rows)) == pytest.approx(want, abs=1e-9)
    many = models.fit_forest(df, list("abcd"), trees=6, depth=3)
    weights = [t.sums[0, 1] for t in many.trees]  # rows drawn with replacement: 1500 each on average, not alike
    assert len(set(weights)) > 1 and all(abs(w - 1500) < 200 for w in weights)


def test_a_forest_keeps_no_count_of_every_tree_for_a_row(spark, fitted):
    df, _ = fitted
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    started = []
    for trees in (2, 9):
        spark.sparkContext.setJobGroup(f"forest-{trees}", "")
        models.fit_forest(df, ["a", "b"], trees=trees, depth=6)
        started.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{trees}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert started[0] == started[1] and spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_scores_are_looked_up_by_bin(spark, fitted, monkeypatch):
    """No row is scored anew for a repeat, and the scores are the model's; many rows take the other way."""
    import numpy as np

    from asphalta.ml import blocks, shapley

    df, model = fitted
    parsed = [(2.0 * w, shapley.leaves_of(t.toDebugString.split("\n"))) for w, t in zip(model.treeWeights, model.trees)]
    boxes, tree = shapley.boxes_of(parsed), np.repeat(np.arange(len(parsed)), [len(v) for _, v in parsed])
    ends = [np.concatenate([b[boxes.feature == j] for b in (boxes.low, boxes.high)]) for j in (0, 1)]
    edges = [np.unique(e[np.isfinite(e)]) for e in ends]
    x = np.array([[r["a"], r["b"]] for r in df.limit(50).collect()])
    bins = blocks.binned(x, edges).T
    for j in (0, 1):
        table = explain.score_table(boxes, tree, edges, bins, j)
        for b, at in enumerate([*edges[j], 9.0]):
            moved = x.copy()
            moved[:, j] = at
            assert table[:, b] / explain.SCORE_UNIT == pytest.approx(boxes.score(moved), abs=1e-9)
    assert explain.area(np.array([1.0, 1.0, 2.0, 0.0]), np.array([True, False, True, False])) == 0.875
    monkeypatch.setattr(explain, "score_arrays", None)
    one = {r["feature"]: r["importance_mean"] for r in explain.permutation_importance(model, df, ["a", "b"], "grave", repeats=8).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(explain, "RANKED_ROWS", 10)
    other = {r["feature"]: r["importance_mean"] for r in explain.permutation_importance(model, df, ["a", "b"], "grave", repeats=8).collect()}
    assert one == pytest.approx(other, abs=0.03)

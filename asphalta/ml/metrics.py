"""Ranking metrics, threshold search, curves and error tables.

Everything starts from counts per distinct score, so ties are exact and no task
sorts more than one range of scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Balance, running_totals

CATEGORIES = {"TP": "TP (grave détecté)", "TN": "TN (léger détecté)",
              "FN": "FN (grave RATÉ)", "FP": "FP (fausse alerte)"}


def score_counts(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    kept = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return kept.groupBy(*groups, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def cumulated(df: DataFrame, score: str, label: str, groups: Sequence[str] = (),
              balance: Balance | None = None) -> DataFrame:
    """Per distinct score: positives and negatives at or above it."""
    balance = balance or Balance.of(df, [score])
    counts = score_counts(df, score, label, groups)
    out = running_totals(counts, groups, "score", ["pos", "neg"],
                         balance.bucket(score, F.col("score")), descending=True)
    return out.withColumns({"tp": F.col("pos_before") + F.col("pos"),
                            "fp": F.col("neg_before") + F.col("neg")})


def ranking_metrics(df: DataFrame, score: str, label: str, groups: Sequence[str] = (),
                    balance: Balance | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count half) and stepwise average precision."""
    c = cumulated(df, score, label, groups, balance)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    # Negatives below a score are all negatives minus those at or above it.
    below = F.col("neg_total") - F.col("fp")
    area = F.sum(pos * (below + neg / 2))
    pairs = F.max(F.col("pos_total").cast("double") * F.col("neg_total"))
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    ap = F.sum(pos * precision)
    aggs = [F.try_divide(area, pairs).alias("roc_auc"),
            F.try_divide(ap, F.max("pos_total").cast("double")).alias("pr_auc")]
    return c.groupBy(*groups).agg(*aggs) if groups else c.agg(*aggs)


def outcome(score: Column, label: Column, threshold: float) -> Column:
    """Short name of the prediction outcome at a threshold."""
    hit = score >= F.lit(threshold)
    return (F.when((label == 1) & hit, "TP").when((label == 0) & ~hit, "TN")
            .when((label == 1) & ~hit, "FN").when((label == 0) & hit, "FP"))


def threshold_metrics(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """Confusion counts, precision, recall and F1 (0 where undefined)."""
    o = outcome(F.col(score), F.col(label), threshold)
    n = df.agg(*[F.count_if(o == k).alias(k) for k in ("TN", "FP", "FN", "TP")])
    tp = F.col("TP").cast("double")
    p = F.coalesce(F.try_divide(tp, F.col("TP") + F.col("FP")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, F.col("TP") + F.col("FN")), F.lit(0.0))
    return n.select(
        F.lit(float(threshold)).alias("seuil"), p.alias("precision_grave"), r.alias("recall_grave"),
        F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0)).alias("f1_grave"),
        "TN", "FP", "FN", "TP")


def best_f1_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """Score that maximises F1 when used as threshold; the lowest one on ties."""
    c = cumulated(df, score, label)
    p = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("pos_total"))
    f1 = F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0))
    best = c.agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("neg_score"))).alias("b"))
    return best.select((-F.col("b.neg_score")).alias("seuil"), F.col("b.f1").alias("f1"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, plus the origin."""
    c = cumulated(df, score, label)
    points = c.select(
        F.col("score").alias("seuil"),
        F.try_divide(F.col("fp").cast("double"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("pos_total")).alias("tpr"))
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("seuil"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the end point."""
    c = cumulated(df, score, label)
    points = c.select(
        F.col("score").alias("seuil"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("pos_total")).alias("recall"))
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("seuil"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def full_metrics(df: DataFrame, score: str, label: str, threshold: float, name: str) -> DataFrame:
    """One comparison row: ranking metrics and threshold metrics."""
    one = F.lit(name).alias("strategie")
    left = ranking_metrics(df, score, label).select(one, "roc_auc", "pr_auc")
    right = threshold_metrics(df, score, label, threshold).select(one, "*")
    return left.join(right, "strategie")


def best_by(rows: DataFrame, name: str = "strategie", metric: str = "f1_grave") -> DataFrame:
    """Best row by a metric, first name on ties."""
    return rows.orderBy(F.col(metric).desc(), F.col(name).asc()).limit(1).select(name, metric)


def categorised(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    from ..functions.labels import coded

    o = outcome(F.col(score), F.col(label), threshold)
    return df.withColumn("categorie", coded(o, CATEGORIES))


def missed_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of each feature over missed and over found severe cases, and the gap."""
    fn, tp = F.col("categorie") == CATEGORIES["FN"], F.col("categorie") == CATEGORIES["TP"]
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(F.when(fn, F.col(f))).alias(f"f{i}"), F.avg(F.when(tp, F.col(f))).alias(f"t{i}")]
    wide = df.agg(*aggs)
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"f{i}").alias("moyenne_fn"),
                 F.col(f"t{i}").alias("moyenne_tp")) for i, f in enumerate(features)])).alias("p"))
    return (rows.select("p.*").withColumn("ecart", F.col("moyenne_fn") - F.col("moyenne_tp"))
            .orderBy(F.abs("ecart").desc_nulls_last(), "feature"))


def score_histogram(df: DataFrame, score: str, bins: int = 20) -> DataFrame:
    """Equal-width score histogram per category, each over its own range."""
    ranges = df.where(F.col("categorie").isNotNull()).groupBy("categorie").agg(
        F.min(score).alias("bas"), F.max(score).alias("haut"))
    joined = df.select("categorie", score).join(F.broadcast(ranges), "categorie")
    width = (F.col("haut") - F.col("bas")) / bins
    index = F.when(width > 0, F.least(
        F.floor((F.col(score) - F.col("bas")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return joined.groupBy("categorie", index.cast("int").alias("classe")).agg(
        F.count(F.lit(1)).alias("n"))


def worst_missed(df: DataFrame, score: str, tie: Sequence[str], k: int = 10) -> DataFrame:
    """Severe cases the model was most wrongly sure about."""
    return df.where(F.col("categorie") == CATEGORIES["FN"]).orderBy(score, *tie).limit(k)


def error_summary(df: DataFrame) -> DataFrame:
    """Counts per category and the share of severe cases missed."""
    counts = {k: F.count_if(F.col("categorie") == v).alias(f"n_{k.lower()}")
              for k, v in CATEGORIES.items()}
    row = df.agg(F.count(F.lit(1)).alias("n_total"), *counts.values())
    severe = F.col("n_fn") + F.col("n_tp")
    return row.select("*", severe.alias("n_graves"),
                      F.try_divide(F.col("n_fn") * 100.0, severe).alias("pct_rates"))

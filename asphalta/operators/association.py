"""Contingency tables, correlation, association and collinearity.

Each statistic is one pass: pair counts or pair sums come out of a single
aggregate whatever the number of pairs, and only result-sized frames (columns x
columns) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions.tails import chi2_tail, correlation_tail
from . import matrices
from .ordered import bucket_of, ranked_long


def cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed counts of two categories, NULLs left out."""
    return (df.na.drop(subset=[a, b]).groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
            .agg(F.count(F.lit(1)).alias("n")))


def contingency(df: DataFrame, a: str, b: str, total: str = "Total") -> DataFrame:
    """Long contingency table with row, column and grand totals."""
    kept = df.na.drop(subset=[a, b])
    cube = kept.cube(a, b).agg(F.count(F.lit(1)).alias("n"))
    return cube.na.fill({a: total, b: total})


def contingency_wide(df: DataFrame, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """Wide contingency table over known column labels, zero where empty."""
    kept = df.na.drop(subset=[a, b])
    return kept.groupBy(a).pivot(b, list(columns)).count().na.fill(0)


def row_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """Percentage of each row total."""
    table = cells(df, a, b)
    totals = table.groupBy("a").agg(F.sum("n").alias("_t"))
    return table.join(totals, "a").select(
        F.col("a").alias(a), F.col("b").alias(b), "n",
        (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def chi_square(counts: DataFrame, keys: Sequence[str] = (), correction: bool = True) -> DataFrame:
    """Chi-square statistic, degrees of freedom, n, rows and columns per table.

    With E = r c / n, the sum of (O - E)^2 / E over all cells is
    n (sum O^2 / (r c) - 1), so empty cells need not be produced.  The continuity
    correction applies to 2 x 2 tables only; there every cell deviates by the same
    amount d, and the sum is (d - min(.5, d))^2 times the sum of 1 / E.
    """
    keys = list(keys)
    rows = counts.groupBy(*keys, "a").agg(F.sum("n").alias("row_n"))
    cols = counts.groupBy(*keys, "b").agg(F.sum("n").alias("col_n"))
    row_side = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("r"), F.sum("row_n").alias("n_all"),
        F.sum(1.0 / F.col("row_n")).alias("inv_r"))
    col_side = cols.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum(1.0 / F.col("col_n")).alias("inv_c"))
    joined = counts.join(rows, [*keys, "a"]).join(cols, [*keys, "b"])
    o, e = F.col("n").cast("double"), F.col("row_n").cast("double") * F.col("col_n")
    sums = joined.groupBy(*keys).agg(
        F.sum(o * o / e).alias("s"),
        F.min(F.struct("a", "b", "n", "row_n", "col_n")).alias("cell"))
    if keys:
        out = sums.join(row_side, keys).join(col_side, keys)
    else:
        one = F.lit(1)
        out = (sums.withColumn("_j", one).join(row_side.withColumn("_j", one), "_j")
               .join(col_side.withColumn("_j", one), "_j").drop("_j"))
    n = F.col("n_all").cast("double")
    plain = n * (F.col("s") - 1.0)
    cell = F.col("cell")
    d = F.abs(cell["n"] - cell["row_n"].cast("double") * cell["col_n"] / n)
    yates = F.pow(d - F.least(F.lit(0.5), d), 2) * n * F.col("inv_r") * F.col("inv_c")
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    stat = F.when((dof == 1) & F.lit(correction), yates).otherwise(F.greatest(plain, F.lit(0.0)))
    return out.select(*keys, stat.alias("chi2"), dof.cast("bigint").alias("dof"),
                      F.col("n_all").alias("n"), "r", "k")


def independence_test(df: DataFrame, a: str, b: str, correction: bool = True) -> DataFrame:
    """Chi-square, p-value and Cramer's V of two categories."""
    stat = chi_square(cells(df, a, b), (), correction)
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("r", "k") - 1)))
    return stat.select("chi2", "dof", "n", chi2_tail(F.col("chi2"), F.col("dof")).alias("p_value"),
                       v.alias("v_cramer"))


def few_levels(df: DataFrame, columns: Sequence[str], most: int) -> dict[str, list[str]]:
    """Levels of the columns that have at most `most`, in order; counted exactly, repeats falling together first."""
    named = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    values = df.select(named).select("p.*").where("value IS NOT NULL").distinct()
    counted = values.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in values.join(F.broadcast(counted), "variable").collect():  # at most `most` a column
        levels[row["variable"]].append(row["value"])
    return {c: sorted(v) for c, v in levels.items() if v}


def cramer_matrix(df: DataFrame, columns: Sequence[str], max_card: int = 50,
                  bias_corrected: bool = True) -> DataFrame:
    """Cramer's V of every pair of columns with at most `max_card` values."""
    kept = few_levels(df, columns, max_card)
    if len(kept) < 2:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, n bigint, v double")
    stat = chi_square(matrices.pair_counts(df, kept), ["var1", "var2"], correction=False)
    n, r, k = (F.col(c).cast("double") for c in ("n", "r", "k"))
    phi2 = F.col("chi2") / n
    if bias_corrected:
        phi2 = F.greatest(F.lit(0.0), phi2 - (k - 1) * (r - 1) / (n - 1))
        r, k = r - F.pow(r - 1, 2) / (n - 1), k - F.pow(k - 1, 2) / (n - 1)
    denom = F.least(k - 1, r - 1)
    v = F.when((F.col("r") >= 2) & (F.col("k") >= 2) & (denom > 0), F.sqrt(phi2 / denom))
    return stat.select("var1", "var2", "n", v.alias("v"))


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation r and n of all pairs, var1 < var2."""
    return matrices.pearson(df, columns)


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Spearman correlation rho and n of all pairs, var1 < var2."""
    return matrices.spearman(df, columns)


def pearson_pvalues(df: DataFrame, columns: Sequence[str], propagate_nulls: bool = False) -> DataFrame:
    """Two-sided p-values; optionally NULL for a pair touching a column with NULLs."""
    pairs = pearson_pairs(df, columns)
    p = correlation_tail(F.col("r"), F.col("n"))
    if propagate_nulls:
        counts = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in columns]).head()
        holed = [c for c in columns if counts[c] < counts["_all"]]
        if holed:
            p = F.when(~(F.col("var1").isin(*holed) | F.col("var2").isin(*holed)), p)
    return pairs.withColumn("p_value", p)


def top_pairs(pairs: DataFrame, k: int = 25, value: str = "r") -> DataFrame:
    """Strongest pairs by absolute correlation with strength and sign labels."""
    strength = F.abs(value)
    return (pairs.where(F.col(value).isNotNull() & ~F.isnan(value))
            .withColumn("abs_corr", strength)
            .orderBy(F.col("abs_corr").desc(), "var1", "var2").limit(k)
            .withColumn("force", lb.threshold_label(F.col("abs_corr"), lb.PAIR_STEPS, "FAIBLE"))
            .withColumn("sens", F.when(F.col(value) > 0, "positive (+)")
                        .otherwise("negative (-)")))


def significance_table(df: DataFrame, columns: Sequence[str], k: int = 25) -> DataFrame:
    """Pearson and Spearman with p-values and stars for the strongest pairs."""
    pearson = pearson_pvalues(df, columns)
    rho = spearman_pairs(df, columns).select("var1", "var2", "rho", F.col("n").alias("_m"))
    top = top_pairs(pearson, k)
    joined = top.join(rho, ["var1", "var2"])
    return joined.select(
        "var1", "var2", F.col("r").alias("pearson_r"), F.col("p_value").alias("pearson_p"),
        F.col("rho").alias("spearman_r"), correlation_tail(F.col("rho"), F.col("_m")).alias("spearman_p"),
        F.when(F.col("p_value") < 0.05, "OUI").otherwise("NON").alias("significatif"),
        lb.stars(F.col("p_value")).alias("etoiles"))


def against_target(pairs: DataFrame, target: str, k: int = 10, value: str = "rho") -> DataFrame:
    """Variables most correlated with the target."""
    other = F.when(F.col("var1") == target, F.col("var2")).otherwise(F.col("var1"))
    return (pairs.where((F.col("var1") == target) | (F.col("var2") == target))
            .where(F.col(value).isNotNull())
            .select(other.alias("variable"), F.col(value).alias("correlation"))
            .orderBy(F.abs("correlation").desc(), "variable").limit(k)
            .withColumn("force", lb.threshold_label(
                F.abs("correlation"), lb.CORRELATION_STEPS, "très faible")))


def retained_variables(ranked: DataFrame, threshold: float = 0.15) -> DataFrame:
    return ranked.where(F.abs("correlation") >= threshold).select("variable")


def variance_inflation(df: DataFrame, columns: Sequence[str], intercept: bool = False) -> DataFrame:
    """Variance inflation factors on complete rows, of the columns that vary there.

    Only the columns x columns Gram matrix is inverted on the driver.
    """
    products, varies = matrices.gram(df, columns, intercept)
    kept = [i for i in range(len(columns)) if varies[i]]
    spark = df.sparkSession
    if len(kept) < 2:
        return spark.createDataFrame([], "variable string, vif double, niveau string")
    used = kept + ([len(columns)] if intercept else [])
    products = products[np.ix_(used, used)]
    scale = 1 / np.sqrt(np.diag(products))
    # Scaled to a unit diagonal first: the factor is scale-free, the inversion is not.
    inverse = np.linalg.pinv(products * np.outer(scale, scale), hermitian=True)
    rows = [(columns[i], float(inverse[at, at])) for at, i in enumerate(kept)]
    out = spark.createDataFrame(rows, "variable string, vif double")
    return out.withColumn("niveau", lb.threshold_label(F.col("vif"), lb.VIF_STEPS, "OK"))


def quantile_cuts(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct exact quantiles of every column at 1 / bins, 2 / bins and so on, in one pass.

    Of the ranked values only those at a wanted position come to the driver.
    """
    ranked = ranked_long(df, [], columns)
    shares = [k / bins for k in range(1, bins)]
    last = F.col("n_total") - 1
    wanted = F.flatten(F.transform(F.array(*map(F.lit, shares)), lambda p: F.array(F.floor(last * p), F.ceil(last * p))))
    hit = F.exists(wanted, lambda w: (F.col("n_before") <= w) & (w < F.col("n_before") + F.col("n")))
    found: dict[str, list] = {c: [] for c in columns}
    for row in ranked.where(hit).select("variable", "value", "n", "n_before", "n_total").collect():
        found[row["variable"]].append(row)

    def at(rows: list, place: int) -> float:
        return next(r["value"] for r in rows if r["n_before"] <= place < r["n_before"] + r["n"])

    cuts = {}
    for c, rows in found.items():
        places = [(rows[0]["n_total"] - 1) * p for p in shares] if rows else []
        cuts[c] = sorted({
            (low := at(rows, math.floor(x))) + (at(rows, math.ceil(x)) - low) * (x - math.floor(x)) for x in places})
    return cuts


def mutual_information(df: DataFrame, columns: Sequence[str], target: str,
                       bins: int = 16) -> DataFrame:
    """Mutual information (nats) of each binned column with a binary target.

    Columns with few values keep them; others are cut at exact quantiles.  The nearest
    neighbour estimator needs all rows in one place; binning needs only counts.
    """
    bounds = quantile_cuts(df, list(columns), bins)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"),
                 bucket_of(F.coalesce(F.col(c).cast("double"), F.lit(0.0)),
                           [float(b) for b in bounds[c]]).alias("a")) for c in columns])).alias("p")
    counts = (df.where(F.col(target).isNotNull()).select(F.col(target).alias("b"), pairs)
              .select("b", "p.*").groupBy("variable", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    xs = counts.groupBy("variable", "a").agg(F.sum("n").alias("nx"))
    ys = counts.groupBy("variable", "b").agg(F.sum("n").alias("ny"))
    alls = counts.groupBy("variable").agg(F.sum("n").alias("nn"))
    j = (counts.join(xs, ["variable", "a"]).join(ys, ["variable", "b"]).join(alls, "variable"))
    n, nx, ny, nn = (F.col(c).cast("double") for c in ("n", "nx", "ny", "nn"))
    return j.groupBy("variable").agg(
        F.sum(n / nn * F.log(n * nn / (nx * ny))).alias("mutual_info"))

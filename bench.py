"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from asphalta.catalog import QUERIES  # noqa: E402
from asphalta.session import local_session  # noqa: E402

HEADLINE = (
    "s04_tolerant_scan", "s09_sql_scan", "p21_tercile_bands", "j07_star_enrichment",
    "j09_grid_place_lookup", "j14_key_match_rates", "a02_sensor_week_aggregate", "a06_worst_person",
    "a09_yearly_evolution", "a10_risk_zones", "a11_by_hour", "a16_holiday_effect",
    "a17_rates_per_100k", "a21_rain_severity_test", "a22_cramer_matrix", "a24_spearman_matrix",
    "a31_column_profile", "a36_grain_check", "a38_fill_rates", "w02_surrogate_ids", "m02_engineered_features",
    "m09_logistic_regression", "m13_roc_auc", "m16_best_f1_threshold")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Rows without a score in threshold sweeps and drift."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowlens.operators import evaluate, incidents


def test_sweep_without_scores(spark):
    rows = spark.createDataFrame([(1, .9), (1, None), (1, None), (1, float("nan")), (0, .2)], "y int, p double")
    got = {r["threshold"]: r for r in evaluate.threshold_sweep(rows, "y", "p", [0.1, 0.5]).collect()}
    assert (got[0.5]["tp"], got[0.5]["flagged"], got[0.5]["positives"]) == (1, 1, 4)
    assert (got[0.1]["tp"], got[0.1]["flagged"], got[0.1]["positives"]) == (1, 2, 4)
    assert all(r["precision"] <= 1 for r in got.values())


def test_drift_without_scores(spark):
    now = datetime(2024, 1, 20)
    rows = [(now - timedelta(hours=h), (h % 10) / 10 + .05) for h in range(1, 192)]
    def drift(more):
        df = spark.createDataFrame(rows + more, "ts timestamp, p double")
        return incidents.kl_drift(df, "p", F.lit(now)).first()["kl"]
    assert drift([(now - timedelta(hours=2), None), (now - timedelta(hours=3), float("nan"))]) == drift([])

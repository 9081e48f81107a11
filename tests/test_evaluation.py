import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import evaluate as ev
from flowlens.operators import incidents as ops
from flowlens.operators import split


def brute(y, p, t):
    tp = sum(1 for a, b in zip(y, p) if a and b >= t)
    flagged, pos = sum(1 for b in p if b >= t), sum(y)
    precision, recall = (tp / flagged if flagged else 0), (tp / pos if pos else 0)
    return precision, recall, (2 * precision * recall / (precision + recall) if precision + recall else 0)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    p = [round(float(v), 2) for v in rng.random(500)] + [0.29, 0.57, 0.05, 0.95]
    y = [int(v > 0.4) if i % 7 else 0 for i, v in enumerate(p)]
    return spark.createDataFrame(list(zip(y, p)), "y int, p double"), y, p


def test_sweep_matches_brute_force_on_the_grid(scored):
    df, y, p = scored
    for r in ev.threshold_sweep(df, "y", "p", ev.GRID_ABLATION).collect():
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(brute(y, p, r["threshold"]))


def test_sweep_without_positives(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.9)], "y int, p double")
    rows = ev.threshold_sweep(df, "y", "p", [0.5, 0.95]).orderBy("threshold").collect()
    assert [(r["flagged"], r["precision"], r["recall"], r["f1"]) for r in rows] == [(1, 0, 0, 0), (0, 0, 0, 0)]
    assert ev.auc(df, "y", "p").first()["roc_auc"] is None


def test_policies_and_ties(spark):
    sweep = spark.createDataFrame([(0.1, 0.96, 0.5, 0.60), (0.2, 0.96, 0.5, 0.60), (0.3, 0.90, 0.9, 0.9),
                                   (0.4, 1.0, 0.1, 0.2)], "threshold double, precision double, recall double, f1 double")
    assert ev.pick_threshold(sweep, "max_f1").first()["threshold"] == 0.1
    assert ev.pick_threshold(sweep, "max_recall").first()["threshold"] == 0.1
    assert ev.pick_threshold(sweep, "recall_first").first()["threshold"] == 0.3
    low = sweep.filter("threshold in (0.2, 0.3)").withColumn("precision", F.col("precision") - 0.5)
    assert ev.pick_threshold(low, "max_f1").first()["threshold"] == 0.2
    assert ev.pick_threshold(low, "recall_first").first()["threshold"] == 0.3
    none = spark.createDataFrame([(0.1, 1.0, 0.0, 0.0), (0.2, 0.5, 0.5, 0.5)], sweep.schema)
    assert ev.pick_threshold(none, "max_recall").first()["threshold"] == 0.1


def test_report_with_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b")], "y string, h string")
    rows = {r["label"]: r for r in ev.class_report(df, "y", "h").collect()}
    assert (rows["b"]["support"], rows["b"]["precision"], rows["b"]["recall"]) == (0, 0.0, 0.0)
    assert rows["accuracy"]["f1"] == pytest.approx(1 / 3)
    assert rows["weighted avg"]["recall"] == pytest.approx(1 / 3)
    assert ev.confusion(df, "y", "h").count() == 9
    matrix = ev.confusion_matrix(df, "y", "h", ["a", "b", "c"]).orderBy("actual").collect()
    assert [tuple(r) for r in matrix] == [("a", 1, 1, 0), ("b", 0, 0, 0), ("c", 0, 1, 0)]
    gate = ev.gate_result(ev.class_gate(ev.class_report(df, "y", "h"))).first()
    assert not gate["passed"] and gate["failed_classes"] == "b,c"


def test_auc_matches_pairs(scored):
    df, y, p = scored
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    want = sum((x > z) + 0.5 * (x == z) for x in pos for z in neg) / len(pos) / len(neg)
    assert ev.auc(df, "y", "p").first()["roc_auc"] == pytest.approx(want)


def test_multiclass_point_treats_unseen_as_attack(spark):
    df = spark.createDataFrame([(0, [0.9, 0.05, 0.05]), (1, [0.1, 0.8, 0.1]), (-1, [0.2, 0.1, 0.7])],
                               "cls int, probs array<double>")
    best = ev.multiclass_point(df, "cls", "probs", 0).first()
    assert best["recall"] == 1.0 and best["threshold"] == pytest.approx(0.06)
    out = ev.multiclass_decision(df, "probs", 0, 0.5).collect()
    assert [r["predicted"] for r in out] == [0, 1, 2]


def test_calibration_and_severity(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.95), (0, 0.95)], "y int, p double")
    row = ev.calibration(df, "y", "p").first()
    assert row["brier"] == pytest.approx((0.05**2 + 0.95**2) / 4)
    assert row["mce"] == pytest.approx(abs(2 / 3 - (1 + 0.95 + 0.95) / 3))
    routes = spark.createDataFrame([("Identity Compromise", "ENDPOINT_CURATOR"), ("x", "x"), ("x", "y")], "y string, h string")
    out = ev.severity_error(routes, "y", "h").first()
    assert out["severity_weighted_error"] == pytest.approx((8 + 0 + 6) / 30) and out["severe_rate"] == pytest.approx(1 / 3)


def test_share_gate_and_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 4, "label string")
    rows = {r["label"]: (round(r["share"], 2), r["passed"]) for r in ev.share_gate(df, "label", {"b": 0.2, "c": 0.1}).collect()}
    assert rows == {"a": (0.6, False), "b": (0.4, True), "c": (0.0, False)}
    weights = {r["label"]: r["weight"] for r in split.sample_weights(df, "label").collect()}
    assert weights == {"a": pytest.approx(10 / 12), "b": pytest.approx(10 / 8)}


def incident_rows(spark, rows):
    return spark.createDataFrame(rows, "id int, ts string, source_ip string, threat_classification string, confidence double"
                                 ).withColumn("ts", F.col("ts").cast("timestamp"))


def test_campaign_edges(spark):
    rows = [(i, "2024-01-01 00:04:59", "s", "b" if i % 2 else "a", 0.5) for i in range(10)]
    rows += [(20, "2024-01-01 00:05:00", "s", "a", 1.0)] + [(30 + i, "2024-01-01 00:00:00", " ", None, None) for i in range(10)]
    out = {r["attacker_ip"]: r for r in ops.campaigns(incident_rows(spark, rows), tie="id").collect()}
    assert set(out) == {"s", "unknown"}
    s = out["s"]
    assert (s["aggregated_events"], s["threat_classification"], s["confidence_score"]) == (10, "a", 0.5)
    assert s["all_threat_types"] == ["a", "b"] * 5 and s["window_duration_sec"] == 300
    assert out["unknown"]["threat_classification"] == "malicious" and out["unknown"]["confidence_score"] == 0.0
    import hashlib
    assert s["campaign_id"] == hashlib.sha1(b"s|2024-01-01T00:00:00+00:00").hexdigest()[:16]


def test_campaign_type_list_is_limited_before_the_shuffle(spark):
    rows = [(i, "2024-01-01 00:00:01", "hot", f"t{i % 3}", 0.1) for i in range(500)]
    out = ops.campaigns(incident_rows(spark, rows), tie="id")
    assert len(out.first()["all_threat_types"]) == 200 and out.first()["aggregated_events"] == 500
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_slo_states(spark):
    df = spark.createDataFrame([("end_to_end_latency", 5.0), ("throughput_sustained", 0.0), ("mongo_write_rate", 0.0)],
                               "metric string, value double")
    got = {r["metric"]: r["status"] for r in ops.slo(df).collect()}
    assert got == {"end_to_end_latency": "PASS", "throughput_sustained": "UNVERIFIED", "peak_spike_handling": "UNVERIFIED",
                   "mongo_write_rate": "PASS"}


def test_throughput_of_nothing(spark):
    df = incident_rows(spark, [(1, "2024-01-01 00:00:00", "s", "a", 1.0)])
    now = F.lit("2024-01-02").cast("timestamp")
    assert tuple(ops.throughput(df, now, 5).first()) == (5, 0, 0.0)
    assert ops.throughput(df, now, 0).first()["events_per_sec"] == 0.0


def test_rolling_monitor_and_growth(spark):
    rows = [(i, f"2024-01-01 0{i}:30:00", "s", "a", 0.1 * i) for i in range(5)]
    out = ops.rolling_monitor(incident_rows(spark, rows), F.col("confidence"), "2 hours", "1 hour", 0.2, 0.3).collect()
    got = {r["at"].hour: (round(r["mean"], 2), r["state"]) for r in out}
    assert got[4] == (0.25, "ALERT") and got[6] == (0.4, "ROLLBACK") and got[1] == (0.0, "OK")

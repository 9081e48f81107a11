"""Steps that were repeated over all rows, or shuffled them by class."""

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowlens.models import boosting, experiments, features
from flowlens.operators import split
from flowlens.session import materialize, release


def test_class_weights_do_not_shuffle_the_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "label string")
    weighted = split.sample_weights(df, "label")
    plan = weighted._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(weighted.collect(), key=str) == [("a", 0.75), ("a", 0.75), ("b", 1.5), (None, None)]


def test_histograms_are_exact_beyond_doubles():
    values = np.array([2**52, 2**52 + 1, 3, -(2**51)], np.int64)
    out = np.zeros(2, np.int64)
    boosting._summed(np.array([0, 0, 1, 0]), boosting._steps(values), out)
    assert out.tolist() == [2**53 + 1 - 2**51, 3]


def test_margins_are_bytes():
    margins = np.arange(6.0).reshape(3, 2)
    assert np.array_equal(boosting._matrix(boosting._bytes(margins)).view(np.float64), margins)
    assert isinstance(boosting._bytes(margins), pa.BinaryArray)


def test_softmax_takes_each_exponential_once(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), i % 3) for i in range(60)], "a double, b double, label int")
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).withColumn("weight", F.lit(1.0))
    model = boosting.fit(vectors, 3, 2, 2)
    stages = model.stages(spark)
    assert "transform(" not in stages[-1].getStatement()
    scored = vectors
    for stage in stages:
        scored = stage.transform(scored)
    assert scored.columns == [*vectors.columns, "__margin_0", "__margin_1", "__margin_2", "probability"]
    for r in scored.collect():
        powers = [math.exp(r[f"__margin_{k}"] - max(r[f"__margin_{j}"] for j in range(3))) for k in range(3)]
        assert np.allclose(r["probability"], np.array(powers) / sum(powers), atol=1e-12)


def test_written_by_columns_skips_folders(spark):
    df = spark.range(20).select("id", (F.col("id") % 4).cast("int").alias("fold"))
    table = materialize(df, ["fold"])
    plan = table.filter("fold = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan
    assert sorted(r["id"] for r in table.filter("fold = 1").collect()) == [1, 5, 9, 13, 17]
    release(table)


def _numbers(spark, n=300):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 17).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("b"), ((F.col("id") % 17) > 8).cast("int").alias("y"))


def test_learning_curve_judges_a_share_in_one_pass(spark, monkeypatch):
    def alone(*_):
        raise AssertionError("a pass for one model")

    monkeypatch.setattr(experiments.ev, "accuracy", alone)
    curve = experiments.learning_curve(_numbers(spark), ["a", "b"], "y", "key", "logistic_regression", (0.5, 1.0), 2).collect()
    assert [r["train_share"] for r in curve] == [0.5, 1.0]
    assert all(r["train_accuracy"] > 0.9 and r["test_accuracy"] > 0.9 for r in curve)


def test_learning_curve_after_an_observed_query(spark):
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(10).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 10
    curve = experiments.learning_curve(_numbers(spark), ["a", "b"], "y", "key", "logistic_regression", (1.0,), 2).collect()
    assert [r["train_share"] for r in curve] == [1.0]


def test_samples_hash_the_keys_once(spark, monkeypatch):
    calls, real = [], split.with_hash_order

    def counted(*args, **more):
        calls.append(1)
        return real(*args, **more)

    monkeypatch.setattr(split, "with_hash_order", counted)
    monkeypatch.setattr(features, "with_hash_order", counted, raising=False)
    rows = features.sample_stability(_numbers(spark), "key", ["a", "b"], {"half": 150, "full": 300}).collect()
    assert len(calls) == 1 and [(r["preset"], r["rows_asked"]) for r in rows] == [("half", 150), ("full", 300)]

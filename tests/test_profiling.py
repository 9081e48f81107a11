import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.functions.pvalues import _chi2_tail, _f_tail
from flowlens.operators import profile, split
from flowlens.operators.ordered import order_cutoffs, running_total, within_cutoffs
from flowlens.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 4000
    x = rng.lognormal(3, 2, n)
    x[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"id": np.arange(n), "g": rng.choice(["a", "b", "c"], n, p=[0.75, 0.2, 0.05]), "x": x,
                         "tied": rng.choice([1.0, 2.0, 3.0, 7.5], n, p=[0.6, 0.2, 0.1, 0.1]), "n": rng.normal(10, 2, n)})


@pytest.fixture(scope="module")
def table(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


@pytest.mark.parametrize("by", [None, "g"])
@pytest.mark.parametrize("accuracy", [20_000, 60])
def test_percentiles(table, frame, by, accuracy):
    probs = [0.0, 0.25, 0.333, 0.5, 0.95, 1.0]
    got = exact_percentiles(table, ["x", "tied"], probs, by=by, accuracy=accuracy).collect()
    keys = frame["g"].unique() if by else [None]
    assert len(got) == len(keys) * 2 * len(probs)
    for r in got:
        part = frame[frame["g"] == r["g"]] if by else frame
        assert r["value"] == pytest.approx(part[r["feature"]].quantile(r["prob"]), rel=1e-12)


def test_percentiles_empty_and_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, x double")
    assert {(r["g"], r["value"]) for r in exact_percentiles(df, ["x"], [0.5], by="g").collect()} >= {("b", 2.0)}


def test_percentiles_infinite_and_nan(spark):
    rows = [(1.0,)] * 60 + [(float("inf"),)] * 60 + [(float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "x double")
    for accuracy in (20_000, 10):
        got = {r["prob"]: r["value"] for r in exact_percentiles(df, ["x"], [0.1, 0.5, 0.9], accuracy=accuracy).collect()}
        assert got == {0.1: 1.0, 0.5: float("inf"), 0.9: float("inf")}


def test_percentiles_many_groups(spark):
    df = spark.range(60_000).selectExpr("id % 15000 as g", "cast(id as double) as x")
    got = exact_percentiles(df, ["x"], [0.5], by="g")
    assert got.count() == 15_000 and got.filter("value = g + 22500").count() == 15_000


@pytest.mark.parametrize("descending", [False, True])
def test_running_total(spark, table, frame, descending):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    counts = table.filter("x is not null").groupBy("g", "x").agg(F.count("*").alias("c"))
    out = running_total(counts, "x", ["c"], by=["g"], descending=descending).toPandas()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for _, part in out.groupby("g"):
        part = part.sort_values("x", ascending=not descending)
        assert (part["c"].cumsum() - part["c"]).tolist() == part["c_before"].tolist()
        assert (part["c_all"] == part["c"].sum()).all()


def test_cutoffs_with_null_group(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(30)], "id int, g string")
    keyed = split.with_hash_order(df, "id", 1)
    cut = order_cutoffs(keyed, "_order", "_bucket", lambda _k, n: n // 2, ["g"])
    taken = keyed.filter(within_cutoffs(cut, "_order", ["g"])).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in taken} == {"a": 5, None: 10}


def test_grouped_split_sizes(spark):
    sizes = {"one": 1, "two": 2, "big": 1003}
    rows = [(f"{g}-{i}", g) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "key string, g string")
    out = split.grouped_split(df, "key", ["g"], dedup_before_split=False)
    held = {r["g"]: r["count"] for r in out.filter("split = 'validation'").groupBy("g").count().collect()}
    assert held == {"two": 1, "big": 201} and out.count() == 1006
    for other in (split.grouped_split(df.repartition(5), "key", ["g"], dedup_before_split=False),):
        assert other.columns == out.columns
        assert set(map(tuple, out.collect())) == set(map(tuple, other.collect()))


def test_split_never_separates_copies(spark):
    rows = [(i, f"v{i % 40}", "g") for i in range(200)]
    out = split.grouped_split(spark.createDataFrame(rows, "key int, v string, g string"), "key", ["g"])
    assert out.count() == 40 and out.select("v").distinct().count() == 40


def test_samples(spark):
    rows = [(f"{i:05d}", i, "BENIGN" if i % 10 else f"att{i % 20}") for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, no int, label string")
    pilot = split.pilot_sample(df, "key", "no", "label", 300)
    assert pilot.count() == 300
    got = {r["label"]: r["count"] for r in pilot.groupBy("label").count().collect()}
    # 60 % benign first, every attack row, the rest topped up with benign rows in order.
    assert got == {"BENIGN": 200, "att0": 50, "att10": 50}
    assert split.class_sample(df, "key", "label", 100).count() == 100
    assert [r["key"] for r in split.head(df, "key", "no", 3).collect()] == ["00000", "00001", "00002"]
    assert split.sample_n(df, "key", 2000).count() == 1000
    assert split.sample_n(df, "key", 37).count() == 37


def test_statistics_against_numpy(table, frame):
    out = {r["feature"]: r for r in profile.describe(table, ["x", "tied"]).collect()}
    want = frame["x"].describe()
    assert out["x"]["n"] == want["count"] and out["x"]["std"] == pytest.approx(want["std"])
    assert out["x"]["q25"] == pytest.approx(want["25%"])
    corr = {(r["feature_a"], r["feature_b"]): r["corr"] for r in profile.corr_pairs(table, ["x", "tied", "n"]).collect()}
    for a, b in itertools.combinations(["x", "tied", "n"], 2):
        assert corr[a, b] == pytest.approx(frame[a].corr(frame[b]), abs=1e-9)


def test_kruskal_and_levene(table, frame):
    ranks = frame["tied"].rank()
    n = len(frame)
    h = 12 / (n * (n + 1)) * sum(ranks[frame.g == g].sum() ** 2 / (frame.g == g).sum() for g in "abc") - 3 * (n + 1)
    t = frame["tied"].value_counts()
    h /= 1 - ((t**3 - t).sum()) / (n**3 - n)
    row = profile.kruskal(table, ["tied"], "g").first()
    assert row["h_statistic"] == pytest.approx(h) and row["df"] == 2
    assert row["p_value"] == pytest.approx(math.exp(-h / 2))
    z = [(s := frame.loc[frame.g == g, "n"], (s - s.median()).abs())[1] for g in "abc"]
    grand = np.concatenate(z).mean()
    w = (n - 3) / 2 * sum(len(v) * (v.mean() - grand) ** 2 for v in z) / sum(((v - v.mean()) ** 2).sum() for v in z)
    assert profile.levene(table, ["n"], "g").first()["statistic"] == pytest.approx(w)


def test_levene_leaves_out_flat_groups(spark):
    rows = [("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 3.0), ("c", 5.0), ("c", 5.0)]
    assert profile.levene(spark.createDataFrame(rows, "g string, x double"), ["x"], "g").count() == 0


def test_anderson(table, frame):
    rows = {r["feature"]: r for r in profile.anderson_normal(table, ["n", "x"]).collect()}
    x = np.sort(frame["n"].to_numpy())
    z = (x - x.mean()) / x.std(ddof=1)
    phi = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, len(z) + 1)
    a2 = -len(z) - np.mean((2 * i - 1) * (np.log(phi) + np.log(1 - phi[::-1])))
    assert rows["n"]["statistic"] == pytest.approx(a2, rel=1e-6) and rows["n"]["is_normal"]
    assert not rows["x"]["is_normal"]


def test_tail_probabilities():
    # Published table values.
    assert _chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert _chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert _chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert _f_tail(3.0718, 2, 120) == pytest.approx(0.05, abs=1e-4)
    assert _f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)


def test_duplicates_nulls_and_outliers(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "x int, y string")
    assert tuple(profile.duplicate_count(df).first()) == (1, 3)
    assert profile.dedup(df).count() == 2
    assert profile.null_profile(df).filter("feature = 'y'").first()["null_ratio"] == pytest.approx(2 / 3)
    row = profile.row_null_profile(df, ["x", "y"]).first()
    assert (row["n_rows"], row["rows_with_null"], row["max"]) == (3, 2, 50.0)
    flat = spark.createDataFrame([(1.0, 1.0)] * 9 + [(99.0, 2.0)], "a double, b double")
    assert {r["feature"]: r["outlier_ratio"] for r in profile.outlier_ratio(flat, ["a", "b"]).collect()} == {"a": 0.0, "b": 0.0}
    assert profile.outlier_ratio(flat, ["a"], all_rows=True).first()["outlier_ratio"] == 0.1


def test_cohens_d_undefined_is_zero(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    two = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert profile.cohens_d(one, two, ["x"]).first()["cohens_d"] == 0.0
    assert profile.cohens_d(two, two, ["x"]).first()["cohens_d"] == 0.0


def test_rows_of_one_time_share_the_tasks(spark):
    """Rows without a time are a large part of an event log; one task must not sort them all."""
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN timestamp_seconds(id) END AS ts", "map('k', id) AS m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = split.chronological(df, "ts")
        most = out.where("ts is null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        times = [r["ts"] for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 1500
    assert times[:1000] == sorted(times[:1000]) and times[1000:] == [None] * 3000


def test_levene_meets_medians_without_a_shuffle_of_the_rows(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", float(i % 17)) for i in range(300)], "label string, x double")
    out = profile.levene(df, ["x"], "label")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1

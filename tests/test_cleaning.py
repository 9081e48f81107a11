import math

import pytest
from pyspark.sql import functions as F

from flowlens import functions as fn
from flowlens.functions.values import to_number
from flowlens.operators import clean, joins, profile


def values(df, column):
    return [r[column] for r in df.collect()]


def test_labels(spark):
    rows = [("  BENIGN ",), ("Web Attack � XSS",), ("Web Attack - Brute Force",), ("Mystery",), (None,)]
    df = spark.createDataFrame(rows, "label string").select(fn.normalize_label(F.col("label")).alias("label"))
    out = df.select("label", fn.binary_target(F.col("label")).alias("t"), fn.attack_group(F.col("label")).alias("g"))
    assert [tuple(r) for r in out.collect()] == [
        ("BENIGN", 0, "Normal Traffic"), ("Web Attack XSS", 1, "Web Attacks"),
        ("Web Attack Brute Force", 1, "Web Attacks"), ("Mystery", 1, None), (None, 1, None)]


def test_raw_label_groups(spark):
    df = spark.createDataFrame([("Web Attack � XSS",), ("DoS slowloris",)], "label string")
    assert values(df.select(fn.attack_group(F.col("label")).alias("g")), "g") == ["Web Attacks", "DoS"]


def test_numbers(spark):
    texts = ["80", "", "  1.5 ", "n/a", "1.5d", "1e3", "NaN", "-Infinity", "inf", None, ".5", "-0.0"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = values(df.select(to_number(F.col("x")).alias("n")), "n")
    assert got == [80.0, None, 1.5, None, None, 1000.0, None, -math.inf, math.inf, None, 0.5, 0.0]
    coerced, report = clean.coerce_numeric(df, ["x", "absent"])
    assert [tuple(r) for r in report.collect()] == [("x", 4)]
    assert coerced.schema["x"].dataType.simpleString() == "double"


def test_finite_and_infinities(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.nan, "a"), (math.inf, "b"), (-math.inf, "b"), (None, "b"), (-0.0, "a")],
                               "x double, label string")
    assert values(clean.finite_columns(df, ["x"]), "x") == [1.0, None, None, None, None, -0.0]
    assert profile.inf_profile(df, ["x"]).first()["inf_count"] == 2
    by = {r["label"]: (r["inf_rows"], r["nan_rows"]) for r in profile.bad_rows_by_class(df, ["x"], "label").collect()}
    assert by == {"a": (0, 1), "b": (2, 1)}


def test_numeric_columns_counts_infinity_as_number(spark):
    rows = [("1", "x", math.inf), ("inf", "y", math.nan), ("3", "4", 1.0), ("NaN", "z", 2.0)]
    df = spark.createDataFrame(rows, "a string, b string, c double")
    assert clean.numeric_columns(df, floor=0.7) == ["a", "c"]
    assert clean.numeric_columns(df, exclude=["a"]) == ["c"]


def test_constant_and_identical_columns(spark):
    rows = [(1, 1.0, 5, None, 1.0), (2, 1.0, 5, None, 1.0), (3, None, 5, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b int, c double, d double")
    assert clean.constant_columns(df) == ["b", "c"]
    assert clean.identical_columns(df) == {"a": ["d"]}
    assert clean.drop_identical(df).columns == ["id", "a", "b", "c"]


def test_identical_columns_survive_copied_rows(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 1, 2)], "a int, b int, c int")
    assert clean.identical_columns(df) == {"a": ["b"]}


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "` Flow Bytes/s` int, `Fwd.Len-Max ` int")
    safe, back = clean.safe_columns(df)
    assert safe.columns == ["Flow_Bytes_s", "Fwd_Len_Max"]
    assert back == {"Flow_Bytes_s": "Flow Bytes/s", "Fwd_Len_Max": "Fwd.Len-Max"}
    with pytest.raises(ValueError):
        clean.safe_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a_b` int"))


def test_contract_and_leak(spark):
    df = spark.createDataFrame([(1.0, "x", "BENIGN")], "`Flow Duration` double, `Source IP` string, Label string")
    report = clean.check_contract(df)
    assert "Destination Port" in report["required_missing"] and report["identifiers_present"] == ["Source IP"]
    with pytest.raises(ValueError):
        clean.assert_no_leak(df)
    assert clean.assert_no_leak(clean.drop_identifiers(df)).columns == ["Flow Duration", "Label"]
    assert clean.feature_types(df, "Label") == (["Flow Duration"], ["Source IP"])
    assert clean.common_features(df, df.drop("Label"), ["Label", "Flow Duration"]) == ["Flow Duration"]


def test_one_hot_and_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "k string")
    hot = clean.one_hot(df, "k")
    assert hot.columns == ["k", "k_b", "k_c"]
    assert [tuple(r)[1:] for r in hot.collect()] == [(1, 0), (0, 0), (0, 1), (0, 0)]
    codes = clean.index_labels(df, "k")
    assert codes == {"a": 0, "b": 1, "c": 2}
    assert values(clean.lookup(spark.createDataFrame([("z",), ("c",)], "k string"), "k", codes, "i"), "i") == [None, 2]


def test_flow_ids_and_pick(spark):
    df = spark.createDataFrame([("1.1.1.1-2.2.2.2-80", " "), ("nodash", "x"), ("a-b", None), (None, "y")], "id string, ip string")
    src, dst = fn.ips_from_flow_id(F.col("id"))
    rows = df.select(src.alias("s"), dst.alias("d"), fn.pick(F.col("ip"), F.col("id")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("1.1.1.1", "2.2.2.2", "1.1.1.1-2.2.2.2-80"), (None, None, "x"),
                                        ("a", "b", "a-b"), (None, None, "y")]


def test_iso_times(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00.000001", "junk", None, "12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(fn.parse_iso(F.col("t"))).alias("u"))
    base = 1704067200000000
    assert values(df, "u") == [base, base, base + 1, None, None, None]


def test_mitre_rules(spark):
    rows = [("SSH-BruteForce", 22), ("bruteforce", 9), ("webattack", 8080), ("WebAttack", 443), ("ddos", None), ("odd", 1)]
    out = joins.map_mitre(spark.createDataFrame(rows, "t string, p int"), "t", "p")
    assert [r["mitre"]["technique_id"] for r in out.collect()] == ["T1110.001", "T1110", "T0000", "T1190", "T1498", "T0000"]
    assert "Join" not in out._jdf.queryExecution().toString()


def test_null_impact_and_lag(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None)], "label string, x int")
    out = {r["label"]: tuple(r)[1:] for r in joins.null_impact(df, "label").collect()}
    assert out == {"a": (2, 1, 1, 50.0), "b": (1, None, None, None)}
    batch = spark.createDataFrame([(0, 5), (0, 9), (1, 3)], "partition int, offset long")
    ends = spark.createDataFrame([(0, 12)], "partition int, end_offset long")
    assert joins.total_lag(batch, ends).first()[0] == 2


def test_drop_correlated_keeps_first(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"),
                                F.pmod(F.col("id") * 7, F.lit(11)).cast("double").alias("c"), F.lit(4.2).alias("k"))
    pairs = profile.corr_pairs(df, ["a", "b", "c", "k"])
    assert {(r["feature_a"], r["feature_b"]) for r in pairs.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert clean.drop_correlated(df, pairs).columns == ["a", "c", "k"]


def test_unseen_labels_meet_as_distinct_values(spark):
    """Rows of one label must not meet in one task: only distinct values are compared."""
    train = spark.createDataFrame([("a",)] * 5 + [(None,)], "label string")
    other = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "label string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = clean.unseen_labels(train, other, "label")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.split("LeftAnti")[1].count("Aggregate") == 2
    assert [r["label"] for r in out.collect()] == ["b"]

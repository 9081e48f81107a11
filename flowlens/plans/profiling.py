"""Profiling queries."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import clean, profile
from flowlens.plans import adapters as a
from flowlens.plans.registry import Tables, query, rounded

D = (a.FLOWS, a.DIRTY)
KEY = ["flow_duration", "total_fwd_packets", "flow_bytes_s", "flow_iat_mean"]
TEST = ["flow_duration", "total_fwd_packets", "flow_iat_mean", "bwd_packet_length_max", "flow_bytes_s"]


def each(columns: list[str], cell: str, source: str = "flows", extra: str = "") -> str:
    """One SELECT per column, stacked; ``{c}`` is the column."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {cell.format(c=c)} FROM {source} {extra.format(c=c)}" for c in columns)


@query("d01_label_counts", """SELECT label, count(*) AS n FROM dirty GROUP BY 1 ORDER BY n DESC, label LIMIT 15""", D)
def label_counts(t: Tables) -> DataFrame:
    return profile.label_counts(a.dirty(t), "label", 15)


@query("d02_class_share", """SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
  FROM flows GROUP BY label""", (a.FLOWS,))
def class_share(t: Tables) -> DataFrame:
    return profile.class_share(a.flows(t), "label")


@query("d03_duplicate_count", """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS n_rows
  FROM (SELECT count(*) AS n FROM dirty GROUP BY row_key, flow_no, source_file, label, flow_duration, flow_bytes_s,
    total_fwd_packets, flow_id, src_text, ts_text)""", D)
def duplicate_count(t: Tables) -> DataFrame:
    return profile.duplicate_count(a.dirty(t))


@query("d04_dedup", "SELECT DISTINCT row_key, label, flow_bytes_s, flow_id FROM dirty", D)
def dedup(t: Tables) -> DataFrame:
    return profile.dedup(a.dirty(t)).select("row_key", "label", "flow_bytes_s", "flow_id")


_NULLABLE = ["label", "flow_duration", "flow_bytes_s", "flow_id", "src_text", "ts_text", "cwe_flag_count", "total_fwd_packets"]


@query("d05_top_missing", f"""SELECT * FROM ({each(_NULLABLE, "round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS null_ratio", "dirty")})
  ORDER BY null_ratio DESC, feature LIMIT 10""", D)
def top_missing(t: Tables) -> DataFrame:
    return rounded(profile.top_missing(a.dirty(t), _NULLABLE), "null_ratio")


@query("d05_high_missing", f"""SELECT * FROM ({each(_NULLABLE, "round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS null_ratio", "dirty")})
  WHERE null_ratio > 0.1""", D)
def high_missing(t: Tables) -> DataFrame:
    return rounded(profile.high_missing(a.dirty(t), _NULLABLE), "null_ratio")


_MISSING_SUM = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _NULLABLE)


@query("d06_row_null_profile", f"""SELECT count(*) AS n_rows, round(avg(s), 6) AS mean, min(s) AS min,
  quantile_cont(s, 0.5) AS median, max(s) AS max, count(*) FILTER (WHERE s > 0) AS rows_with_null
  FROM (SELECT ({_MISSING_SUM}) * CAST(100 AS DOUBLE) / {len(_NULLABLE)} AS s FROM dirty)""", D)
def row_null_profile(t: Tables) -> DataFrame:
    return rounded(profile.row_null_profile(a.dirty(t), _NULLABLE), "mean")


@query("d07_inf_profile", each(a.DIRTY_NUMERIC, "count(*) FILTER (WHERE isinf({c})) AS inf_count", "dirty"), D)
def inf_profile(t: Tables) -> DataFrame:
    return profile.inf_profile(a.dirty(t), a.DIRTY_NUMERIC)


@query("d07_bad_rows_by_class", """SELECT label, count(*) FILTER (WHERE isinf(flow_duration)) AS inf_rows,
  count(*) FILTER (WHERE flow_duration IS NULL OR isnan(flow_duration)) AS nan_rows FROM dirty GROUP BY label""", D)
def bad_rows_by_class(t: Tables) -> DataFrame:
    out = profile.bad_rows_by_class(a.dirty(t), ["flow_duration", "total_fwd_packets"], "label")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("inf_rows", "nan_rows")})


@query("d08_ts_parse_stats", """SELECT count(*) FILTER (WHERE flow_no % 9 > 1) AS parsed,
  count(*) FILTER (WHERE flow_no % 9 <= 1) AS failed FROM dirty""", D)
def ts_parse_stats(t: Tables) -> DataFrame:
    return profile.ts_parse_stats(a.dirty(t), "ts_text")


@query("d09_cardinality", each(a.FEATURES, "count(DISTINCT {c}) AS distinct_values"), (a.FLOWS,))
def cardinality(t: Tables) -> DataFrame:
    return profile.cardinality(a.flows(t), a.FEATURES)


_DESCRIBE = """count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max,
  quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75"""
_ROUND_DESCRIBE = ("mean", "std", "min", "max", "q25", "q50", "q75")


@query("d10_describe", "SELECT feature, n, " + ", ".join(f"round({c}, 4) AS {c}" for c in _ROUND_DESCRIBE)
       + f" FROM ({each(a.FEATURES, _DESCRIBE)})", (a.FLOWS,))
def describe(t: Tables) -> DataFrame:
    return rounded(profile.describe(a.flows(t), a.FEATURES, stored=True), *_ROUND_DESCRIBE, digits=4)


_OUT = """CASE WHEN q3 = q1 THEN 0.0 ELSE round(avg(CAST({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)
  AS INTEGER)), 6) END AS outlier_ratio"""


@query("d11_outlier_ratio", each(a.FEATURES, _OUT, "flows",
       ", (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM flows) b GROUP BY q1, q3"), (a.FLOWS,))
def outlier_ratio(t: Tables) -> DataFrame:
    return rounded(profile.outlier_ratio(a.flows(t), a.FEATURES, stored=True), "outlier_ratio")


@query("d12_class_profiles", each(KEY, """label, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.95), 4) AS p95""", "flows", "GROUP BY label"), (a.FLOWS,))
def class_profiles(t: Tables) -> DataFrame:
    return rounded(profile.class_profiles(a.flows(t), KEY, "label", stored=True), "median", "p95", digits=4)


_CORR = " UNION ALL ".join(
    f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, corr({x}, {y}) AS corr FROM flows"
    for x, y in itertools.combinations(a.FEATURES, 2))


@query("d13_top_corr_pairs", f"""SELECT feature_a, feature_b, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr
  FROM ({_CORR}) ORDER BY abs(corr) DESC, feature_a, feature_b LIMIT 25""", (a.FLOWS,))
def top_corr_pairs(t: Tables) -> DataFrame:
    return rounded(profile.top_corr_pairs(a.flows(t), a.FEATURES, 25), "corr", "abs_corr")


@query("d13_high_corr_pairs", f"""SELECT feature_a, feature_b, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr
  FROM ({_CORR}) WHERE abs(corr) > 0.85""", (a.FLOWS,))
def high_corr_pairs(t: Tables) -> DataFrame:
    return rounded(profile.top_corr_pairs(a.flows(t), a.FEATURES, min_abs=0.85), "corr", "abs_corr")


@query("b14_drop_correlated", """SELECT count(flow_duration) AS kept_first, count(total_fwd_packets) AS kept_other FROM flows""",
       (a.FLOWS,))
def drop_correlated(t: Tables) -> DataFrame:
    f = a.flows(t).select("flow_duration", "flow_bytes_s", "total_fwd_packets")
    rest = clean.drop_correlated(f, profile.corr_pairs(f, f.columns), 0.95)
    return rest.agg(F.count("flow_duration").alias("kept_first"), F.count("total_fwd_packets").alias("kept_other"))


_COHEN = """round(vm - tm, 6) AS mean_diff, round(sqrt((tv + vv) / 2), 6) AS std_pooled,
  round(CASE WHEN sqrt((tv + vv) / 2) > 0 THEN (vm - tm) / sqrt((tv + vv) / 2) ELSE 0 END, 6) AS cohens_d"""


@query("d14_cohens_d", " UNION ALL ".join(f"""SELECT '{c}' AS feature, {_COHEN} FROM (SELECT
  avg({c}) FILTER (WHERE ts < TIMESTAMP '2000-01-01') AS tm, avg({c}) FILTER (WHERE ts >= TIMESTAMP '2000-01-01') AS vm,
  var_samp({c}) FILTER (WHERE ts < TIMESTAMP '2000-01-01') AS tv, var_samp({c}) FILTER (WHERE ts >= TIMESTAMP '2000-01-01') AS vv
  FROM flows)""" for c in a.FEATURES), (a.FLOWS,))
def cohens_d(t: Tables) -> DataFrame:
    f = a.flows(t)
    out = profile.cohens_d(f.filter(~a.is_validation()), f.filter(a.is_validation()), a.FEATURES)
    return rounded(out, "mean_diff", "std_pooled", "cohens_d")


@query("d15_median_gap", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(am, 4) AS attack_median, round(bm, 4) AS benign_median,
  round(abs(am - bm) / (abs(bm) + 1e-9), 6) AS relative_gap FROM (SELECT
  quantile_cont({c}, 0.5) FILTER (WHERE label <> 'BENIGN') AS am, quantile_cont({c}, 0.5) FILTER (WHERE label = 'BENIGN') AS bm
  FROM flows)""" for c in KEY), (a.FLOWS,))
def median_gap(t: Tables) -> DataFrame:
    out = profile.median_gap(a.flows(t), KEY, "label", stored=True)
    return rounded(rounded(out, "attack_median", "benign_median", digits=4), "relative_gap")


def _levene_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round((sum(n) - count(*)) * sum(n * (zm - zg) * (zm - zg)) / ((count(*) - 1) * sum(n * zv)), 4)
      AS statistic, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM (
      SELECT *, sum(n * zm) OVER () / sum(n) OVER () AS zg FROM (
        SELECT label, count(*) AS n, avg(abs({c} - med)) AS zm, var_pop(abs({c} - med)) AS zv FROM flows
        JOIN (SELECT label, quantile_cont({c}, 0.5) AS med FROM flows GROUP BY label) USING (label)
        GROUP BY label HAVING var_pop({c}) > 0 AND max(abs({c})) > 0))"""


@query("d16_levene", " UNION ALL ".join(_levene_sql(c) for c in TEST), (a.FLOWS,))
def levene(t: Tables) -> DataFrame:
    return rounded(profile.levene(a.flows(t), TEST, "label", stored=True).drop("p_value"), "statistic", digits=4)


def _kruskal_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h_statistic,
      k - 1 AS df FROM (SELECT sum(r * r / nj) AS s, count(*) AS k FROM (SELECT label, sum(rk) AS r, count(*) AS nj FROM (
          SELECT label, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk FROM flows) GROUP BY label)),
        (SELECT CAST(count(*) AS DOUBLE) AS n FROM flows), (SELECT sum(CAST(q AS DOUBLE) * q * q - q) AS ties FROM (
          SELECT count(*) AS q FROM flows GROUP BY {c}))"""


@query("d17_kruskal", " UNION ALL ".join(_kruskal_sql(c) for c in TEST), (a.FLOWS,))
def kruskal(t: Tables) -> DataFrame:
    return rounded(profile.kruskal(a.flows(t), TEST, "label").drop("p_value"), "h_statistic", digits=4)


@query("d18_anderson_normal")
def anderson_normal(t: Tables) -> DataFrame:
    return profile.anderson_normal(a.flows(t), KEY)


@query("k03_test_pvalues")
def pvalues(t: Tables) -> DataFrame:
    f = a.flows(t)
    kw = profile.kruskal(f, KEY, "label").select("feature", F.lit("kruskal").alias("test"), "p_value")
    lv = profile.levene(f, KEY, "label", stored=True).select("feature", F.lit("levene").alias("test"), "p_value")
    return kw.unionByName(lv)

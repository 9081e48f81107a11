"""Joins, set operations, splits, samples and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.contract import MITRE_RULES
from flowlens.operators import clean, joins, split
from flowlens.plans import adapters as a
from flowlens.plans.registry import Tables, query, rounded
from flowlens.sources.flows import file_counts, union_all

D = (a.FLOWS, a.DIRTY)
I = (a.SCORED, a.INCIDENTS)


@query("c01_null_impact", """SELECT label, count(*) AS n_before, nullif(count(*) FILTER (WHERE ok), 0) AS n_after,
  count(*) - nullif(count(*) FILTER (WHERE ok), 0) AS abs_diff,
  round((count(*) - nullif(count(*) FILTER (WHERE ok), 0)) * 100.0 / count(*), 2) AS diff_pct
  FROM (SELECT label, flow_duration IS NOT NULL AND NOT isnan(flow_duration) AND NOT isinf(flow_duration)
    AND flow_id IS NOT NULL AS ok FROM dirty) WHERE label IS NOT NULL GROUP BY label""", D)
def null_impact(t: Tables) -> DataFrame:
    d = clean.finite_columns(a.dirty(t).select("label", "flow_duration", "flow_id"), ["flow_duration"])
    return joins.null_impact(d, "label")


@query("c02_compare_importance", """SELECT c.feature, c.importance, s.statistic FROM (
    SELECT unnest(['flow_duration', 'flow_iat_mean', 'fin_flag_count']) AS feature, unnest([round(abs(corr(flow_duration, y)), 6),
      round(abs(corr(flow_iat_mean, y)), 6), round(abs(corr(fin_flag_count, y)), 6)]) AS importance
    FROM (SELECT *, CAST(label <> 'BENIGN' AS INTEGER) AS y FROM flows)) c
  LEFT JOIN (SELECT unnest(['flow_duration', 'flow_iat_mean']) AS feature, unnest([round(avg(flow_duration), 4),
    round(avg(flow_iat_mean), 4)]) AS statistic FROM flows) s USING (feature)""", (a.FLOWS,))
def compare_importance(t: Tables) -> DataFrame:
    f = a.flows(t).withColumn("y", (F.col("label") != "BENIGN").cast("int"))
    left = ["flow_duration", "flow_iat_mean", "fin_flag_count"]
    scores = f.agg(*[F.round(F.abs(F.corr(c, "y")), 6).alias(c) for c in left])
    means = f.agg(*[F.round(F.avg(c), 4).alias(c) for c in left[:2]])
    return joins.compare_importance(clean.unpivot_row(scores, left, "importance"),
                                    clean.unpivot_row(means, left[:2], "statistic"))


@query("c03_top_up", """SELECT row_key FROM flows WHERE label <> 'BENIGN' AND row_key NOT IN (
  SELECT row_key FROM flows WHERE flow_no % 3 = 0) ORDER BY row_key LIMIT 200""", (a.FLOWS,))
def top_up(t: Tables) -> DataFrame:
    f = split.with_row_order(a.flows(t), "row_key", "flow_no").filter("label <> 'BENIGN'")
    taken = a.flows(t).filter("flow_no % 3 = 0")
    return joins.top_up(f, taken, "row_key", "_order", "_bucket", 200).select("row_key")


@query("c04_realign", """SELECT label, count(*) AS n FROM flows WHERE row_key IN (SELECT row_key FROM dirty
  WHERE flow_duration IS NOT NULL AND NOT isnan(flow_duration) AND NOT isinf(flow_duration)) GROUP BY label""", D)
def realign(t: Tables) -> DataFrame:
    rows = clean.finite_columns(a.dirty(t).select("row_key", "flow_duration"), ["flow_duration"]).dropna()
    return joins.realign(a.flows(t).select("row_key", "label"), rows, "row_key").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))


@query("c05_lookup", """SELECT label, CASE label WHEN 'BENIGN' THEN 0 WHEN 'DDoS' THEN 1 END AS idx, count(*) AS n
  FROM flows GROUP BY ALL""", (a.FLOWS,))
def lookup(t: Tables) -> DataFrame:
    return clean.lookup(a.flows(t), "label", {"BENIGN": 0, "DDoS": 1}, "idx").groupBy("label", "idx").agg(
        F.count(F.lit(1)).alias("n"))


_RULES_SQL = ", ".join(
    f"({i}, '{text}', {'NULL' if port is None else port}, '{tactic}', '{tid}', '{name}')"
    for i, (text, port, tactic, tid, name) in enumerate(MITRE_RULES))
_THREAT_SQL = """CASE threat_classification WHEN 'error' THEN 'ddos flood' WHEN 'click' THEN 'SSH-BruteForce'
  WHEN 'view' THEN 'webattack xss' WHEN 'purchase' THEN 'PortScan' ELSE 'other' END"""


@query("c06_map_mitre", f"""SELECT coalesce(r.tactic, 'Unknown') AS tactic, coalesce(r.tid, 'T0000') AS technique_id,
  coalesce(r.name, 'Unclassified') AS technique_name, count(*) AS n FROM (SELECT event_id, port, threat,
    (SELECT min(ord) FROM (VALUES {_RULES_SQL}) v(ord, txt, p, tactic, tid, name)
     WHERE contains(lower(x.threat), lower(v.txt)) AND (v.p IS NULL OR v.p = x.port)) AS ord
    FROM (SELECT event_id, target_port AS port, {_THREAT_SQL} AS threat FROM incidents) x) m
  LEFT JOIN (VALUES {_RULES_SQL}) r(ord, txt, p, tactic, tid, name) ON r.ord = m.ord GROUP BY ALL""", I)
def map_mitre(t: Tables) -> DataFrame:
    kind = F.col("threat_classification")
    threat = (F.when(kind == "error", "ddos flood").when(kind == "click", "SSH-BruteForce")
              .when(kind == "view", "webattack xss").when(kind == "purchase", "PortScan").otherwise("other"))
    mapped = joins.map_mitre(a.incidents(t).withColumn("threat", threat), "threat", "target_port")
    return mapped.groupBy("mitre.tactic", "mitre.technique_id", "mitre.technique_name").agg(
        F.count(F.lit(1)).alias("n"))


@query("c07_consumer_lag", """SELECT e.part AS "partition", greatest(coalesce(o.end_offset, 0) - (e.max_off + 1), 0) AS lag
  FROM (SELECT CAST(event_id % 8 AS INTEGER) AS part, max(event_id) AS max_off FROM events
    WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1) e
  LEFT JOIN (SELECT CAST(event_id % 8 AS INTEGER) AS part, max(event_id) + 1 AS end_offset FROM events
    WHERE event_id % 8 < 7 GROUP BY 1) o USING (part)""")
def consumer_lag(t: Tables) -> DataFrame:
    rows = a.scored(t).select((F.col("event_id") % 8).cast("int").alias("partition"),
                              F.col("event_id").alias("offset"), "ts")
    ends = rows.filter("partition < 7").groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"))
    return joins.consumer_lag(rows.filter(F.col("ts") < a.now()), ends)


_METRIC_SQL = """SELECT unnest(['precision_attack', 'recall_attack', 'f1_attack']) AS metric, unnest([tp / nullif(fl, 0),
  tp / nullif(ps, 0), 2 * tp / nullif(fl + ps, 0)]) AS value FROM (SELECT CAST(count(*) FILTER (WHERE y = 1 AND p >= {t}) AS DOUBLE) AS tp,
  count(*) FILTER (WHERE p >= {t}) AS fl, count(*) FILTER (WHERE y = 1) AS ps FROM scored)"""


def _run_metrics(t: Tables, threshold: float) -> DataFrame:
    from flowlens.operators.evaluate import prf
    m = prf(a.scored(t).withColumn("hit", (F.col("p") >= threshold).cast("int")), "y", "hit")
    return m.select(F.col("precision").alias("precision_attack"), F.col("recall").alias("recall_attack"),
                    F.col("f1").alias("f1_attack")).unpivot(
        [], ["precision_attack", "recall_attack", "f1_attack"], "metric", "value")


@query("c08_compare_runs", f"""SELECT metric, round(b.value, 6) AS base_value, round(o.value, 6) AS other_value,
  round(o.value - b.value, 6) AS delta, round((b.value - o.value) / b.value, 6) AS relative_degradation,
  CASE WHEN metric = 'f1_attack' THEN CASE WHEN o.value - b.value >= 0 THEN 'use_multiclass_now'
    ELSE 'keep_binary_plus_rules_fallback' END END AS recommendation
  FROM ({_METRIC_SQL.format(t=0.5)}) b JOIN ({_METRIC_SQL.format(t=0.25)}) o USING (metric)""", (a.SCORED,))
def compare_runs(t: Tables) -> DataFrame:
    return rounded(joins.compare_runs(_run_metrics(t, 0.5), _run_metrics(t, 0.25)),
                   "base_value", "other_value", "delta", "relative_degradation")


@query("c09_head_to_head", """SELECT 'events' AS metric, CAST(count(*) FILTER (WHERE event_id % 2 = 0) AS DOUBLE) AS python,
    CAST(count(*) FILTER (WHERE event_id % 2 = 1) AS DOUBLE) AS spark_v3 FROM events UNION ALL
  SELECT 'mean_value', round(avg(value) FILTER (WHERE event_id % 2 = 0), 6),
    round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) FROM events""")
def head_to_head(t: Tables) -> DataFrame:
    system = F.when(F.col("event_id") % 2 == 0, "python").otherwise("spark_v3").alias("system")
    long = t.table("events").groupBy(system).agg(
        F.count(F.lit(1)).cast("double").alias("events"), F.avg("value").alias("mean_value")).unpivot(
        ["system"], ["events", "mean_value"], "metric", "value")
    return rounded(joins.head_to_head(long, ["python", "spark_v3"]), "python", "spark_v3")


@query("d48_disagreement", """SELECT count(*) AS compared, round(avg(CAST(a <> b AS INTEGER)), 6) AS disagreement_rate
  FROM (SELECT p >= 0.5 AS a, value * value / 5000 >= 0.5 AS b FROM scored)""", (a.SCORED,))
def disagreement(t: Tables) -> DataFrame:
    s = a.scored(t)
    live = s.select("event_id", (F.col("p") >= 0.5).alias("flag"))
    shadow = s.select("event_id", (F.col("value") * F.col("value") / 5000 >= 0.5).alias("flag"))
    return rounded(joins.disagreement(live, shadow, "event_id", "flag"), "disagreement_rate")


# --- splits and samples ------------------------------------------------------------------

@query("e01_grouped_split", """SELECT row_key, label, source_file, CASE WHEN n > 1 AND rn <=
    greatest(1, least(CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT), n - 1)) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT row_key, label, source_file, count(*) OVER (PARTITION BY label, source_file) AS n,
    row_number() OVER (PARTITION BY label, source_file ORDER BY md5(row_key || '|42'), row_key) AS rn FROM flows)""", (a.FLOWS,))
def grouped_split(t: Tables) -> DataFrame:
    f = a.flows(t).select("row_key", "label", "source_file")
    return split.grouped_split(f, "row_key", ["label", "source_file"], dedup_before_split=False)


@query("e02_pilot_sample", """SELECT row_key, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_key) AS rn
  FROM flows) WHERE rn <= CASE WHEN label = 'BENIGN' THEN 600 ELSE 100 END""", (a.FLOWS,))
def pilot_sample(t: Tables) -> DataFrame:
    return split.pilot_sample(a.flows(t), "row_key", "flow_no", "label", 1000).select("row_key", "label")


@query("e03_class_sample", """SELECT row_key, label FROM (SELECT row_key, label, row_number() OVER (PARTITION BY label = 'BENIGN'
  ORDER BY md5(row_key || '|42'), row_key) AS rn FROM flows) WHERE rn <= CASE WHEN label = 'BENIGN' THEN 600 ELSE 400 END""",
       (a.FLOWS,))
def class_sample(t: Tables) -> DataFrame:
    return split.class_sample(a.flows(t), "row_key", "label", 1000).select("row_key", "label")


@query("e08_tail", """SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 50""")
def tail(t: Tables) -> DataFrame:
    return split.tail(t.table("events").select("event_id", "value"), "event_id", 50)


@query("f01_chronological", """SELECT row_key, CASE flow_no % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 3 THEN ts - INTERVAL 2 HOUR
  ELSE ts END AS parsed FROM dirty ORDER BY parsed NULLS LAST""", D)
def chronological(t: Tables) -> DataFrame:
    from flowlens.functions import parse_iso
    rows = a.dirty(t).select("row_key", parse_iso(F.col("ts_text")).alias("parsed"))
    return split.chronological(rows, "parsed").withColumn("parsed", F.col("parsed").cast("timestamp_ntz"))


@query("f03_top_k", """SELECT row_key, flow_bytes_s FROM flows ORDER BY flow_bytes_s DESC, row_key LIMIT 25""", (a.FLOWS,))
def top_k(t: Tables) -> DataFrame:
    return split.top_k(a.flows(t).select("row_key", "flow_bytes_s"), 25, F.desc("flow_bytes_s"), F.asc("row_key"))


@query("f04_head", "SELECT row_key FROM flows ORDER BY row_key LIMIT 500", (a.FLOWS,))
def head(t: Tables) -> DataFrame:
    return split.head(a.flows(t), "row_key", "flow_no", 500).select("row_key")


@query("f04_sample_n", "SELECT row_key FROM flows ORDER BY md5(row_key || '|7'), row_key LIMIT 777", (a.FLOWS,))
def sample_n(t: Tables) -> DataFrame:
    return split.sample_n(a.flows(t), "row_key", 777, seed=7).select("row_key")


@query("i18_random_split", """SELECT row_key, CASE WHEN rn <= ceil(n * CAST(0.33 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT row_key, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(row_key || '|42'), row_key) AS rn FROM flows)""",
       (a.FLOWS,))
def random_split(t: Tables) -> DataFrame:
    return split.random_split(a.flows(t).select("row_key"), "row_key", 0.33)


# --- set operations ----------------------------------------------------------------------

@query("g01_union_all", """SELECT source_file, label, flow_id, count(*) AS n FROM (
  SELECT source_file, label, NULL AS flow_id FROM flows UNION ALL SELECT source_file, label, flow_id FROM dirty) GROUP BY ALL""", D)
def union_rows(t: Tables) -> DataFrame:
    left = a.flows(t).select("source_file", "label")
    right = a.dirty(t).select("label", "flow_id", "source_file")
    return union_all([left, right]).groupBy("source_file", "label", "flow_id").agg(F.count(F.lit(1)).alias("n"))


@query("g02_all_labels", "SELECT label FROM scored UNION SELECT predicted FROM scored", (a.SCORED,))
def all_labels(t: Tables) -> DataFrame:
    from flowlens.operators.evaluate import all_labels as labels
    return labels(a.scored(t), "label", "predicted")


@query("g03_unseen_labels", "SELECT DISTINCT label FROM dirty WHERE label IS NOT NULL EXCEPT SELECT label FROM flows", D)
def unseen_labels(t: Tables) -> DataFrame:
    return clean.unseen_labels(a.flows(t), a.dirty(t), "label")


@query("d49_file_counts", "SELECT source_file, count(*) AS n FROM flows GROUP BY 1", (a.FLOWS,))
def files(t: Tables) -> DataFrame:
    return file_counts(a.flows(t))

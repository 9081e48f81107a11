"""Incident, campaign, service-level and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.contract import SLO_TARGETS
from flowlens.operators import incidents as ops
from flowlens.operators import reports as rep
from flowlens.plans import adapters as a
from flowlens.plans.registry import Tables, naive, query, rounded
from flowlens.sources import store

I = (a.SCORED, a.INCIDENTS)
R = (a.REPORTS,)
CUT = f"ts >= TIMESTAMP '{a.NOW}' - INTERVAL {a.HOURS} HOUR"


# Campaign view ``camp`` over one-day windows, and the same with a twelve-hour slide.
TUMBLING = """base AS (SELECT coalesce(source_ip, 'unknown') AS ip, threat_classification AS kind, confidence, ts, event_id,
  date_trunc('day', ts) AS w FROM incidents),
kinds AS (SELECT ip, w, kind, count(*) AS n FROM base GROUP BY ALL),
modal AS (SELECT ip, w, kind FROM (SELECT *, row_number() OVER (PARTITION BY ip, w ORDER BY n DESC, kind) AS rn FROM kinds) WHERE rn = 1),
camp AS (SELECT substr(sha1(b.ip || '|' || strftime(b.w, '%Y-%m-%dT%H:%M:%S+00:00')), 1, 16) AS campaign_id, b.ip AS attacker_ip,
  b.w AS timestamp_start, b.w + INTERVAL 1 DAY AS timestamp_end, count(*) AS aggregated_events,
  avg(confidence) AS confidence_score, any_value(m.kind) AS threat_classification,
  string_agg(b.kind, ',' ORDER BY ts, event_id) AS all_threat_types
  FROM base b JOIN modal m ON m.ip = b.ip AND m.w = b.w GROUP BY b.ip, b.w HAVING count(*) >= 2)"""
SLIDING = TUMBLING.replace("date_trunc('day', ts) AS w FROM incidents", "time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * off AS w "
                           "FROM incidents, (VALUES (0), (1)) o(off)")
_CAMP_COLUMNS = """campaign_id, attacker_ip, timestamp_start, timestamp_end, aggregated_events,
  round(confidence_score, 10) AS confidence_score, threat_classification"""


def daily_campaigns(t: Tables, tie: bool = False) -> DataFrame:
    return ops.campaigns(a.incidents(t), "1 day", None, 2, "event_id" if tie else None)


def _clean(df: DataFrame) -> DataFrame:
    return naive(rounded(df, "confidence_score", digits=10), "timestamp_start", "timestamp_end")


@query("d35_campaigns", f"""SELECT {_CAMP_COLUMNS}, array_to_string(string_split(all_threat_types, ',')[1:200], ',') AS all_threat_types,
  86400 AS window_duration_sec FROM camp""", (*I, TUMBLING))
def campaigns(t: Tables) -> DataFrame:
    out = daily_campaigns(t, tie=True)
    return _clean(out.withColumn("all_threat_types", F.array_join("all_threat_types", ",")))


@query("j04_sliding_campaigns", f"SELECT {_CAMP_COLUMNS}, 86400 AS window_duration_sec FROM camp", (*I, SLIDING))
def sliding_campaigns(t: Tables) -> DataFrame:
    return _clean(ops.campaigns(a.incidents(t), "1 day", "12 hours", 2))


@query("d36_summary", f"""SELECT {a.HOURS} AS hours, (SELECT count(*) FROM incidents WHERE {CUT}) AS incidents,
  (SELECT count(*) FROM camp WHERE timestamp_start >= TIMESTAMP '{a.NOW}' - INTERVAL {a.HOURS} HOUR) AS campaigns,
  (SELECT round(avg(confidence), 6) FROM incidents WHERE {CUT}) AS avg_confidence""", (*I, TUMBLING))
def summary(t: Tables) -> DataFrame:
    return rounded(ops.summary(a.incidents(t), daily_campaigns(t), a.now(), a.HOURS), "avg_confidence")


@query("d36_top_sources", f"""SELECT coalesce(source_ip, 'unknown') AS source_ip, count(*) AS n FROM incidents WHERE {CUT}
  GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""", I)
def top_sources(t: Tables) -> DataFrame:
    return ops.top_sources(a.incidents(t), a.now(), a.HOURS)


@query("d37_timeseries", f"""SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS t, count(*) AS n, round(avg(confidence), 10) AS avg_conf
  FROM incidents WHERE {CUT} GROUP BY 1 ORDER BY 1""", I)
def timeseries(t: Tables) -> DataFrame:
    return naive(rounded(ops.timeseries(a.incidents(t), a.now(), a.HOURS * 60, 15), "avg_conf", digits=10), "t")


@query("d38_throughput", f"""SELECT {a.HOURS * 60} AS minutes, count(*) AS incidents, round(count(*) / ({a.HOURS * 3600}.0), 8)
  AS events_per_sec FROM incidents WHERE {CUT}""", I)
def throughput(t: Tables) -> DataFrame:
    return rounded(ops.throughput(a.incidents(t), a.now(), a.HOURS * 60), "events_per_sec", digits=8)


@query("d39_hotspots", f"""SELECT dimension, value, n, CAST(place AS INTEGER) AS place FROM (SELECT *,
  row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value NULLS FIRST) AS place FROM (
  SELECT 'port' AS dimension, CAST(target_port AS VARCHAR) AS value, count(*) AS n FROM incidents WHERE {CUT} GROUP BY ALL
  UNION ALL SELECT 'destination_ip', destination_ip, count(*) FROM incidents WHERE {CUT} GROUP BY ALL
  UNION ALL SELECT 'threat_type', threat_classification, count(*) FROM incidents WHERE {CUT} GROUP BY ALL)) WHERE place <= 8""", I)
def hotspots(t: Tables) -> DataFrame:
    return ops.hotspots(a.incidents(t), a.now(), a.HOURS)


_LAT = {"latency_ingest_to_detect_ms": ("ingest_ts", "detect_ts"), "latency_ingest_to_write_ms": ("ingest_ts", "write_ts"),
        "latency_detect_to_write_ms": ("detect_ts", "write_ts")}


@query("d40_latency_stats", " UNION ALL ".join(f"""SELECT '{n}' AS stage, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50,
  round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99
  FROM (SELECT CAST(date_diff('microsecond', {x}, {y}) AS DOUBLE) / 1000 AS ms FROM incidents)""" for n, (x, y) in _LAT.items()), I)
def latency_stats(t: Tables) -> DataFrame:
    return rounded(ops.latency_stats(a.incidents(t), stored=True), "mean", "p50", "p95", "p99")


@query("d40_rolling_latency", " UNION ALL ".join(f"""SELECT '{n}' AS stage, count(*) AS n, round(avg(CAST(date_diff('microsecond', {x}, {y}) AS DOUBLE) / 1000), 6)
  AS mean, true AS p50_close, true AS p95_close, true AS p99_close FROM incidents WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"""
  for n, (x, y) in _LAT.items()), I)
def rolling_latency(t: Tables) -> DataFrame:
    """A week from hourly sketches; how many rows really lie below its percentiles is counted to judge them."""
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-12"))
    rows = a.incidents(t)
    week = ops.rolling_latency(ops.latency_sketches(rows), start, end)
    long = rows.where((F.col("ts") >= start) & (F.col("ts") < end)).select(*ops.latencies()).unpivot([], list(_LAT), "stage", "ms")
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    below = long.join(F.broadcast(week), "stage").groupBy("stage").agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"),
        *[(F.abs(F.avg((F.col("ms") <= F.col(p)).cast("int")) - v) <= 3 * ops.RANK_ERROR).alias(f"{p}_close") for p, v in probs.items()])
    return rounded(below, "mean")


@query("j08_latency_by_run", """SELECT run_id, round(quantile_cont(ms, 0.95), 6) AS p95_ms, run_id = (
  SELECT benchmark_run_id FROM incidents ORDER BY ingest_ts DESC, benchmark_run_id DESC LIMIT 1) AS freshest FROM (
  SELECT benchmark_run_id AS run_id, CAST(date_diff('microsecond', ingest_ts, write_ts) AS DOUBLE) / 1000 AS ms FROM incidents)
  GROUP BY run_id""", I)
def latency_by_run(t: Tables) -> DataFrame:
    return rounded(ops.latency_by_run(a.incidents(t), "benchmark_run_id"), "p95_ms")


def measured(t: Tables) -> DataFrame:
    """Three measured service levels; the peak is not measured."""
    inc = a.incidents(t)
    lat = ops.latency_stats(inc, stored=True).filter("stage = 'latency_ingest_to_write_ms'").select(
        F.lit("end_to_end_latency").alias("metric"), (F.col("p95") / 1000).alias("value"))
    rate = ops.throughput(inc, a.now(), a.HOURS * 60).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col("events_per_sec").alias("value"))
        for n in ("throughput_sustained", "mongo_write_rate")])).alias("s")).select("s.*")
    return lat.unionByName(rate)


_SLO = f"""slo AS (SELECT metric, target, round(m.value, 8) AS measured, CASE WHEN m.value IS NULL THEN 'UNVERIFIED'
  WHEN direction = 'max' AND m.value <= target OR direction = 'min' AND m.value >= target THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (VALUES {", ".join(f"('{m}', CAST({v} AS DOUBLE), '{d}')" for m, v, d in SLO_TARGETS)}) s(metric, target, direction)
  LEFT JOIN (SELECT 'end_to_end_latency' AS metric, quantile_cont(CAST(date_diff('microsecond', ingest_ts, write_ts) AS DOUBLE) / 1000, 0.95)
      / 1000 AS value FROM incidents
    UNION ALL SELECT unnest(['throughput_sustained', 'mongo_write_rate']), count(*) / {a.HOURS * 3600}.0 FROM incidents WHERE {CUT}) m
  USING (metric))"""


@query("d41_slo", "SELECT * FROM slo", (*I, _SLO))
def slo(t: Tables) -> DataFrame:
    return rounded(ops.slo(measured(t)), "measured", digits=8)


@query("d46_status_counts", """SELECT count(*) FILTER (WHERE status = 'PASS') AS pass, count(*) FILTER (WHERE status = 'FAIL') AS fail,
  count(*) FILTER (WHERE status = 'UNVERIFIED') AS unverified FROM slo""", (*I, _SLO))
def status_counts(t: Tables) -> DataFrame:
    return ops.status_counts(ops.slo(measured(t)))


@query("f02_recent_incidents", f"""SELECT event_id, ts, confidence FROM incidents WHERE ts >= TIMESTAMP '{a.NOW}' - INTERVAL 6000 MINUTE
  ORDER BY ts DESC, event_id LIMIT 100""", I)
def recent_incidents(t: Tables) -> DataFrame:
    page = ops.newest(ops.recent_rows(a.incidents(t), a.now(), 6000), "ts", "event_id")
    return naive(page.select("event_id", "ts", "confidence"), "ts")


@query("f02_recent_campaigns", f"""SELECT campaign_id, timestamp_start FROM camp WHERE timestamp_start >= TIMESTAMP '{a.NOW}' - INTERVAL 24 HOUR
  ORDER BY timestamp_start DESC, campaign_id LIMIT 100""", (*I, TUMBLING))
def recent_campaigns(t: Tables) -> DataFrame:
    page = ops.newest(ops.recent_rows(daily_campaigns(t), a.now(), 24 * 60, "timestamp_start"), "timestamp_start", "campaign_id")
    return naive(page.select("campaign_id", "timestamp_start"), "timestamp_start")


@query("b20_campaigns_by_ip", f"""SELECT {_CAMP_COLUMNS} FROM camp WHERE attacker_ip = '10.0.0.7'
  ORDER BY timestamp_start DESC, campaign_id LIMIT 100""", (*I, TUMBLING))
def campaigns_by_ip(t: Tables) -> DataFrame:
    page = ops.campaigns_by_ip(daily_campaigns(t), "10.0.0.7")
    return _clean(page.drop("window_duration_sec"))


@query("d45_benchmark_rollup", """SELECT count(*) AS profiles, max(consumer_eps) AS max_profile_eps, CASE WHEN bool_or(producer_eps > consumer_eps)
  THEN 'consumer_bound' ELSE 'producer_bound' END AS bottleneck_hint FROM (SELECT user_id, round(sum(value), 4) AS producer_eps,
  round(sum(value) * 0.5, 4) AS consumer_eps FROM events GROUP BY user_id)""")
def benchmark_rollup(t: Tables) -> DataFrame:
    runs = t.table("events").groupBy("user_id").agg(
        F.round(F.sum("value"), 4).alias("producer_eps"), F.round(F.sum("value") * 0.5, 4).alias("consumer_eps"))
    return ops.benchmark_rollup(runs)


@query("d45_stage_means", """SELECT unnest(['score', 'write']) AS stage, unnest([round(avg(event_id % 997), 3), round(avg(event_id % 389), 3)])
  AS mean_ms FROM events""")
def stage_means(t: Tables) -> DataFrame:
    no = F.col("event_id")
    stages = F.create_map(F.lit("score"), (no % 997).cast("double"), F.lit("write"), (no % 389).cast("double"))
    return ops.stage_means(t.table("events").select(stages.alias("stage_ms")))


@query("d47_rolling_monitor", """SELECT w + INTERVAL 24 HOUR AS at, count(*) AS n, round(avg(p), 10) AS mean,
  CASE WHEN avg(p) > 0.52 THEN 'ROLLBACK' WHEN avg(p) > 0.48 THEN 'ALERT' ELSE 'OK' END AS state
  FROM (SELECT p, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * off AS w FROM scored, (VALUES (0), (1), (2), (3)) o(off))
  GROUP BY w""", (a.SCORED,))
def rolling_monitor(t: Tables) -> DataFrame:
    out = ops.rolling_monitor(a.scored(t), F.col("p"), "24 hours", "6 hours", 0.48, 0.52)
    return naive(rounded(out, "mean", digits=10), "at")


@query("d47_kl_drift", f"""SELECT CAST(any_value(ct) AS BIGINT) AS current_rows, CAST(any_value(bt) AS BIGINT) AS baseline_rows,
  round(sum((c + 1) / (ct + 10) * ln(((c + 1) / (ct + 10)) / ((b + 1) / (bt + 10)))), 6) AS kl,
  CASE WHEN sum((c + 1) / (ct + 10) * ln(((c + 1) / (ct + 10)) / ((b + 1) / (bt + 10)))) > 0.25 THEN 'ROLLBACK'
    WHEN sum((c + 1) / (ct + 10) * ln(((c + 1) / (ct + 10)) / ((b + 1) / (bt + 10)))) > 0.1 THEN 'ALERT' ELSE 'OK' END AS state
  FROM (SELECT *, sum(c) OVER () AS ct, sum(b) OVER () AS bt FROM (SELECT g.bin,
      CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '{a.NOW}' - INTERVAL 24 HOUR) AS DOUBLE) AS c,
      CAST(count(*) FILTER (WHERE ts < TIMESTAMP '{a.NOW}' - INTERVAL 24 HOUR) AS DOUBLE) AS b
    FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN (SELECT *, CASE WHEN p < 0.1 THEN 0 WHEN p < 0.2 THEN 1 WHEN p < 0.3 THEN 2
        WHEN p < 0.4 THEN 3 WHEN p < 0.5 THEN 4 WHEN p < 0.6 THEN 5 WHEN p < 0.7 THEN 6 WHEN p < 0.8 THEN 7 WHEN p < 0.9 THEN 8 ELSE 9 END AS bin
      FROM scored WHERE ts >= TIMESTAMP '{a.NOW}' - INTERVAL 24 HOUR - INTERVAL 7 DAY AND ts < TIMESTAMP '{a.NOW}') s USING (bin)
    GROUP BY g.bin))""", (a.SCORED,))
def kl_drift(t: Tables) -> DataFrame:
    return rounded(ops.kl_drift(a.scored(t), "p", a.now()), "kl")


@query("d47_weekly_growth", """SELECT w.week, round(w.total, 4) AS total, round((w.total - p.total) / p.total, 6) AS growth,
  CASE WHEN (w.total - p.total) / p.total > 0.3 THEN 'ROLLBACK' WHEN (w.total - p.total) / p.total > 0.15 THEN 'ALERT' ELSE 'OK' END AS state
  FROM weeks w LEFT JOIN weeks p ON p.week + INTERVAL 7 DAY = w.week""",
       ("weeks AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, sum(value) AS total FROM events GROUP BY 1)",))
def weekly_growth(t: Tables) -> DataFrame:
    out = ops.weekly_growth(a.scored(t), F.col("value"))
    return naive(rounded(rounded(out, "total", digits=4), "growth"), "week")


# --- reports -----------------------------------------------------------------------------

@query("d42_final_status", """SELECT round(v, 6) AS precision_attack, round(v * 0.75, 6) AS recall_attack, round(v * 0.25, 6) AS f1_attack,
  (SELECT arg_max(value, run_ts) FROM params WHERE key = 'classification_threshold') AS threshold,
  (SELECT arg_max(value, run_ts) FROM params WHERE key = 'pca_k') AS pca_k,
  (SELECT arg_max(value, run_ts) FROM params WHERE key = 'pca_variance_retained') AS pca_variance_retained,
  v >= 0.85 AS precision_pass, v * 0.75 >= 0.8 AS recall_pass, v * 0.25 >= 0.6 AS f1_pass
  FROM reports WHERE prefix = 'xgb_feature_set_ablation' ORDER BY run_ts DESC LIMIT 1""", (a.REPORTS, a.PARAMS))
def final_status(t: Tables) -> DataFrame:
    return rounded(rep.final_status(a.reports(t), a.params(t)), "precision_attack", "recall_attack", "f1_attack")


@query("d43_model_eval", """SELECT 'multiclass' AS type, 'BENIGN,DDoS' AS labels, value > 50 AS gate_pass, NULL AS best_name,
  CAST(NULL AS DOUBLE) AS f1_attack FROM reports WHERE prefix = 'multiclass_eval' ORDER BY run_ts DESC LIMIT 1""", R)
def model_eval(t: Tables) -> DataFrame:
    return rep.model_eval(a.reports(t))


@query("d43_model_eval_fallback", """SELECT 'binary' AS type, 'benign,attack' AS labels, CAST(NULL AS BOOLEAN) AS gate_pass,
  'combo_targeted10_pca25' AS best_name, round(v * 0.25, 6) AS f1_attack FROM reports WHERE prefix = 'xgb_feature_set_ablation'
  ORDER BY run_ts DESC LIMIT 1""", R)
def model_eval_fallback(t: Tables) -> DataFrame:
    return rounded(rep.model_eval(a.reports(t).filter("prefix <> 'multiclass_eval'")), "f1_attack")


_MEANING = """CASE prefix WHEN 'pca_full_comparison' THEN 'PCA component stability across fast/balanced/full scales.'
  WHEN 'xgb_feature_set_ablation' THEN 'Hybrid combo (10+25) selected as strongest tested feature set.'
  WHEN 'benchmark_baseline' THEN 'consumer_bound' ELSE 'Captured run artifact.' END"""


@query("d44_catalog", f"""SELECT prefix AS test_name, prefix || '_' || run_ts || '.json' AS file, {_MEANING} AS inference,
  CASE WHEN prefix IN ('xgb_feature_set_ablation') THEN event_id END AS train_rows,
  CASE WHEN prefix = 'benchmark_baseline' THEN value END AS max_profile_eps,
  CASE WHEN prefix = 'pca_full_comparison' THEN event_id % 30 END AS first_k95 FROM reports""", R)
def catalog(t: Tables) -> DataFrame:
    entries = rep.catalog(a.reports(t))
    return entries.select(
        "test_name", "file", "inference", F.get_json_object("config", "$.train_rows").cast("bigint").alias("train_rows"),
        F.get_json_object("result", "$.max_profile_eps").cast("double").alias("max_profile_eps"),
        F.get_json_object("result", "$.k95_values[0]").cast("bigint").alias("first_k95"))


# The kinds that `reports` has no payload for, in turn over the events.
_MORE = ["recall_recovery_experiments", "multiclass_vs_binary", "benchmark_full_plan"]


@query("d44_catalog_more", """SELECT prefix AS test_name, prefix || '_' || run_ts || '.json' AS file, CASE prefix
  WHEN 'recall_recovery_experiments' THEN 'Threshold tuning helped recall; aggressive class-weight sweeps degraded.'
  WHEN 'multiclass_vs_binary' THEN 'keep binary' ELSE 'Full industry-style benchmark matrix for ramp/burst/soak/recovery.' END AS inference,
  CASE prefix WHEN 'recall_recovery_experiments' THEN '{"train_rows":' || event_id || '}' WHEN 'multiclass_vs_binary'
    THEN '{"run_timestamp":"r' || event_id || '"}' ELSE '{"rows":' || event_id || '}' END AS config,
  CASE prefix WHEN 'recall_recovery_experiments' THEN '{"threshold_sweep":[' || event_id || '],"scale_pos_weight_sweep":[]}' WHEN 'multiclass_vs_binary'
    THEN '{"winner":"binary"}' ELSE '["ramp","soak"]' END AS result
  FROM (SELECT * REPLACE (['recall_recovery_experiments', 'multiclass_vs_binary', 'benchmark_full_plan'][event_id % 3 + 1] AS prefix) FROM reports)""", R)
def catalog_more(t: Tables) -> DataFrame:
    no = F.col("event_id")
    payload = F.struct(no.alias("train_rows"), F.concat(F.lit("r"), no).alias("run_timestamp"), F.array(no).alias("threshold_sweep_hybrid"),
                       F.lit("keep binary").alias("recommendation"), F.struct(F.lit("binary").alias("winner")).alias("comparison"),
                       F.struct(no.alias("rows")).alias("inputs"), F.array(F.lit("ramp"), F.lit("soak")).alias("phases"))
    kind = F.get(F.array(*[F.lit(k) for k in _MORE]), (no % 3).cast("int"))
    return rep.catalog(a.reports(t).withColumn("prefix", kind).withColumn("payload", F.to_json(payload)))


@query("b23_filter_catalog", """SELECT prefix || '_' || run_ts || '.json' AS file FROM reports WHERE prefix = 'benchmark_baseline'
  AND contains(run_ts, '20240105')""", R)
def filter_catalog(t: Tables) -> DataFrame:
    hits = rep.filter_catalog(rep.catalog(a.reports(t)), "benchmark_baseline", "20240105", "CONSUMER_Bound")
    return hits.select("file")


@query("d44_benchmark_snapshot", """SELECT run_ts, value AS max_profile_eps FROM reports WHERE prefix = 'benchmark_baseline'
  ORDER BY run_ts DESC LIMIT 1""", R)
def benchmark_snapshot(t: Tables) -> DataFrame:
    newest = store.latest_report(a.reports(t), "benchmark_baseline")
    return newest.select("run_ts", F.get_json_object("payload", "$.max_profile_eps").cast("double").alias("max_profile_eps"))

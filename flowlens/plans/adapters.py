"""The domain tables derived from the given ones, in Spark and as SQL text.

``flows``     one row per line item, numeric features and a class label
``dirty``     the same with text numbers, blanks, NaN, infinities, odd labels and copies
``scored``    events with a probability, a binary target and a predicted class
``incidents`` scored rows from a threshold on, with addresses and stage times
``reports``   run reports made of events; ``params`` the same for parameters
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.plans.registry import Tables

FEATURES = ["destination_port", "flow_duration", "total_fwd_packets", "total_backward_packets",
            "fwd_packet_length_max", "bwd_packet_length_max", "flow_iat_mean", "flow_bytes_s",
            "syn_flag_count", "ack_flag_count", "fin_flag_count"]
TARGETED = ["destination_port", "flow_duration", "syn_flag_count", "ack_flag_count", "fin_flag_count",
            "total_fwd_packets"]
THRESHOLD = 0.3
NOW = "2024-01-25 00:00:00"
HOURS = 24 * 14


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def flows(t: Tables) -> DataFrame:
    li = t.table("lineitem")
    text = [F.lpad(F.col(c).cast("string"), n, "0") for c, n in
            (("l_orderkey", 12), ("l_partkey", 10), ("l_suppkey", 8), ("l_linenumber", 2))]
    label = (F.when(F.col("l_returnflag") == "N", "BENIGN")
             .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "DoS Hulk")
             .when(F.col("l_returnflag") == "A", "PortScan")
             .when(F.col("l_linestatus") == "F", "DDoS").otherwise("Bot"))
    return li.select(
        F.concat_ws("-", *text).alias("row_key"), F.col("l_orderkey").alias("flow_no"),
        F.concat(F.lit("year_"), F.year("l_shipdate").cast("string"), F.lit(".csv")).alias("source_file"),
        label.alias("label"), F.col("l_suppkey").cast("double").alias("destination_port"),
        F.col("l_extendedprice").alias("flow_duration"), F.col("l_quantity").alias("total_fwd_packets"),
        F.col("l_linenumber").cast("double").alias("total_backward_packets"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("fwd_packet_length_max"),
        (F.col("l_quantity") * F.col("l_tax")).alias("bwd_packet_length_max"),
        F.col("l_discount").alias("flow_iat_mean"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("flow_bytes_s"),
        (F.col("l_partkey") % 3).cast("double").alias("syn_flag_count"),
        (F.col("l_suppkey") % 2).cast("double").alias("ack_flag_count"),
        (F.col("l_orderkey") % 2).cast("double").alias("fin_flag_count"),
        F.col("l_shipdate").cast("timestamp").alias("ts"))


FLOWS = """flows AS (SELECT
  lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') || '-'
    || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS row_key,
  l_orderkey AS flow_no, 'year_' || CAST(year(l_shipdate) AS VARCHAR) || '.csv' AS source_file,
  CASE WHEN l_returnflag = 'N' THEN 'BENIGN' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'DoS Hulk'
    WHEN l_returnflag = 'A' THEN 'PortScan' WHEN l_linestatus = 'F' THEN 'DDoS' ELSE 'Bot' END AS label,
  CAST(l_suppkey AS DOUBLE) AS destination_port, l_extendedprice AS flow_duration,
  l_quantity AS total_fwd_packets, CAST(l_linenumber AS DOUBLE) AS total_backward_packets,
  l_extendedprice / l_quantity AS fwd_packet_length_max, l_quantity * l_tax AS bwd_packet_length_max,
  l_discount AS flow_iat_mean, l_extendedprice * (1 - l_discount) AS flow_bytes_s,
  CAST(l_partkey % 3 AS DOUBLE) AS syn_flag_count, CAST(l_suppkey % 2 AS DOUBLE) AS ack_flag_count,
  CAST(l_orderkey % 2 AS DOUBLE) AS fin_flag_count, CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem)"""


def is_validation() -> Column:
    return F.col("ts") >= F.lit("2000-01-01").cast("timestamp")


def dirty(t: Tables) -> DataFrame:
    f = flows(t)
    no = F.col("flow_no")
    number = F.col("flow_bytes_s").cast("string")
    odd = {0: "", 1: "Infinity", 2: "NaN", 3: "n/a", 5: "-Infinity", 6: "  1.5 ", 7: "1e3", 8: "1.5d"}
    text = F.when(no % 50 == 4, None)
    for k, v in odd.items():
        text = text.when(no % 50 == k, v)
    duration = (F.when(no % 40 == 0, float("nan")).when(no % 40 == 1, float("inf"))
                .when(no % 40 == 2, float("-inf")).when(no % 40 == 3, None).otherwise(F.col("flow_duration")))
    label = (F.when(no % 20 == 0, F.concat(F.lit("  "), "label", F.lit(" ")))
             .when(no % 20 == 1, "Web Attack � XSS").when(no % 20 == 2, "Web Attack - Brute Force")
             .when(no % 20 == 3, None).when(no % 20 == 4, "Mystery").when(no % 20 == 5, "Infiltration")
             .otherwise(F.col("label")))
    flow_id = (F.when(no % 10 == 0, None).when(no % 10 == 1, "nodash").otherwise(F.concat_ws(
        "-", F.concat(F.lit("10.0."), (no % 200).cast("string"), F.lit(".1")), F.lit("172.16.0.9"), F.lit("80"))))
    src = (F.when(no % 7 == 0, "  ").when(no % 7 == 1, None)
           .otherwise(F.concat(F.lit("192.168.1."), (no % 250).cast("string"))))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ts_text = (F.when(no % 9 == 0, "junk").when(no % 9 == 1, None).when(no % 9 == 2, F.concat(iso, F.lit("Z")))
               .when(no % 9 == 3, F.concat(iso, F.lit("+02:00"))).otherwise(iso))
    base = f.select("row_key", "flow_no", "source_file", label.alias("label"), duration.alias("flow_duration"),
                    text.otherwise(number).alias("flow_bytes_s"), "total_fwd_packets",
                    F.col("total_fwd_packets").alias("subflow_fwd_packets"), F.lit(0.0).alias("bwd_psh_flags"),
                    F.lit(None).cast("double").alias("cwe_flag_count"), flow_id.alias("flow_id"),
                    src.alias("src_text"), ts_text.alias("ts_text"))
    # A copy of some rows, from the same scan.
    return base.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(no % 25 == 0, 2).otherwise(1)))).drop("_copy")


DIRTY_NUMERIC = ["flow_duration", "total_fwd_packets", "subflow_fwd_packets", "bwd_psh_flags", "cwe_flag_count"]

DIRTY = """dirty0 AS (SELECT row_key, flow_no, source_file,
  CASE flow_no % 20 WHEN 0 THEN '  ' || label || ' ' WHEN 1 THEN 'Web Attack ' || chr(65533) || ' XSS'
    WHEN 2 THEN 'Web Attack - Brute Force' WHEN 3 THEN NULL WHEN 4 THEN 'Mystery' WHEN 5 THEN 'Infiltration'
    ELSE label END AS label,
  CASE flow_no % 40 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE)
    WHEN 2 THEN CAST('-Infinity' AS DOUBLE) WHEN 3 THEN NULL ELSE flow_duration END AS flow_duration,
  CASE flow_no % 50 WHEN 0 THEN '' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'NaN' WHEN 3 THEN 'n/a' WHEN 4 THEN NULL
    WHEN 5 THEN '-Infinity' WHEN 6 THEN '  1.5 ' WHEN 7 THEN '1e3' WHEN 8 THEN '1.5d'
    ELSE CAST(flow_bytes_s AS VARCHAR) END AS flow_bytes_s,
  total_fwd_packets, total_fwd_packets AS subflow_fwd_packets, CAST(0 AS DOUBLE) AS bwd_psh_flags,
  CAST(NULL AS DOUBLE) AS cwe_flag_count,
  CASE flow_no % 10 WHEN 0 THEN NULL WHEN 1 THEN 'nodash'
    ELSE '10.0.' || CAST(flow_no % 200 AS VARCHAR) || '.1-172.16.0.9-80' END AS flow_id,
  CASE flow_no % 7 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE '192.168.1.' || CAST(flow_no % 250 AS VARCHAR) END AS src_text,
  CASE flow_no % 9 WHEN 0 THEN 'junk' WHEN 1 THEN NULL WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
    WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS ts_text, ts
  FROM flows),
dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE flow_no % 25 = 0)"""


def scored(t: Tables) -> DataFrame:
    e = t.table("events")
    predicted = (F.when(F.col("value") < 25, F.col("event_type")).when(F.col("value") < 60, "click")
                 .otherwise("scan"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "props",
                    F.col("event_type").alias("label"), "value",
                    F.least(F.col("value") / 100, F.lit(1.0)).alias("p"),
                    (F.col("event_type") == "error").cast("int").alias("y"),
                    (F.least(F.col("value") / 100, F.lit(1.0)) >= 0.5).cast("int").alias("yhat"),
                    predicted.alias("predicted"))


SCORED = """scored AS (SELECT event_id, ts, user_id, props, event_type AS label, value,
  least(value / 100, 1.0) AS p, CAST(event_type = 'error' AS INTEGER) AS y,
  CAST(least(value / 100, 1.0) >= 0.5 AS INTEGER) AS yhat,
  CASE WHEN value < 25 THEN event_type WHEN value < 60 THEN 'click' ELSE 'scan' END AS predicted FROM events)"""


def multiclass(t: Tables) -> DataFrame:
    """Scored rows with four class probabilities; class 0 is benign."""
    s = scored(t)
    spread = [F.lit(0.2), F.col("p"), F.col("p") * F.pmod(F.col("user_id"), F.lit(4)) / 4.0,
              F.col("p") * F.pmod(F.col("event_id"), F.lit(8)) / 8.0]
    return s.withColumn("probs", F.array(*[c.cast("double") for c in spread])).withColumn(
        "cls", F.when(F.col("y") == 1, F.pmod("event_id", F.lit(3)).cast("int") + 1).otherwise(0))


MULTICLASS = """multiclass AS (SELECT *, CAST(0.2 AS DOUBLE) AS p0, p AS p1, p * (user_id % 4) / 4.0 AS p2,
  p * (event_id % 8) / 8.0 AS p3, CAST(CASE WHEN y = 1 THEN event_id % 3 + 1 ELSE 0 END AS INTEGER) AS cls FROM scored)"""


def with_stage_times(df: DataFrame) -> DataFrame:
    def later(ts: Column, millis: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(ts) + millis * 1000)

    staged = df.withColumn("ingest_ts", F.col("ts")).withColumn(
        "detect_ts", later(F.col("ts"), F.col("event_id") % 997))
    return staged.withColumn("write_ts", later(F.col("detect_ts"), F.col("event_id") % 389))


def incidents_of(s: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows = s.filter(F.col("p") >= threshold).select(
        "event_id", "ts", F.when(F.col("user_id") % 17 != 0, F.concat(
            F.lit("10.0.0."), F.col("user_id").cast("string"))).alias("source_ip"),
        F.concat(F.lit("172.16.0."), (F.col("event_id") % 16).cast("string")).alias("destination_ip"),
        F.get_json_object("props", "$.k").cast("int").alias("target_port"),
        F.col("label").alias("threat_classification"), F.col("p").alias("confidence"),
        F.concat(F.lit("run_"), (F.col("event_id") % 5).cast("string")).alias("benchmark_run_id"),
        F.lit("baseline").alias("benchmark_profile"))
    return with_stage_times(rows)


def incidents(t: Tables) -> DataFrame:
    return incidents_of(scored(t))


INCIDENTS = f"""incidents AS (SELECT *, detect_ts + to_milliseconds(CAST(event_id % 389 AS BIGINT)) AS write_ts FROM (
  SELECT event_id, ts, CASE WHEN user_id % 17 <> 0 THEN '10.0.0.' || CAST(user_id AS VARCHAR) END AS source_ip,
  '172.16.0.' || CAST(event_id % 16 AS VARCHAR) AS destination_ip,
  CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS target_port, label AS threat_classification,
  p AS confidence, 'run_' || CAST(event_id % 5 AS VARCHAR) AS benchmark_run_id, 'baseline' AS benchmark_profile,
  ts AS ingest_ts, ts + to_milliseconds(CAST(event_id % 997 AS BIGINT)) AS detect_ts
  FROM scored WHERE p >= {THRESHOLD}))"""

# Report kinds stand for event types.
KINDS = {"error": "xgb_feature_set_ablation", "click": "benchmark_baseline", "view": "pca_full_comparison",
         "purchase": "multiclass_eval", "signup": "hybrid_xgb_eval"}


def reports(t: Tables) -> DataFrame:
    e = t.table("events")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    v = F.least(F.col("value") / 100, F.lit(1.0))
    ablation = F.struct(
        F.col("event_id").alias("train_rows"), F.lit("combo_targeted10_pca25").alias("best_by_f1_attack"),
        F.array(*[F.struct(F.lit(n).alias("name"), (v * a).alias("precision_attack"), (v * b).alias("recall_attack"),
                           (v * c).alias("f1_attack"), F.lit(0.05).alias("selected_threshold"))
                  for n, a, b, c in (("only_targeted10", 0.5, 0.5, 0.5), ("combo_targeted10_pca25", 1.0, 0.75, 0.25))]
                ).alias("results"))
    bench = F.struct(F.lit("node").alias("host"), F.col("value").alias("max_profile_eps"),
                     F.lit("consumer_bound").alias("bottleneck_hint"),
                     F.array(F.struct(F.lit("low").alias("profile"), F.col("event_id").alias("rows"),
                                      F.col("value").alias("producer_eps"),
                                      (F.col("value") * 0.5).alias("consumer_processed_rate_eps"))).alias("profiles"))
    pca = F.struct(F.lit(78).alias("feature_count"), F.col("event_id").alias("total_rows_available"),
                   F.array(F.struct(F.lit("fast").alias("preset"), (F.col("event_id") % 30).cast("int").alias("k95"),
                                    (F.col("event_id") % 40).cast("int").alias("k99"),
                                    F.col("value").alias("total_s"))).alias("results"))
    multi = F.struct(F.array(F.lit("BENIGN"), F.lit("DDoS")).alias("labels_evaluated"),
                     F.struct((F.col("value") > 50).alias("pass")).alias("gate_result"))
    other = F.struct(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("run_timestamp"), v.alias("f1_attack"))
    payload = (F.when(F.col("event_type") == "error", F.to_json(ablation))
               .when(F.col("event_type") == "click", F.to_json(bench))
               .when(F.col("event_type") == "view", F.to_json(pca))
               .when(F.col("event_type") == "purchase", F.to_json(multi)).otherwise(F.to_json(other)))
    return e.select(kind.alias("prefix"), F.concat(
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 12, "0")
    ).alias("run_ts"), payload.alias("payload"), "event_id", "value")


_KIND_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())
REPORTS = f"""reports AS (SELECT CASE event_type {_KIND_SQL} END AS prefix,
  strftime(ts, '%Y%m%dT%H%M%SZ') || '_' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_ts,
  event_id, value, least(value / 100, 1.0) AS v FROM events)"""


def params(t: Tables) -> DataFrame:
    keys = ["classification_threshold", "pca_k", "pca_variance_retained", "scale_pos_weight",
            "multiclass_recall_attack"]
    e = t.table("events")
    name = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("event_id") % len(keys)).cast("int") + 1)
    return e.select(name.alias("key"), F.col("value"), F.concat(
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"),
        F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_ts"))


PARAMS = """params AS (SELECT CASE event_id % 5 WHEN 0 THEN 'classification_threshold' WHEN 1 THEN 'pca_k'
  WHEN 2 THEN 'pca_variance_retained' WHEN 3 THEN 'scale_pos_weight' ELSE 'multiclass_recall_attack' END AS key, value,
  strftime(ts, '%Y%m%dT%H%M%SZ') || '_' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_ts FROM events)"""

"""Cleaning, scalar functions and table maintenance on the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import functions as fn
from flowlens.contract import telemetry_schema
from flowlens.functions.times import iso_utc
from flowlens.functions.values import to_number
from flowlens.operators import clean, incidents as ops, split
from flowlens.plans import adapters as a
from flowlens.plans.registry import Tables, naive, query, rounded
from flowlens.sources import flows as flow_files, store, telemetry

D = (a.FLOWS, a.DIRTY)
NUM_SQL = r"""CASE WHEN regexp_full_match(trim({0}), '[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)')
  THEN try_cast(trim({0}) AS DOUBLE) END"""
LABEL_SQL = "replace(replace(trim({0}), chr(65533), '-'), 'Web Attack -', 'Web Attack')"
FIN_SQL = "CASE WHEN isnan({0}) OR isinf({0}) THEN NULL ELSE {0} END"


# --- messages, incidents, reports and parameters -----------------------------------------

def _messages(t: Tables) -> DataFrame:
    """Telemetry messages made of events; some values are quoted, some payloads are broken."""
    e = t.table("events")
    no = F.col("event_id")
    quoted = F.concat(F.lit('{"Flow Duration": "'), F.col("value").cast("string"),
                      F.lit('", "source_ip": "10.0.0.'), F.col("user_id").cast("string"), F.lit('"}'))
    plain = F.concat(F.lit('{"Flow Duration": '), F.col("value").cast("string"),
                     F.lit(', "source_ip": "10.0.0.'), F.col("user_id").cast("string"), F.lit('"}'))
    text = F.when(no % 10 == 0, "not json").when(no % 10 == 1, quoted).otherwise(plain)
    return e.select((no % 8).cast("int").alias("partition"), no.alias("offset"), text.cast("binary").alias("value"))


_MSG_SQL = """messages AS (SELECT CAST(event_id % 8 AS INTEGER) AS part, event_id AS off, value, user_id,
  event_id % 10 = 0 AS broken, event_id % 10 = 1 AS quoted FROM events)"""


@query("a06_parse_payload", """SELECT part AS "partition", off AS "offset", broken AS parse_failed,
  CASE WHEN NOT broken AND NOT quoted THEN value END AS strict_duration,
  CASE WHEN NOT broken THEN value END AS lenient_duration,
  CASE WHEN NOT broken THEN '10.0.0.' || CAST(user_id AS VARCHAR) END AS source_ip FROM messages""", (_MSG_SQL,))
def parse_payload(t: Tables) -> DataFrame:
    schema = T.StructType([T.StructField("Flow Duration", T.DoubleType()), T.StructField("source_ip", T.StringType())])
    strict = telemetry.parse_payload(_messages(t), schema, keep=("partition", "offset", "value"))
    both = telemetry.parse_payload(strict.select("partition", "offset", "value", F.col("Flow_Duration").alias("strict")),
                                   schema, lenient=True, keep=("partition", "offset", "strict"))
    return both.select("partition", "offset", "parse_failed", F.col("strict").alias("strict_duration"),
                       F.col("Flow_Duration").alias("lenient_duration"), "source_ip")


@query("a06_parse_failures", """SELECT count(*) AS raw_rows, count(*) FILTER (WHERE NOT broken) AS parsed_rows,
  count(*) FILTER (WHERE broken) AS parse_failures FROM messages""", (_MSG_SQL,))
def parse_failures(t: Tables) -> DataFrame:
    return telemetry.parse_failures(telemetry.parse_payload(_messages(t), telemetry_schema(["Flow Duration"])))


@query("a05_replay_messages", """SELECT CASE WHEN trim(src_text) <> '' THEN src_text
    WHEN contains(flow_id, '-') THEN split_part(trim(flow_id), '-', 1)
    ELSE '10.10.' || CAST(CAST('0x' || substr(s, 1, 2) AS INTEGER) % 254 + 1 AS VARCHAR) || '.'
      || CAST(CAST('0x' || substr(s, 3, 2) AS INTEGER) % 254 + 1 AS VARCHAR) END AS source_ip, count(*) AS n
  FROM (SELECT *, sha1('src|' || row_key || '|None') AS s FROM dirty) GROUP BY 1""", D)
def replay_messages(t: Tables) -> DataFrame:
    d = a.dirty(t).withColumnsRenamed({"src_text": "Source IP", "flow_id": "Flow ID"})
    messages = telemetry.replay_messages(d, "row_key", F.lit(a.NOW).cast("timestamp"))
    return messages.groupBy(F.col("key").cast("string").alias("source_ip")).agg(F.count(F.lit(1)).alias("n"))


@query("a09_expire", f"""SELECT event_id FROM incidents
  WHERE ts >= TIMESTAMP '{a.NOW}' - INTERVAL 10 DAY""", (a.SCORED, a.INCIDENTS))
def expire(t: Tables) -> DataFrame:
    return store.expire(a.incidents(t), "ts", a.now(), 10).select("event_id")


@query("a11_latest_report", """SELECT prefix, max(run_ts) AS run_ts, arg_max(event_id, run_ts) AS event_id
  FROM reports GROUP BY prefix""", (a.REPORTS,))
def latest_report(t: Tables) -> DataFrame:
    newest = store.latest_report(a.reports(t))
    return newest.select("prefix", "run_ts", F.split("run_ts", "_")[1].cast("bigint").alias("event_id"))


@query("a12_lag_history", """SELECT event_id, user_id AS consumer_lag_messages FROM (
  SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 300)""")
def lag_history(t: Tables) -> DataFrame:
    points = t.table("events").select("event_id", "ts", F.col("user_id").alias("consumer_lag_messages"))
    return split.tail(points, "ts", 300).select("event_id", "consumer_lag_messages")


@query("a13_params", """SELECT key, arg_max(value, run_ts) AS value, max(run_ts) AS run_ts
  FROM params GROUP BY key""", (a.PARAMS,))
def params(t: Tables) -> DataFrame:
    return store.get_params(a.params(t))


@query("a08_latest_campaigns", """SELECT user_id, arg_max(event_id, event_id) AS event_id,
  arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def latest_rows(t: Tables) -> DataFrame:
    return store.latest_rows(t.table("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("a02_manifest", """SELECT name, EXISTS (SELECT 1 FROM flows f WHERE lower(f.source_file) = lower(m.name)) AS present
  FROM (SELECT DISTINCT 'YEAR_' || CAST(year(o_orderdate) + 2 AS VARCHAR) || '.csv' AS name FROM orders) m""", (a.FLOWS,))
def manifest(t: Tables) -> DataFrame:
    expected = t.table("orders").select(F.concat(
        F.lit("YEAR_"), (F.year("o_orderdate") + 2).cast("string"), F.lit(".csv")).alias("name")).distinct()
    return flow_files.manifest(expected, a.flows(t).select(F.col("source_file").alias("name")))


# --- names, labels, numbers --------------------------------------------------------------

@query("b01_safe_columns", """SELECT row_key, flow_duration AS Flow_Duration, flow_bytes_s AS Flow_Bytes_s,
  total_fwd_packets AS Fwd_Pkts_Max FROM flows""", (a.FLOWS,))
def safe_columns(t: Tables) -> DataFrame:
    f = a.flows(t).select("row_key", F.col("flow_duration").alias(" Flow Duration"),
                          F.col("flow_bytes_s").alias("Flow Bytes/s"), F.col("total_fwd_packets").alias("Fwd.Pkts-Max "))
    return clean.safe_columns(f)[0]


@query("b02_normalize_label", f"SELECT {LABEL_SQL.format('label')} AS label, count(*) AS n FROM dirty GROUP BY 1", D)
def normalize_label(t: Tables) -> DataFrame:
    return a.dirty(t).groupBy(fn.normalize_label(F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("b03_coerce_numeric", f"""SELECT sum(num) AS total, count(num) AS parsed, (SELECT count(*) FROM dirty
    WHERE flow_bytes_s IS NOT NULL AND ({NUM_SQL.format('flow_bytes_s')}) IS NULL) AS null_increase
  FROM (SELECT round(x, 2) AS num FROM (SELECT {NUM_SQL.format('flow_bytes_s')} AS x FROM dirty) WHERE NOT isinf(x))""", D)
def coerce_numeric(t: Tables) -> DataFrame:
    coerced, report = clean.coerce_numeric(a.dirty(t).select("flow_bytes_s"), ["flow_bytes_s"])
    num = F.round(fn.finite(F.col("flow_bytes_s")), 2)
    gained = report.select("null_increase").scalar()
    return rounded(coerced.agg(F.sum(num).alias("total"), F.count(num).alias("parsed")).select(
        "total", "parsed", gained.alias("null_increase")), "total", digits=2)


@query("b04_numeric_share", f"""SELECT unnest(['flow_bytes_s', 'flow_id', 'flow_duration', 'cwe_flag_count']) AS feature,
  unnest([avg(CAST(({NUM_SQL.format('flow_bytes_s')}) IS NOT NULL AS INTEGER)), avg(CAST(({NUM_SQL.format('flow_id')})
    IS NOT NULL AS INTEGER)), avg(CAST(flow_duration IS NOT NULL AND NOT isnan(flow_duration) AS INTEGER)), 0.0]) AS share
  FROM dirty""", D)
def numeric_share(t: Tables) -> DataFrame:
    return clean.numeric_share(a.dirty(t).select("flow_bytes_s", "flow_id", "flow_duration", "cwe_flag_count"))


@query("b05_finite", f"SELECT row_key, {FIN_SQL.format('flow_duration')} AS flow_duration FROM dirty", D)
def finite(t: Tables) -> DataFrame:
    return clean.finite_columns(a.dirty(t).select("row_key", "flow_duration"), ["flow_duration"])


@query("b07_binary_target", f"""SELECT label, CAST(coalesce(label, '') <> 'BENIGN' AS INTEGER) AS target, count(*) AS n
  FROM (SELECT {LABEL_SQL.format('label')} AS label FROM dirty) GROUP BY ALL""", D)
def binary_target(t: Tables) -> DataFrame:
    d = a.dirty(t).select(fn.normalize_label(F.col("label")).alias("label"))
    return d.groupBy("label", fn.binary_target(F.col("label")).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("b08_index_labels", """SELECT label, CAST(code AS INTEGER) AS code, count(*) AS n FROM flows LEFT JOIN (
  SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM flows
  WHERE ts < TIMESTAMP '2000-01-01' GROUP BY label) USING (label) GROUP BY ALL""", (a.FLOWS,))
def index_labels(t: Tables) -> DataFrame:
    f = a.flows(t)
    codes = clean.label_codes(f.filter(~a.is_validation()), "label")
    return clean.with_codes(f, "label", codes, "code").groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"))


@query("b09_attack_group", f"""SELECT CASE l WHEN 'BENIGN' THEN 'Normal Traffic' WHEN 'DoS Hulk' THEN 'DoS'
  WHEN 'DDoS' THEN 'DDoS' WHEN 'PortScan' THEN 'Port Scanning' WHEN 'Bot' THEN 'Bots' WHEN 'Infiltration' THEN 'Infiltration'
  WHEN 'Web Attack Brute Force' THEN 'Web Attacks' WHEN 'Web Attack XSS' THEN 'Web Attacks' END AS attack_type, count(*) AS n
  FROM (SELECT {LABEL_SQL.format('label')} AS l FROM dirty) GROUP BY 1""", D)
def attack_group(t: Tables) -> DataFrame:
    group = fn.attack_group(fn.normalize_label(F.col("label")))
    return a.dirty(t).groupBy(group.alias("attack_type")).agg(F.count(F.lit(1)).alias("n"))


@query("b10_drop_classes", f"""SELECT count(*) AS n FROM (SELECT {LABEL_SQL.format('label')} AS l FROM dirty)
  WHERE l IS NULL OR l <> 'Infiltration'""", D)
def drop_classes(t: Tables) -> DataFrame:
    grouped = a.dirty(t).select(fn.attack_group(fn.normalize_label(F.col("label"))).alias("attack_type"))
    return clean.drop_classes(grouped, "attack_type").agg(F.count(F.lit(1)).alias("n"))


@query("b11_drop_incomplete", f"""SELECT row_key FROM dirty WHERE label IS NOT NULL
  AND ({FIN_SQL.format('flow_duration')}) IS NOT NULL AND flow_id IS NOT NULL""", D)
def drop_incomplete(t: Tables) -> DataFrame:
    d = clean.finite_columns(a.dirty(t).select("row_key", "label", "flow_duration", "flow_id"), ["flow_duration"])
    return clean.drop_incomplete(d).select("row_key")


@query("b12_constant_columns", """SELECT unnest(['total_fwd_packets', 'bwd_psh_flags', 'cwe_flag_count', 'src_text']) AS feature,
  unnest([count(DISTINCT total_fwd_packets) + max(CAST(total_fwd_packets IS NULL AS INTEGER)) = 1,
    count(DISTINCT bwd_psh_flags) + max(CAST(bwd_psh_flags IS NULL AS INTEGER)) = 1,
    count(DISTINCT cwe_flag_count) + max(CAST(cwe_flag_count IS NULL AS INTEGER)) = 1,
    count(DISTINCT src_text) + max(CAST(src_text IS NULL AS INTEGER)) = 1]) AS is_constant FROM dirty""", D)
def constant_columns(t: Tables) -> DataFrame:
    columns = ["total_fwd_packets", "bwd_psh_flags", "cwe_flag_count", "src_text"]
    return clean.constant_profile(a.dirty(t), columns)


@query("b13_identical_columns", """SELECT 'total_fwd_packets' AS first_column, 'subflow_fwd_packets' AS same_column
  FROM dirty HAVING count(*) FILTER (WHERE total_fwd_packets IS DISTINCT FROM subflow_fwd_packets) = 0""", D)
def identical_columns(t: Tables) -> DataFrame:
    same = clean.identical_columns(a.dirty(t).select(*a.DIRTY_NUMERIC))
    return t.spark.createDataFrame([(k, v) for k, vs in same.items() for v in vs],
                                   "first_column string, same_column string")


@query("b17_file_filter", "SELECT source_file, count(*) AS n FROM flows WHERE contains(lower(source_file), 'year_2000') GROUP BY 1",
       (a.FLOWS,))
def file_filter(t: Tables) -> DataFrame:
    return flow_files.file_counts(clean.file_contains(a.flows(t), "Year_2000"))


@query("b18_recent", f"SELECT event_id FROM incidents WHERE ts >= TIMESTAMP '{a.NOW}' - INTERVAL 3000 MINUTE",
       (a.SCORED, a.INCIDENTS))
def recent(t: Tables) -> DataFrame:
    return ops.recent_rows(a.incidents(t), a.now(), 3000).select("event_id")


@query("b19_threats", "SELECT event_id, p FROM scored WHERE p >= 0.29", (a.SCORED,))
def threats(t: Tables) -> DataFrame:
    return ops.threats(a.scored(t), 0.29, "p").select("event_id", "p")


@query("b21_to_incident", """SELECT threat_classification, benchmark_run_id AS run_id, destination_ip, count(*) AS n,
  round(sum(confidence), 6) AS confidence, round(sum(date_diff('microsecond', ingest_ts, write_ts) / 1000.0), 3) AS ms,
  round(sum(confidence * 2), 6) AS feature_sum, min(detect_ts) AS first_seen FROM incidents GROUP BY ALL""",
       (a.SCORED, a.INCIDENTS))
def to_incident(t: Tables) -> DataFrame:
    rows = a.incidents(t).withColumn("Double Confidence", F.col("confidence") * 2)
    docs = ops.to_incident(rows, ["Double Confidence"], a.THRESHOLD)
    out = docs.groupBy("threat_classification", F.col("benchmark.run_id").alias("run_id"),
                       F.col("network_identifiers.destination_ip").alias("destination_ip")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"),
        F.sum("latency_ingest_to_write_ms").alias("ms"),
        F.sum(F.col("features")["Double Confidence"]).alias("feature_sum"), F.min("timestamp").alias("first_seen"))
    return naive(rounded(rounded(out, "confidence", "feature_sum"), "ms", digits=3), "first_seen")


@query("b22_clean_documents", """SELECT coalesce(source_ip, 'unknown') AS source_ip, count(*) AS n
  FROM incidents GROUP BY 1""", (a.SCORED, a.INCIDENTS))
def clean_documents(t: Tables) -> DataFrame:
    docs = a.incidents(t).withColumn("_id", F.col("event_id"))
    filled = clean.clean_documents(docs, {"source_ip": "unknown", "threat_classification": "malicious", "confidence": 0.0})
    return filled.groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"))


@query("b24_one_hot", """SELECT CAST(sum(CAST(label = 'Bot' AS INTEGER)) AS BIGINT) AS label_Bot,
  CAST(sum(CAST(label = 'DDoS' AS INTEGER)) AS BIGINT) AS label_DDoS,
  CAST(sum(CAST(label = 'DoS Hulk' AS INTEGER)) AS BIGINT) AS label_DoS_Hulk,
  CAST(sum(CAST(label = 'PortScan' AS INTEGER)) AS BIGINT) AS label_PortScan FROM flows""", (a.FLOWS,))
def one_hot(t: Tables) -> DataFrame:
    hot = clean.one_hot(a.flows(t).select("label"), "label")
    return hot.agg(*[F.sum(c).alias(c) for c in hot.columns if c != "label"])


@query("b06_drop_identifiers", "SELECT flow_no, label FROM flows", (a.FLOWS,))
def drop_identifiers(t: Tables) -> DataFrame:
    f = a.flows(t).select("flow_no", "label", F.col("row_key").alias("Flow ID"), F.col("ts").alias("Timestamp"))
    return clean.assert_no_leak(clean.drop_identifiers(f))


# --- scalar functions --------------------------------------------------------------------

@query("h01_pick", """SELECT row_key, CASE WHEN trim(src_text) <> '' THEN src_text WHEN trim(flow_id) <> '' THEN flow_id END
  AS picked FROM dirty""", D)
def pick(t: Tables) -> DataFrame:
    return a.dirty(t).select("row_key", fn.pick(F.col("src_text"), F.col("flow_id")).alias("picked"))


@query("h02_ips_from_flow_id", """SELECT CASE WHEN contains(flow_id, '-') THEN split_part(trim(flow_id), '-', 1) END AS src,
  CASE WHEN contains(flow_id, '-') THEN split_part(trim(flow_id), '-', 2) END AS dst, count(*) AS n FROM dirty GROUP BY ALL""", D)
def ips_from_flow_id(t: Tables) -> DataFrame:
    src, dst = fn.ips_from_flow_id(F.col("flow_id"))
    return a.dirty(t).groupBy(src.alias("src"), dst.alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query("h03_synthetic_ip", """SELECT event_id, '10.10.' || CAST(CAST('0x' || substr(s, 1, 2) AS INTEGER) % 254 + 1 AS VARCHAR)
  || '.' || CAST(CAST('0x' || substr(s, 3, 2) AS INTEGER) % 254 + 1 AS VARCHAR) AS ip
  FROM (SELECT event_id, sha1('src|' || CAST(event_id AS VARCHAR) || '|80') AS s FROM events)""")
def synthetic_ip(t: Tables) -> DataFrame:
    seed = F.concat_ws("|", F.lit("src"), F.col("event_id").cast("string"), F.lit("80"))
    return t.table("events").select("event_id", fn.synthetic_ip(seed, "10.10").alias("ip"))


@query("h04_parse_iso", """SELECT row_key, CASE flow_no % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL
  WHEN 3 THEN ts - INTERVAL 2 HOUR ELSE ts END AS parsed FROM dirty""", D)
def parse_iso(t: Tables) -> DataFrame:
    return naive(a.dirty(t).select("row_key", fn.parse_iso(F.col("ts_text")).alias("parsed")), "parsed")


@query("h05_floor_window", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1""")
def floor_window(t: Tables) -> DataFrame:
    e = a.scored(t).groupBy(fn.floor_window(F.col("ts"), 5).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return naive(e, "start")


@query("h06_epoch_bucket", """SELECT epoch_ms(epoch_ms(ts) - epoch_ms(ts) % 420000) AS start, count(*) AS n
  FROM events GROUP BY 1""")
def epoch_bucket(t: Tables) -> DataFrame:
    e = a.scored(t).groupBy(fn.epoch_bucket(F.col("ts"), 420).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return naive(e, "start")


@query("h07_millis_between", """SELECT event_id, date_diff('microsecond', ingest_ts, detect_ts) / 1000.0 AS ms
  FROM incidents""", (a.SCORED, a.INCIDENTS))
def millis_between(t: Tables) -> DataFrame:
    return a.incidents(t).select("event_id", fn.millis_between(F.col("ingest_ts"), F.col("detect_ts")).alias("ms"))


@query("h08_key_hash", """SELECT event_id, substr(sha1(CAST(user_id AS VARCHAR) || '|' ||
  strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S+00:00')), 1, 16) AS id FROM events""")
def key_hash(t: Tables) -> DataFrame:
    return a.scored(t).select("event_id", fn.key_hash(
        F.col("user_id").cast("string"), iso_utc(F.date_trunc("hour", "ts"))).alias("id"))


@query("h09_text", """SELECT DISTINCT source_file, upper(split_part(source_file, '_', 2)) AS part,
  contains(lower(source_file), 'year') AS has_year FROM flows""", (a.FLOWS,))
def text(t: Tables) -> DataFrame:
    return a.flows(t).select("source_file").distinct().select(
        "source_file", F.upper(F.split("source_file", "_")[1]).alias("part"),
        F.lower("source_file").contains("year").alias("has_year"))


@query("h10_safe_ratio", """SELECT row_key, round(total_fwd_packets / greatest(flow_iat_mean, 1e-6), 3) AS ratio
  FROM flows""", (a.FLOWS,))
def safe_ratio(t: Tables) -> DataFrame:
    return rounded(a.flows(t).select("row_key", fn.safe_ratio(
        F.col("total_fwd_packets"), F.col("flow_iat_mean"), 1e-6).alias("ratio")), "ratio", digits=3)


@query("h11_masked_argmax", """SELECT event_id, greatest(p1, p2, p3) AS best,
  CAST(CASE WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS INTEGER) AS cls FROM multiclass""",
       (a.SCORED, a.MULTICLASS))
def masked_argmax(t: Tables) -> DataFrame:
    best, position = fn.masked_argmax(F.col("probs"), 0)
    return a.multiclass(t).select("event_id", best.alias("best"), position.alias("cls"))


@query("h12_json", """SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k,
  '{"p":' || CAST(value AS VARCHAR) || '}' AS doc FROM events""")
def json_values(t: Tables) -> DataFrame:
    features = F.map_from_arrays(F.array(F.lit("p")), F.array("value"))
    return t.table("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                                    F.to_json(features).alias("doc"))


@query("h13_round", "SELECT row_key, round(total_fwd_packets / 7, 3) AS rounded FROM flows", (a.FLOWS,))
def rounding(t: Tables) -> DataFrame:
    return a.flows(t).select("row_key", F.round(F.col("total_fwd_packets") / 7, 3).alias("rounded"))


@query("h15_risk_flags", """SELECT (syn_flag_count > 0 AND ack_flag_count = 0) AS syn_without_ack,
  (total_backward_packets >= 0.5 * greatest(total_fwd_packets, 1.0)) AS reply_heavy, (flow_duration < 5000) AS near_zero,
  count(*) AS n FROM flows GROUP BY ALL""", (a.FLOWS,))
def risk_flags(t: Tables) -> DataFrame:
    flags = fn.risk_flags(F.col("syn_flag_count"), F.col("ack_flag_count"), F.col("total_fwd_packets"),
                          F.col("total_backward_packets"), F.col("flow_duration"), imbalance=0.5, short=5000.0)
    return a.flows(t).select(flags.alias("f")).groupBy(
        "f.syn_without_ack", "f.reply_heavy", F.col("f.near_zero_duration").alias("near_zero")).agg(
        F.count(F.lit(1)).alias("n"))

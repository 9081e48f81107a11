import json
import time

import pytest
from pyspark.sql import functions as F

from flowlens.contract import telemetry_schema
from flowlens.operators import incidents as ops
from flowlens.sources import flows, store, telemetry
from flowlens.streaming import jobs

SCHEMA = "id int, ts timestamp, source_ip string, threat_classification string, confidence double"


def put(spark, folder, rows):
    spark.createDataFrame(rows, "id int, ts string, source_ip string, threat_classification string, confidence double"
                          ).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return jobs.stream_session(spark, 2).readStream.schema(SCHEMA).parquet(folder)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_campaigns_late_rows_and_restart(spark, folder):
    src, table, checkpoint = f"{folder}/in", f"{folder}/table", f"{folder}/cp"

    def drain():
        live = jobs.campaign_stream(stream(spark, src), "5 minutes", None, 2, "10 minutes")
        query = jobs.append_campaigns(live, table, checkpoint, None)
        run(query)
        return sum(r["dropped_late"] for r in jobs.progress_rows(query))

    put(spark, src, [(1, "2024-01-01 00:01:00", "a", "x", 0.5), (2, "2024-01-01 00:20:00", "a", "x", 0.5)])
    drain()
    # On time for its window: the watermark is at 00:10, so 00:01 is late and 00:21 is not.
    put(spark, src, [(3, "2024-01-01 00:02:00", "a", "y", 0.5), (4, "2024-01-01 00:21:00", "a", "y", 1.0),
                     (5, "2024-01-01 01:00:00", "b", "z", 1.0)])
    dropped = drain()
    out = spark.read.parquet(table).collect()
    assert [(r["attacker_ip"], r["aggregated_events"], r["confidence_score"], r["first_type"], r["threat_types"])
            for r in out] == [("a", 2, 0.75, "x", ["x", "y"])]
    assert dropped == 1
    drain()
    assert spark.read.parquet(table).count() == 1


def test_update_stream_equals_batch(spark, folder):
    src = f"{folder}/in"
    rows = [(i, f"2024-01-01 0{i % 4}:{(i * 7) % 60:02d}:00", f"ip{i % 3}", f"k{i % 5 % 2}", i / 100) for i in range(60)]
    put(spark, src, rows[:30])
    put(spark, src, rows[30:])
    session = jobs.stream_session(spark, 2)
    source = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    run(jobs.upsert_campaigns(jobs.campaign_stream(source, "1 hour", "30 minutes", 2, "1 day"),
                              f"{folder}/table", f"{folder}/cp", None))
    columns = ["campaign_id", "aggregated_events", F.round("confidence_score", 9), "threat_classification"]
    got = store.read_table(spark, f"{folder}/table").select(*columns).collect()
    want = ops.campaigns(spark.read.parquet(src), "1 hour", "30 minutes", 2).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_upsert_replay(spark, folder):
    def rows(*r):
        return spark.createDataFrame(list(r), "k string, n int, at string").withColumn("at", F.col("at").cast("timestamp"))

    table = f"{folder}/t"
    store.upsert(rows(("a", 1, "2024-01-01"), ("b", 1, "2024-01-02")), table, "k", "n", "at")
    for _ in range(2):
        store.upsert(rows(("a", 5, "2024-01-01"), ("c", 2, "2024-01-01")), table, "k", "n", "at")
    got = sorted((r["k"], r["n"]) for r in store.read_table(spark, table).collect())
    assert got == [("a", 5), ("b", 1), ("c", 2)]


def test_incident_batch_is_replaced_not_repeated(spark, folder):
    scored = spark.createDataFrame([(0.5, 1.0), (0.4999, 2.0), (0.9, None)], "p double, bytes double")
    write = jobs.incident_writer(f"{folder}/inc", f"{folder}/met", 0.5, ["bytes"])
    for _ in range(2):
        write(scored, 7)
    docs = store.read_incidents(spark, f"{folder}/inc")
    assert docs.count() == 2 and docs.select("threat_classification").distinct().first()[0] == "malicious"
    row = spark.read.parquet(f"{folder}/met").collect()
    assert len(row) == 1 and (row[0]["rows"], row[0]["threats"], row[0]["batch_id"]) == (3, 2, 7)


def test_stamps_follow_the_work(spark, folder, monkeypatch):
    @F.udf("double")
    def slow(x):
        time.sleep(2)
        return x

    failures = [OSError("first write fails")]
    plain = jobs.write_incidents

    def flaky(*args, **more):
        if failures:
            raise failures.pop()
        time.sleep(1)
        plain(*args, **more)

    monkeypatch.setattr(jobs, "write_incidents", flaky)
    scored = spark.createDataFrame([(0.5, 1.0)], "p double, bytes double").coalesce(1).withColumn("p", slow("p"))
    jobs.incident_writer(f"{folder}/inc", f"{folder}/met", 0.5, ["bytes"])(scored, 1)
    row = spark.read.parquet(f"{folder}/met").first()
    assert row["ingest_to_detect_ms_p95"] >= 2000 and row["detect_to_write_ms"] >= 1000 and row["write_errors"] == 1
    assert row["ingest_to_write_ms_p95"] >= 3000 and row["stage_ms"]["score"] >= 2000
    assert store.read_incidents(spark, f"{folder}/inc").first()["latency_ingest_to_detect_ms"] >= 2000


def test_duplicate_messages(spark, folder):
    rows = [(0, 1, "2024-01-01 00:00:00"), (0, 1, "2024-01-01 00:00:01"), (1, 1, "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "partition int, offset long, t string").withColumn(
        "t", F.col("t").cast("timestamp")).write.parquet(f"{folder}/in")
    source = jobs.stream_session(spark, 2).readStream.schema("partition int, offset long, t timestamp").parquet(f"{folder}/in")
    run(jobs.append_campaigns(jobs.unique_messages(source, "t"), f"{folder}/out", f"{folder}/cp", None))
    assert spark.read.parquet(f"{folder}/out").count() == 2


def test_replay_parse_score(spark, folder):
    flow = spark.createDataFrame([(1, 80.0, "1.1.1.1-2.2.2.2-80", None), (2, 22.0, None, "9.9.9.9"), (3, 53.0, "x", " ")],
                                 "row long, `Destination Port` double, `Flow ID` string, `Source IP` string")
    messages = telemetry.with_offsets(telemetry.replay_messages(flow, "row", F.lit("2024-01-01").cast("timestamp"), run_id="r1"))
    telemetry.replay_to_topic(messages, f"{folder}/topic", "parquet")
    source = telemetry.read_telemetry(jobs.stream_session(spark, 2), f"{folder}/topic", "parquet", rate_per_second=10)
    parsed = telemetry.parse_payload(source, telemetry_schema(["Destination Port"]))
    assert parsed.isStreaming
    query = parsed.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    run(query)
    rows = {r["Destination_Port"]: r for r in spark.read.parquet(f"{folder}/out").collect()}
    assert (rows[80.0]["source_ip"], rows[80.0]["destination_ip"]) == ("1.1.1.1", "2.2.2.2")
    assert rows[22.0]["source_ip"] == "9.9.9.9" and rows[22.0]["destination_ip"].startswith("172.16.")
    assert rows[53.0]["source_ip"].startswith("10.10.") and rows[53.0]["benchmark_run_id"] == "r1"


def test_payload_edges(spark):
    texts = ['{"a": 1}', '{"a": "80"}', '{"a": ""}', "junk", '{"a": NaN}', "[1]", None, '{"a": 1', '{}']
    df = spark.createDataFrame([(0, i, t.encode() if t is not None else None) for i, t in enumerate(texts)],
                               "partition int, offset long, value binary")
    strict = telemetry.parse_payload(df, telemetry_schema(["a"])).orderBy("offset").collect()
    lenient = telemetry.parse_payload(df, telemetry_schema(["a"]), lenient=True).orderBy("offset").collect()
    assert [r["parse_failed"] for r in strict] == [False, False, False, True, False, True, True, True, False]
    assert strict[0]["a"] == 1.0 and strict[1]["a"] is None and lenient[1]["a"] == 80.0 and lenient[2]["a"] is None


def test_flow_files(spark, folder):
    with open(f"{folder}/Monday.csv", "w") as f:
        f.write(" Flow Duration, Label\n1,BENIGN\n2,DDoS\n")
    with open(f"{folder}/Friday.csv", "w") as f:
        f.write(" Label, Flow Duration, Extra\nBot,3,x\n")
    df, missing = flows.read_flows(spark, [f"{folder}/Monday.csv", f"{folder}/Friday.csv", f"{folder}/none.csv"])
    assert missing == [f"{folder}/none.csv"] and set(df.columns) == {"Flow Duration", "Label", "Extra", "source_file"}
    assert {(r["Flow Duration"].strip(), r["Label"], r["source_file"]) for r in df.collect()} == {
        ("1", "BENIGN", "Monday.csv"), ("2", "DDoS", "Monday.csv"), ("3", "Bot", "Friday.csv")}
    expected = spark.createDataFrame([("MONDAY.csv",), ("Sunday.csv",)], "name string")
    found = {r["name"]: r["present"] for r in flows.manifest(expected, flows.list_files(spark, folder)).collect()}
    assert found == {"MONDAY.csv": True, "Sunday.csv": False}
    assert flows.read_flows(spark, [f"{folder}/none.csv"]) == (None, [f"{folder}/none.csv"])
    flows.write_csv(df, f"{folder}/csv")
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 3


def test_reports_params_lines_seed(spark, folder):
    one = spark.createDataFrame([(0.5,)], "f1 double")
    for stamp in ("20240101T000000Z", "20240102T000000Z"):
        store.append_report(one.withColumn("stamp", F.lit(stamp)), f"{folder}/rep", "eval", stamp)
    newest = store.latest_report(store.read_reports(spark, f"{folder}/rep"), "eval").first()
    assert newest["run_ts"] == "20240102T000000Z" and json.loads(newest["payload"])["stamp"] == "20240102T000000Z"
    schema = "key string, value double, run_ts string"
    store.put_params(spark.createDataFrame([("k", 1.0, "1"), ("z", 3.0, "1")], schema), f"{folder}/par")
    store.put_params(spark.createDataFrame([("k", 2.0, "2")], schema), f"{folder}/par")
    assert store.param_values(spark.read.parquet(f"{folder}/par"), ["k", "z"]) == {"k": 2.0, "z": 3.0}
    with open(f"{folder}/lag.jsonl", "w") as f:
        f.write('{"t": 1}\nnot json\n{"t": 2}\n')
    assert store.read_lines(spark, f"{folder}/lag.jsonl", "t int").count() == 2
    with open(f"{folder}/seed.json", "w") as f:
        json.dump([{"a": 1}, {"a": 2}], f)
    for _ in range(2):
        assert flows.seed(spark, [f"{folder}/seed.json"], f"{folder}/coll").count() == 2


@pytest.mark.parametrize("days, kept", [(30, 1), (60, 2)])
def test_retention(spark, days, kept):
    df = spark.createDataFrame([("2024-01-01",), ("2024-02-01",)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    assert store.expire(df, "t", F.lit("2024-02-15").cast("timestamp"), days).count() == kept

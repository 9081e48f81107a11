"""Intake caps, progress logs, headers, latency sketches, codes for many classes."""

import time

import pytest
from pyspark.sql import functions as F

from flowlens.operators import clean, incidents, split
from flowlens.sources import flows, telemetry
from flowlens.streaming import jobs
from flowlens.streaming.progress import ProgressLog, lag_history, progress_log


def messages(spark, low, high):
    return spark.range(low, high).select((F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("offset"),
                                         F.lit(b"k").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))


def test_no_trigger_takes_more_events_than_the_cap(spark, folder):
    for low, high in ((0, 333), (333, 400)):
        telemetry.replay_to_topic(messages(spark, low, high).repartition(3), f"{folder}/raw", "parquet")
        telemetry.refile(jobs.stream_session(spark, 2), f"{folder}/raw", f"{folder}/topic", f"{folder}/cp0", 10).awaitTermination()
    telemetry.replay_to_topic(messages(spark, 0, 67).coalesce(1), f"{folder}/small", "parquet", events_per_file=10)
    sizes = spark.read.parquet(f"{folder}/small").groupBy("_metadata.file_path").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert tuple(sizes) == (10, 7)
    seen = []

    def start(stop_after):
        source = telemetry.read_telemetry(jobs.stream_session(spark, 2), f"{folder}/topic", "parquet", rate_per_second=15, trigger_seconds=2,
                                          events_per_file=10)

        def take(batch, batch_id):
            rows = [r["offset"] for r in batch.select("offset").collect()]
            if len(seen) == stop_after:
                raise RuntimeError("gone")
            seen.append((batch_id, rows))
        query = source.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001
            pass
    start(4)
    start(-1)
    assert max(len(rows) for _, rows in seen) <= 30, seen
    assert sum(len(rows) for _, rows in seen) == 400, [(b, len(rows)) for b, rows in seen]
    assert [b for b, _ in seen] == list(range(len(seen)))
    assert sorted(o for _, rows in seen for o in rows) == list(range(400))
    with pytest.raises(ValueError):
        telemetry.read_telemetry(spark, f"{folder}/topic", "parquet", rate_per_second=5, events_per_file=10)


def test_log_has_a_line_for_every_batch(spark, folder):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10 + n).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    session = jobs.stream_session(spark, 2)
    log = ProgressLog(session, f"{folder}/log")
    session.streams.addListener(log)

    def drain():
        query = session.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in") \
            .writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return len({p.batchId for p in query.recentProgress if p.numInputRows})

    assert drain() == 3
    limit = time.monotonic() + 20
    while time.monotonic() < limit and (not flows.path_exists(spark, f"{folder}/log") or progress_log(spark, f"{folder}/log").where("rows > 0").count() < 3):
        time.sleep(0.2)
    session.streams.removeListener(log)
    lines = progress_log(spark, f"{folder}/log").where("rows > 0").orderBy("batch_id").collect()
    assert sorted(r["rows"] for r in lines) == [10, 11, 12] and [r["batch_id"] for r in lines] == [0, 1, 2]
    assert lines[-1]["processed_total"] == 33 and all(r["stage_ms"]["addBatch"] > 0 for r in lines)
    points = lag_history(spark, f"{folder}/log", 2).collect()
    assert len(points) == 2 and points[0]["t"] <= points[1]["t"] and points[-1]["consumer_lag_messages"] == 0


def test_headers_of_many_files_in_one_job(spark, folder):
    import os
    os.makedirs(f"{folder}/csv")
    for i in range(60):
        with open(f"{folder}/csv/f{i:02d}.csv", "w") as f:
            f.write(("" if i == 7 else (" a,b \n1,x\n2,y\n" if i % 2 else "b,c\nz,5\n")))
    paths = [f"{folder}/csv/f{i:02d}.csv" for i in range(60)]
    spark.sparkContext.setJobGroup("headers", "headers")
    groups = flows.by_header(spark, paths)
    jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert [len(g) for g in groups] == [30, 29] and jobs_run <= 4  # stages of one adaptive query, whatever the number of files
    df, missing = flows.read_flows(spark, [*paths, f"{folder}/none.csv"])
    assert missing == [f"{folder}/none.csv"] and df.count() == 30 + 58 and set(df.columns) == {"a", "b", "c", "source_file"}


def test_latency_from_stored_sketches(spark, folder):
    rows = spark.range(40000).select(
        (F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 10)).alias("ingest_ts"), (F.pow(F.rand(3), F.lit(4)) * 1000).alias("ms")).withColumns({
            "detect_ts": F.expr("timestampadd(MICROSECOND, cast(ms * 1000 as bigint), ingest_ts)"),
            "write_ts": F.expr("timestampadd(MICROSECOND, cast(ms * 3000 as bigint), ingest_ts)")})
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    half = F.col("ingest_ts") < F.lit("2024-01-03").cast("timestamp")
    for part in (rows.where(half), rows.where(~half)):  # two batches
        incidents.latency_sketches(part).write.mode("append").parquet(f"{folder}/sketches")
    sketches = spark.read.parquet(f"{folder}/sketches")
    start, end = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp") for d in (2, 5))
    chosen = rows.where((F.col("ingest_ts") >= start) & (F.col("ingest_ts") < end))
    got = {r["stage"]: r for r in incidents.rolling_latency(sketches, start, end).collect()}
    exact = {r["stage"]: r for r in incidents.latency_stats(chosen).collect()}
    assert set(got) == set(exact) and len(got) == 3
    for stage, r in got.items():
        assert r["n"] == chosen.count() and r["mean"] == pytest.approx(exact[stage]["mean"])
        values = chosen.select(*incidents.latencies()).select(stage)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            share = values.agg(F.avg((F.col(stage) <= r[name]).cast("int"))).first()[0]
            assert abs(share - p) <= 3 * r["rank_error"]
    plan = incidents.rolling_latency(sketches, start, end)._jdf.queryExecution().executedPlan().toString()
    assert f"{folder}/rows" not in plan
    assert incidents.rolling_latency(sketches.limit(0)).collect() == []


def test_codes_and_weights_of_many_classes(spark):
    df = spark.range(60000).select(F.format_string("c%05d", F.col("id") % 20000).alias("label")).unionByName(spark.createDataFrame([(None,)], "label string"))
    coded = clean.with_codes(df, "label", clean.label_codes(df, "label"), "code")
    assert coded.where("label is not null and code <> cast(substring(label, 2, 5) as int)").count() == 0 and coded.count() == 60001
    assert coded.where("label is null").first()["code"] is None
    weighted = split.sample_weights(df, "label")
    assert weighted.where("label is not null and weight <> 1.0").count() == 0 and weighted.where("weight is null").count() == 1
    assert weighted.columns == ["label", "weight"]

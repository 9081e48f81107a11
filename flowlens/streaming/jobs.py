"""Streaming scoring, campaign formation and batch metrics.

Rows stay on the executors: a micro-batch is parsed, scored, filtered and
written as one distributed job, and only its counters reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions.times import millis_between, parse_iso
from flowlens.models.detectors import score
from flowlens.operators.clean import q
from flowlens.operators.incidents import campaign_fields, threats, to_incident
from flowlens.session import prepare, remove_path
from flowlens.sources.flows import path_exists
from flowlens.sources.store import upsert, write_incidents
from flowlens.sources.versions import VersionedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for streams: fixed state partitions (AQE does not apply), state outside the heap."""
    session = prepare(spark.newSession())
    session.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def unique_messages(messages: DataFrame, event_time: str, delay: str = "10 minutes",
                    key: tuple[str, ...] = ("partition", "offset")) -> DataFrame:
    """Drop repeated messages; the remembered keys expire with the watermark."""
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def batch_counters(batch: DataFrame, p: str, threshold: float) -> list[Column]:
    failed = F.col("parse_failed") if "parse_failed" in batch.columns else F.lit(False)
    return [F.count(F.lit(1)).alias("rows"), F.count_if(q(p) >= threshold).alias("threats"),
            F.count_if(failed).alias("parse_failures")]


METRICS = ("batch_id long, updated_at timestamp, run_id string, rows long, threats long, parse_failures long, "
           "rate_eps double, ingest_to_detect_ms_avg double, ingest_to_detect_ms_p95 double, ingest_to_write_ms_p95 double, "
           "detect_to_write_ms double, write_successes long, write_errors long, stage_ms map<string,double>")


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _millis(start: datetime, end: datetime) -> float:
    return (end - start).total_seconds() * 1000


def _query_id(spark: SparkSession, default: str) -> str:
    """Id of the running streaming query, the same after each restart; the default outside of one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or default


def incident_writer(path: str, metrics_path: str | None, threshold: float, features: list[str], p: str = "p",
                    run_id: str = "", attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: threats of a scored batch to the incident table, one metrics row per batch.

    The threats are scored into a staging folder of the query and batch, which
    goes when the batch is done; counters are observed on the way, so the batch
    runs once. ``detect_ts`` is the time when that is done. ``write_ts`` of a
    document is the time its writing starts; the metrics measure up to the
    commit. A write is tried ``attempts`` times. The commit names the query and
    the batch, so a batch that is replayed after any of its steps is in the
    table once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, started = batch.sparkSession, _now()
        writer = _query_id(spark, "incidents")
        metrics = f"{metrics_path}/batch_id_key={batch_id}"
        if VersionedTable(spark, path).current().has((writer, batch_id)) and (not metrics_path or path_exists(spark, metrics)):
            return
        arrived = F.coalesce("ingest_ts", F.lit(started)) if "ingest_ts" in batch.columns else F.lit(started)
        counters = Observation()
        seen = batch.withColumn("ingest_ts", arrived).observe(counters, *batch_counters(batch, p, threshold))
        scored = threats(seen, threshold, p)
        staged = f"{path}_scored/{writer}-{batch_id}"
        scored.write.mode("overwrite").parquet(staged)
        detected = _now()
        hits = spark.read.schema(scored.schema).parquet(staged).withColumn("detect_ts", F.lit(detected))
        absent = {c: F.lit(None).cast("string") for c in
                  ("threat_classification", "benchmark_run_id", "benchmark_profile", "source_ip", "destination_ip",
                   "target_port") if c not in hits.columns}
        for attempt in range(attempts):
            try:
                stamped = hits.withColumn("write_ts", F.lit(_now()))
                write_incidents(to_incident(stamped.withColumns(absent), features, threshold, p), path, batch_id, writer=writer)
                break
            except Exception:
                if attempt + 1 == attempts:
                    raise
        done = _now()
        if metrics_path:
            to_detect, to_write = (millis_between(F.col("ingest_ts"), F.lit(t)) for t in (detected, done))
            delays = hits.agg(F.avg(to_detect), F.percentile_approx(to_detect, 0.95, 10_000),
                              F.percentile_approx(to_write, 0.95, 10_000)).first()
            c, total = counters.get, max(_millis(started, done), 1e-3)
            row = (batch_id, done, run_id, c["rows"], c["threats"], c["parse_failures"], c["rows"] / total * 1000, *delays,
                   _millis(detected, done), c["threats"], attempt,
                   {"score": _millis(started, detected), "write": _millis(detected, done), "batch": total})
            spark.createDataFrame([row], METRICS).coalesce(1).write.mode("overwrite").parquet(metrics)
        remove_path(spark, staged)

    return write


def score_stream(parsed: DataFrame, model: PipelineModel, threshold: float, path: str, checkpoint: str,
                 features: list[str], metrics_path: str | None = None, every: str | None = None,
                 run_id: str = "") -> StreamingQuery:
    """Parsed telemetry to scored threats in the incident table. Without ``every`` it drains the source and stops."""
    ready = parsed.withColumn("ingest_ts", parse_iso(F.col("ingest_ts"))) if \
        dict(parsed.dtypes).get("ingest_ts") == "string" else parsed
    return write_stream(score(model, ready), threshold, path, checkpoint, features, metrics_path, every, run_id)


def write_stream(scored: DataFrame, threshold: float, path: str, checkpoint: str, features: list[str],
                 metrics_path: str | None = None, every: str | None = None, run_id: str = "") -> StreamingQuery:
    writer = scored.writeStream.foreachBatch(
        incident_writer(path, metrics_path, threshold, features, run_id=run_id)).outputMode("append")
    return _start(writer, checkpoint, every)


def campaign_stream(incidents: DataFrame, window: str = "5 minutes", slide: str | None = "1 minute",
                    min_events: int = 10, delay: str = "30 minutes") -> DataFrame:
    """Streaming campaigns: one stateful aggregate per window and source.

    The state of a group is its counters and its distinct threat types, so a
    busy source does not grow it. Late rows count until the watermark passes.
    """
    source = F.coalesce(F.when(F.trim("source_ip") != "", F.col("source_ip")), F.lit("unknown"))
    kind = F.coalesce("threat_classification", F.lit("malicious"))
    slots = F.window("ts", window, slide) if slide else F.window("ts", window)
    grouped = incidents.select("ts", source.alias("attacker_ip"), kind.alias("kind"),
                               F.coalesce("confidence", F.lit(0.0)).alias("confidence")
                               ).withWatermark("ts", delay).groupBy(slots.alias("w"), "attacker_ip").agg(
        F.count(F.lit(1)).alias("aggregated_events"), F.avg("confidence").alias("confidence_score"),
        F.mode("kind", True).alias("threat_classification"), F.min_by("kind", F.struct("ts", "kind")).alias("first_type"),
        F.sort_array(F.collect_set("kind")).alias("threat_types"))
    return campaign_fields(grouped.filter(F.col("aggregated_events") >= min_events))


def upsert_campaigns(campaigns: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Live campaigns: each change of a window replaces the campaign's row, in one step for the whole batch.

    A later batch counts, whatever its numbers, and a replayed one is known by its query and number.
    ``updated_at`` is the time of the batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("updated_at", F.current_timestamp())
        batch.persist()  # read twice below; without it the stateful plan would run twice
        upsert(batch, path, "campaign_id", "aggregated_events", "timestamp_start", (_query_id(batch.sparkSession, "campaigns"), batch_id))
        batch.unpersist()

    return _start(campaigns.writeStream.foreachBatch(write).outputMode("update"), checkpoint, every)


def append_campaigns(campaigns: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Final campaigns only: a window is written once, when the watermark has passed its end."""
    return _start(campaigns.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, every)


def progress_rows(query: StreamingQuery) -> list[dict]:
    """Per-batch progress: rates, stage times, late rows dropped and lag behind the source."""
    out = []
    for p in query.recentProgress:
        lag = [s.metrics.get("maxOffsetsBehindLatest", "0") if s.metrics else "0" for s in p.sources]
        out.append({
            "batch_id": p.batchId, "t": p.timestamp, "rows": p.numInputRows,
            "input_eps": p.inputRowsPerSecond, "processed_eps": p.processedRowsPerSecond,
            "stage_ms": dict(p.durationMs), "consumer_lag_messages": sum(int(float(x)) for x in lag),
            "dropped_late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)})
    return out


PROGRESS = ("batch_id long, t string, rows long, input_eps double, processed_eps double, stage_ms map<string,double>, "
            "consumer_lag_messages long, dropped_late long")


def progress_frame(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    names = [f.split()[0] for f in PROGRESS.split(", ")]
    rows = [tuple({k: float(v) for k, v in r[n].items()} if n == "stage_ms" else r[n] for n in names)
            for r in progress_rows(query)]
    return spark.createDataFrame(rows, PROGRESS)


def running_totals(metrics: DataFrame) -> DataFrame:
    """Totals over the batches so far, at read time: one row per micro-batch is a bounded, small table."""
    upto = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    return metrics.withColumns({"processed_total": F.sum("rows").over(upto),
                                "threats_total": F.sum("threats").over(upto)})

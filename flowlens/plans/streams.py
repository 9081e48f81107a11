"""Streaming jobs drained over the event table, and their batch twins."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.models.detectors import fit_binary
from flowlens.models.features import raw_space
from flowlens.plans import adapters as a
from flowlens.plans.operations import I, SLIDING, TUMBLING
from flowlens.plans.registry import Tables, naive, query, rounded
from flowlens.session import work_dir
from flowlens.sources.flows import path_exists
from flowlens.sources.store import expire_table, read_incidents, read_table, upsert
from flowlens.sources.versions import VersionedTable
from flowlens.streaming import jobs
from flowlens.streaming.progress import ProgressLog, progress_log

_STREAM_COLUMNS = """campaign_id, attacker_ip, timestamp_start, timestamp_end, aggregated_events,
  round(confidence_score, 10) AS confidence_score, threat_classification"""


class StreamTables(Tables):
    """Event table as a file stream; every other table as usual."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        schema = self.spark.read.parquet(f"{self.folder}/events.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option(
            "maxFilesPerTrigger", 100).parquet(self.folder)


def streamed(t: Tables) -> StreamTables:
    out = StreamTables(jobs.stream_session(t.spark), t.folder)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def drain(streaming_query) -> None:
    streaming_query.awaitTermination()
    if streaming_query.exception():
        raise streaming_query.exception()


def _campaign_columns(df: DataFrame) -> DataFrame:
    out = df.select("campaign_id", "attacker_ip", "timestamp_start", "timestamp_end", "aggregated_events",
                    "confidence_score", "threat_classification")
    return naive(rounded(out, "confidence_score", digits=10), "timestamp_start", "timestamp_end")


@query("j04_stream_update", f"SELECT {_STREAM_COLUMNS} FROM camp", (*I, SLIDING))
def stream_update(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "sliding")
    live = jobs.campaign_stream(a.incidents(streamed(t)), "1 day", "12 hours", 2)
    drain(jobs.upsert_campaigns(live, folder + "/table", folder + "/checkpoint", None))
    return _campaign_columns(read_table(t.spark, folder + "/table"))


@query("j04_stream_append", f"""SELECT {_STREAM_COLUMNS} FROM camp
  WHERE timestamp_end <= (SELECT max(ts) FROM incidents) - INTERVAL 30 MINUTE""", (*I, SLIDING))
def stream_append(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "final")
    live = jobs.campaign_stream(a.incidents(streamed(t)), "1 day", "12 hours", 2)
    drain(jobs.append_campaigns(live, folder + "/table", folder + "/checkpoint", None))
    return _campaign_columns(t.spark.read.schema(live.schema).parquet(folder + "/table"))


@query("j05_tumbling_upsert", f"SELECT {_STREAM_COLUMNS} FROM camp", (*I, TUMBLING))
def tumbling_upsert(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "tumbling")
    live = jobs.campaign_stream(a.incidents(streamed(t)), "1 day", None, 2)
    drain(jobs.upsert_campaigns(live, folder + "/table", folder + "/checkpoint", None))
    return _campaign_columns(read_table(t.spark, folder + "/table"))


def _scored_stream(t: Tables) -> DataFrame:
    s = a.scored(streamed(t))
    return s.select("event_id", F.col("ts").alias("ingest_ts"), "p", F.col("label").alias("threat_classification"),
                    F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("source_ip"), "value")


@query("j03_threat_sink", """SELECT threat_classification, '10.0.0.' || CAST(user_id AS VARCHAR) AS source_ip, count(*) AS n,
  round(sum(value), 4) AS value FROM (SELECT *, label AS threat_classification FROM scored WHERE p >= 0.5) GROUP BY ALL""",
       (a.SCORED,))
def threat_sink(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "threats")
    drain(jobs.write_stream(_scored_stream(t), 0.5, folder + "/incidents", folder + "/checkpoint", ["value"]))
    docs = read_incidents(t.spark, folder + "/incidents")
    return rounded(docs.groupBy("threat_classification", F.col("network_identifiers.source_ip").alias("source_ip")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("features")["value"]).alias("value")), "value", digits=4)


@query("j07_batch_metrics", """SELECT count(*) AS processed_total, count(*) FILTER (WHERE p >= 0.5) AS threats_total
  FROM scored""", (a.SCORED,))
def batch_metrics(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "metrics")
    drain(jobs.write_stream(_scored_stream(t), 0.5, folder + "/incidents", folder + "/checkpoint", ["value"],
                            folder + "/metrics"))
    totals = jobs.running_totals(t.spark.read.parquet(folder + "/metrics"))
    return totals.agg(F.max("processed_total").alias("processed_total"), F.max("threats_total").alias("threats_total"))


@query("j11_unique_messages", """SELECT event_id % 8 AS "partition", count(*) AS n FROM events GROUP BY 1""")
def unique_messages(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "unique")
    s = a.scored(streamed(t)).select((F.col("event_id") % 8).alias("partition"), F.col("event_id").alias("offset"), "ts")
    unique = jobs.unique_messages(s.unionByName(s), "ts", "10 minutes")
    drain(jobs.append_campaigns(unique, folder + "/table", folder + "/checkpoint", None))
    return t.spark.read.parquet(folder + "/table").groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@query("j13_stream_progress")
def stream_progress(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "progress")
    live = jobs.campaign_stream(a.incidents(streamed(t)), "1 day", None, 2)
    running = jobs.append_campaigns(live, folder + "/table", folder + "/checkpoint", None)
    drain(running)
    return jobs.progress_frame(t.spark, running)


@query("j03_scoring_stream")
def scoring_stream(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "scoring")
    columns = ["value", "hour", "user_no"]

    def with_features(s: DataFrame) -> DataFrame:
        return s.select("event_id", F.col("ts").alias("ingest_ts"), "y", "value", F.hour("ts").cast("double").alias("hour"),
                        F.col("user_id").cast("double").alias("user_no"))

    train = with_features(a.scored(t))
    model = fit_binary(train, raw_space(train, columns), max_iter=3, max_depth=3)
    drain(jobs.score_stream(with_features(a.scored(streamed(t))), model, 0.5, folder + "/incidents",
                            folder + "/checkpoint", columns))
    return read_incidents(t.spark, folder + "/incidents").select("timestamp", "confidence", "features")


@query("a08_versioned_upsert", """SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN value - 1000 ELSE value END, 6) AS value FROM events""")
def versioned_upsert(t: Tables) -> DataFrame:
    """All events, then corrections with lower values, then the first batch again, which changes nothing."""
    path = new_folder(t.spark, "upsert") + "/table"
    events = t.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    lower = events.where("event_id % 5 = 0").withColumn("value", F.col("value") - 1000)
    for batch, rows in ((0, events), (1, lower), (0, events)):
        upsert(rows, path, "event_id", "value", "ts", ("corrections", batch))
    return rounded(read_table(t.spark, path).select("event_id", "value"), "value")


@query("a09_expired_table", f"""SELECT event_id FROM incidents
  WHERE ts >= TIMESTAMP '{a.NOW}' - INTERVAL 10 DAY""", (a.SCORED, a.INCIDENTS))
def expired_table(t: Tables) -> DataFrame:
    """A stored table without what is out of retention: days dropped, the border day rewritten, files deleted."""
    path = new_folder(t.spark, "retention") + "/table"
    VersionedTable(t.spark, path).append(a.incidents(t).select("event_id", F.col("ts").cast("timestamp").alias("ts")), "ts")
    expire_table(t.spark, path, "ts", a.now(), 10)
    return read_table(t.spark, path).select("event_id")


@query("j10_replayed_batches", """SELECT label AS threat_classification, count(*) AS n, count(DISTINCT event_id % 3) AS batches FROM scored
  WHERE p >= 0.5 GROUP BY 1""", (a.SCORED,))
def replayed_batches(t: Tables) -> DataFrame:
    """Three micro-batches, each delivered twice: the ledger keeps one copy."""
    path = new_folder(t.spark, "replay") + "/incidents"
    scored = a.scored(t).select("event_id", F.col("ts").cast("timestamp").alias("ingest_ts"), "p", F.col("label").alias("threat_classification"),
                                (F.col("event_id") % 3).cast("double").alias("batch"))
    write = jobs.incident_writer(path, None, 0.5, ["batch"])
    for batch in (0, 0, 1, 2, 2):
        write(scored.where(F.col("batch") == batch), batch)
    write(scored.where("batch = 1"), 1)
    docs = read_incidents(t.spark, path)
    return docs.groupBy("threat_classification").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("features")["batch"]).alias("batches"))


@query("j09_progress_log", """SELECT count(*) AS processed_total, CAST(0 AS BIGINT) AS lag, true AS timed FROM events""")
def logged_progress(t: Tables) -> DataFrame:
    """What a stream's own log says after it has drained the events."""
    folder, session = new_folder(t.spark, "log"), streamed(t)
    log = ProgressLog(session.spark, folder + "/log")
    session.spark.streams.addListener(log)
    drain(jobs.append_campaigns(a.incidents(session).select("ts", "event_id"), folder + "/table", folder + "/checkpoint", None))
    wait_for(lambda: path_exists(t.spark, folder + "/log"))
    session.spark.streams.removeListener(log)
    lines = progress_log(t.spark, folder + "/log")
    return lines.agg(F.max("processed_total").alias("processed_total"), F.max("consumer_lag_messages").alias("lag"),
                     F.bool_and(F.col("stage_ms")["addBatch"].isNotNull()).alias("timed"))


def wait_for(done, seconds: float = 30.0) -> None:
    """Listeners are told a little later than the query ends."""
    limit = time.monotonic() + seconds
    while not done() and time.monotonic() < limit:
        time.sleep(0.1)

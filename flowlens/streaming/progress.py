"""Progress of streams, kept: one line per batch, written when the batch ends."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from flowlens.operators.split import tail
from flowlens.sources.store import read_lines

LINE = ("query_id string, run_id string, batch_id long, t string, rows long, consumer_lag_messages long, dropped_late long, "
        "input_eps double, processed_rate_eps double, stage_ms map<string,double>")


class ProgressLog(StreamingQueryListener):
    """Appends rates, lag and stage times of every batch of the session's streams to ``path``.

    A batch has one file, named after its query and number, so a batch that is
    run again after a restart replaces its line. ``spark.streams.addListener``
    starts the log, ``removeListener`` ends it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        lags = [(s.metrics or {}).get("maxOffsetsBehindLatest", "0") for s in p.sources]
        number = lambda x: float(x) if x is not None and x == x and abs(x) != float("inf") else None
        line = {"query_id": str(p.id), "run_id": str(p.runId), "batch_id": p.batchId, "t": p.timestamp, "rows": p.numInputRows,
                "consumer_lag_messages": sum(int(float(x)) for x in lags), "dropped_late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
                "input_eps": number(p.inputRowsPerSecond), "processed_rate_eps": number(p.processedRowsPerSecond),
                "stage_ms": {k: float(v) for k, v in dict(p.durationMs).items()}}
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p.id}-{p.batchId:012d}.json")
        out = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target, True)
        try:
            out.write(bytearray((json.dumps(line) + "\n").encode()))
        finally:
            out.close()


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log with ``processed_total``, the rows of a query up to each batch."""
    upto = Window.partitionBy("query_id").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    return read_lines(spark, path, LINE).withColumn("processed_total", F.sum("rows").over(upto))


def lag_history(spark: SparkSession, path: str, points: int = 300) -> DataFrame:
    """The newest ``points`` lines: time, total, lag and rate."""
    lines = progress_log(spark, path).withColumn("t", F.to_timestamp("t"))
    return tail(lines.select("query_id", "batch_id", "t", "processed_total", "consumer_lag_messages", "processed_rate_eps"), "t", points)

"""Incident, campaign, report and parameter tables; model folders."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.clean import q
from flowlens.sources.versions import VersionedTable


def write_incidents(df: DataFrame, path: str, batch_id: int, ts: str = "timestamp", writer: str = "incidents") -> bool:
    """Add a micro-batch to the incident table, by day; False if that batch of the writer is in it already."""
    return VersionedTable(df.sparkSession, path).append(df, ts, (writer, batch_id))


def read_incidents(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Incidents and their ``day``; only the folders of the asked days are read."""
    return VersionedTable(spark, path).read(start, end)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of a table that `upsert` writes."""
    return VersionedTable(spark, path).read()


def latest_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of every key: one aggregate, merged before the shuffle."""
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(q(key).alias(key)).agg(
        F.max_by(F.struct(*[q(c) for c in rest]), q(version)).alias("_row"))
    return newest.select(key, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*[q(c) for c in df.columns])


def upsert(df: DataFrame, path: str, key: str, version: str, day_of: str, writer: tuple[str, int] | None = None) -> bool:
    """Insert or replace rows by key in a table by day: what comes later counts, also if its ``version`` is lower.

    ``version`` orders the rows of one key within ``df``. Replaying a batch
    gives the same table; with ``writer`` (name, batch) it is not even written.
    """
    return VersionedTable(df.sparkSession, path).upsert(df, key, day_of, version, writer)


def expire(df: DataFrame, ts: str, now: Column, days: int = 30) -> DataFrame:
    """Rows that are still within retention."""
    return df.filter(q(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def expire_table(spark: SparkSession, path: str, ts: str, now: Column, days: int = 30) -> int:
    """Remove what is out of retention from a stored table, rows and files; the number of folders deleted.

    Whole days are dropped by name, the day of the limit is rewritten without
    its old rows, then the files that no version names are deleted.
    """
    table = VersionedTable(spark, path)
    table.expire(ts, now - F.make_dt_interval(days=F.lit(days)))
    return table.vacuum(kept=1)


def append_report(df: DataFrame, path: str, prefix: str, run_ts: str) -> None:
    """Append one-run results as JSON payloads under their report kind."""
    df.select(F.lit(prefix).alias("prefix"), F.lit(run_ts).alias("run_ts"),
              F.to_json(F.struct(*[q(c) for c in df.columns])).alias("payload")
              ).write.mode("append").partitionBy("prefix").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run_ts string, payload string, prefix string").json(path)


def latest_report(reports: DataFrame, prefix: str | None = None) -> DataFrame:
    """Newest payload per report kind."""
    chosen = reports if prefix is None else reports.filter(F.col("prefix") == prefix)
    return chosen.groupBy("prefix").agg(F.max(F.struct("run_ts", "payload")).alias("r")).select(
        "prefix", "r.run_ts", "r.payload")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def put_params(params: DataFrame, path: str) -> None:
    """Append ``(key, value, run_ts)``; reading takes the newest value of each key."""
    params.write.mode("append").parquet(path)


def get_params(params: DataFrame) -> DataFrame:
    return params.groupBy("key").agg(F.max(F.struct("run_ts", "value")).alias("r")).select("key", "r.value", "r.run_ts")


def param_values(params: DataFrame, keys: Sequence[str]) -> dict[str, float]:
    """The newest values of the named keys."""
    wanted = get_params(params.filter(F.col("key").isin(*keys)))
    return {r["key"]: r["value"] for r in wanted.collect()}


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

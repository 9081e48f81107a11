"""Telemetry messages: sources, payload parsing and replay."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions.network import ips_from_flow_id, pick, synthetic_ip
from flowlens.functions.values import to_number
from flowlens.operators.clean import q, safe_name

MESSAGE_SCHEMA = T.StructType([
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
])


def read_telemetry(spark: SparkSession, path_or_topic: str, fmt: str = "kafka", starting: str = "latest",
                   rate_per_second: int | None = None, trigger_seconds: float = 1.0, events_per_file: int | None = None,
                   schema: T.StructType = MESSAGE_SCHEMA, options: Mapping[str, str] | None = None) -> DataFrame:
    """Unbounded message table from a Kafka topic, or from a folder of message files.

    ``rate_per_second`` caps the intake of a trigger at rate x interval events.
    Kafka counts them by offsets. A folder is admitted by files, so its files
    must hold at most ``events_per_file`` events (`replay_to_topic` and
    `refile` write such files); without it a trigger takes one file. The
    checkpoint knows which files were taken, so the cap holds after restarts.
    """
    reader = spark.readStream.format(fmt).options(**dict(options or {}))
    cap = None if rate_per_second is None else max(int(rate_per_second * trigger_seconds), 1)
    if fmt == "kafka":
        reader = reader.option("subscribe", path_or_topic).option("startingOffsets", starting)
        if cap:
            reader = reader.option("maxOffsetsPerTrigger", cap)
        return reader.load()
    if cap:
        if events_per_file and events_per_file > cap:
            raise ValueError(f"files of {events_per_file} events do not fit a cap of {cap} a trigger")
        reader = reader.option("maxFilesPerTrigger", cap // events_per_file if events_per_file else 1)
    return reader.schema(schema).load(path_or_topic)


def refile(spark: SparkSession, source: str, target: str, checkpoint: str, events_per_file: int, fmt: str = "parquet",
           schema: T.StructType = MESSAGE_SCHEMA, files_per_trigger: int = 1000) -> StreamingQuery:
    """Copy a folder of message files into one whose files hold at most ``events_per_file`` events; new files only, each once."""
    files = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(source)
    return files.writeStream.format(fmt).option("path", target).option("checkpointLocation", checkpoint).option(
        "maxRecordsPerFile", events_per_file).trigger(availableNow=True).start()


def parse_payload(messages: DataFrame, schema: T.StructType, lenient: bool = False,
                  keep: tuple[str, ...] = ("partition", "offset")) -> DataFrame:
    """Message value to typed, safely named columns and a ``parse_failed`` flag.

    Strict parsing makes quoted numbers NULL; ``lenient`` accepts them.
    """
    fields = list(schema.fields)
    if lenient:
        schema = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    text = q("value").cast("string")
    data = F.from_json(text, schema)
    # A bad field makes that field NULL; only text that is no JSON object is a failure.
    probe = F.from_json(text, "_any string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = messages.withColumn("_data", data).withColumn("parse_failed", ~F.coalesce(
        F.trim(text).startswith("{") & probe["_corrupt"].isNull(), F.lit(False)))

    def value(f: T.StructField) -> Column:
        raw = F.col("_data").getField(f.name)
        return to_number(raw) if lenient and isinstance(f.dataType, T.NumericType) else raw

    return parsed.select(*[q(c) for c in keep], "parse_failed", *[value(f).alias(safe_name(f.name)) for f in fields])


def parse_failures(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(~F.col("parse_failed")).alias("parsed_rows"),
                      F.count_if("parse_failed").alias("parse_failures"))


def replay_messages(flows: DataFrame, row_id: str, ingest_ts: Column, port: str = "Destination Port",
                    source: tuple[str, ...] = ("Source IP", "Src IP", "src_ip"),
                    destination: tuple[str, ...] = ("Destination IP", "Dst IP", "dst_ip"),
                    flow_id: str = "Flow ID", run_id: str | None = None, profile: str | None = None) -> DataFrame:
    """Flow rows to ``(key, value)`` messages: JSON payload, keyed by source address.

    Missing addresses come from the flow id, else a stable made-up one.
    """
    def candidates(names: tuple[str, ...]) -> list[Column]:
        return [pick(*[q(c) for c in names if c in flows.columns])] if any(c in flows.columns for c in names) else []

    derived = ips_from_flow_id(q(flow_id)) if flow_id in flows.columns else ()
    port_text = q(port).cast("string") if port in flows.columns else F.lit(None).cast("string")
    made_up = [synthetic_ip(F.concat_ws("|", F.lit(tag), q(row_id).cast("string"),
                                        F.coalesce(port_text, F.lit("None"))), prefix)
               for tag, prefix in (("src", "10.10"), ("dst", "172.16"))]
    src = F.coalesce(*candidates(source), *derived[:1], made_up[0])
    dst = F.coalesce(*candidates(destination), *derived[1:], made_up[1])
    stamped = flows.withColumns({
        "source_ip": src, "destination_ip": dst, "ingest_ts": F.date_format(ingest_ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"),
        **({"benchmark_run_id": F.lit(run_id)} if run_id else {}),
        **({"benchmark_profile": F.lit(profile)} if profile else {}),
    })
    return stamped.select(F.col("source_ip").cast("binary").alias("key"),
                          F.to_json(F.struct(*[q(c) for c in stamped.columns if c != row_id])).cast("binary").alias("value"))


def replay_to_topic(messages: DataFrame, path_or_topic: str, fmt: str = "kafka",
                    options: Mapping[str, str] | None = None, events_per_file: int | None = None) -> None:
    """Write messages to a topic, or append them to a folder as (partition, offset, key, value), ``events_per_file`` at most in a file."""
    writer = messages.write.format(fmt).options(**dict(options or {})).mode("append")
    if events_per_file:
        writer = writer.option("maxRecordsPerFile", events_per_file)
    if fmt == "kafka":
        writer.option("topic", path_or_topic).save()
    else:
        writer.save(path_or_topic)


def with_offsets(messages: DataFrame, partitions: int = 8) -> DataFrame:
    """Stand-in for a topic's numbering in folder tests: hash partition, increasing offset."""
    return messages.withColumn("partition", F.pmod(F.hash("key"), F.lit(partitions))).withColumn(
        "offset", F.monotonically_increasing_id()).select("partition", "offset", "key", "value")

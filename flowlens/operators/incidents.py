"""Operational analytics over incidents and campaigns.

Incident columns: ``ts``, ``source_ip``, ``destination_ip``, ``target_port``,
``threat_classification``, ``confidence`` and the stage times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.contract import SLO_TARGETS
from flowlens.functions.times import iso_utc, millis_between, recent
from flowlens.functions.values import finite, key_hash
from flowlens.operators.clean import q
from flowlens.operators.ordered import bin_of
from flowlens.operators.quantiles import exact_percentiles


def threats(df: DataFrame, threshold: float, p: str = "confidence") -> DataFrame:
    return df.filter(q(p) >= threshold)


def recent_rows(df: DataFrame, now: Column, minutes: int, ts: str = "ts") -> DataFrame:
    return df.filter(recent(q(ts), now, minutes))


def newest(df: DataFrame, ts: str, tie: str, n: int = 100) -> DataFrame:
    """Newest-first page of ``n`` rows."""
    return df.orderBy(q(ts).desc(), q(tie).asc()).limit(n)


def campaigns_by_ip(campaigns: DataFrame, ip: str, n: int = 100) -> DataFrame:
    return newest(campaigns.filter(F.col("attacker_ip") == ip), "timestamp_start", "campaign_id", n)


def campaigns(incidents: DataFrame, window: str = "5 minutes", slide: str | None = None, min_events: int = 10,
              tie: str | None = None, cap: int = 200) -> DataFrame:
    """Group incidents of one source and time window into campaigns.

    Counts are first taken per threat type, which merges a hot source on the map
    side; the modal type then comes from a handful of rows (ties by name). With
    ``tie``, a unique order column, the first ``cap`` types are kept as a list:
    the window-limit keeps at most ``cap`` rows per group before the shuffle.
    """
    source = F.coalesce(F.when(F.trim("source_ip") != "", F.col("source_ip")), F.lit("unknown"))
    kind = F.coalesce("threat_classification", F.lit("malicious"))
    slots = F.window("ts", window, slide) if slide else F.window("ts", window)
    base = incidents.filter(F.col("ts").isNotNull()).select(
        source.alias("attacker_ip"), kind.alias("kind"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        slots.alias("w"), *([q(tie).alias("_tie"), "ts"] if tie else []))
    key = ["attacker_ip", "w"]
    per_kind = base.groupBy(*key, "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("s"))
    # Smallest name among the largest counts.
    whole = per_kind.groupBy(*key).agg(
        F.sum("n").alias("aggregated_events"), (F.sum("s") / F.sum("n")).alias("confidence_score"),
        F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("threat_classification"))
    kept = whole.filter(F.col("aggregated_events") >= min_events)
    if tie:
        order = Window.partitionBy(*key).orderBy("ts", "_tie")
        first = base.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cap).groupBy(*key).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_rn", "kind"))), lambda s: s["kind"])
            .alias("all_threat_types"))
        kept = kept.join(first, key)
    return campaign_fields(kept)


def campaign_fields(grouped: DataFrame) -> DataFrame:
    """Campaign document columns from ``attacker_ip``, window ``w`` and the aggregates."""
    start, end = F.col("w.start"), F.col("w.end")
    rest = [c for c in grouped.columns if c not in ("attacker_ip", "w")]
    return grouped.select(
        key_hash(F.col("attacker_ip"), iso_utc(start)).alias("campaign_id"), "attacker_ip",
        start.alias("timestamp_start"), end.alias("timestamp_end"), *rest,
        ((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000).cast("int").alias("window_duration_sec"))


def to_incident(df: DataFrame, features: list[str], threshold: float, p: str = "confidence") -> DataFrame:
    """Flat scored rows to nested incident documents; the stamp is the detection time."""
    pairs = [x for c in features for x in (F.lit(c), q(c).cast("double"))]
    return df.select(
        F.col("detect_ts").alias("timestamp"), "ingest_ts", "detect_ts", "write_ts",
        q(p).alias("confidence"), F.lit(float(threshold)).alias("threshold"),
        F.coalesce("threat_classification", F.lit("malicious")).alias("threat_classification"),
        F.struct(F.col("benchmark_run_id").alias("run_id"), F.col("benchmark_profile").alias("profile"))
        .alias("benchmark"),
        F.struct("source_ip", "destination_ip", F.col("target_port").cast("double").alias("target_port"))
        .alias("network_identifiers"),
        (F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,double>)")).alias("features"),
        *latencies())


def latencies() -> list[Column]:
    stages = (("ingest_to_detect", "ingest_ts", "detect_ts"), ("ingest_to_write", "ingest_ts", "write_ts"),
              ("detect_to_write", "detect_ts", "write_ts"))
    return [millis_between(F.col(a), F.col(b)).alias(f"latency_{name}_ms") for name, a, b in stages]


def summary(incidents: DataFrame, campaigns_: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row: incidents, campaigns and mean confidence of the last hours."""
    inc = recent_rows(incidents, now, hours * 60).agg(
        F.count(F.lit(1)).alias("incidents"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    camp = recent_rows(campaigns_, now, hours * 60, "timestamp_start").agg(F.count(F.lit(1)))
    return inc.select(F.lit(hours).alias("hours"), "incidents", camp.scalar().alias("campaigns"), "avg_confidence")


def top_sources(incidents: DataFrame, now: Column, hours: int = 24, k: int = 5) -> DataFrame:
    counts = recent_rows(incidents, now, hours * 60).groupBy(
        F.coalesce("source_ip", F.lit("unknown")).alias("source_ip")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "source_ip").limit(k)


def timeseries(incidents: DataFrame, now: Column, minutes: int = 120, bucket: int = 5) -> DataFrame:
    """Count and mean confidence per epoch-aligned bucket, ascending."""
    rows = recent_rows(incidents, now, minutes)
    return rows.groupBy(F.window("ts", f"{bucket} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_conf")).select(
        F.col("w.start").alias("t"), "n", "avg_conf").orderBy("t")


def throughput(incidents: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    rows = recent_rows(incidents, now, minutes).agg(F.count(F.lit(1)).alias("incidents"))
    rate = F.col("incidents") / float(minutes * 60) if minutes > 0 else F.lit(0.0)
    return rows.select(F.lit(minutes).alias("minutes"), "incidents", rate.alias("events_per_sec"))


def hotspots(incidents: DataFrame, now: Column, hours: int = 24, k: int = 8) -> DataFrame:
    """Top ports, destinations and threat types from one scan (grouping sets)."""
    rows = recent_rows(incidents, now, hours * 60).select(
        F.col("target_port").cast("string").alias("port"),
        F.coalesce("destination_ip", F.lit("unknown")).alias("dst"),
        F.coalesce("threat_classification", F.lit("unknown")).alias("kind"))
    sets = rows.groupingSets([["port"], ["dst"], ["kind"]], "port", "dst", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # grouping_id has a bit per column that is NOT grouped: port=011, dst=101, kind=110.
    dimension = F.when(F.col("g") == 3, "port").when(F.col("g") == 5, "destination_ip").otherwise("threat_type")
    value = F.when(F.col("g") == 3, F.col("port")).when(F.col("g") == 5, F.col("dst")).otherwise(F.col("kind"))
    named = sets.select(dimension.alias("dimension"), value.alias("value"), "n")
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    return named.withColumn("place", place).filter(F.col("place") <= k)


def latency_stats(incidents: DataFrame, probs: tuple[float, ...] = (0.5, 0.95, 0.99), stored: bool = False) -> DataFrame:
    """Mean and exact percentiles of the three stage latencies; ``stored`` as in `exact_percentiles`."""
    names = ["latency_ingest_to_detect_ms", "latency_ingest_to_write_ms", "latency_detect_to_write_ms"]
    rows = incidents.select(*latencies())
    means = rows.agg(*[F.avg(c).alias(c) for c in names]).unpivot([], names, "feature", "mean")
    wide = exact_percentiles(rows, names, list(probs), stored=stored).groupBy("feature").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in probs])
    return means.join(F.broadcast(wide), "feature", "left").withColumnRenamed("feature", "stage")


#: Sketch size of stored latencies and what it costs: at 99 of 100 a rank is off by less than this part of the rows.
SKETCH_SIZE = 4000
RANK_ERROR = 2.296 / SKETCH_SIZE ** 0.9021


def latency_sketches(incidents: DataFrame, ts: str = "ingest_ts", bucket: str = "1 hour") -> DataFrame:
    """(bucket, stage, n, mean, sketch): stage latencies by time bucket, as quantile sketches that can be merged.

    Rows of one batch or of all; a table of them takes further batches by
    appending, as sketches of one bucket merge when they are read.
    """
    names = ["latency_ingest_to_detect_ms", "latency_ingest_to_write_ms", "latency_detect_to_write_ms"]
    rows = incidents.select(F.window(q(ts), bucket)["start"].alias("bucket"), *latencies())
    wide = rows.groupBy("bucket").agg(F.array(*[F.struct(
        F.lit(c).alias("stage"), F.count(c).alias("n"), F.avg(c).alias("mean"),
        F.kll_sketch_agg_double(c, F.lit(SKETCH_SIZE)).alias("sketch")) for c in names]).alias("s"))
    return wide.select("bucket", F.explode("s").alias("s")).select("bucket", "s.*").where("n > 0")


def rolling_latency(sketches: DataFrame, start: Column | None = None, end: Column | None = None,
                    probs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(stage, n, mean, p50, ..., rank_error) of the buckets from ``start`` to before ``end``: no rows are read, only sketches.

    `latency_stats` is the exact form. Here the share of values up to a
    percentile is within ``rank_error`` of it, 99 times in 100.
    """
    chosen = sketches if start is None else sketches.where(F.col("bucket") >= start)
    chosen = chosen if end is None else chosen.where(F.col("bucket") < end)
    merged = chosen.groupBy("stage").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
                                         F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select("stage", "n", "mean", *[F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(f"p{round(p * 100)}") for p in probs],
                         F.lit(RANK_ERROR).alias("rank_error"))


def latency_by_run(incidents: DataFrame, run: str = "run_id") -> DataFrame:
    """p95 ingest-to-write per run, and which run is the freshest."""
    rows = incidents.select(q(run).alias("run_id"), "ingest_ts", *latencies())
    freshest = rows.agg(F.max_by("run_id", F.struct("ingest_ts", "run_id"))).scalar()
    p95 = exact_percentiles(rows, ["latency_ingest_to_write_ms"], [0.95], by="run_id")
    return p95.select("run_id", F.col("value").alias("p95_ms"), (F.col("run_id") == freshest).alias("freshest"))


def slo(measured: DataFrame, targets=SLO_TARGETS, always: tuple[str, ...] = ("mongo_write_rate",)) -> DataFrame:
    """PASS, FAIL or UNVERIFIED per target; a missing or non-positive measurement is unverified."""
    table = measured.sparkSession.createDataFrame(list(targets), "metric string, target double, direction string")
    value = F.col("measured")
    known = (value > 0) | F.col("metric").isin(*always)
    met = F.when(F.col("direction") == "max", F.coalesce(value, F.lit(0.0)) <= F.col("target")).otherwise(
        value >= F.col("target"))
    verdict = F.when(~F.coalesce(known, F.col("metric").isin(*always)), "UNVERIFIED").when(met, "PASS").otherwise("FAIL")
    return table.join(measured.select("metric", q("value").cast("double").alias("measured")), "metric", "left").select(
        "metric", "target", "measured", verdict.alias("status"))


def status_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "UNVERIFIED")])


def benchmark_rollup(runs: DataFrame) -> DataFrame:
    """Highest consumer rate and the bottleneck hint over all profiles of a benchmark."""
    rate = F.coalesce("consumer_eps", F.lit(0.0))
    slower = F.bool_or(F.coalesce("producer_eps", F.lit(0.0)) > rate)
    return runs.agg(F.count(F.lit(1)).alias("profiles"), F.max(rate).alias("max_profile_eps"),
                    F.when(slower, "consumer_bound").otherwise("producer_bound").alias("bottleneck_hint"))


def stage_means(metrics: DataFrame, stages: str = "stage_ms") -> DataFrame:
    """Mean time per named stage of the batch metrics (a map column)."""
    return metrics.select(F.explode(q(stages)).alias("stage", "ms")).groupBy("stage").agg(
        F.round(F.avg("ms"), 3).alias("mean_ms"))


def rolling_monitor(df: DataFrame, value: Column, span: str, slide: str, alert: float, rollback: float,
                    above: bool = True, ts: str = "ts") -> DataFrame:
    """Mean of ``value`` over a rolling span, judged every ``slide``.

    Rows collapse to one per slide before the overlapping spans are formed, so
    the span/slide blow-up never touches the raw rows, and no global window is needed.
    """
    ticks = df.groupBy(F.window(ts, slide).alias("t")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    rolled = ticks.select(F.col("t.start").alias("start"), "s", "n").groupBy(
        F.window("start", span, slide).alias("w")).agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    worse = (lambda limit: F.col("mean") > limit) if above else (lambda limit: F.col("mean") < limit)
    state = F.when(worse(rollback), "ROLLBACK").when(worse(alert), "ALERT").otherwise("OK")
    return rolled.select(F.col("w.end").alias("at"), "n", "mean", state.alias("state"))


def kl_drift(df: DataFrame, p: str, now: Column, current_hours: int = 24, baseline_days: int = 7,
             bins: int = 10, alert: float = 0.10, rollback: float = 0.25, ts: str = "ts") -> DataFrame:
    """KL divergence of the confidence histogram: last hours against the days before.

    Add-one smoothing keeps empty bins finite; rows without a finite score are left out.
    """
    cut = now - F.make_dt_interval(hours=F.lit(current_hours))
    first = cut - F.make_dt_interval(days=F.lit(baseline_days))
    in_current, in_baseline = q(ts) >= cut, (q(ts) >= first) & (q(ts) < cut)
    edges = [i / bins for i in range(1, bins)]
    counts = df.filter((q(ts) >= first) & (q(ts) < now)).withColumn("_p", finite(q(p))).filter("_p is not null").groupBy(
        bin_of("_p", edges).alias("bin")).agg(
        F.count_if(in_current).alias("c"), F.count_if(in_baseline).alias("b"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").fillna(0, ["c", "b"])
    totals = full.agg(F.sum("c").alias("ct"), F.sum("b").alias("bt"),
                      F.sum((F.col("c") + 1) * F.ln((F.col("c") + 1) / (F.col("b") + 1))).alias("x"))
    n, m = F.col("ct") + bins, F.col("bt") + bins
    out = totals.select(F.col("ct").alias("current_rows"), F.col("bt").alias("baseline_rows"),
                        (F.col("x") / n + F.ln(m / n)).alias("kl"))
    return out.withColumn("state", F.when(F.col("kl") > rollback, "ROLLBACK").when(
        F.col("kl") > alert, "ALERT").otherwise("OK"))


def weekly_growth(df: DataFrame, value: Column, ts: str = "ts", alert: float = 0.15, rollback: float = 0.30) -> DataFrame:
    """Week-over-week growth of a sum, by an equi-join of each week with the next one."""
    weeks = df.groupBy(F.date_trunc("week", q(ts)).alias("week")).agg(F.sum(value).alias("total"))
    earlier = weeks.select((F.col("week") + F.make_dt_interval(days=F.lit(7))).alias("week"),
                           F.col("total").alias("previous"))
    growth = F.try_divide(F.col("total") - F.col("previous"), F.col("previous"))
    return weeks.join(earlier, "week", "left").select("week", "total", growth.alias("growth")).withColumn(
        "state", F.when(F.col("growth") > rollback, "ROLLBACK").when(F.col("growth") > alert, "ALERT").otherwise("OK"))

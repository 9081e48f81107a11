"""Joins and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.contract import MITRE_DEFAULT, MITRE_RULES
from flowlens.operators.clean import q
from flowlens.operators.ordered import first_rows


def null_impact(df: DataFrame, label: str) -> DataFrame:
    """Rows per class before and after dropping incomplete rows.

    One scan with a conditional count does what a join of two counts would do.
    A class that loses every row has no count after, as in a left join.
    """
    complete = ~F.exists(F.array(*[q(c).isNull() for c in df.columns]), lambda b: b)
    out = df.filter(q(label).isNotNull()).groupBy(q(label).alias(label)).agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(complete).alias("kept"))
    after = F.when(F.col("kept") > 0, F.col("kept"))
    lost = F.col("n_before") - after
    return out.select(label, "n_before", after.alias("n_after"), lost.alias("abs_diff"),
                      F.round(lost * 100.0 / F.col("n_before"), 2).alias("diff_pct"))


def compare_importance(importance: DataFrame, scores: DataFrame, feature: str = "feature") -> DataFrame:
    """Left join of two per-feature score tables, most important first."""
    return importance.join(scores, feature, "left").orderBy(F.desc("importance"), feature)


def top_up(df: DataFrame, taken: DataFrame, key: str, order: str, bucket: str, n: int) -> DataFrame:
    """Rows whose key is not taken yet, the first ``n`` in order."""
    return first_rows(df.join(taken.select(key), key, "left_anti"), order, bucket, n)


def realign(labels: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Label rows that still have a feature row."""
    return labels.join(rows.select(key), key, "left_semi")


def map_mitre(df: DataFrame, threat: str, port: str, rules: Sequence[tuple] = MITRE_RULES,
              default: tuple[str, str, str] = MITRE_DEFAULT) -> DataFrame:
    """First rule whose class text is contained and whose port is open or equal.

    The rule list is configuration, so it compiles to one CASE expression:
    first match wins by construction and no join is needed.
    """
    def outcome(tactic: str, technique: str, name: str) -> Column:
        return F.struct(F.lit(tactic).alias("tactic"), F.lit(technique).alias("technique_id"),
                        F.lit(name).alias("technique_name"))

    chain = None
    for text, rule_port, *target in rules:
        hit = F.lower(q(threat)).contains(text.lower())
        if rule_port is not None:
            hit = hit & (q(port) == F.lit(rule_port))
        chain = F.when(hit, outcome(*target)) if chain is None else chain.when(hit, outcome(*target))
    mapped = chain.otherwise(outcome(*default)) if chain is not None else outcome(*default)
    return df.withColumn("mitre", mapped)


def consumer_lag(batch: DataFrame, ends: DataFrame) -> DataFrame:
    """Messages behind the end of each partition; partitions without an end count 0."""
    seen = batch.groupBy("partition").agg(F.max("offset").alias("max_offset"))
    return seen.join(ends, "partition", "left").select(
        "partition", F.greatest(
            F.coalesce("end_offset", F.lit(0)) - (F.col("max_offset") + 1), F.lit(0)).alias("lag"))


def total_lag(batch: DataFrame, ends: DataFrame) -> DataFrame:
    return consumer_lag(batch, ends).agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("consumer_lag_messages"))


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """Metric table of two runs with delta, relative change and advice.

    Both inputs are ``(metric, value)``; advice follows the change of ``f1_attack``.
    """
    joined = base.select("metric", F.col("value").alias("base_value")).join(
        other.select("metric", F.col("value").alias("other_value")), "metric")
    delta = F.col("other_value") - F.col("base_value")
    # The two advice texts.
    advice = F.when(F.col("metric") == "f1_attack", F.when(delta >= 0, "use_multiclass_now")
                    .otherwise("keep_binary_plus_rules_fallback"))
    return joined.select("metric", "base_value", "other_value", delta.alias("delta"),
                         F.try_divide(-delta, F.col("base_value")).alias("relative_degradation"),
                         advice.alias("recommendation"))


def head_to_head(metrics: DataFrame, systems: Sequence[str]) -> DataFrame:
    """``(system, metric, value)`` rows to one row per metric and a column per system."""
    return metrics.groupBy("metric").pivot("system", list(systems)).agg(F.max("value"))


def disagreement(production: DataFrame, shadow: DataFrame, key: str, decision: str) -> DataFrame:
    """Share of common keys on which two systems decide differently."""
    both = production.select(key, q(decision).alias("_p")).join(shadow.select(key, q(decision).alias("_s")), key)
    return both.agg(F.count(F.lit(1)).alias("compared"),
                    F.avg((~F.col("_p").eqNullSafe(F.col("_s"))).cast("int")).alias("disagreement_rate"))

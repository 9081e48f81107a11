"""Questions on run reports: ``(prefix, run_ts, payload)`` with a JSON payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.contract import MODEL_TARGETS
from flowlens.sources.store import get_params, latest_report

RESULT_FIELDS = (
    "name string, precision_attack double, recall_attack double, f1_attack double, selected_threshold double, "
    "preset string, k95 int, k99 int, total_s double")
PAYLOAD = (
    f"results array<struct<{RESULT_FIELDS.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>, "
    "best_by_f1_attack string, train_rows bigint, validation_rows bigint, scale_pos_weight double, "
    "feature_count bigint, total_rows_available bigint, base_scale_pos_weight double, timestamp string, run_timestamp string, "
    "recommendation string, host string, generated_at string, max_profile_eps double, bottleneck_hint string, "
    "labels_evaluated array<string>, gate_result struct<pass:boolean>, "
    "profiles array<struct<profile:string,rows:bigint,producer_eps:double,consumer_processed_rate_eps:double>>")
# What a report of each kind means, and of any other.
MEANINGS = {
    "pca_full_comparison": "PCA component stability across fast/balanced/full scales.",
    "xgb_feature_set_ablation": "Hybrid combo (10+25) selected as strongest tested feature set.",
    "recall_recovery_experiments": "Threshold tuning helped recall; aggressive class-weight sweeps degraded.",
    "benchmark_full_plan": "Full industry-style benchmark matrix for ramp/burst/soak/recovery.",
}
OTHER_MEANING = "Captured run artifact."
# Fixed value: the feature set the final status reports on.
SELECTED = "combo_targeted10_pca25"


def parsed(reports: DataFrame) -> DataFrame:
    return reports.withColumn("p", F.from_json("payload", PAYLOAD))


def _named_or_last(results: Column, name: Column) -> Column:
    """Result with the given name, else the last one, else NULL."""
    named = F.filter(results, lambda r: r["name"] == name)
    return F.coalesce(F.get(named, F.lit(0)), F.when(F.size(results) > 0, F.element_at(results, -1)))


def ablation_choice(reports: DataFrame) -> DataFrame:
    """Fields of the selected result in the newest ablation report (one row, or none)."""
    newest = parsed(latest_report(reports, "xgb_feature_set_ablation"))
    chosen = _named_or_last(F.col("p.results"), F.lit(SELECTED))
    return newest.select(chosen.alias("s")).select("s.*")


def final_status(reports: DataFrame, params: DataFrame, targets: dict[str, float] = MODEL_TARGETS) -> DataFrame:
    """Precision, recall, F1 and threshold of the selected model against the targets.

    Metrics come from the ablation report, else from the parameter store; the
    threshold the other way round; 0 when neither has a value.
    """
    stored = get_params(params).agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
        for k in ("multiclass_precision_attack", "multiclass_recall_attack", "validation_f1_attack_binary",
                  "classification_threshold", "pca_k", "pca_variance_retained")])
    choice = ablation_choice(reports).agg(*[
        F.max(c).alias(c) for c in ("precision_attack", "recall_attack", "f1_attack", "selected_threshold")])
    picked = stored.withColumns({
        f"_{c}": choice.select(c).scalar()
        for c in ("precision_attack", "recall_attack", "f1_attack", "selected_threshold")})
    out = picked.select(
        F.coalesce("_precision_attack", "multiclass_precision_attack", F.lit(0.0)).alias("precision_attack"),
        F.coalesce("_recall_attack", "multiclass_recall_attack", F.lit(0.0)).alias("recall_attack"),
        F.coalesce("_f1_attack", "validation_f1_attack_binary", F.lit(0.0)).alias("f1_attack"),
        F.coalesce("classification_threshold", "_selected_threshold", F.lit(0.0)).alias("threshold"),
        "pca_k", "pca_variance_retained")
    return out.withColumns({f"{k.split('_')[0]}_pass": F.col(k) >= v for k, v in targets.items()})


def model_eval(reports: DataFrame) -> DataFrame:
    """The newest multiclass evaluation; without one, the best result of the newest ablation."""
    kinds = F.when(F.col("prefix") == "multiclass_eval", 0).otherwise(1)
    newest = parsed(latest_report(reports.filter(
        F.col("prefix").isin("multiclass_eval", "xgb_feature_set_ablation"))))
    best = _named_or_last(F.col("p.results"), F.col("p.best_by_f1_attack"))
    is_multi = F.col("prefix") == "multiclass_eval"
    return newest.orderBy(kinds).limit(1).select(
        F.when(is_multi, "multiclass").otherwise("binary").alias("type"),
        F.when(is_multi, F.array_join("p.labels_evaluated", ",")).otherwise("benign,attack").alias("labels"),
        F.when(is_multi, F.col("p.gate_result.pass")).alias("gate_pass"),
        F.when(~is_multi, best["name"]).alias("best_name"), F.when(~is_multi, best["f1_attack"]).alias("f1_attack"))


def catalog(reports: DataFrame) -> DataFrame:
    """One row per report: kind, file name, and what it configured, found and means.

    ``config`` and ``result`` are JSON texts whose fields depend on the kind.
    """
    p = "p."
    kind = F.col("prefix")
    # Fixed values below: the report kinds and the keys of their texts.

    def js(**fields: Column | str) -> Column:
        return F.to_json(F.struct(*[
            (F.col(p + v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))

    def each(column: str, field: str) -> Column:
        return F.transform(F.col(p + column), lambda r: r[field])

    def listed(field: str) -> Column:
        return F.coalesce(F.get_json_object("payload", f"$.{field}"), F.lit("[]"))

    scores = F.transform(F.col("p.results"), lambda r: F.struct(
        *[r[c].alias(c) for c in ("name", "precision_attack", "recall_attack", "f1_attack")]))
    profiles = F.transform(F.col("p.profiles"), lambda r: F.struct(
        r["profile"].alias("profile"), r["rows"].alias("rows"), r["producer_eps"].alias("producer_eps"),
        r["consumer_processed_rate_eps"].alias("consumer_eps")))
    config = (
        F.when(kind == "pca_full_comparison", js(feature_count="feature_count",
               total_rows_available="total_rows_available", presets=each("results", "preset")))
        .when(kind == "xgb_feature_set_ablation", js(train_rows="train_rows", validation_rows="validation_rows",
              scale_pos_weight="scale_pos_weight"))
        .when(kind == "recall_recovery_experiments", js(base_scale_pos_weight="base_scale_pos_weight",
              train_rows="train_rows"))
        .when(kind == "multiclass_vs_binary", js(run_timestamp="run_timestamp"))
        .when(kind == "benchmark_baseline", js(host="host", generated_at="generated_at"))
        .when(kind == "benchmark_full_plan", F.get_json_object("payload", "$.inputs"))
        .otherwise(js(timestamp="timestamp", run_timestamp="run_timestamp", generated_at="generated_at")))
    result = (
        F.when(kind == "pca_full_comparison", js(k95_values=each("results", "k95"),
               k99_values=each("results", "k99"), total_time_s=each("results", "total_s")))
        .when(kind == "xgb_feature_set_ablation", js(best_by_f1_attack="best_by_f1_attack", scores=scores))
        .when(kind == "recall_recovery_experiments", F.concat(
            F.lit('{"threshold_sweep":'), listed("threshold_sweep_hybrid"),
            F.lit(',"scale_pos_weight_sweep":'), listed("scale_pos_weight_sweep_hybrid_at_t005"), F.lit("}")))
        .when(kind == "multiclass_vs_binary", F.get_json_object("payload", "$.comparison"))
        .when(kind == "benchmark_baseline", js(max_profile_eps="max_profile_eps", profiles=profiles))
        .when(kind == "benchmark_full_plan", F.get_json_object("payload", "$.phases"))
        .otherwise(F.to_json(F.struct(F.slice(F.json_object_keys("payload"), 1, 12).alias("keys")))))
    meaning = F.when(kind == "multiclass_vs_binary", F.coalesce("p.recommendation", F.lit(""))).when(
        kind == "benchmark_baseline", F.coalesce("p.bottleneck_hint", F.lit("")))
    for name, text in MEANINGS.items():
        meaning = meaning.when(kind == name, text)
    return parsed(reports).select(
        kind.alias("test_name"), F.concat("prefix", F.lit("_"), "run_ts", F.lit(".json")).alias("file"),
        config.alias("config"), result.alias("result"), meaning.otherwise(OTHER_MEANING).alias("inference"))


def filter_catalog(entries: DataFrame, kind: str = "all", date: str = "", text: str = "") -> DataFrame:
    """Entries of a kind whose file name holds ``date`` and whose whole record holds ``text``."""
    out = entries
    if kind != "all":
        out = out.filter(F.col("test_name") == kind)
    if date:
        out = out.filter(F.col("file").contains(date))
    if text:
        record = F.lower(F.to_json(F.struct(*entries.columns)))
        out = out.filter(record.contains(text.lower()))
    return out

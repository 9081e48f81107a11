"""Detection metrics, threshold choice, curves, calibration and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.contract import BENIGN, CLASS_F1_TARGETS, FPR_TARGET
from flowlens.functions.values import masked_argmax
from flowlens.operators.clean import q
from flowlens.operators.ordered import bin_of, running_total
from flowlens.session import materialize


def grid(first: int, last: int, step: int = 1, unit: int = 100) -> list[float]:
    """Thresholds ``first/unit .. last/unit``; from whole numbers, so no drift."""
    return [i / unit for i in range(first, last + 1, step)]


# Threshold grids.
GRID_PRECISION = grid(30, 94)
GRID_ABLATION = grid(5, 95)
GRID_RECALL = grid(1, 50)
GRID_RECOVERY = [0.05, 0.10, 0.15, 0.30]


def _zero(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))


def _rates(tp: Column, flagged: Column, positives: Column) -> list[Column]:
    """Precision, recall and F1, all 0 on empty denominators."""
    return [_zero(tp, flagged).alias("precision"), _zero(tp, positives).alias("recall"),
            _zero(2 * tp, flagged + positives).alias("f1")]


def pos_weight(df: DataFrame, y: str) -> DataFrame:
    counts = df.agg(F.count_if(q(y) == 0).alias("benign"), F.count_if(q(y) == 1).alias("attack"))
    return counts.select("benign", "attack", (
        F.col("benign") / F.greatest("attack", F.lit(1))).alias("scale_pos_weight"))


def prf(df: DataFrame, y: str, yhat: str) -> DataFrame:
    counts = df.agg(F.count_if((q(y) == 1) & (q(yhat) == 1)).alias("tp"),
                    F.count_if(q(yhat) == 1).alias("flagged"), F.count_if(q(y) == 1).alias("positives"))
    return counts.select("tp", "flagged", "positives",
                         *_rates(F.col("tp"), F.col("flagged"), F.col("positives")))


def fpr(df: DataFrame, y: str, yhat: str, target: float = FPR_TARGET) -> DataFrame:
    counts = df.agg(F.count_if((q(y) == 0) & (q(yhat) == 1)).alias("fp"), F.count_if(q(y) == 0).alias("negatives"))
    return counts.select("fp", "negatives", _zero(F.col("fp"), F.col("negatives")).alias("fpr")).withColumn(
        "within_target", F.col("fpr") < target)


def confusion_counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(q(y).alias("actual"), q(yhat).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def all_labels(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Union of true and predicted labels, from the small confusion table."""
    pairs = confusion_counts(df, y, yhat)
    return pairs.select(F.explode(F.array("actual", "predicted")).alias("label")).filter(
        "label is not null").distinct()


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Full confusion table: every pair of known labels, absent pairs as 0.

    The labels are gathered once per actual label, so the completion is bounded
    by classes x classes and is no join of two tables.
    """
    pairs = confusion_counts(df, y, yhat)
    labels = pairs.select(F.explode(F.array("actual", "predicted")).alias("l")).filter("l is not null")
    known = labels.agg(F.sort_array(F.collect_set("l"))).scalar()
    full = labels.distinct().select(F.col("l").alias("actual"), F.explode(known).alias("predicted"))
    return full.join(pairs, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_matrix(df: DataFrame, y: str, yhat: str, labels: Sequence[str]) -> DataFrame:
    return confusion(df, y, yhat).groupBy("actual").pivot("predicted", list(labels)).agg(F.max("n"))


def class_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Per class precision, recall, F1 and support, plus accuracy, macro and weighted rows."""
    pairs = confusion_counts(df, y, yhat)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                 .otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("flagged"), F.col("n").alias("support")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.col("n").alias("flagged"), F.lit(0).cast("bigint").alias("support")))).alias("s")).select("s.*")
    per = sides.filter("label is not null").groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("flagged").alias("flagged"), F.sum("support").alias("support"))
    rows = per.select("label", *_rates(F.col("tp"), F.col("flagged"), F.col("support")), "support", "tp")
    means = rows.agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[_zero(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
          for m in ("precision", "recall", "f1")])
    accuracy = _zero(F.col("tp"), F.col("support"))
    summary = means.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(m) for m in ("precision", "recall", "f1")],
                 F.col("support")),
        *[F.struct(F.lit(f"{kind} avg").alias("label"),
                   *[F.col(f"{kind}_{m}").alias(m) for m in ("precision", "recall", "f1")], F.col("support"))
          for kind in ("macro", "weighted")])).alias("s")).select("s.*")
    return rows.drop("tp").unionByName(summary)


def target_status(report: DataFrame, targets: dict[str, float] = CLASS_F1_TARGETS) -> DataFrame:
    """F1 target per class and whether it is met; classes without a target are left out."""
    table = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    return report.withColumn("target", F.try_element_at(table, F.col("label"))).filter(
        "target is not null").select("label", "f1", "target", (F.col("f1") > F.col("target")).alias("passed"))


def threshold_sweep(df: DataFrame, y: str, p: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 for every threshold from one aggregate over the rows.

    A row is counted in the bin of the largest threshold it reaches; the totals
    per threshold are sums over the bins from the top. Rows whose score is NULL
    or NaN are never flagged, but their positives count as missed.
    """
    points = sorted(set(thresholds))
    work = df.select(q(y).alias("_y"), F.nullif(q(p).cast("double"), F.lit(float("nan"))).alias("_p"))
    bins = work.withColumn("_bin", F.when(F.col("_p").isNull(), 0).otherwise(bin_of("_p", points))).groupBy("_bin").agg(
        F.count_if((F.col("_y") == 1) & F.col("_p").isNotNull()).alias("tp"), F.count("_p").alias("flagged"),
        F.count_if((F.col("_y") == 1)).alias("pos"))
    table = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate([None, *points])], "_bin int, threshold double")
    full = table.join(bins, "_bin", "left").fillna(0, ["tp", "flagged", "pos"])
    # Bounded: one row per threshold.
    above = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = full.select("threshold", F.sum("tp").over(above).alias("tp"),
                         F.sum("flagged").over(above).alias("flagged"),
                         F.sum("pos").over(everything).alias("positives"))
    return totals.filter("threshold is not null").select(
        "threshold", "tp", "flagged", "positives", *_rates(F.col("tp"), F.col("flagged"), F.col("positives")))


def pick_threshold(sweep: DataFrame, policy: str, floor: float | None = None) -> DataFrame:
    """One operating point; the lowest threshold wins a tie.

    ``max_f1``: best F1 with precision >= .95, else best (precision, F1).
    ``max_recall``: best recall with precision >= .95, else best (precision, recall).
    ``recall_first``: best (recall, F1, precision) with precision >= .85, else the same over all.
    """
    rules = {
        "max_f1": (0.95, ["f1"], ["precision", "f1"]),
        "max_recall": (0.95, ["recall"], ["precision", "recall"]),
        "recall_first": (0.85, ["recall", "f1", "precision"], ["recall", "f1", "precision"]),
    }
    default, best, fallback = rules[policy]
    valid = F.col("precision") >= (default if floor is None else floor)
    if policy == "max_recall":
        valid = valid & (F.col("recall") > 0)
    order = [F.desc("valid")]
    order += [F.when(F.col("valid"), F.col(c)).desc_nulls_last() for c in best]
    order += [F.col(c).desc() for c in fallback]
    return sweep.withColumn("valid", valid).orderBy(*order, F.asc("threshold")).limit(1)


def multiclass_scores(df: DataFrame, probs: str, benign_index: int) -> DataFrame:
    """Add the largest non-benign probability and its class."""
    best, position = masked_argmax(q(probs), benign_index)
    return df.withColumn("attack_prob", best).withColumn("attack_class", position)


def multiclass_point(df: DataFrame, y: str, probs: str, benign_index: int, floor: float = 0.85,
                     thresholds: Sequence[float] = GRID_ABLATION) -> DataFrame:
    """Operating point of a multiclass model: recall-first at a precision floor."""
    scored = multiclass_scores(df, probs, benign_index).withColumn(
        "_attack", (~q(y).eqNullSafe(F.lit(benign_index))).cast("int"))
    return pick_threshold(threshold_sweep(scored, "_attack", "attack_prob", thresholds), "max_recall", floor)


def multiclass_decision(df: DataFrame, probs: str, benign_index: int, threshold: float) -> DataFrame:
    scored = multiclass_scores(df, probs, benign_index)
    return scored.withColumn("predicted", F.when(F.col("attack_prob") >= threshold, F.col("attack_class"))
                             .otherwise(F.lit(benign_index)))


def class_gate(report: DataFrame) -> DataFrame:
    """Per-class recall floor: 0.50 from 1,000 rows of support, else 0.05."""
    classes = report.filter(~F.col("label").isin("accuracy", "macro avg", "weighted avg"))
    needed = F.when(F.col("support") >= 1000, 0.50).otherwise(0.05)
    return classes.select("label", "support", "recall", needed.alias("required_recall"),
                          (F.col("recall") >= needed).alias("passed"))


def gate_result(gate: DataFrame) -> DataFrame:
    """Overall verdict and the failed classes (bounded by the number of classes)."""
    return gate.agg(F.bool_and("passed").alias("passed"), F.array_join(F.sort_array(
        F.collect_list(F.when(~F.col("passed"), F.col("label")))), ",").alias("failed_classes"))


def label_recall(df: DataFrame, label: str, p: str, threshold: float) -> DataFrame:
    """Recall per original label; BENIGN has no attacks and scores 0."""
    caught = F.count_if(q(p) >= threshold)
    return df.groupBy(q(label).alias("label")).agg(F.count(F.lit(1)).alias("support"), caught.alias("caught")).select(
        "label", "support", F.when(F.col("label").eqNullSafe(F.lit(BENIGN)), 0.0)
        .otherwise(F.col("caught") / F.col("support")).alias("recall"))


def winner(metrics: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Best row by the keys in order; the first name wins a full tie."""
    return metrics.orderBy(*[F.desc(k) for k in keys], F.asc(name)).limit(1)


def score_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.filter(q(p).isNotNull()).groupBy(q(p).cast("double").alias("threshold")).agg(
        F.count_if(q(y) == 1).alias("pos"), F.count_if(q(y) != 1).alias("neg"))


def curves(df: DataFrame, y: str, p: str) -> DataFrame:
    """ROC and precision-recall point of every distinct score, with the previous ROC point.

    ``tp0``/``fp0`` are the counts of the next higher score, so areas need no
    second ordered pass.
    """
    counts = materialize(score_counts(df, y, p))
    c = running_total(counts, "threshold", ["pos", "neg"], descending=True)
    return c.select("threshold", F.col("pos_before").alias("tp0"), F.col("neg_before").alias("fp0"),
                    (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"),
                    F.col("pos_all").alias("positives"), F.col("neg_all").alias("negatives"))


def roc_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    return curves(df, y, p).select("threshold", _zero(F.col("fp"), F.col("negatives")).alias("fpr"),
                                   _zero(F.col("tp"), F.col("positives")).alias("tpr"))


def pr_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    return curves(df, y, p).select("threshold", _zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                                   _zero(F.col("tp"), F.col("positives")).alias("recall"))


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Trapezoid areas under both curves; the precision-recall curve starts at (0, 1)."""
    c = curves(df, y, p)
    roc = (F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2.0
    before = F.when(F.col("tp0") + F.col("fp0") == 0, 1.0).otherwise(
        _zero(F.col("tp0"), F.col("tp0") + F.col("fp0")))
    pr = (F.col("tp") - F.col("tp0")) * (_zero(F.col("tp"), F.col("tp") + F.col("fp")) + before) / 2.0
    sums = c.agg(F.sum(roc).alias("r"), F.sum(pr).alias("a"), F.max("positives").alias("pos"),
                 F.max("negatives").alias("neg"))
    return sums.select(F.try_divide(F.col("r"), F.col("pos").cast("double") * F.col("neg")).alias("roc_auc"),
                       F.try_divide(F.col("a"), F.col("pos").cast("double")).alias("pr_auc"))


def accuracy(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.avg(q(y).eqNullSafe(q(yhat)).cast("int")).alias("accuracy"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean confidence and hit rate per equal-width bin; 1.0 falls in the last bin."""
    place = F.least(F.floor(q(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(q(p)).alias("confidence"), F.avg(q(y).cast("double")).alias("hit_rate"),
        F.sum(F.pow(q(p) - q(y), F.lit(2))).alias("square_error"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Brier score, expected and maximum calibration error."""
    gap = F.abs(F.col("hit_rate") - F.col("confidence"))
    return reliability(df, y, p, bins).agg(
        (F.sum("square_error") / F.sum("n")).alias("brier"), (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"),
        F.max(gap).alias("mce"))


# Fixed values: (true class, wrong destination, severity score).
SEVERITY = (
    ("Identity Compromise", "DEFAULT_QUEUE", 1),
    ("Network Exfiltration", "IDENTITY_CURATOR", 5),
    ("Identity Compromise", "ENDPOINT_CURATOR", 8),
    ("Ransomware (Endpoint)", "IDENTITY_CURATOR", 10),
)
SEVERITY_DEFAULT = 6


def severity_error(df: DataFrame, y: str, yhat: str, penalties: Sequence[tuple] = SEVERITY,
                   default: int = SEVERITY_DEFAULT, severe: int = 8, scale: float = 10.0) -> DataFrame:
    """Mean severity of wrong routes on a 0-1 scale, and the share of severe ones.

    ``penalties`` lists (true, predicted, score); other wrong pairs get ``default``.
    """
    score = F.when(q(y).eqNullSafe(q(yhat)), 0)
    for true, predicted, points in penalties:
        score = score.when((q(y) == F.lit(true)) & (q(yhat) == F.lit(predicted)), points)
    return df.select(score.otherwise(default).alias("s")).agg(
        (F.avg("s") / scale).alias("severity_weighted_error"),
        F.avg((F.col("s") >= severe).cast("int")).alias("severe_rate"),
        F.count_if(F.col("s") >= scale).alias("critical_misses"))


def share_gate(df: DataFrame, label: str, floors: dict[str, float], ceiling: float = 0.5) -> DataFrame:
    """Share of each class against its floor and the common ceiling; absent classes count 0."""
    counts = df.groupBy(q(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    asked = df.sparkSession.createDataFrame(list(floors.items()), "label string, floor double")
    share = F.coalesce(F.col("n") / total, F.lit(0.0))
    table = counts.join(asked, "label", "full")
    return table.select("label", share.alias("share"), F.coalesce("floor", F.lit(0.0)).alias("floor")).withColumn(
        "passed", (F.col("share") >= F.col("floor")) & (F.col("share") <= ceiling))

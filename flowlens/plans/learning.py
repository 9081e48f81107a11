"""Feature and model queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.models import boosting, detectors, experiments, features as fx
from flowlens.operators import evaluate as ev
from flowlens.plans import adapters as a
from flowlens.plans.registry import Tables, query, rounded
from flowlens.session import materialize

D = (a.FLOWS, a.DIRTY)
VALUES = ["flow_duration", "total_fwd_packets", "flow_iat_mean"]
POOL = [c for c in a.FEATURES if c not in a.TARGETED]
DIMS = 64
FIT = {"max_iter": 3, "max_depth": 3}
_FINITE = "CASE WHEN isnan(flow_duration) OR isinf(flow_duration) THEN NULL ELSE flow_duration END"


@query("i01_impute", f"""SELECT row_key, coalesce(x, (SELECT quantile_cont(y, 0.5) FROM (SELECT {_FINITE} AS y FROM dirty)))
  AS flow_duration FROM (SELECT row_key, {_FINITE} AS x FROM dirty)""", D)
def impute(t: Tables) -> DataFrame:
    return fx.impute(a.dirty(t).select("row_key", "flow_duration"), ["flow_duration"])


_Z = ", ".join(f"round(({c} - (SELECT avg({c}) FROM flows)) / (SELECT stddev_pop({c}) FROM flows), 6) + 0.0 AS {c}" for c in VALUES)


@query("i02_standardize", f"SELECT row_key, {_Z} FROM flows", (a.FLOWS,))
def standardize(t: Tables) -> DataFrame:
    return rounded(fx.standardize(a.flows(t).select("row_key", *VALUES), VALUES), *VALUES)


_MM = ", ".join(f"round(({c} - (SELECT min({c}) FROM flows)) / ((SELECT max({c}) FROM flows) - (SELECT min({c}) FROM flows)), 6) AS {c}"
                for c in VALUES)


@query("i03_min_max", f"SELECT row_key, {_MM} FROM flows", (a.FLOWS,))
def min_max(t: Tables) -> DataFrame:
    return rounded(fx.min_max(a.flows(t).select("row_key", *VALUES), VALUES), *VALUES)


def wide(t: Tables) -> tuple[DataFrame, list[str]]:
    """Embedding vectors as 64 numeric columns."""
    names = [f"v{i}" for i in range(DIMS)]
    e = t.table("embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query("i04_pca_projection")
def pca_projection(t: Tables) -> DataFrame:
    df, names = wide(t)
    stages, _ = fx.pca_stages(df, names, 10)
    values = vector_to_array(F.col("pca"))
    return PipelineModel(stages).transform(df).select("vec_id", *[values[i].alias(f"pc{i + 1}") for i in range(10)])


@query("i05_explained_variance")
def explained_variance(t: Tables) -> DataFrame:
    df, names = wide(t)
    _, model = fx.pca_stages(df, names, len(names))
    return fx.explained(model, t.spark).withColumns({
        "k95": F.lit(fx.components_for(model, 0.95)), "k99": F.lit(fx.components_for(model, 0.99))})


@query("i06_top_loadings")
def top_loadings(t: Tables) -> DataFrame:
    df, names = wide(t)
    _, model = fx.pca_stages(df, names, 2)
    return fx.top_loadings(model, names, t.spark)


@query("i06_projection_sample")
def projection_sample(t: Tables) -> DataFrame:
    df, names = wide(t)
    stages, _ = fx.pca_stages(df, names, 3)
    return fx.projection(df, stages, "vec_id", 200, dims=3)


@query("i07_sample_stability")
def sample_stability(t: Tables) -> DataFrame:
    n = t.table("lineitem").count()
    return fx.sample_stability(a.flows(t), "row_key", a.FEATURES, {"fast": n // 6, "balanced": n // 2, "full": n})


def binary(t: Tables) -> DataFrame:
    return a.flows(t).withColumn("y", (F.col("label") != "BENIGN").cast("int"))


def day_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    f = binary(t)
    return f.filter(~a.is_validation()), f.filter(a.is_validation())


@query("i08_hybrid_space")
def hybrid_space(t: Tables) -> DataFrame:
    train, validation = day_split(t)
    stages = fx.hybrid_space(train, a.TARGETED, POOL, 4)
    return PipelineModel(stages).transform(validation).select(
        "row_key", "label", "y", vector_to_array("features").alias("features"))


@query("i09_binary_detector")
def binary_detector(t: Tables) -> DataFrame:
    train, validation = day_split(t)
    model = detectors.fit_binary(train, fx.raw_space(train, a.FEATURES), **FIT)
    return ev.threshold_sweep(detectors.score(model, validation), "y", "p", ev.GRID_ABLATION)


@query("i10_multiclass_detector")
def multiclass_detector(t: Tables) -> DataFrame:
    train, validation = day_split(t)
    model, codes = detectors.fit_multiclass(train, fx.raw_space(train, a.FEATURES), "label", trees=5, max_depth=4)
    scored = materialize(detectors.score_multiclass(model, validation).select("label", "probs"))  # read twice
    benign = codes["BENIGN"]
    coded = scored.withColumn("cls", F.when(F.col("label") == "BENIGN", benign).otherwise(-1))
    point = ev.multiclass_point(coded, "cls", "probs", benign).first()
    decided = ev.multiclass_decision(scored, "probs", benign, point["threshold"])
    names = F.array(*[F.lit(c) for c in sorted(codes, key=codes.get)])
    return ev.class_report(decided.withColumn("predicted_label", F.get(names, "predicted")), "label", "predicted_label")


@query("i11_ablation")
def ablation(t: Tables) -> DataFrame:
    train, validation = day_split(t)
    return experiments.ablation(train, validation, a.TARGETED, POOL, 4, **FIT)


@query("i12_recall_recovery")
def recall_recovery(t: Tables) -> DataFrame:
    train, validation = day_split(t)
    return experiments.recall_recovery(train, validation, a.TARGETED, POOL, **boosting.FULL_RECOVERY)


@query("i13_high_recall")
def high_recall(t: Tables) -> DataFrame:
    from flowlens.operators.split import grouped_split
    # written once: the split hashes every key, and each candidate reads its sides several times
    parts = materialize(grouped_split(binary(t), "row_key", ["label", "source_file"], dedup_before_split=False))
    train, validation = parts.filter("split = 'train'"), parts.filter("split = 'validation'")
    stress = binary(t).filter(a.is_validation())
    return experiments.high_recall(train, validation, stress, a.TARGETED, POOL, **boosting.FULL_BINARY)[0]


@query("i14_forest_importance")
def forest_importance(t: Tables) -> DataFrame:
    return experiments.forest_importance(a.flows(t), a.FEATURES, "label", "row_key", trees=3, max_depth=4)[0]


@query("i15_bakeoff")
def bakeoff(t: Tables) -> DataFrame:
    return experiments.bakeoff(binary(t), a.FEATURES, "y", "row_key")


_KNN = """SELECT vec_id, CAST(arg_min(label, (-n, label)) AS INTEGER) AS predicted FROM (SELECT q AS vec_id, label, count(*) AS n FROM (
  SELECT a.vec_id AS q, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn
  FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id) WHERE rn <= 5 GROUP BY ALL) GROUP BY vec_id"""


@query("i16_knn_vote", _KNN, ("vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",))
def knn_vote(t: Tables) -> DataFrame:
    e = t.table("embeddings")
    return detectors.knn_vote(e, e, "vec_id", "embedding", "label", 5, exclude_self=True)


@query("i17_learning_curve")
def learning_curve(t: Tables) -> DataFrame:
    return experiments.learning_curve(binary(t), a.FEATURES, "y", "row_key", "logistic_regression")


@query("i19_score")
def score(t: Tables) -> DataFrame:
    train, validation = day_split(t)
    model = detectors.fit_binary(train, fx.hybrid_space(train, a.TARGETED, POOL, 4), **FIT)
    return detectors.score(model, validation.select("row_key", "label", *a.FEATURES)).select("row_key", "label", "p")


@query("k01_user_model", f"""SELECT row_key, round(1 / (1 + exp(-(total_fwd_packets - 25) / 10)), 6) AS p FROM flows""", (a.FLOWS,))
def user_model(t: Tables) -> DataFrame:
    import numpy as np

    def predict(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x[:, 0] - 25) / 10))

    rows = a.flows(t).select("row_key", "total_fwd_packets")
    return rounded(detectors.score_with(rows, ["total_fwd_packets"], predict).select("row_key", "p"), "p")

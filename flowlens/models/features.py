"""Fitted feature transforms as plain pipeline stages.

Medians are exact, and the scale is the population one; both enter the stages
as literals, so a fitted pipeline can be saved, loaded and run on a stream
without any Python in the data path.
"""

from __future__ import annotations

from collections.abc import Sequence
from time import perf_counter

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import PCA, ElementwiseProduct, PCAModel, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.values import finite
from flowlens.operators.clean import q
from flowlens.operators.ordered import first_rows
from flowlens.operators.quantiles import percentile_values
from flowlens.operators.split import sample_n, with_hash_order
from flowlens.session import materialize, release, reusable


def _number(x: float | None) -> str:
    return f"CAST('{x!r}' AS DOUBLE)" if x is not None else "CAST(0 AS DOUBLE)"


def _finite_sql(c: str) -> str:
    return f"CASE WHEN abs(`{c}`) < CAST('Infinity' AS DOUBLE) THEN CAST(`{c}` AS DOUBLE) END"


def _select_more(expressions: dict[str, str]) -> SQLTransformer:
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"{e} AS `{n}`" for n, e in expressions.items())
                          + " FROM __THIS__")


def medians(df: DataFrame, columns: Sequence[str], stored: bool = False) -> dict[str, float]:
    """Exact medians of the finite values; 0 for a column without any."""
    values = df.select(*[finite(q(c)).alias(c) for c in columns])
    return {c: (v[0] if v[0] is not None else 0.0) for c, v in percentile_values(values, columns, [0.5], stored=stored).items()}


def impute(df: DataFrame, columns: Sequence[str], fill: dict[str, float] | None = None) -> DataFrame:
    """Missing and non-finite values become the training median."""
    fill = fill or medians(df, columns)
    return df.withColumns({c: F.coalesce(finite(q(c)), F.lit(fill[c])) for c in columns})


def scale_values(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column scales by 1.

    The columns must be complete. They are summarised as one vector, so the
    cost of the plan does not grow with their number.
    """
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df).select("_v")
    stats = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    n = stats["count"]
    if not n:
        return {c: (0.0, 1.0) for c in columns}
    # The summary's variance is the sample one.
    spread = {c: float(np.sqrt(v * (n - 1) / n)) for c, v in zip(columns, stats["variance"])}
    return {c: (float(m), spread[c] if spread[c] > 1e-12 * abs(m) else 1.0) for c, m in zip(columns, stats["mean"])}


def standardize(df: DataFrame, columns: Sequence[str], fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    fitted = fitted or scale_values(df, columns)
    return df.withColumns({c: (q(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1]) for c in columns})


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0."""
    row = df.agg(*[F.struct(F.min(q(c)).alias("a"), F.max(q(c)).alias("b")).alias(str(i))
                   for i, c in enumerate(columns)]).first()

    def scaled(i: int, c: str):
        low, high = row[str(i)]["a"], row[str(i)]["b"]
        return (q(c) - F.lit(low)) / F.lit((high - low) or 1.0) if low is not None else q(c)

    return df.withColumns({c: scaled(i, c) for i, c in enumerate(columns)})


def scaled_vector_stages(train: DataFrame, columns: Sequence[str], output: str,
                         fill: dict[str, float] | None = None, stored: bool = False) -> list[Transformer]:
    """Impute and standardise in one SQL stage, then assemble. ``stored``: ``train`` is a written table."""
    train = train if stored else reusable(train.select(*[q(c) for c in columns]))
    fill = fill or medians(train, columns, stored=True)
    fitted = scale_values(impute(train, columns, fill), columns)
    names = {f"{c}__z": f"(coalesce({_finite_sql(c)}, {_number(fill[c])}) - {_number(fitted[c][0])}) / {_number(fitted[c][1])}"
             for c in columns}
    return [_select_more(names), VectorAssembler(inputCols=list(names), outputCol=output)]


def sign_vector(model: PCAModel) -> list[float]:
    """+1/-1 per component so that its largest loading is positive."""
    pc = model.pc.toArray()
    return [float(np.sign(pc[np.argmax(np.abs(pc[:, j])), j]) or 1.0) for j in range(pc.shape[1])]


def pca_stages(train: DataFrame, columns: Sequence[str], k: int, output: str = "pca",
               fill: dict[str, float] | None = None, stored: bool = False) -> tuple[list[Transformer], PCAModel]:
    """Impute, standardise, project; the covariance is one distributed aggregate. ``stored``: ``train`` is a written table."""
    train = train if stored else reusable(train.select(*[q(c) for c in columns]))
    stages = scaled_vector_stages(train, columns, f"{output}_in", fill, stored=True)
    scaled = PipelineModel(stages).transform(train).select(f"{output}_in")
    model = PCA(k=k, inputCol=f"{output}_in", outputCol=f"{output}_raw").fit(scaled)
    signs = ElementwiseProduct(scalingVec=Vectors.dense(sign_vector(model)), inputCol=f"{output}_raw", outputCol=output)
    return [*stages, model, signs], model


def explained(model: PCAModel, spark) -> DataFrame:
    """Component, its share of variance, and the running share (one row per component)."""
    share = model.explainedVariance.toArray()
    rows = [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(share, np.cumsum(share)))]
    return spark.createDataFrame(rows, "component int, explained_variance double, cumulative_variance double")


def components_for(model: PCAModel, target: float) -> int:
    """Fewest components that reach the target share; all of them when none do."""
    running = np.cumsum(model.explainedVariance.toArray())
    reached = np.nonzero(running >= target - 1e-12)[0]
    return int(reached[0]) + 1 if len(reached) else len(running)


def variance_at(model: PCAModel, k: int) -> float:
    running = np.cumsum(model.explainedVariance.toArray())
    return float(running[min(k, len(running)) - 1])


def top_loadings(model: PCAModel, columns: Sequence[str], spark, components: int = 2, k: int = 20) -> DataFrame:
    """Largest absolute loadings of the first components."""
    pc = model.pc.toArray()
    rows = [(f"PC{j + 1}", c, float(abs(pc[i, j]))) for j in range(min(components, pc.shape[1]))
            for i, c in enumerate(columns)]
    table = spark.createDataFrame(rows, "component string, feature string, abs_loading double")
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("abs_loading"), "feature"))
    return table.withColumn("place", place).filter(F.col("place") <= k)


def projection(df: DataFrame, stages: list[Transformer], key: str, n: int, dims: int = 2, output: str = "pca") -> DataFrame:
    """The first components of a reproducible sample of rows."""
    points = PipelineModel(stages).transform(sample_n(df, key, n))
    values = vector_to_array(F.col(output))
    return points.select(key, *[values[i].alias(f"pc{i + 1}") for i in range(dims)])


def sample_stability(df: DataFrame, key: str, columns: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    """Component counts and variance shares for growing samples, with stage times."""
    rows = []
    # keys are hashed once; every sample reads the written order
    ordered = materialize(with_hash_order(df.select(key, *[q(c) for c in columns]), key, seed=42))
    for name, n in sizes.items():
        sample = materialize(first_rows(ordered, "_order", "_bucket", n).select(*[q(c) for c in columns]))
        t0 = perf_counter()
        stages = scaled_vector_stages(sample, columns, "v", stored=True)
        t1 = perf_counter()
        model = PCA(k=len(columns), inputCol="v", outputCol="p").fit(PipelineModel(stages).transform(sample).select("v"))
        t2 = perf_counter()
        rows.append((name, n, components_for(model, 0.95), components_for(model, 0.99), variance_at(model, 1),
                     variance_at(model, 10), variance_at(model, 20), round(t1 - t0, 3), round(t2 - t1, 3), round(t2 - t0, 3)))
        release(sample)
    release(ordered)
    return df.sparkSession.createDataFrame(
        rows, "preset string, rows_asked long, k95 int, k99 int, pc1_var double, cum10 double, cum20 double, "
              "prepare_s double, pca_s double, total_s double")


def raw_space(train: DataFrame, columns: Sequence[str], output: str = "features",
              fill: dict[str, float] | None = None, stored: bool = False) -> list[Transformer]:
    """Imputed columns plus a missing flag for each column that has gaps in training. ``stored``: ``train`` is a written table."""
    train = train if stored else reusable(train.select(*[q(c) for c in columns]))
    fill = fill or medians(train, columns, stored=True)
    gaps = train.agg(*[F.max(finite(q(c)).isNull()).alias(str(i)) for i, c in enumerate(columns)]).first()
    names = {f"{c}__x": f"coalesce({_finite_sql(c)}, {_number(fill[c])})" for c in columns}
    names |= {f"{c}__gap": f"CAST(({_finite_sql(c)}) IS NULL AS DOUBLE)" for i, c in enumerate(columns) if gaps[str(i)]}
    return [_select_more(names), VectorAssembler(inputCols=list(names), outputCol=output)]


def pca_space(train: DataFrame, columns: Sequence[str], k: int, output: str = "features") -> list[Transformer]:
    stages, _ = pca_stages(train, columns, min(k, len(columns)))
    return [*stages, VectorAssembler(inputCols=["pca"], outputCol=output)]


def hybrid_space(train: DataFrame, targeted: Sequence[str], pool: Sequence[str], k: int = 25,
                 output: str = "features") -> list[Transformer]:
    """Targeted columns bypass the reduction; the rest goes through ``k`` components."""
    train = reusable(train.select(*[q(c) for c in [*targeted, *pool]]))
    fill = medians(train, [*targeted, *pool], stored=True)
    stages, _ = pca_stages(train, pool, min(k, len(pool)), fill=fill, stored=True)
    bypass = raw_space(train, targeted, "targeted", fill, stored=True)
    return [*stages, *bypass, VectorAssembler(inputCols=["targeted", "pca"], outputCol=output)]

"""Order-based building blocks that never sort one whole group in one task.

Ranks, running totals and "first n" need a global order. A plain window
partitioned by class would send the majority class (most of the rows) to a
single task. Here the order is cut into bins first: bin totals are a small
aggregate, and only rows of one bin meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import materialize

MAX_GROUPS = 10_000


def bin_count(df: DataFrame) -> int:
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8), 256)


def bounded_rows(df: DataFrame, limit: int = MAX_GROUPS) -> list:
    """Collect a summary that must be small; refuse when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"summary has more than {limit} rows")
    return rows


def _tree(low: int, high: int, value: str, split: Callable[[int], str]) -> str:
    if low == high:
        return str(low)
    mid = (low + high) // 2
    return (f"CASE WHEN {value} < {split(mid)} THEN {_tree(low, mid, value, split)} "
            f"ELSE {_tree(mid + 1, high, value, split)} END")


def bin_of(value: str, splits: Sequence[float]) -> Column:
    """Number of split points not above column ``value``; ``splits`` ascending.

    A balanced CASE expression: log2(n) comparisons, inside generated code.
    """
    return F.expr(_tree(0, len(splits), f"`{value}`", lambda i: f"{float(splits[i])!r}D"))


def range_splits(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> dict[tuple, list[float]]:
    """About ``bins`` equal-depth split points of ``column`` per group, on the driver."""
    probs = [i / bins for i in range(1, bins)]
    rows = bounded_rows(df.groupBy(*by).agg(
        F.percentile_approx(column, probs, 20 * bins).alias("_splits")))
    return {tuple(r[c] for c in by): sorted(set(r["_splits"] or [])) for r in rows}


def running_total(df: DataFrame, order: str, measures: Sequence[str], by: Sequence[str] = (),
                  descending: bool = False) -> DataFrame:
    """Add ``<m>_before``, the sum of measure ``m`` over smaller order values, and ``<m>_all``.

    ``df`` holds one row per group and order value (aggregate first). It is
    written once in ranges of (group, order value); totals per range give the
    offsets and a window runs inside each range, so a range is as large as a
    shuffle partition, whatever the number or size of the groups.
    """
    by = list(by)
    dealt = df.withColumn("_ord", -F.col(order) if descending else F.col(order)).repartitionByRange(*by, "_ord")
    work = materialize(dealt.withColumn("_bin", F.spark_partition_id()))
    keys = [f"_by{i}" for i in range(len(by))]
    totals = work.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("_bin").alias("_in")).agg(
        *[F.sum(m).alias(f"_t_{m}") for m in measures])
    earlier = Window.partitionBy(*keys).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_in",
        *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(Window.partitionBy(*keys)).alias(f"{m}_all") for m in measures])
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    inside = Window.partitionBy(*by, "_bin").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    out = work.join(offsets, [F.col("_bin") == F.col("_in"), *same])
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)))
    return out.drop("_ord", "_bin", "_in", *keys, *[f"_o_{m}" for m in measures])


def order_cutoffs(df: DataFrame, order: str, bucket: str, quota: Callable[[dict, int], int],
                  by: Sequence[str] = ()) -> dict[tuple, Column | None]:
    """Per group the order value (a literal) of its quota-th row, or None for a quota of 0.

    ``order`` is a unique sortable column and ``bucket`` a column that grows with
    it. ``quota(key, n)`` gives the wanted rows of a group with ``n`` rows. Two
    narrow passes: bucket counts, then a rank inside each group's border bucket.
    """
    by = list(by)
    # Bounded by groups x buckets; written once because sizes and borders both need it.
    counts = materialize(df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    sizes = {tuple(r[c] for c in by): r["n"] or 0 for r in bounded_rows(total)}
    wanted = {k: max(0, min(quota(dict(zip(by, k)), n), n)) for k, n in sizes.items()}
    cutoffs: dict[tuple, Column | None] = {k: None for k in wanted}
    asked = [(*k, w) for k, w in wanted.items() if w > 0]
    if not asked:
        return cutoffs
    names = [f"_k{i}" for i in range(len(by))]
    fields = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, by)]
    quotas = df.sparkSession.createDataFrame(asked, ", ".join([*fields, "_quota long"]))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)] or [F.lit(True)]
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    border = (
        counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(F.broadcast(quotas), same)  # bounded by MAX_GROUPS
        .filter((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("n") >= F.col("_quota")))
        .select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(bucket).alias("_border"),
                (F.col("_quota") - F.col("_before")).alias("_left")))
    # One row per group, bounded by MAX_GROUPS.
    for r in bounded_rows(_placed(df, order, bucket, F.broadcast(border), by, same[: len(by)])):
        cutoffs[tuple(r[c] for c in by)] = _literal(r[order], df.schema[order].dataType)
    return cutoffs


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    return F.lit(value).cast(kind)


def with_cutoff_column(df: DataFrame, order: str, bucket: str, quota: Callable[[Column], Column], by: Sequence[str],
                       output: str) -> DataFrame:
    """Flag the first rows of each group, for any number of groups.

    ``quota`` maps the group's row count to the wanted rows. Bucket counts find
    each group's border bucket; only its rows are ranked, and the cut points
    are joined to the rows by group.
    """
    by = list(by)
    counts = materialize(df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n")))
    whole, earlier = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1)
    names = {c: f"_k{i}" for i, c in enumerate(by)}
    marks = counts.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(bucket).alias("_border"), "_n",
                          quota(F.sum("_n").over(whole)).alias("_quota"),
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    border = marks.filter((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") >= F.col("_quota"))).select(
        *names.values(), "_border", (F.col("_quota") - F.col("_before")).alias("_left"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    cuts = materialize(_placed(df, order, bucket, border, by, same).select(*names.values(), F.col(order).alias("_cut")))
    # A written table of one row per group: the planner knows its size.
    return df.join(cuts, same, "left").withColumn(output, F.coalesce(F.col(order) <= F.col("_cut"), F.lit(False))).drop(
        *names.values(), "_cut")


def _placed(df: DataFrame, order: str, bucket: str, border: DataFrame, by: Sequence[str], same: list[Column]) -> DataFrame:
    """The ``_left``-th row of each group's border bucket, ranked in ranges however many rows the bucket has."""
    near = df.select(*by, bucket, order).join(border, [*same, F.col(bucket) == F.col("_border")])
    return running_total(near.withColumn("_one", F.lit(1)), order, ["_one"], by).filter(F.col("_one_before") + 1 == F.col("_left"))


def within_cutoffs(cutoffs: dict[tuple, Column | None], order: str, by: Sequence[str] = ()) -> Column:
    """Predicate: the row is among the first of its group. Bounded by MAX_GROUPS literals."""
    by = list(by)
    if not by:
        cut = cutoffs.get(())
        return F.lit(False) if cut is None else F.col(order) <= F.lit(cut)
    known = {k: v for k, v in cutoffs.items() if v is not None}
    if not known:
        return F.lit(False)
    sep = "\x1f"
    key = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in by])
    table = F.create_map(*[
        F.lit(x) for k, v in known.items()
        for x in (sep.join("\x00" if p is None else str(p) for p in k), v)])
    return F.coalesce(F.col(order) <= F.try_element_at(table, key), F.lit(False))


def first_rows(df: DataFrame, order: str, bucket: str, n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, without gathering them in one task."""
    cut = order_cutoffs(df, order, bucket, lambda _k, _n: n)
    return df.filter(within_cutoffs(cut, order))

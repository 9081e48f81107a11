"""Splits and samples. Exact sizes, reproducible, and no class is gathered in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.contract import BENIGN
from flowlens.functions.values import hash_order
from flowlens.operators.clean import q
from flowlens.operators.ordered import (
    bin_count, bin_of, bounded_rows, first_rows, order_cutoffs, range_splits, with_cutoff_column, within_cutoffs)
from flowlens.session import materialize


def with_hash_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add ``_order`` (hash, then the key itself) and its 4,096-way bucket ``_bucket``."""
    digest = hash_order(q(key).cast("string"), seed)
    return df.withColumn("_order", F.concat_ws("|", digest, q(key).cast("string"))).withColumn(
        "_bucket", F.substring("_order", 1, 3))


def with_row_order(df: DataFrame, key: str, leading: str) -> DataFrame:
    """Add ``_order`` = (leading number, key), NULL first, and ``_bucket`` = a range bin of the leading number."""
    bins = bin_count(df)
    splits = range_splits(df, leading, bins).get((), [])
    return df.withColumn("_order", F.struct(q(leading).alias("leading"), q(key).alias("key"))).withColumn(
        "_bucket", F.when(q(leading).isNull(), -1).otherwise(bin_of(leading, splits)))


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("_order", "_bucket")


def half_even_share(n: Column, ratio: float) -> Column:
    """Held-out rows of a group: rounded share, at least 1 and at most n-1; none of a single row."""
    return F.when(n <= 1, 0).otherwise(F.greatest(F.lit(1), F.least(F.bround(n * F.lit(float(ratio))).cast("long"), n - 1)))


def grouped_split(df: DataFrame, key: str, by: Sequence[str], ratio: float = 0.2, seed: int = 42,
                  dedup_before_split: bool = True) -> DataFrame:
    """Add ``split`` = train/validation, stratified by the ``by`` columns in hash order.

    ``key`` identifies a row. With ``dedup_before_split`` rows that agree in
    everything but the key count once, so copies cannot sit on both sides.
    Groups may be of any number: their cut points are joined, not literals.
    """
    if dedup_before_split:
        rest = [c for c in df.columns if c != key]
        df = df.groupBy(*[q(c) for c in rest]).agg(F.min(q(key)).alias(key)).select(*[q(c) for c in df.columns])
        df = materialize(df)  # read three times below
    ordered = with_hash_order(df, key, seed)
    flagged = with_cutoff_column(ordered, "_order", "_bucket", lambda n: half_even_share(n, ratio), by, "_held")
    side = F.when(F.col("_held"), "validation").otherwise("train")
    return _plain(flagged.withColumn("split", side).drop("_held"))


def random_split(df: DataFrame, key: str, test_ratio: float, seed: int = 42) -> DataFrame:
    """Add ``split`` = train/test with exactly ``ceil(n * ratio)`` test rows."""
    ordered = with_hash_order(df, key, seed)
    cut = order_cutoffs(ordered, "_order", "_bucket", lambda _k, n: -int(-n * test_ratio // 1))
    return _plain(ordered.withColumn("split", F.when(within_cutoffs(cut, "_order"), "test").otherwise("train")))


def chronological_split(df: DataFrame, is_validation: Column) -> tuple[DataFrame, DataFrame]:
    return df.filter(~is_validation), df.filter(is_validation)


def head(df: DataFrame, key: str, leading: str, n: int) -> DataFrame:
    ordered = with_row_order(df, key, leading)
    return _plain(first_rows(ordered, "_order", "_bucket", n))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) in hash order, without replacement."""
    return _plain(first_rows(with_hash_order(df, key, seed), "_order", "_bucket", n))


def _staged(ordered: DataFrame, label: str, total: int, quotas: Callable[[dict[str | None, int]], dict]) -> DataFrame:
    """Class quotas first, then attack rows, then any rows, each in order, up to ``total``."""
    is_benign = q(label).eqNullSafe(F.lit(BENIGN))
    group = F.coalesce(q(label).cast("string"), F.lit("nan"))
    work = ordered.withColumn("_class", group)
    sizes = {r["_class"]: r["n"] for r in bounded_rows(work.groupBy("_class").agg(F.count(F.lit(1)).alias("n")))}
    plan, attack_target = quotas(sizes)
    taken = {c: min(plan.get(c, 0), n) for c, n in sizes.items()}
    cut = order_cutoffs(work, "_order", "_bucket", lambda k, _n: taken[k["_class"]], ["_class"])
    picked = within_cutoffs(cut, "_order", ["_class"])
    attacks_taken = sum(n for c, n in taken.items() if c != BENIGN)
    attacks_left = sum(n - taken[c] for c, n in sizes.items() if c != BENIGN)
    extra = max(min(attack_target - attacks_taken, attacks_left), 0)
    if extra:
        left = work.filter(~picked & ~is_benign)
        picked = picked | (~is_benign & within_cutoffs(
            order_cutoffs(left, "_order", "_bucket", lambda _k, _n: extra), "_order"))
    short = min(total, sum(sizes.values())) - sum(taken.values()) - extra
    if short > 0:
        left = work.filter(~picked)
        picked = picked | within_cutoffs(
            order_cutoffs(left, "_order", "_bucket", lambda _k, _n: short), "_order")
    return _plain(work.filter(picked).drop("_class"))


def pilot_sample(df: DataFrame, key: str, leading: str, label: str, n: int) -> DataFrame:
    """60 % benign, an equal share per attack class, topped up; always the first rows in row order."""
    def quotas(sizes: dict) -> tuple[dict, int]:
        benign = min(int(n * 0.6), sizes.get(BENIGN, 0))
        attack_target = max(n - benign, 0)
        attacks = [c for c in sizes if c != BENIGN]
        share = max(attack_target // max(len(attacks), 1), 1)
        plan = {c: share for c in attacks}
        # With more attack classes than places, only the first classes in name order get one.
        room = attack_target
        for c in sorted(attacks):
            plan[c] = min(share, room, sizes[c])
            room -= plan[c]
        return {**plan, BENIGN: benign}, attack_target

    return _staged(with_row_order(df, key, leading), label, n, quotas)


def class_sample(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded random 60/40 sample of benign and attack rows, topped up from the rest."""
    ordered = with_hash_order(df, key, seed)
    side = F.when(q(label).eqNullSafe(F.lit(BENIGN)), BENIGN).otherwise("attack")

    def quotas(sizes: dict) -> tuple[dict, int]:
        benign = min(int(n * 0.6), sizes.get(BENIGN, 0))
        return {BENIGN: benign, "attack": max(n - benign, 0)}, max(n - benign, 0)

    return _staged(ordered.withColumn("_side", side), "_side", n, quotas).drop("_side")


def chronological(df: DataFrame, ts: str) -> DataFrame:
    """Rows by time, those without one last. Rows of one time go by a hash, so many of them share the tasks."""
    plain = [q(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.orderBy(q(ts).asc_nulls_last(), F.xxhash64(*plain))


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """Last ``n`` rows by ``order``, ascending. ``n`` is a report size."""
    return df.orderBy(q(order).desc()).limit(n).orderBy(q(order).asc())


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sample_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Balanced weights n / (classes * class rows), for any number of classes: the counts are joined to the rows."""
    # written: the planner knows the size, and rows are shuffled by class only where there are very many
    sizes = materialize(df.where(q(label).isNotNull()).groupBy(q(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n")))
    whole = sizes.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).alias("w")).scalar()
    weights = sizes.select("_class", (whole["n"] / (whole["k"] * F.col("_n"))).alias("_weight"))
    return df.join(weights, q(label) == F.col("_class"), "left").withColumn(output, F.col("_weight")).drop("_class", "_weight")

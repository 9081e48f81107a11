"""Exact percentiles (linear interpolation) by bucket counts and a distributed rank."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.buckets import value_buckets
from flowlens.operators.ordered import running_total
from flowlens.session import materialize, reusable


#: Buckets are this part of their values wide, at most.
ACCURACY = 256
SIGN_AND_EXPONENT = 12


def exact_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: str | None = None,
                      accuracy: int = ACCURACY, stored: bool = False) -> DataFrame:
    """Rows ``(by?, feature, prob, value)``; NULL and NaN are skipped, infinities are ordered as values.

    ``percentile`` keeps every distinct value of a group in one state. Here one
    pass counts the values by their leading bits (`value_buckets`), which tells
    the bucket of each wanted rank and how many values lie before it. If some
    of these hold more than one value, a second pass ranks the few values of
    those buckets, in ranges, for groups of any size and number; a bucket is
    about 1 / ``accuracy`` of its values wide, which changes the work and not
    the result. A feature without values gets a NULL. ``stored`` tells that
    ``df`` is a plain scan of a table, which is then read twice; otherwise the
    columns are written first.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    base = df.select((F.col(f"`{by}`") if by else F.lit("")).alias("_g"), *[
        F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"_v{i}") for i, c in enumerate(columns)])
    base = base if stored else reusable(base)
    counts = value_buckets(base, "_g", [f"_v{i}" for i in range(len(columns))],
                           SIGN_AND_EXPONENT + max(1, accuracy.bit_length() - 1))
    whole = Window.partitionBy("_g", "i")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"all": F.sum("n").over(whole), "below": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    # a wanted rank is slot 2j for the rank below a percentile, 2j + 1 for the one above
    place = lambda j: (F.col("all") - 1) * F.lit(probs[j])
    ranks = F.array(*[F.struct(F.lit(2 * j + side).alias("s"), end(place(j)).alias("rank"), place(j).alias("h"))
                      for j in range(len(probs)) for side, end in enumerate((F.floor, F.ceil))])
    inside = F.filter(ranks, lambda r: (F.col("below") <= r["rank"]) & (r["rank"] < F.col("below") + F.col("n")))
    # the upper rank mostly lies in the bucket of the lower one, whose values then serve both
    shared = F.exists("inside", lambda r: r["s"] == F.col("r.s") - 1) & (F.col("r.s") % 2 == 1)
    first = F.col("i") * (2 * len(probs)) + F.col("r.s")
    targets = placed.withColumn("inside", inside).where(F.size("inside") > 0).select("*", F.explode("inside").alias("r")).select(
        "_g", first.alias("s"), F.when(shared, first - 1).otherwise(first).alias("of"), "low", "high",
        (F.col("r.rank") - F.col("below")).alias("left"), F.col("r.h").alias("h"))
    if not by:
        return _of_all(base, targets, columns, probs)
    targets = materialize(targets)
    # buckets of one value need no second pass; the others are few: at most two for each column and percentile
    several = F.col("low") < F.col("high")
    slots = sorted(r[0] for r in targets.where(several).select("of").distinct().collect())
    known = targets.where(~several).select(F.col("_g").alias("_key"), "s", "h", F.col("low").alias("v"))
    if slots:
        known = known.unionByName(_inside(base, targets.where(several), slots, 2 * len(probs)))
    side = lambda n: F.max(F.when(F.col("s") % 2 == n, F.col("v")))
    known = known.groupBy("_key", F.floor(F.col("s") / 2).cast("int").alias("slot")).agg(side(0).alias("a"), side(1).alias("b"), F.max("h").alias("h"))
    # As `percentile` interpolates, to the last bit.
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        (F.ceil("h") - F.col("h")) * F.col("a") + (F.col("h") - F.floor("h")) * F.col("b"))
    every = base.select("_g").distinct()
    names = F.array(*[F.struct(F.lit(i * len(probs) + j).alias("slot"), F.lit(c).alias("feature"), F.lit(p).alias("prob"))
                      for i, c in enumerate(columns) for j, p in enumerate(probs)])
    wanted = every.select("_g", F.explode(names).alias("x")).select("_g", "x.*")
    found = known.select("_key", F.col("slot").alias("_slot"), value.alias("value"))
    out = wanted.join(found, F.col("_g").eqNullSafe(F.col("_key")) & (F.col("slot") == F.col("_slot")), "left")
    return out.select(F.col("_g").alias(by), "feature", "prob", "value")


def _of_all(base: DataFrame, targets: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Without groups the wanted ranks are two rows for each column and percentile, which the driver holds."""
    spark, each = base.sparkSession, 2 * len(probs)
    rows = targets.collect()
    held = {r["s"]: r["low"] for r in rows if r["low"] == r["high"]}
    several = [tuple(r) for r in rows if r["low"] < r["high"]]
    if several:
        small = F.broadcast(spark.createDataFrame(several, targets.schema))
        held |= {r["s"]: r["v"] for r in _inside(base, small, sorted({r["of"] for r in rows if r["low"] < r["high"]}), each, True).collect()}
    place = {r["s"]: r["h"] for r in rows}

    def value(i: int, j: int) -> float | None:
        s = i * each + 2 * j
        if s not in held:
            return None
        a, b, h = held[s], held[s + 1], place[s]
        # As `percentile` interpolates, to the last bit.
        return a if a == b else (math.ceil(h) - h) * a + (h - math.floor(h)) * b

    return spark.createDataFrame([(c, p, value(i, j)) for i, c in enumerate(columns) for j, p in enumerate(probs)],
                                 "feature string, prob double, value double")


def _inside(base: DataFrame, targets: DataFrame, slots: list[int], each: int, small: bool = False) -> DataFrame:
    """(_key, s, h, v): the values at the wanted ranks of buckets that hold several."""
    at = {s: k for k, s in enumerate(slots)}
    ends = lambda c: F.array(*[F.max(F.when(F.col("s") == s, F.col(c))) for s in slots]).alias(c)
    ranges = targets.where("s = of").groupBy(F.col("_g").alias("_key")).agg(ends("low"), ends("high"))
    # One row without groups; otherwise the planner knows the size of the written table.
    ranged = base.join(F.broadcast(ranges) if small else ranges, F.col("_g").eqNullSafe(F.col("_key")))

    def found_in(s: int) -> Column:
        v, low, high = F.col(f"_v{s // each}"), F.col("low")[at[s]], F.col("high")[at[s]]
        return F.when((v >= low) & (v <= high), F.struct(F.lit(s).alias("s"), (v + F.lit(0.0)).alias("v")))

    values = materialize(ranged.select("_g", F.explode(F.array(*[found_in(s) for s in slots])).alias("x")).where("x is not null")
                         .groupBy("_g", "x.s", "x.v").agg(F.count(F.lit(1)).alias("c")))
    ranked = running_total(values, "v", ["c"], by=["_g", "s"])
    asked = targets.select(F.col("_g").alias("_key"), F.col("s").alias("_s"), "of", "left", "h")
    met = ranked.join(F.broadcast(asked) if small else asked, F.col("_g").eqNullSafe(F.col("_key")) & (F.col("s") == F.col("of")))
    return met.where((F.col("c_before") <= F.col("left")) & (F.col("left") < F.col("c_before") + F.col("c"))).select(
        "_key", F.col("_s").alias("s"), "h", "v")


def percentile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float], stored: bool = False) -> dict[str, list[float | None]]:
    """Percentiles of the whole table as literals: feature -> one value per probability."""
    rows = exact_percentiles(df, columns, probs, stored=stored).collect()
    found = {(r["feature"], r["prob"]): r["value"] for r in rows}
    return {c: [found.get((c, float(p))) for p in probs] for c in columns}

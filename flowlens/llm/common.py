"""Helpers that several corpus operators share."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialize, release

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text as long; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: str, key: Column) -> Column:
    """60 random-looking bits of a key, the same in every run and in plain SQL (``md5``)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def text_key(text: Column) -> Column:
    """Equal texts share it; NULL counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def apportion(df: DataFrame, votes: str, seats: str, order: list[str], within: list[str], name: str) -> DataFrame:
    """Sainte-Lague: ``seats`` of each ``within`` group go one by one to the row with the highest votes / (2 held + 1).

    Closed form of the same result. With n rows the final divisor d satisfies
    |sum(votes / d) - seats| <= n / 2, which bounds every row's seats from both
    sides; only the quotients between those bounds are ranked, about 2n in all.
    Equal quotients go by ``order``. A group without votes gets no seats.
    """
    group = Window.partitionBy(*within)
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    total, n = F.sum(v).over(group), F.count(F.lit(1)).over(group)
    share = lambda shift: F.when(total > 0, v / total * F.greatest(s + shift * n / 2, F.lit(0.0))).otherwise(0.0)
    # one more on either side than the bounds ask for, against rounding
    bounds = df.withColumn("__low", F.greatest(F.ceil(share(-1) - 0.5) - 1, F.lit(0)).cast("long")) \
        .withColumn("__high", (F.ceil(share(1) + 0.5) + 1).cast("long")) \
        .withColumn("__rest", F.col(seats) - F.sum("__low").over(group))
    keys = [*within, *order]
    ranked = bounds.select(*keys, "__rest", v.alias("__v"), F.explode(F.sequence("__low", "__high")).alias("__held")) \
        .where(F.col("__v") > 0) \
        .withColumn("__rank", F.row_number().over(
            Window.partitionBy(*within).orderBy((F.col("__v") / (2 * F.col("__held") + 1)).desc(), *order)))
    won = ranked.where(F.col("__rank") <= F.col("__rest")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__won"))
    same = functools.reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    return bounds.alias("l").join(won.alias("r"), same, "left").select(
        *(F.col(f"l.{c}") for c in df.columns), (F.col("__low") + F.coalesce("__won", F.lit(0))).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node that links reach.

    Alternating large-star and small-star steps; every step is one partial
    aggregate and one join, and its edges are a table in the shared folder, so
    neither the driver nor a task ever holds a component. Loops and repeated
    edges are allowed.
    """
    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return both.join(minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        pairs = e.join(minima(e), "u")
        return pairs.select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(pairs.select("u", F.col("m").alias("v")))

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                          .where("u <> v").distinct())
    before = None
    while (now := state(current)) != before:
        before = now
        newer = materialize(small(large(current).where("u <> v").distinct()).where("u <> v").distinct())
        release(current)
        current = newer
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct())

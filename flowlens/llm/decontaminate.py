"""Benchmark decontamination: item-sized windows, candidates by their rarest shingles, exact weighted similarity."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import text_key
from flowlens.session import materialize

BITS = 64


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: Column, run: int) -> Column:
    """Hashes of the runs of words, in order; empty if there are fewer words."""
    last = F.size(words) - run
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(run))))) \
        .otherwise(F.array().cast("array<bigint>"))


def _simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> ``print``, the fingerprint as a long, from distinct (keys, h, weight)."""
    sums = rows.groupBy(*keys).agg(*(
        F.expr(f"sum(if(shiftright(h, {bit}) & 1 = 1, weight, -weight))").alias(f"s{bit}") for bit in range(BITS)))
    return sums.select(*keys, F.expr(" | ".join(f"if(s{bit} > 0, shiftleft(1L, {bit}), 0L)" for bit in range(BITS))).alias("print"))


def _rarest(rows: DataFrame, keys: list[str], total: str, percent: int) -> DataFrame:
    """The rarest (heaviest) shingles of each set (keys, h, weight, total): a partner of ``percent`` similarity shares one of them.

    ``rest`` is the weight of the set's shingles from this one on. All sets
    order their shingles alike, so at the first one that two sets share, both
    ``rest`` bound the shared weight.
    """
    order = Window.partitionBy(*keys).orderBy("weight", "h").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rest", F.sum("weight").over(order)).where(F.col("rest") * 100 >= F.col(total) * percent) \
        .select(*keys, "h", total, "rest")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", shingle: int = 5, percent: int = 80, keys: bool = False) -> DataFrame:
    """Where documents hold benchmark items: ``doc_id``, ``item_id``, ``start``, ``n_words``, ``distance``, ``similarity``.

    One row for each input row and item with a qualifying window, its best one
    (highest similarity, then lowest start); rows without one do not appear.
    Words are runs of letters and digits, lower-cased; ``start`` counts words.

    1. Items become sets of ``shingle``-word shingles (all words as one for
       shorter items). A shingle's weight is round(1000 ln(1 + items / items
       that hold it)), and that of a shingle of one item where no item has it.
    2. Windows are as long as an item, in words. A window of the required
       similarity shares most shingles with its item, so windows are opened
       where a shared shingle puts the item's beginning. All words of all
       texts take part; only windows that cannot qualify are never built.
    3. A window whose shingles are too light without those of no item cannot
       qualify. Of the others and of the items, the rarest shingles are kept
       that a partner must touch (`_rarest`); a window and an item of its
       length that meet there, and have weight enough from there on, are a
       pair. No pair that qualifies is missed, whatever the weights.
    4. The weighted Jaccard similarity of the shingle sets decides.

    ``distance`` is the number of bits in which the 64-bit SimHashes of the
    weighted shingles of the window and the item differ. It selects nothing: at
    similarity 0.8 it spreads too far for a radius, most of all where few heavy
    shingles stand against many light ones.

    NULL and empty texts hold nothing, NULL and empty items are never found;
    NULL and repeated ids of either table are returned as they are, repeated
    rows as often as they stand. Texts are known by SHA-256, so copies are
    searched once; with ``keys`` the hash of the text (`text_key`) is a column.
    Other columns are not read. Nothing is broadcast by force.
    """
    items = materialize(benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text_col].alias("text"))
                        .withColumn("item", text_key(F.col("text"))).withColumn("w", _words(F.col("text"))).where("size(w) > 0")
                        .select("item_id", "item", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(shingle)).alias("run")))
    runs = sorted(r[0] for r in items.select("run").distinct().collect())  # at most `shingle` values
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("key", text_key(F.col("text")))
    distinct = items.dropDuplicates(["item"])
    held = functools.reduce(DataFrame.unionByName, [
        distinct.where(F.col("run") == run).select("item", "n", "run", F.posexplode(_shingles(F.col("w"), run)).alias("at", "h"))
        for run in runs]) if runs else distinct.select("item", "n", "run", F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("h")).limit(0)
    number = F.lit(distinct.count())
    weight = lambda df: F.round(1000 * F.log1p(number / df)).cast("long")
    common = held.groupBy("run", "h").agg(F.count_distinct("item").alias("df")).select("run", "h", weight(F.col("df")).alias("weight"))
    held = materialize(held.join(common, ["run", "h"]))
    places = held.select("run", "h", "n", "at").distinct()
    words = base.select("key", _words(F.col("text")).alias("w"))
    hits = [words.select("key", F.size("w").alias("long"), F.posexplode(_shingles(F.col("w"), run)).alias("pos", "h"))
            .join(places.where(F.col("run") == run), "h")
            .select("key", "run", "n", F.greatest(F.least(F.col("pos") - F.col("at"), F.col("long") - F.col("n")), F.lit(0)).alias("start"))
            for run in runs]
    if not hits:
        return base.select("doc_id", *(["key"] if keys else []), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"),
                           F.lit(0).alias("n_words"), F.lit(0).alias("distance"), F.lit(0.0).alias("similarity")).limit(0)
    windows = materialize(functools.reduce(DataFrame.unionByName, hits).distinct())
    opened = windows.groupBy("key", "run").agg(F.collect_set(F.struct("n", "start")).alias("windows"))
    near = base.join(opened, "key").dropDuplicates(["key", "run"]).select("key", "run", "windows", _words(F.col("text")).alias("w"))
    content = functools.reduce(DataFrame.unionByName, [
        near.where(F.col("run") == run).select("key", "run", "windows", _shingles(F.col("w"), run).alias("all"))
        .select("key", "run", "all", F.explode("windows").alias("x"))
        .select("key", "run", "x.n", "x.start", F.explode(F.array_distinct(F.slice(
            "all", F.col("x.start") + 1, F.greatest(F.col("x.n") - run + 1, F.lit(1))))).alias("h")) for run in runs])
    content = materialize(content.join(common, ["run", "h"], "left").withColumn("known", F.col("weight").isNotNull())
                          .withColumn("weight", F.coalesce("weight", weight(F.lit(1)))))
    place = ["key", "run", "n", "start"]
    likely = content.groupBy(*place).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("known"), F.col("weight"))).alias("most")) \
        .where(F.col("most") * 100 >= F.col("total") * percent).drop("most")
    alive = materialize(content.where("known").join(likely, place).select(*place, "h", "weight", "total"))
    once = held.select("item", "n", "run", "h", "weight").distinct()
    totals = once.groupBy("item").agg(F.sum("weight").alias("item_total"))
    left = _rarest(alive, place, "total", percent)
    right = _rarest(once.join(totals, "item"), ["item", "n", "run"], "item_total", percent).withColumnRenamed("rest", "item_rest")
    pairs = left.join(right, ["n", "run", "h"]).where(
        F.least("rest", "item_rest") * (100 + percent) >= (F.col("total") + F.col("item_total")) * percent) \
        .select(*place, "item", "total", "item_total").distinct()
    shared = pairs.join(alive.drop("total"), place).join(once.select("item", "run", "h"), ["item", "run", "h"]) \
        .groupBy(*place, "item", "total", "item_total").agg(F.sum("weight").alias("both"))
    similarity = F.col("both") / (F.col("total") + F.col("item_total") - F.col("both"))
    best = materialize(shared.withColumn("similarity", F.round(similarity, 9)).where(
        F.col("both") * 100 >= (F.col("total") + F.col("item_total") - F.col("both")) * percent)
        .groupBy("key", "item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n", "run")).alias("m"))
        .select("key", "item", "m.run", "m.n", "m.start", (-F.col("m.s")).alias("similarity")))
    prints = _simhash(content.join(best.select(*place).distinct(), place), place)
    item_prints = _simhash(once.join(best.select("item").distinct(), "item"), ["item"]).withColumnRenamed("print", "item_print")
    best = best.join(prints, place).join(item_prints, "item") \
        .select("key", "item", "start", F.col("n").alias("n_words"),
                F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("distance"), "similarity")
    return base.select("doc_id", "key").join(best, "key").join(items.select("item_id", "item"), "item") \
        .select("doc_id", *(["key"] if keys else []), "item_id", "start", "n_words", "distance", "similarity")

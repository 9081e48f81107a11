"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import apportion, seeded, word_count
from flowlens.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_times: float) -> DataFrame:
    """Words that each source gives: (source, size) -> idx, weight, target.

    ``share`` of all words goes to the sources by weight; what exceeds
    ``max_times`` a source's size is shared again among the others. That is
    level filling: with the sources ordered by limit / weight, the first whose
    level reaches no further than its limit sets the level of all after it.
    One row per source runs through these windows.
    """
    rows = sizes.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) \
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))) \
        .withColumn("__limit", F.col("size") * F.lit(float(max_times)))
    line = Window.orderBy(F.col("__limit") / F.col("weight"), "idx")
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("size").over(all_rows) * F.lit(float(share))
             - F.coalesce(F.sum("__limit").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) \
        / F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__level", F.when(level <= F.col("__limit") / F.col("weight"), level)) \
        .withColumn("__level", F.first("__level", ignorenulls=True).over(
            line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("target", F.coalesce(F.least("__limit", F.col("weight") * F.col("__level")), "__limit")) \
        .drop("__limit", "__level")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_times: float = 2.0, block_words: int = 32,
        shard_unit: int = 4096, seed: str = "mix", carry: bool = False) -> DataFrame:
    """How many words of each document the mix takes.

    One row per input row: ``doc_id``, ``size`` (words), ``source_size``,
    ``target`` (both of its source), ``taken`` (words taken, repeats counted).
    With ``carry`` a struct ``__row`` of all input columns comes along.

    1. Every source gets a target (see `targets`).
    2. The mix is cut into blocks of ``block_words``; sources get blocks by
       Sainte-Lague on their targets, then the shards of a source by
       Sainte-Lague on their words: integer quotas per shard.
    3. Within a shard the documents stand in a seeded order on one line of
       words, which is cut into equal blocks. A quota takes the line whole as
       often as it fits and then its first blocks, so a document at the end of
       a quota is taken in part.

    A source of w words has ceil(sqrt(w / shard_unit)) shards: both the number
    of shards of a source and the words of a shard grow with the square root,
    so no window sees a whole source.

    NULL or empty texts have size 0 and are never taken. NULL is a source of
    its own, ordered last; so is the empty string. A NULL id is ordered as an
    empty one; rows that repeat an id are separate rows. Ties in the seeded
    order go by id, then size. An empty table gives an empty result. Columns
    other than the three named are ignored, whatever their names.
    """
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("__row")] if carry else []
    sizes = materialize(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
                                    word_count(docs[text_col]).alias("size"), *row)
                        .withColumn("__h", seeded(seed, F.col("doc_id"))))
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("size")), weights, share, max_times)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("__seats", F.round(F.sum("target").over(everything) / block_words).cast("long")) \
        .withColumn("__all", F.lit(0))
    sources = materialize(apportion(sources, "target", "__seats", ["idx"], ["__all"], "quota")
                          .withColumn("__shards", F.greatest(F.ceil(F.sqrt(F.col("size") / shard_unit)), F.lit(1)).cast("long"))
                          .withColumnRenamed("size", "source_size"))
    placed = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select(
        sizes["doc_id"], sizes["size"], sizes["__h"], *(["__row"] if carry else []),
        "idx", "source_size", "target", "quota", F.pmod("__h", "__shards").alias("shard"))
    shards = placed.groupBy("idx", "shard").agg(F.sum("size").alias("__words"), F.max("quota").alias("quota"))
    shards = apportion(shards, "__words", "quota", ["shard"], ["idx"], "__quota") \
        .withColumn("__blocks", F.ceil(F.col("__words") / block_words)) \
        .withColumn("__quota", F.least("__quota", F.floor(F.col("__blocks") * F.lit(float(max_times))))) \
        .withColumn("__passes", F.when(F.col("__blocks") > 0, F.floor(F.col("__quota") / F.col("__blocks"))).otherwise(0)) \
        .withColumn("__head", (F.col("__quota") - F.col("__passes") * F.col("__blocks")) * block_words) \
        .select("idx", "shard", "__passes", "__head")
    line = Window.partitionBy("idx", "shard").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("size").over(line) - F.col("size")
    taken = F.col("size") * F.col("__passes") \
        + F.greatest(F.least(F.col("size"), F.col("__head") - F.col("__start")), F.lit(0))
    return placed.join(shards, ["idx", "shard"]).withColumn("__start", start) \
        .select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["__row"] if carry else []))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix as rows: each as often as the mix takes it, to the nearest whole number."""
    taken = mix(docs, carry=True, **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return taken.select("__row", F.explode(F.array_repeat(F.lit(1), times))).select("__row.*")

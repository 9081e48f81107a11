"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _windows(text: Column, length: int) -> tuple[Column, Column]:
    """(position, trimmed line) of the lines that are not blank; digests of every run of ``length`` of them."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("i"), F.trim(line).alias("t"))),
                     lambda x: x["t"] != "")
    def digest(c, k):
        return F.unhex(F.md5(F.concat_ws("\n", *(F.get(c, k + j)["t"] for j in range(length)))))
    starts = lambda c: F.when(F.size(c) >= length, F.sequence(F.lit(0), F.size(c) - length)).otherwise(F.array().cast("array<int>"))
    return lines, lambda c: F.transform(starts(c), lambda k: F.struct(k.alias("k"), digest(c, k).alias("h")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 3) -> DataFrame:
    """Remove passages of ``length`` or more lines that stand earlier in the corpus.

    One row per input row: ``doc_id``, ``text`` (what is left), ``n_lines``,
    ``n_removed``. Lines are separated by line feeds and compared without
    spaces at their ends; blank ones are skipped when windows are formed and
    never removed. Windows overlap: every run of ``length`` lines is one.

    The order of the corpus is (id, text hash, position), NULL ids last. All
    but the first occurrence of a repeated window are marked, and the marks of
    overlapping windows merge. Lines of a first occurrence stay even where a
    marked window overlaps them, so a whole copy of every repeated window is
    left. Rows equal in id and text are one document and end alike.

    NULL texts stay NULL with 0 lines; texts of fewer than ``length`` lines
    are never changed. Only the digest, the id and a position are shuffled per
    window; a digest that stands in a third of all documents is reduced before
    the shuffle, and its occurrences meet one row in a join that adaptive
    execution may split.
    """
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("part"))
    lines, windows = _windows(F.col("text"), length)
    shaped = base.select("doc_id", "part", lines.alias("lines"))
    seen = shaped.select("doc_id", "part", F.explode(windows(F.col("lines"))).alias("w")).select("doc_id", "part", "w.*")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "part", "k")
    first = seen.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    marks = seen.join(first, "h").withColumn("is_first", place == F.col("first")) \
        .groupBy(F.col("doc_id").alias("id"), F.col("part").alias("p")).agg(
            F.collect_set(F.when(~F.col("is_first"), F.col("k"))).alias("later"),
            F.collect_set(F.when(F.col("is_first"), F.col("k"))).alias("kept"))
    joined = base.join(marks, base["doc_id"].eqNullSafe(marks["id"]) & (base["part"] == marks["p"]), "left")
    covered = lambda ks: F.flatten(F.transform(ks, lambda k: F.array(*(
        F.get(F.col("at"), k + j)["i"] for j in range(length)))))
    removed = F.when(F.size("later") > 0, F.array_sort(F.array_except(covered(F.col("later")), covered(F.col("kept"))))) \
        .otherwise(F.array().cast("array<int>"))
    marked = joined.withColumn("all", F.split("text", "\n", -1)) \
        .withColumn("at", F.when(F.size("later") > 0, lines)).withColumn("gone", removed)
    # what stands between two removed lines, as slices: linear in the lines
    def piece(j):
        before = F.coalesce(F.get(F.col("gone"), j - 1), F.lit(-1))
        after = F.coalesce(F.get(F.col("gone"), j), F.size("all"))
        return F.slice(F.col("all"), before + 2, after - before - 1)
    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), piece)), "\n")
    return marked.select("doc_id", F.when(F.size("gone") > 0, left).otherwise(F.col("text")).alias("text"),
                         F.when(F.col("text").isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_lines"),
                         F.size("gone").cast("long").alias("n_removed"))

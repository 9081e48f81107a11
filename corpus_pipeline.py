"""A corpus from raw documents: toxicity, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept
and returns a DataFrame; all but the last return the columns of documents.
Filters drop whole documents. Rows with a NULL doc_id are never duplicates;
NULL and empty texts pass the filters, and the mix, which counts words, takes
none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, mixing, near, sharding, toxicity
from flowlens.llm.common import text_key
from flowlens.session import materialize, prepare, remove_path, tables_written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the folder's labels, does not call toxic."""
    model = toxicity.learn(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)(docs["text"]) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Different texts of a repeated doc_id are documents of their own.

    Decisions travel as (doc_id, text hash); the marks of documents that go or
    stand several times are a written table, so the planner joins them to the
    texts by broadcast while they are few and by one shuffle beyond.
    """
    prepare(spark)
    found = near.near_duplicates(docs, parts=True).where("doc_id is not null")
    marks = materialize(found.groupBy(F.col("doc_id").alias("marked"), F.col("part").alias("text_marked")).agg(
        F.max("kept").alias("stays"), F.count(F.lit(1)).alias("times")).where("not stays or times > 1"))
    same = (docs["doc_id"] == marks["marked"]) & (near.part(docs["text"]) == marks["text_marked"])
    once = docs.join(marks, same, "left_anti")
    least = docs.join(marks.where("stays"), same, "left_semi").groupBy("doc_id", "text") \
        .agg(F.min(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")))).alias("row")) \
        .select(*(F.col(c) if c in ("doc_id", "text") else F.col("row")[c].alias(c) for c in docs.columns))
    return once.unionByName(least)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, by their texts, whatever their ids."""
    found = decontaminate.find_benchmark(docs, _table(spark, sf_dir, "benchmark"), keys=True)
    held = materialize(found.select(F.col("key").alias("held")).distinct())
    return docs.join(held, text_key(docs["text"]) == held["held"], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so a document that is taken twice is two rows."""
    prepare(spark)
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard."""
    prepare(spark)
    return sharding.place(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark_free), ("mixing", mixed), ("sharding", sharded)]

#: No SQL has the lexicon of the first stage; a test holds the rows of every stage of run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again for the next.

    A stage's working tables are deleted when its result is written; the results stay.
    """
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with tables_written() as written:
            result = stage(spark, docs, sf_dir)
        docs = materialize(result)
        for path in written:
            remove_path(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)

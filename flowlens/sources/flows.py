"""Flow record files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.clean import trim_headers


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name, absent ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_source_file(df: DataFrame, column: str = "source_file") -> DataFrame:
    return df.select("*", F.col("_metadata.file_name").alias(column))


def read_flows(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None
               ) -> tuple[DataFrame | None, list[str]]:
    """Rows of the files that exist, tagged with their file name, and the missing paths.

    With a schema all files are one scan, and headers are checked against it.
    Without one, files that share a header (`by_header`) are one scan of text
    columns; groups with other columns are aligned by name.
    """
    existing = [p for p in paths if path_exists(spark, p)]
    missing = [p for p in paths if p not in existing]
    if not existing:
        return None, missing
    reader = spark.read.option("header", True)
    if schema is not None:
        df = with_source_file(reader.option("enforceSchema", False).schema(schema).csv(existing))
        return trim_headers(df), missing
    frames = [trim_headers(with_source_file(reader.csv(list(group)))) for group in by_header(spark, existing)]
    return union_all(frames), missing


def by_header(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """Files in groups of one first line, by one job over all of them; empty files are left out.

    Groups come in the order of their first path. What reaches the driver is
    the list of paths that the reader needs.
    """
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                                F.monotonically_increasing_id().alias("at"))
    first = lines.where("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [r["paths"] for r in sorted(groups.collect(), key=lambda r: r["paths"][0])]


def manifest(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected file names and whether they are present, ignoring case."""
    present = listing.select(F.lower("name").alias("_key")).distinct().withColumn("_found", F.lit(True))
    return expected.withColumn("_key", F.lower("name")).join(present, "_key", "left").select(
        "name", F.coalesce("_found", F.lit(False)).alias("present"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def file_counts(df: DataFrame, column: str = "source_file") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def seed(spark: SparkSession, json_paths: Sequence[str], path: str) -> DataFrame:
    """Replace a collection with the documents of JSON files (arrays or objects)."""
    spark.read.option("multiLine", True).json(list(json_paths)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Token counts, and totals that signed batches keep up to date."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how this family of byte-level vocabularies splits texts into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEYS = ("source", "lang", "version")


@functools.lru_cache(maxsize=4)
def _encoding(path: str, pieces: str):
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})


def counter(path: str = VOCABULARY, pieces: str = PIECES):
    """Column function: text -> tokens (int64). NULL and empty texts have none.

    The vocabulary file must be installed at ``path`` on every executor, as
    the tokenizer libraries are; each worker reads it once.
    """
    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        encode = _encoding(path, pieces).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")
    return tokens


class Rollup:
    """Additive totals (documents, tokens) by source, language and tokenizer version, in one folder.

    Each commit writes a new numbered snapshot: totals and the names of all
    batches in it, in one write. Spark's success marker makes a snapshot
    valid, so a commit that dies leaves the one before in force, and a batch
    that is named in the snapshot is not applied again. One writer at a time.
    """

    SCHEMA = "batch string, source string, lang string, version string, docs long, tokens long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        path, files = self._path("")
        if not files.exists(path):
            return -1
        names = [f.getPath().getName() for f in files.listStatus(path)]
        done = [int(n.removeprefix("v=")) for n in names if n.startswith("v=") and files.exists(self._path(f"{n}/_SUCCESS")[0])]
        return max(done, default=-1)

    def _snapshot(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/v={version}")

    def totals(self) -> DataFrame:
        """Groups that hold documents: source, lang, version, docs, tokens. NULL keys are groups of their own."""
        return self._snapshot(self._version()).where("batch is null and (docs <> 0 or tokens <> 0)").drop("batch")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply signed changes (source, lang, version, tokens, sign) once; False if the batch was applied before.

        sign is 1 for an insert and -1 for a delete; a revised count is a
        delete of the old and an insert of the new. Rows with a NULL sign or
        token count change nothing. Changes are summed before the shuffle, so
        a source that holds a third of all rows is a few rows per task.
        """
        version = self._version()
        before = self._snapshot(version)
        if not before.where(F.col("batch") == batch).isEmpty():
            return False
        names = before.where("batch is not null").unionByName(
            self.spark.createDataFrame([(batch, None, None, None, 0, 0)], self.SCHEMA))
        delta = changes.where("sign is not null and tokens is not null").groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        totals = before.where("batch is null").drop("batch").unionByName(delta).groupBy(*KEYS).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).withColumn("batch", F.lit(None).cast("string"))
        totals.unionByName(names).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/v={version + 1}")
        old, files = self._path(f"v={version - 1}")
        if version > 0:
            files.delete(old, True)
        return True

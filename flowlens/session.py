"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch to a worker. A task holds a batch several times over: vectors and a stream outside the heap, then the worker's copies.
BATCH_BYTES = 2 << 20

_local_roots: dict[str, str] = {}
_archives: dict[str, tempfile.TemporaryDirectory] = {}
_watching: list[list[str]] = []


def build_session(app: str = "flowlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    Functions reach the workers by the name of their module, which only the
    driver's path may hold. The driver serves the archive; nothing else reads
    its folder, which goes when the driver ends.
    """
    package, app = Path(__file__).resolve().parent, spark.sparkContext.applicationId
    if app in _archives or not package.is_dir():
        return
    _archives[app] = tempfile.TemporaryDirectory(prefix="flowlens-")
    archive = f"{_archives[app].name}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and set the SQL options every operator relies on; keep what the user has chosen."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # batches of long texts and arrays are bounded by bytes, not only by rows
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.conf.get("spark.sql.shuffle.partitions") == "200":
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", str(max(2 * cores, 8)))
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        _local_roots[app] = tempfile.mkdtemp(prefix="flowlens-")
    return _local_roots[app]


def materialize(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate that later steps read several times, and cut its lineage.

    A Parquet table in the shared folder survives lost executors and still
    allows column pruning. ``by`` are columns of few values, last in the table,
    with a folder each: filters on them skip the others.
    """
    path = f"{work_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    for written in _watching:
        written.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """The paths that `materialize` writes meanwhile, for `remove_path` when nothing reads them any more."""
    written: list[str] = []
    _watching.append(written)
    try:
        yield written
    finally:
        _watching.remove(written)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialize` returned, when nothing will read them or anything derived from them again."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path:
            remove_path(table.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """Even partitions: at least one for each core of a small input, of the advised size in a large one."""
    return df.hint("rebalance")


def reusable(df: DataFrame) -> DataFrame:
    """For several passes over the same rows: written once, in even partitions."""
    return materialize(spread(df))

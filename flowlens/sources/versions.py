"""Tables by day whose changes become visible in one step.

``<path>/_versions/<number>.json`` names the folders of every day, the schema
and the last batch of each writer; ``<path>/_data/write=<id>/day=<day>`` holds
the files. A change writes new folders and then creates the next version,
which fails if another writer was first. So a reader sees all of a change or
nothing of it, a writer that dies leaves the table as it was, and a batch that
is repeated is known from the same file that made its rows visible.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.clean import q
from flowlens.session import remove_path

#: Versions that readers may still use; older ones and their files are removed by `vacuum`.
KEPT_VERSIONS = 2
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Other writers were first, more often than the writer was ready to try."""


@dataclass
class Version:
    """Number, schema, folders (relative) by day, and the last batch of each writer."""

    number: int = 0
    schema: dict | None = None
    days: dict[str, list[str]] = field(default_factory=dict)
    ledger: dict[str, int] = field(default_factory=dict)

    def has(self, writer: tuple[str, int] | None) -> bool:
        return writer is not None and self.ledger.get(writer[0], -1) >= writer[1]


class VersionedTable:
    """A table by day under one path. Its manifests hold a line per day and writer, never per row or file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- versions ---------------------------------------------------------------

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/_versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> Version:
        target, fs = self._fs(f"{self.path}/_versions/{number:012d}.json")
        stream = fs.open(target)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def current(self) -> Version:
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else Version()

    def _switch(self, version: Version) -> bool:
        """Make a version the current one; False if its number is taken."""
        jvm = self.spark._jvm
        folder = f"{self.path}/_versions"
        draft, fs = self._fs(f"{folder}/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(version.__dict__).encode()))
        finally:
            out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{folder}/{version.number:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)  # refuses to replace
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True

    # -- reading ----------------------------------------------------------------

    def _frame(self, version: Version, days: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(version.schema)
        folders = [f for d, held in sorted(version.days.items()) if days is None or d in days for f in held]
        if not folders:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("day", T.DateType())]))
        data = f"{self.path}/_data"
        whole = T.StructType([*schema.fields, T.StructField("write", T.StringType()), T.StructField("day", T.DateType())])
        rows = self.spark.read.schema(whole).option("basePath", data).parquet(*[f"{data}/{f}" for f in folders])
        return rows.select(*[q(f.name) for f in schema.fields], "day")

    def read(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """The current rows and their ``day``, of the days from ``start`` to ``end``: others are not even listed."""
        version = self.current()
        if version.schema is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._frame(version, [d for d in version.days if _within(d, start, end)])

    def days(self) -> list[date | None]:
        return sorted((None if d == NO_DAY else date.fromisoformat(d) for d in self.current().days), key=lambda d: d or date.min)

    # -- changes ------------------------------------------------------------------

    def _write(self, df: DataFrame) -> dict[str, str]:
        """New folders of a frame with a ``day``, by day."""
        name = f"write={uuid.uuid4().hex}"
        df.write.partitionBy("day").parquet(f"{self.path}/_data/{name}")
        folder, fs = self._fs(f"{self.path}/_data/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        return {d.removeprefix("day="): f"{name}/{d}" for d in found if d.startswith("day=")}

    @staticmethod
    def _dated(df: DataFrame, day_of: str) -> DataFrame:
        taken = {"day", "write"} & {c.lower() for c in df.columns}
        if taken:
            raise ValueError(f"the table has its own columns {sorted(taken)}")
        return df.withColumn("day", F.to_date(q(day_of)))

    def _change(self, change: Callable[[Version], dict[str, list[str]] | None], schema: T.StructType | None,
                writer: tuple[str, int] | None, tries: int = 10) -> bool:
        """Apply ``change`` to the current version until no other writer is first. False: this batch is in the table already."""
        for _ in range(tries):
            now = self.current()
            if now.has(writer):
                return False
            held = T.StructType.fromJson(now.schema) if now.schema else schema
            if schema is not None and [(f.name, f.dataType) for f in held] != [(f.name, f.dataType) for f in schema]:
                raise ValueError(f"columns differ from the table's: {schema.simpleString()} and {held.simpleString()}")
            days = change(now)
            ledger = now.ledger if writer is None else {**now.ledger, writer[0]: writer[1]}
            if days is None and ledger == now.ledger:
                return False
            new = Version(now.number + 1, held.jsonValue() if held is not None else None, now.days if days is None else days, ledger)
            if self._switch(new):
                return True
        raise Conflict(f"{tries} tries to change {self.path}")

    def append(self, df: DataFrame, day_of: str, writer: tuple[str, int] | None = None) -> bool:
        """Add rows. ``writer`` (name, batch) makes a repeated batch do nothing; batches of a writer come in ascending order."""
        rows = self._dated(df, day_of)
        written: dict[str, str] = {}

        def change(now: Version) -> dict[str, list[str]]:
            if not written:
                written.update(self._write(rows))
            return now.days | {d: [*now.days.get(d, []), f] for d, f in written.items()}

        return self._change(change, df.schema, writer)

    def upsert(self, df: DataFrame, key: str, day_of: str, order: str | None = None, writer: tuple[str, int] | None = None) -> bool:
        """Insert or replace rows by key: what comes later replaces what is stored, also with lower counts.

        Within ``df`` the row with the largest ``order`` counts; without
        ``order`` it must hold a key once. Days are copied on write, and only
        those of ``df`` are read; a row's day must follow from its key.
        """
        from flowlens.sources.store import latest_rows
        fresh = self._dated(latest_rows(df, key, order) if order else df, day_of)

        def change(now: Version) -> dict[str, list[str]]:
            # the fresh rows are written once; a day without stored rows takes them as they are
            new = self._write(fresh)
            days = dict(now.days)
            old = [d for d in new if d in now.days]
            if old:
                data = f"{self.path}/_data"
                rows = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("write", T.StringType()), T.StructField("day", T.DateType())])) \
                    .option("basePath", data).parquet(*[f"{data}/{new[d]}" for d in old])
                kept = self._frame(now, old).join(rows.select(q(key)), key, "left_anti").select(*[q(c) for c in df.columns], "day")
                rest = self._write(kept)
                days |= {d: [f for f in (rest.get(d), new[d]) if f] for d in old}
            return days | {d: [f] for d, f in new.items() if d not in old}

        return self._change(change, df.schema, writer)

    def expire(self, ts: str, limit: Column) -> bool:
        """Remove the rows with ``ts`` before ``limit`` (one instant): older days go by name, only the day of the limit is rewritten."""
        border, at = self.spark.range(1).select(F.to_date(limit).cast("string"), limit.cast("timestamp")).first()

        def change(now: Version) -> dict[str, list[str]] | None:
            days = {d: f for d, f in now.days.items() if d == NO_DAY or d >= border}
            if border in days:
                left = self._write(self._frame(now, [border]).where(q(ts) >= F.lit(at)).withColumn("day", F.lit(border).cast("date")))
                days = {d: f for d, f in days.items() if d != border} | {d: [f] for d, f in left.items()}
            return days

        return self._change(change, None, None)

    def compact(self) -> bool:
        """One folder for every day that lies in several."""
        def change(now: Version) -> dict[str, list[str]] | None:
            several = [d for d, f in now.days.items() if len(f) > 1]
            if not several:
                return None
            return now.days | {d: [f] for d, f in self._write(self._frame(now, several).repartition("day")).items()}

        return self._change(change, None, None)

    def vacuum(self, kept: int = KEPT_VERSIONS) -> int:
        """Delete all but the newest versions and every folder that none of them names; the number of folders deleted.

        Not while a writer is at work: its folders are in no version yet.
        """
        numbers = self._numbers()
        versions = [self._load(n) for n in numbers[-kept:]]
        named = {f for v in versions for held in v.days.values() for f in held}
        data, fs = self._fs(f"{self.path}/_data")
        gone = 0
        for write in (fs.listStatus(data) if fs.exists(data) else []):
            inside = [s for s in fs.listStatus(write.getPath()) if s.isDirectory()]
            used = {s.getPath().getName() for s in inside if f"{write.getPath().getName()}/{s.getPath().getName()}" in named}
            for s in inside:
                if s.getPath().getName() not in used:
                    gone += bool(fs.delete(s.getPath(), True))
            if not used:
                fs.delete(write.getPath(), True)
        for number in numbers[:-kept]:
            remove_path(self.spark, f"{self.path}/_versions/{number:012d}.json")
        return gone


def _within(day: str, start: date | None, end: date | None) -> bool:
    if start is None and end is None:
        return True
    return day != NO_DAY and (start is None or day >= start.isoformat()) and (end is None or day <= end.isoformat())


def exists(spark: SparkSession, path: str) -> bool:
    return bool(VersionedTable(spark, path)._numbers())

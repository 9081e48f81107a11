"""Versioned tables: nothing half done is seen, nothing is written twice, old days leave the disk."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from flowlens.sources import store
from flowlens.sources.versions import Conflict, VersionedTable
from flowlens.streaming import jobs

SCHEMA = "k string, n int, at timestamp"


def rows(spark, *r):
    return spark.createDataFrame([(k, n, at) for k, n, at in r], "k string, n int, at string").withColumn("at", F.col("at").cast("timestamp"))


def held(table):
    return sorted((r["k"], r["n"]) for r in table.read().collect())


def parquet_files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_later_rows_count_even_with_lower_numbers(spark, folder):
    table = VersionedTable(spark, f"{folder}/t")
    table.upsert(rows(spark, ("a", 5, "2024-01-01"), ("b", 1, "2024-01-02"), ("c", 9, None)), "k", "at", "n", ("q", 0))
    table.upsert(rows(spark, ("a", 3, "2024-01-01"), ("a", 2, "2024-01-01"), ("d", 1, "2024-01-05")), "k", "at", "n", ("q", 1))
    assert held(table) == [("a", 3), ("b", 1), ("c", 9), ("d", 1)]
    assert table.days() == [None, date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 5)]
    assert [r["k"] for r in table.read(date(2024, 1, 2), date(2024, 1, 4)).collect()] == ["b"]
    assert not table.upsert(rows(spark, ("a", 7, "2024-01-01")), "k", "at", "n", ("q", 1))  # a replay
    assert table.upsert(rows(spark, ("a", 7, "2024-01-01")), "k", "at", "n", ("other", 0))
    assert held(table)[0] == ("a", 7)
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(1,)], "x int").withColumn("at", F.current_timestamp()), "at")
    with pytest.raises(ValueError):
        table.append(rows(spark).withColumn("day", F.lit(1)), "at")


def test_days_that_a_change_does_not_touch_stay_as_they_are(spark, folder):
    table = VersionedTable(spark, f"{folder}/t")
    table.append(rows(spark, ("a", 1, "2024-01-01"), ("b", 1, "2024-01-02")), "at")
    before = table.current().days
    table.upsert(rows(spark, ("b", 2, "2024-01-02")), "k", "at", "n")
    after = table.current().days
    assert after["2024-01-01"] == before["2024-01-01"] and after["2024-01-02"] != before["2024-01-02"]
    plan = table.read(date(2024, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-01" not in plan and held(table) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("step", ["_write", "_switch"])
def test_a_writer_that_dies_changes_nothing(spark, folder, monkeypatch, step):
    table = VersionedTable(spark, f"{folder}/t")
    table.append(rows(spark, ("a", 1, "2024-01-01"), ("b", 1, "2024-01-02")), "at", ("q", 0))
    plain = getattr(VersionedTable, step)

    def dies(self, *args):
        if step == "_write":
            plain(self, *args)  # after its files, before the version
        raise KeyboardInterrupt

    monkeypatch.setattr(VersionedTable, step, dies)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(rows(spark, ("a", 2, "2024-01-01"), ("c", 1, "2024-01-03")), "k", "at", "n", ("q", 1))
    monkeypatch.setattr(VersionedTable, step, plain)
    assert held(table) == [("a", 1), ("b", 1)] and not table.current().has(("q", 1))
    assert table.upsert(rows(spark, ("a", 2, "2024-01-01"), ("c", 1, "2024-01-03")), "k", "at", "n", ("q", 1))
    assert held(table) == [("a", 2), ("b", 1), ("c", 1)]
    assert table.vacuum(kept=1) > 0
    assert held(table) == [("a", 2), ("b", 1), ("c", 1)]
    named = {f for days in table.current().days.values() for f in days}
    assert {os.path.dirname(f).split("_data/")[1] for f in parquet_files(f"{folder}/t")} == named


def test_two_writers_at_once(spark, folder, monkeypatch):
    table, other = VersionedTable(spark, f"{folder}/t"), VersionedTable(spark, f"{folder}/t")
    table.append(rows(spark, ("a", 1, "2024-01-01")), "at")
    plain, met = VersionedTable._switch, []

    def second(self, version):
        if self is table and not met:
            met.append(1)
            other.upsert(rows(spark, ("a", 2, "2024-01-01"), ("b", 2, "2024-01-01")), "k", "at", "n")
        return plain(self, version)

    monkeypatch.setattr(VersionedTable, "_switch", second)
    table.upsert(rows(spark, ("b", 3, "2024-01-01")), "k", "at", "n")
    assert held(table) == [("a", 2), ("b", 3)] and table.current().number == 3
    monkeypatch.setattr(VersionedTable, "_switch", lambda self, version: False)
    with pytest.raises(Conflict):
        table.append(rows(spark, ("z", 1, "2024-01-01")), "at")


def test_retention_removes_files(spark, folder):
    table = VersionedTable(spark, f"{folder}/t")
    table.append(rows(spark, *[(f"k{d}{h}", d, f"2024-01-{d:02d} {h:02d}:00:00") for d in range(1, 11) for h in (6, 18)], ("none", 0, None)), "at")
    table.append(rows(spark, ("x", 1, "2024-01-04 07:00:00"), ("y", 1, "2024-01-04 20:00:00")), "at")
    files = len(parquet_files(f"{folder}/t"))
    gone = store.expire_table(spark, f"{folder}/t", "at", F.lit("2024-01-14 12:00:00").cast("timestamp"), 10)
    want = [("none", 0), *[(f"k{d}{h}", d) for d in range(4, 11) for h in (6, 18) if (d, h) != (4, 6)], ("y", 1)]
    assert held(table) == sorted(want)
    assert gone == 5 and len(parquet_files(f"{folder}/t")) < files
    assert not [f for f in parquet_files(f"{folder}/t") if "day=2024-01-01" in f or "day=2024-01-03" in f]
    kept = table.current().days["2024-01-07"]
    assert store.expire_table(spark, f"{folder}/t", "at", F.lit("2024-01-14 12:00:00").cast("timestamp"), 10) <= 1
    assert table.current().days["2024-01-07"] == kept  # days inside the limit are not rewritten
    assert table.compact() is False and held(table) == sorted(want)


def test_compaction(spark, folder):
    table = VersionedTable(spark, f"{folder}/t")
    for n in range(3):
        table.append(rows(spark, (f"a{n}", n, "2024-01-01"), (f"b{n}", n, f"2024-01-0{n + 2}")), "at", ("q", n))
    before = held(table)
    assert table.compact() and [len(f) for f in table.current().days.values()] == [1, 1, 1, 1] and held(table) == before
    assert table.current().ledger == {"q": 2}


@pytest.mark.parametrize("step", ["stage", "write", "switch", "metrics"])
def test_a_batch_replayed_after_any_step_is_there_once(spark, folder, monkeypatch, step):
    """The job dies once, after the named step of batch 0, and starts again from its checkpoint."""
    spark.createDataFrame([(0.9, 1.0), (0.4, 2.0), (0.8, 3.0)], "p double, bytes double").write.parquet(f"{folder}/in")
    died = []

    def dies_after(owner, name):
        plain = getattr(owner, name)

        def run(*args, **more):
            if step == "stage" and not died:  # staged, and nothing of the commit done
                died.append(1)
                raise RuntimeError("gone")
            out = plain(*args, **more)
            if not died:
                died.append(1)
                raise RuntimeError("gone")
            return out
        monkeypatch.setattr(owner, name, run)

    dies_after(*{"stage": (jobs, "write_incidents"), "write": (VersionedTable, "_write"), "switch": (VersionedTable, "_switch"),
                 "metrics": (jobs, "remove_path")}[step])

    def start():
        source = jobs.stream_session(spark, 2).readStream.schema("p double, bytes double").parquet(f"{folder}/in")
        query = source.writeStream.foreachBatch(jobs.incident_writer(f"{folder}/inc", f"{folder}/met", 0.5, ["bytes"], attempts=1)) \
            .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001
            return False
        return True

    assert not start() and died
    assert start()
    assert store.read_incidents(spark, f"{folder}/inc").count() == 2
    met = spark.read.parquet(f"{folder}/met").collect()
    assert [(r["batch_id"], r["rows"], r["threats"], r["write_successes"]) for r in met] == [(0, 3, 2, 2)]
    ledger = VersionedTable(spark, f"{folder}/inc").current().ledger
    assert len(ledger) == 1 and list(ledger) != ["incidents"]  # known by the query's own id

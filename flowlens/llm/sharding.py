"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import seeded

#: Prime; far more slots than shards, so that shares differ by little.
SLOTS = 16381
SHARDS = 64


def _draw(seed: str, shard: str, what: str, below: int) -> int:
    return int(hashlib.md5(f"{seed}:{shard}:{what}".encode()).hexdigest()[:15], 16) % below


def lookup_table(shards: list[str], slots: int = SLOTS, seed: str = "shards") -> list[int]:
    """Shard index of every slot.

    Each shard prefers the slots in an order of its own: offset, offset + skip,
    offset + 2 skip ... modulo the prime ``slots``, a permutation. The shards
    take turns; each claims the next slot of its order that is still free. A
    shard that leaves gives its slots up and moves few others.
    """
    if not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be prime")
    skips = [1 + _draw(seed, s, "skip", slots - 1) for s in shards]
    wanted = [_draw(seed, s, "offset", slots) for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for turn, skip in enumerate(skips[:free]):
            while table[wanted[turn]] >= 0:
                wanted[turn] = (wanted[turn] + skip) % slots
            table[wanted[turn]] = turn
            free -= 1
    return table


def place(docs: DataFrame, id_col: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS,
          seed: str = "shards") -> DataFrame:
    """All input columns but same-named ones, plus ``slot`` (int) and ``shard`` (string).

    The slot is a hash of the id modulo the table size; the table, ``slots``
    rows and so of a fixed size, is broadcast: one lookup per row, no shuffle,
    whatever the keys. Rows with equal ids share a shard. A NULL id counts as
    the empty string. Existing columns ``slot`` and ``shard`` are replaced. An
    empty table gives an empty result. No other column is read.
    """
    names = [f"shard-{i:03d}" for i in range(SHARDS)] if shards is None else shards
    spark = docs.sparkSession
    table = spark.createDataFrame([(slot, names[turn]) for slot, turn in enumerate(lookup_table(names, slots, seed))],
                                  "slot int, shard string")
    slot = F.pmod(seeded(seed, docs[id_col]), F.lit(slots)).cast("int")
    return docs.drop("shard").withColumn("slot", slot).join(F.broadcast(table), "slot") \
        .select(*(c for c in docs.columns if c not in ("slot", "shard")), "slot", "shard")

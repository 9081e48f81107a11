"""Exact counts of values by their leading bits: few however many rows there are, and the same in any order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Leading bits of a double that tell its bucket: sign, exponent and eight of the fraction.
BITS = 20
#: Counts that a task holds before it hands them on.
HELD = 1 << 20
_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)


def bucket_of(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets ascend with the values; -0 and 0 are one."""
    whole = (values + 0.0).view(np.int64)
    return (whole ^ ((whole >> 63) & _FLIP)) >> np.int64(64 - bits)


def _value(ordered: np.ndarray) -> np.ndarray:
    return (ordered ^ ((ordered >> 63) & _FLIP)).view(np.float64)


def bucket_ends(bucket: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest double of each bucket."""
    first = bucket << np.int64(64 - bits)
    low, high = _value(first), _value(first | np.int64((1 << (64 - bits)) - 1))
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def _merged(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, counts, low, high
    return keys[first], np.add.reduceat(counts[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _counted(kind: pa.DataType, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        held: list[tuple[np.ndarray, ...]] = []  # (group, feature, bucket) as one number, count, least and largest value
        size = limit = 0

        def merged() -> tuple[np.ndarray, ...]:
            return _merged(*(np.concatenate(x) for x in zip(*held)))

        def handed(keys, counts, low, high):
            bucket = (keys & np.int64((1 << bits) - 1)) - np.int64(1 << (bits - 1))
            place = keys >> np.int64(bits)
            names = pa.array(list(groups), kind)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(place // width)), pa.array((place % width).astype(np.int32)), pa.array(bucket), pa.array(low), pa.array(high), pa.array(counts)],
                names=["_g", "i", "bucket", "low", "high", "n"])

        width = 1
        for batch in batches:
            width = batch.num_columns - 1
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            known = np.array([groups.setdefault(v, len(groups)) for v in coded.dictionary.to_pylist()], np.int64)
            code = known[coded.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.int64)
            for i in range(width):
                column = batch.column(i + 1)
                v = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                there = ~np.isnan(v)
                v = v[there]
                key = ((code[there] * width + i) << np.int64(bits)) | (bucket_of(v, bits) + np.int64(1 << (bits - 1)))
                held.append(_merged(key, np.ones(len(v), np.int64), v, v))
                size += len(held[-1][0])
            if size > max(HELD, 2 * limit):
                held[:] = [merged()]
                size = limit = len(held[0][0])
                if limit > HELD:
                    yield from handed(*held.pop())
                    size = limit = 0
        if held:
            yield from handed(*merged())
    return run


def value_buckets(df: DataFrame, group: str, columns: Sequence[str], bits: int = BITS) -> DataFrame:
    """(_g, i, bucket, low, high, n): rows of each group whose ``i``-th column is in the bucket, its least and largest value there.

    NULL and NaN are left out, infinities are values. Columns must be doubles.
    Tasks count Arrow batches and merge their counts; Spark adds them up. A
    group and column have at most 2^``bits`` buckets, typically some thousands.
    """
    field = df.select(F.col(group).alias("_g")).schema["_g"]
    kind = pa.array([], _arrow(field.dataType)).type
    schema = T.StructType([T.StructField("_g", field.dataType)] + [T.StructField(n, t()) for n, t in (
        ("i", T.IntegerType), ("bucket", T.LongType), ("low", T.DoubleType), ("high", T.DoubleType), ("n", T.LongType))])
    counts = df.select(F.col(group).alias("_g"), *columns).mapInArrow(_counted(kind, bits), schema)
    return counts.groupBy("_g", "i", "bucket").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)

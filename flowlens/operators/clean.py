"""Cleaning: names, labels, numeric coercion, constant and identical columns, row filters."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.contract import IDENTIFIERS, FeatureContract
from flowlens.functions.labels import RARE_GROUPS
from flowlens.functions.values import finite, is_numeric_text, to_number
from flowlens.operators.ordered import running_total


def q(name: str) -> Column:
    """Column by its literal name; flow headers contain spaces, dots and slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_name(name: str) -> str:
    return re.sub(r"[ /\\\-.]", "_", name.strip())


def safe_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename to safe names; the second value maps safe -> original (trimmed)."""
    names = {safe_name(c): c.strip() for c in df.columns}
    if len(names) != len(df.columns):
        raise ValueError("column names collide after cleaning")
    return df.toDF(*names), names


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Text columns to double, and one report row per column with the NULLs gained."""
    present = [c for c in columns if c in df.columns]
    numbers = {c: to_number(q(c).cast("string")) for c in present}
    gained = df.agg(*[
        F.count_if(q(c).isNotNull() & numbers[c].isNull()).alias(c) for c in present])
    return df.withColumns(numbers), unpivot_row(gained, present, "null_increase")


def unpivot_row(df: DataFrame, columns: Sequence[str], value: str, name: str = "feature") -> DataFrame:
    """One-row wide summary to one row per column."""
    return df.unpivot([], [q(c) for c in columns], name, value)


def numeric_share(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Share of rows that parse as a number, per column. Infinities are numbers here."""
    candidates = [c for c in df.columns if c not in set(exclude)]
    shares = df.agg(*[F.avg(_parses(df, c).cast("int")).alias(c) for c in candidates])
    return unpivot_row(shares, candidates, "share")


def _parses(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.NumericType):
        return q(column).isNotNull() & ~F.isnan(q(column).cast("double"))
    text = q(column).cast("string")
    return F.coalesce(is_numeric_text(text) & ~F.lower(F.trim(text)).isin("nan"), F.lit(False))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = (), floor: float = 0.7) -> list[str]:
    """Columns with at least ``floor`` parseable values; bounded by the number of columns."""
    rows = numeric_share(df, exclude).filter(F.col("share") >= floor).collect()
    keep = {r["feature"] for r in rows}
    return [c for c in df.columns if c in keep]


def finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(q(c)) for c in columns})


def drop_identifiers(df: DataFrame, identifiers: Sequence[str] = IDENTIFIERS) -> DataFrame:
    return df.drop(*identifiers)


def assert_no_leak(df: DataFrame, identifiers: Sequence[str] = IDENTIFIERS) -> DataFrame:
    leaked = [c for c in identifiers if c in df.columns]
    if leaked:
        raise ValueError(f"identifier columns among the features: {leaked}")
    return df


def drop_classes(df: DataFrame, column: str, names: Sequence[str] = RARE_GROUPS) -> DataFrame:
    """Remove rows of the named groups; rows without a group stay."""
    return df.filter(~F.coalesce(q(column).isin(*names), F.lit(False)))


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with a single value, NULL counted as a value. One pass, no distinct sets."""
    columns = list(columns or df.columns)
    rows = constant_profile(df, columns).filter("is_constant").collect()
    keep = {r["feature"] for r in rows}
    return [c for c in columns if c in keep]


def constant_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    state = df.agg(*[
        F.when(F.count(q(c)) == 0, F.count(F.lit(1)) > 0)
        .otherwise((F.count(q(c)) == F.count(F.lit(1))) & F.min(q(c)).eqNullSafe(F.max(q(c)))).alias(c)
        for c in columns])
    return unpivot_row(state, columns, "is_constant")


def identical_columns(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, list[str]]:
    """First column -> later columns with the same values in every row.

    Order-free fingerprints find candidates in one pass, a second pass confirms.
    """
    columns = list(columns or df.columns)
    row = F.xxhash64(*[q(c) for c in columns])
    prints = df.agg(*[
        F.sum(F.pmod(F.xxhash64(row, F.coalesce(q(c).cast("string"), F.lit("\x00"))), F.lit(1 << 22)).cast("decimal(20,0)"))
        .alias(str(i)) for i, c in enumerate(columns)]).first()
    same_print: dict[tuple, list[str]] = {}
    for i, c in enumerate(columns):
        same_print.setdefault((prints[str(i)], df.schema[c].dataType), []).append(c)
    pairs = [p for group in same_print.values() for p in itertools.combinations(group, 2)]
    if not pairs:
        return {}
    differs = df.agg(*[
        F.count_if(~q(a).eqNullSafe(q(b))).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
    out: dict[str, list[str]] = {}
    taken: set[str] = set()
    for i, (a, b) in enumerate(pairs):
        if differs[str(i)] == 0 and a not in taken and b not in taken:
            out.setdefault(a, []).append(b)
            taken.add(b)
    return out


def drop_identical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*[c for later in identical_columns(df, columns).values() for c in later])


def drop_correlated(df: DataFrame, pairs: DataFrame, floor: float = 0.95) -> DataFrame:
    """Drop the later column of each pair correlated at ``floor`` or more."""
    later: list[str] = []
    for r in pairs.filter(F.col("corr") >= floor).orderBy("feature_a", "feature_b").collect():
        if r["feature_a"] not in later and r["feature_b"] not in later:
            later.append(r["feature_b"])
    return df.drop(*later)


def check_contract(df: DataFrame, contract: FeatureContract = FeatureContract()) -> dict[str, list[str]]:
    have = set(df.columns)
    return {
        "required_missing": [c for c in contract.required if c not in have],
        "optional_missing": [c for c in contract.optional if c not in have],
        "identifiers_present": [c for c in contract.identifiers if c in have],
    }


def feature_types(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != target]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != target]
    return numeric, text


def common_features(left: DataFrame, right: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """Columns of the left frame (or of ``wanted``) that both frames have."""
    return [c for c in (wanted or left.columns) if c in left.columns and c in right.columns]


def file_contains(df: DataFrame, text: str, column: str = "source_file") -> DataFrame:
    return df.filter(F.lower(q(column)).contains(text.lower()))


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None, drop_first: bool = True) -> DataFrame:
    """0/1 column per value in alphabetical order, without the first one."""
    if values is None:
        values = sorted(r[0] for r in df.select(q(column)).distinct().limit(1001).collect() if r[0] is not None)
        if len(values) > 1000:
            raise ValueError("too many values for one-hot columns")
    kept = list(values)[1 if drop_first else 0:]
    return df.withColumns({
        f"{column}_{safe_name(v)}": F.coalesce((q(column) == F.lit(v)).cast("int"), F.lit(0)) for v in kept})


def label_codes(train: DataFrame, column: str) -> DataFrame:
    """(value, code): alphabetical codes from 0 of the training set's values, for any number of them."""
    values = train.select(q(column).cast("string").alias("value")).where("value is not null").distinct()
    return running_total(values.withColumn("_one", F.lit(1)), "value", ["_one"]).select("value", F.col("_one_before").cast("int").alias("code"))


def with_codes(df: DataFrame, column: str, codes: DataFrame, output: str) -> DataFrame:
    """Add the code of a value from a table (value, code); unknown and missing values give NULL."""
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(named, q(column).cast("string") == F.col("_value"), "left").withColumn(output, F.col("_code")).drop("_value", "_code")


def unseen_labels(train: DataFrame, validation: DataFrame, column: str) -> DataFrame:
    """Values of a validation set that its training set does not have; only distinct values of either side meet."""
    known, asked = (df.select(q(column)).where(q(column).isNotNull()).distinct() for df in (train, validation))
    return asked.subtract(known)


def index_labels(train: DataFrame, column: str) -> dict[str, int]:
    """`label_codes` on the driver, for models that hold their classes."""
    return {r["value"]: r["code"] for r in label_codes(train, column).collect()}


def lookup(df: DataFrame, column: str, table: dict[str, object], output: str) -> DataFrame:
    """Lookup in a table that the driver holds, as a broadcast join; unknown keys give NULL."""
    if not table:
        return df.withColumn(output, F.lit(None))
    named = df.sparkSession.createDataFrame(list(table.items()), ["_key", "_value"])
    return df.join(F.broadcast(named), q(column) == F.col("_key"), "left").withColumn(output, F.col("_value")).drop("_key", "_value")


def clean_documents(df: DataFrame, defaults: dict[str, object], drop: Sequence[str] = ("_id",)) -> DataFrame:
    """Drop storage ids and fill missing fields."""
    present = {c: v for c, v in defaults.items() if c in df.columns}
    return df.drop(*drop).withColumns({c: F.coalesce(q(c), F.lit(v)) for c, v in present.items()})

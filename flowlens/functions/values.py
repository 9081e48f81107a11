"""Column functions on numbers and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in text: decimal notation, infinities and NaN.
_NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?|NaN|nan)$"


def is_numeric_text(text: Column) -> Column:
    return F.trim(text).rlike(_NUMBER)


def to_number(text: Column) -> Column:
    """Text to double; NaN, blanks and anything that is no number become NULL."""
    value = F.when(is_numeric_text(text), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    value = value.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def safe_ratio(x: Column, y: Column, eps: float = 1e-9) -> Column:
    return x / F.greatest(y, F.lit(eps))


def key_hash(*parts: Column, length: int = 16) -> Column:
    """First hex digits of SHA-1 over the parts joined by ``|``."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def hash_order(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of rows, the same in every SQL engine."""
    return F.md5(F.concat(key, F.lit(f"|{seed}")))


def masked_argmax(probs: Column, masked: int) -> tuple[Column, Column]:
    """Largest probability outside position ``masked`` (0-based) and its position."""
    others = F.transform(probs, lambda p, i: F.when(i == masked, F.lit(-1.0)).otherwise(p))
    best = F.array_max(others)
    return best, (F.array_position(others, best) - 1).cast("int")


def rounded(columns: Sequence[str], digits: int = 6) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in columns]

"""Column functions on flow identifiers and traffic shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor blank, unchanged."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in candidates])


def ips_from_flow_id(flow_id: Column) -> tuple[Column, Column]:
    """Source and destination from ``src-dst-...``; NULL when there is no dash."""
    parts = F.split(F.trim(flow_id), "-")
    many = F.size(parts) >= 2
    return F.when(many, F.get(parts, F.lit(0))), F.when(many, F.get(parts, F.lit(1)))


def synthetic_ip(seed: Column, prefix: str) -> Column:
    """Stable made-up address: the first two SHA-1 bytes under ``prefix``."""
    digest = F.sha1(seed)

    def octet(start: int) -> Column:
        byte = F.conv(F.substring(digest, start, 2), 16, 10).cast("int")
        return (byte % 254 + 1).cast("string")

    return F.concat_ws(".", F.lit(prefix), octet(1), octet(3))


def risk_flags(syn: Column, ack: Column, fwd: Column, bwd: Column, duration: Column,
               imbalance: float = 100.0, short: float = 1000.0) -> Column:
    """Rule-based risk fields of a flow as one struct."""
    return F.struct(
        F.coalesce((syn > 0) & (ack == 0), F.lit(False)).alias("syn_without_ack"),
        F.coalesce(bwd >= imbalance * F.greatest(fwd, F.lit(1.0)), F.lit(False)).alias("reply_heavy"),
        F.coalesce(duration < short, F.lit(False)).alias("near_zero_duration"),
    )

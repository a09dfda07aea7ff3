"""Time helpers shared by the joins and the rolling features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY = 86_400


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp, timestamp_ntz or date column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def bucket_of(pos: Column, width: int) -> Column:
    """Index of the fixed-width bucket (``width`` in the unit of ``pos``)."""
    return F.floor(pos / F.lit(width)).cast("long")


def floor_bucket(pos: Column, width: int) -> Column:
    """As ``bucket_of`` in integer arithmetic, exact for 64-bit microseconds."""
    return ((pos - F.pmod(pos, F.lit(width))) / F.lit(width)).cast("long")

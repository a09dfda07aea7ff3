"""Point-in-time (as-of) join: the latest feature row at or before each spine row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNKS, running
from .timekeys import MICROS, micros


def asof_join(
    spine: DataFrame,
    features: DataFrame,
    key: str,
    spine_ts: str,
    feature_ts: str,
    columns: list[str],
    inclusive: bool = True,
    ttl_seconds: int | None = None,
    tie_break: list[str] | None = None,
    prefix: str = "",
    n_chunks: int | None = CHUNKS,
) -> DataFrame:
    """Left as-of join of ``columns`` (and ``feature_ts``) to every spine row.

    Both sides are stacked and scanned once in time order with ``last(ignoreNulls)``, in
    chunks, so there is no range join and no task that holds a whole entity. ``inclusive``
    lets a feature stamped exactly at the spine time match; ``ttl_seconds`` drops matches
    older than that. ``tie_break`` names feature columns ordering rows at one instant.
    """
    payload = [feature_ts, *[c for c in columns if c != feature_ts]]
    side_spine, side_feature = (1, 0) if inclusive else (0, 1)
    ties = tie_break or []
    s = spine.select(
        F.col(key), micros(spine_ts).alias("__pos"), F.lit(side_spine).alias("__side"),
        *[F.lit(None).cast(features.schema[c].dataType).alias(f"__tie_{c}") for c in ties],
        F.struct(*[F.col(c) for c in spine.columns]).alias("__spine"),
        F.lit(None).cast(features.select(F.struct(*payload)).schema[0].dataType).alias("__feat"),
    )
    f = features.where(F.col(feature_ts).isNotNull()).select(
        F.col(key), micros(feature_ts).alias("__pos"), F.lit(side_feature).alias("__side"),
        *[F.col(c).alias(f"__tie_{c}") for c in ties],
        F.lit(None).cast(s.schema["__spine"].dataType).alias("__spine"),
        F.struct(*payload).alias("__feat"),
    )
    order = ["__pos", "__side", *[f"__tie_{c}" for c in ties]]
    scanned = running(s.unionByName(f), [key], order, {"__hit": ("last", F.col("__feat"))}, n_chunks=n_chunks)
    hits = scanned.where(F.col("__spine").isNotNull())
    valid = F.lit(True)
    if ttl_seconds is not None:
        valid = micros("__spine." + spine_ts) - micros("__hit." + feature_ts) <= F.lit(ttl_seconds * MICROS)
    return hits.select(
        *[F.col(f"__spine.{c}").alias(c) for c in spine.columns],
        *[F.when(valid, F.col(f"__hit.{c}")).alias(prefix + c) for c in payload],
    )

"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Above this many bytes a side is not broadcast by hint.
BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate; None where the session does not expose it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session has no plan of the JVM at hand
        return None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the estimate is under `limit`.

    Otherwise the frame comes back unhinted: the join is then a shuffle join, whose skewed partitions AQE splits.
    """
    size = estimated_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df
